"""Ranking of matches, confidence, fallbacks and outcomes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: reason -> (distance, confidence, score, level, review)
OUTCOMES = {
    "ocr_fast_path": (998.0, 98.0, 1000, "high", False),
    "ocr_fast_path_live": (998.0, 98.0, 1000, "high", False),
    "ocr_metadata_unique": (998.0, 97.0, 999, "high", False),
    "ocr_rules_text_live": (997.0, 75.0, 3, "medium", False),
    "ocr_name_primary_live": (999.0, 62.0, 2, "low", True),
    "metadata_name_only": (999.0, 60.0, 1, "low", True),
    "ocr_name_only": (999.0, 55.0, 1, "low", True),
    "ocr_name_only_live": (999.0, 55.0, 1, "low", True),
    "ocr_name_only_noisy": (999.0, 45.0, 0, "low", True),
}
RELAXED = "no_match_at_strict_threshold"


def with_outcome(rows: DataFrame, reason: Column) -> DataFrame:
    """rows with the fixed distance, confidence, score, level and review flag of their fallback reason."""
    pick = lambda k: F.coalesce(*(F.when(reason == r, F.lit(v[k])) for r, v in OUTCOMES.items()))
    return rows.withColumns({"fallback_reason": reason, "distance": pick(0), "confidence": pick(1), "metadata_match_score": pick(2), "confidence_level": pick(3), "manual_review_required": pick(4)})


def identity(product_id: Column, game: Column, name: Column, number: Column, set_code: Column) -> Column:
    """What tells items apart: the product's id, else game, name, number and set together."""
    parts = (F.coalesce(c.cast("string"), F.lit("")) for c in (game, name, number, set_code))
    return F.coalesce(F.concat(F.lit("id:"), product_id.cast("string")), F.concat(F.lit("row:"), F.to_json(F.array(*parts))))


def dedupe(matches: DataFrame, keys: list[str], distance: str, tie: str) -> DataFrame:
    """The nearest match for each key; ties go to the lower tie-break."""
    w = Window.partitionBy(*keys).orderBy(F.col(distance).asc_nulls_last(), F.col(tie).asc_nulls_last())
    return matches.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def ranked(matches: DataFrame, probe: str, score: str, distance: str, tie: str, n: int) -> DataFrame:
    """The first n matches of each probe by score, distance and tie-break."""
    w = Window.partitionBy(probe).orderBy(F.col(score).desc_nulls_last(), F.col(distance).asc_nulls_last(), F.col(tie).asc_nulls_last())
    return matches.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def blended(hash_confidence: Column, region_score: Column, weight: float = 0.15) -> Column:
    """Hash confidence with a share of the region score; no score counts as 0."""
    w = min(max(weight, 0.0), 1.0)
    return hash_confidence * F.lit(1 - w) + F.coalesce(region_score, F.lit(0.0)) * 100.0 * F.lit(w)


def level(confidence: Column) -> Column:
    return F.when(confidence >= 90, "high").when(confidence >= 75, "medium").otherwise("low")


def needs_review(confidence: Column) -> Column:
    return confidence < 70


def relaxed(matches: DataFrame, probe: str, distance: str, strict: float, wide: float) -> DataFrame:
    """Matches within ``strict``, or for probes without one those within ``wide``, tagged."""
    inside = F.col(distance) <= strict
    found = F.max(inside).over(Window.partitionBy(probe))
    out = matches.where(F.col(distance) <= wide).withColumn("_found", found).where(~F.col("_found") | inside)
    return out.withColumns({"fallback_reason": F.when(~F.col("_found"), RELAXED), "relaxed_threshold": F.when(~F.col("_found"), F.lit(wide)), "manual_review_required": ~F.col("_found")}).drop("_found")


def adaptive(matches: DataFrame, probe: str, distance: str, first: int = 5, last: int = 20, step: int = 2, target: int = 5) -> DataFrame:
    """(probe, threshold, matches): the first threshold with ``target`` matches or an exact one; else the last."""
    steps = list(range(first, last + 1, step))
    tries = F.explode(F.array(*(F.lit(t) for t in steps))).alias("threshold")
    counts = matches.groupBy(probe).agg(*(F.count_if(F.col(distance) <= t).alias(f"_{t}") for t in steps), F.min(distance).alias("_least"))
    at = counts.select(probe, "_least", F.map_from_arrays(F.array(*(F.lit(t) for t in steps)), F.array(*(F.col(f"_{t}") for t in steps))).alias("_m")).select(probe, "_least", "_m", tries)
    at = at.withColumn("matches", F.element_at("_m", F.col("threshold")))
    stop = at.where((F.col("matches") >= target) | ((F.col("_least") == 0) & (F.col("matches") > 0)) | (F.col("threshold") == steps[-1]))
    return stop.groupBy(probe).agg(F.min_by(F.struct("threshold", "matches"), "threshold").alias("s")).select(probe, "s.threshold", "s.matches")


def best_source(candidates: DataFrame, probe: str, source: str) -> DataFrame:
    """The best of several crops of a probe: no review, then a crop, then confidence, then distance; a null distance is far."""
    order = F.struct((~F.col("manual_review_required")).cast("int").alias("a"), F.col(source).isin("manual_crop", "contour_crop").cast("int").alias("b"), F.col("confidence").alias("c"), (-F.coalesce("distance", F.lit(9999.0))).alias("d"), F.col(source).alias("e"))
    return candidates.groupBy(probe).agg(F.max_by(F.struct(source, "confidence", "distance"), order).alias("m")).select(probe, f"m.{source}", "m.confidence", "m.distance")


def accepted_by_margin(candidates: DataFrame, group: str, score: str, tie: str, least: float = 0.50, margin: float = 0.05) -> DataFrame:
    """The best candidate of each group if it scores enough and leads the second, when that is positive, by the margin."""
    w = Window.partitionBy(group).orderBy(F.col(score).desc(), F.col(tie).asc())
    second = F.coalesce(F.lead(score).over(w), F.lit(0.0))
    return candidates.withColumns({"_n": F.row_number().over(w), "_second": second}).where((F.col("_n") == 1) & (F.col(score) >= least) & ((F.col("_second") <= 0) | (F.col(score) - F.col("_second") >= margin))).drop("_n", "_second")


def unique_top(candidates: DataFrame, group: str, item: str, score: str, least: Column) -> DataFrame:
    """The single best-scored item of each group, if its score is at least ``least``; several at the top give none."""
    best = candidates.groupBy(group, item).agg(F.max(score).alias(score))
    w = Window.partitionBy(group)
    top = best.withColumn("_top", F.max(score).over(w)).where(F.col(score) == F.col("_top"))
    return top.withColumn("_n", F.count("*").over(w)).where((F.col("_n") == 1) & (F.col(score) >= least)).drop("_top", "_n")


def metadata_score(name: Column, resolved: Column, raw: Column, number: Column, hint_number: Column, set_code: Column, hint_set: Column, cmc: Column, hint_cmc: Column) -> Column:
    """Points for each piece of metadata on which a candidate agrees with the hints."""
    same = lambda a, b: F.coalesce(F.lower(F.trim(a)) == F.lower(F.trim(b)), F.lit(False)) & (F.trim(b) != "")
    part = lambda test, x: F.when(test, x).otherwise(0)
    return part(same(name, resolved), 120) + part(same(name, raw), 80) + part(same(number, hint_number), 90) + part(same(set_code, hint_set), 85) + part(F.coalesce(cmc == hint_cmc, F.lit(False)), 70)


def priority_first(rows: DataFrame, first: Column, others: Column, key: str, order: list[Column | str], n: int) -> DataFrame:
    """A sample of n rows, each key once: those that pass the first test, then those that pass the other, in order."""
    kept = rows.where(F.coalesce(first, F.lit(False)) | F.coalesce(others, F.lit(False))).dropDuplicates([key])
    return kept.orderBy(F.when(first, 0).otherwise(1), *order).limit(n)
