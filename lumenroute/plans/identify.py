"""End-to-end identification of probes against a catalogue: hints, hashes, fallbacks, ranking.

One plan for all probes at once. The branches of the fallback chain are
computed as tables and the first that has rows for a probe counts. For images
(``mode`` "image"; "file" differs only in the reason of the first):

1. a unique metadata match of a recognised name (``ocr_metadata_unique``, ``ocr_fast_path``),
2. hash matches within the strict threshold, narrowed by the metadata filter,
3. an item of the resolved name, if set, number or cost was given or the name is close (``metadata_name_only``),
4. the name alone, if it looks like one (``ocr_name_only``),
5. hash matches within the relaxed threshold, to be reviewed,
6. the name alone, noisy as it is (``ocr_name_only_noisy``).

In "live" mode a unique metadata match (``ocr_fast_path_live``), the resolved name
in one game (``ocr_name_primary_live``) or in several (``ocr_name_only_live``) and
the rules text (``ocr_rules_text_live``) come before any hashes.

No step pairs all probes with all items but the comparison of hashes, which
needs it; hints meet the catalogue by keys.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.similarity import seq_ratio
from ..functions.values import picked_price, truthy
from ..operators import hashing, metafilter, ranking, resolve
from ..sources import plugins


@dataclass(frozen=True)
class Options:
    """Thresholds and limits; the sets, finishes and rarities that results may have; the way in.

    ``fetch`` names a plug-in that computes hashes of catalogue images; with it,
    the best 25 candidates of a name hint none of whose candidates has a hash get one.
    """

    threshold: float = 40.0
    relaxed: float = 140.0
    top_n: int = 10
    per_game: int = 50
    region_weight: float = 0.15
    sets: tuple[str, ...] = ()
    finishes: tuple[str, ...] = ()
    rarities: tuple[str, ...] = ()
    filters: dict[str, bool] = field(default_factory=dict)
    mode: str = "image"
    grayscale: bool = False
    fetch: str | None = None


HINTS = ("hint_name", "hint_color", "hint_cmc", "hint_set", "hint_number", "hint_type", "hint_subtype")
_FACTS = ("name", "number", "set_code", "set_name", "rarity", "subTypeName", "color", "market_price", "low_price")


def hash_matches(probes: DataFrame, items: DataFrame, most: float) -> DataFrame:
    """Pairs within a mean distance of ``most`` bits, with distances and confidence.

    probes: probe_id and words r, g, b as pr, pg, pb; items: product_id, game
    and words r, g, b. The red channel alone is looked at first: a pair whose
    red bits differ in more than three times ``most`` can't be within it.
    """
    flat = lambda df, names: df.select(*(c for c in df.columns if c not in names), *(x for n in names for x in hashing.longs(F.col(n), n)))
    d = {c: hashing.long_hamming(c, f"p{c}") for c in "rgb"}
    total = d["r"] + d["g"] + d["b"]
    pairs = hashing.threshold_join(flat(probes, ("pr", "pg", "pb")), flat(items, ("r", "g", "b")), total, 3 * most, first=d["r"])
    out = pairs.withColumns({f"dist_{c}": d[c] for c in "rgb"}).withColumn("distance", (F.col("dist_r") + F.col("dist_g") + F.col("dist_b")) / F.lit(3.0))
    return out.withColumn("phash_confidence", hashing.confidence(F.col("distance"))).drop(*(f"{p}{c}{k}" for p in ("", "p") for c in "rgb" for k in range(4)))


def candidates(probes: DataFrame, catalogue: DataFrame, options: Options) -> tuple[DataFrame, DataFrame]:
    """The probes with a hint to filter by, and (probe_id, product_id, metadata_match_score, filters) of what the filters leave."""
    hinted = probes.select("probe_id", *HINTS).where(metafilter.hinted(options.filters))
    rows = catalogue.select("product_id", "name", "color", "cmc", "set_code", "number", "type", "subTypeName")
    scored = metafilter.apply(metafilter.candidates(hinted, rows, options.filters), options.filters)
    alive = scored.where("alive").select("probe_id", "product_id", F.col("score").alias("metadata_match_score"), "filters").dropDuplicates(["probe_id", "product_id"])
    return hinted.select("probe_id"), alive


def hydrated(index: DataFrame, alive: DataFrame, named: DataFrame, catalogue: DataFrame, fetch: str, most: int = 25) -> DataFrame:
    """The index and the hashes, by a plug-in, of the best candidates of named probes that have none in it."""
    lacking = alive.join(named.select("probe_id"), "probe_id", "left_semi").where("metadata_match_score > 0")
    known = lacking.join(index.where("r_phash IS NOT NULL").select("product_id"), "product_id", "left_semi").select("probe_id").distinct()
    order = Window.partitionBy("probe_id").orderBy(F.desc("metadata_match_score"), "product_id")
    wanted = lacking.join(known, "probe_id", "left_anti").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= most).select("product_id").distinct()
    cards = catalogue.select("product_id", "game", "image_url").join(wanted, "product_id", "left_semi")
    return index.unionByName(plugins.fetched_hashes(cards, index.where("r_phash IS NOT NULL"), fetch), allowMissingColumns=True)


def _by_hash(probes: DataFrame, catalogue: DataFrame, index: DataFrame, o: Options) -> DataFrame:
    """Hash matches, strict or tagged as relaxed, narrowed by the hints, the best of each game, each item once."""
    wide = max(o.threshold, o.relaxed)
    channels = ["grayscale_phash"] * 3 if o.grayscale else [f"{c}_phash" for c in "rgb"]
    asked = probes.select("probe_id", *(hashing.hash_words(F.col(x if x in probes.columns else f"{c}_phash")).alias(f"p{c}") for x, c in zip(channels, "rgb", strict=True)))
    hinted, alive = candidates(probes, catalogue, o)
    if o.fetch is not None:
        index = hydrated(index, alive, probes.where(truthy(F.trim("hint_name")).isNotNull()), catalogue, o.fetch)
    facts = [F.col(c) if c in index.columns else F.lit(None).cast("string").alias(c) for c in ("name", "number", "set_code")]
    shown = index.select("product_id", F.coalesce("game", F.lit("")).alias("game"), ranking.identity(F.col("product_id"), F.coalesce("game", F.lit("")), *facts).alias("_key"), *(hashing.hash_words(F.col(x)).alias(c) for x, c in zip(channels, "rgb", strict=True)))
    near = hash_matches(asked, shown, wide)
    narrowed = near.join(hinted.withColumn("_hinted", F.lit(True)), "probe_id", "left").join(alive, ["probe_id", "product_id"], "left")
    narrowed = narrowed.where(F.col("_hinted").isNull() | F.col("metadata_match_score").isNotNull()).withColumn("metadata_match_score", F.coalesce("metadata_match_score", F.lit(0)))
    by_game = Window.partitionBy("probe_id", "game").orderBy("distance", "product_id")
    capped = narrowed.withColumn("_n", F.row_number().over(by_game)).where(F.col("_n") <= o.per_game).drop("_n", "_hinted")
    best = ranking.dedupe(capped, ["probe_id", "_key"], "distance", "game").drop("_key")
    return ranking.relaxed(best, "probe_id", "distance", o.threshold, wide)


#: the order in which branches count, by reason; hash matches have no reason
_ORDER = {
    "image": ("ocr_metadata_unique", None, "metadata_name_only", "ocr_name_only", ranking.RELAXED, "ocr_name_only_noisy"), "file": ("ocr_fast_path", None, "metadata_name_only", "ocr_name_only", ranking.RELAXED, "ocr_name_only_noisy"),
    "live": ("ocr_fast_path_live", "ocr_name_primary_live", "ocr_name_only_live", "ocr_rules_text_live", None, ranking.RELAXED),
}


def _by_name(probes: DataFrame, catalogue: DataFrame, o: Options) -> list[DataFrame]:
    """The outcomes of recognised names and texts: a unique item, and the best that the name alone is good for."""
    hints = probes.select("probe_id", *HINTS)
    named = hints.where(truthy(F.trim("hint_name")).isNotNull())
    resolved = resolve.resolve_names(named.select("probe_id", "hint_name"), catalogue, "probe_id", "hint_name")
    facts = resolved.join(hints, "probe_id").select("probe_id", "resolved", F.trim("hint_name").alias("raw_name"), "hint_number", "hint_set", F.col("hint_cmc").cast("int").alias("hint_cmc"))
    typed = catalogue.withColumn("cmc", F.col("cmc").cast("string").try_cast("double").try_cast("int"))
    unique = ranking.with_outcome(resolve.resolve_metadata(facts, typed, "probe_id").drop("score"), F.lit(_ORDER[o.mode][0]))
    items = catalogue.select(F.lower("name").alias("_name"), "name", "product_id", F.coalesce("game", F.lit("")).alias("_game"))
    first = items.groupBy("_name").agg(F.min_by(F.struct("product_id", "name"), F.struct("_game", "product_id")).alias("_item"), F.countDistinct("_game").alias("_games"))
    rows = named.join(resolved, "probe_id", "left").withColumn("_name", F.lower("resolved")).join(first, "_name", "left").withColumn("_said", F.coalesce("resolved", F.trim("hint_name")))
    if o.mode == "live":
        reason = F.when(F.col("_games") == 1, "ocr_name_primary_live").otherwise("ocr_name_only_live")
        by_name = rows.where("resolved IS NOT NULL").withColumn("_reason", reason)
    else:
        close = F.when(F.col("resolved").isNotNull(), seq_ratio(F.lower(F.trim("hint_name")), F.lower("resolved"))) >= 0.90
        given = truthy(F.col("hint_number")).isNotNull() | truthy(F.col("hint_set")).isNotNull() | F.col("hint_cmc").isNotNull()
        known = F.col("_item").isNotNull() & (given | F.coalesce(close, F.lit(False)))
        by_name = rows.withColumn("_reason", F.when(known, "metadata_name_only").when(text.title_signal(F.trim("hint_name")), "ocr_name_only").otherwise("ocr_name_only_noisy"))
    item = F.when(F.col("_reason").isin("metadata_name_only", "ocr_name_primary_live"), F.col("_item.product_id")).alias("product_id")
    found = [unique, ranking.with_outcome(by_name.select("probe_id", item, "_said", "_reason"), F.col("_reason")).drop("_reason")]
    if o.mode == "live" and "rules_text" in probes.columns:
        found.append(ranking.with_outcome(resolve.resolve_rules(probes, catalogue, "probe_id", "rules_text").select("probe_id", "product_id"), F.lit("ocr_rules_text_live")))
    return found


def identify(probes: DataFrame, catalogue: DataFrame, index: DataFrame, options: Options | None = None) -> DataFrame:
    """The ranked matches of each probe.

    probes: probe_id, r_phash, g_phash, b_phash, mser_score, the hint columns
    and, for live mode, rules_text; catalogue: the canonical columns; index: product_id, game, r_phash,
    g_phash, b_phash, and grayscale_phash for that mode.
    """
    o = options or Options()
    missing = [c for c in HINTS if c not in probes.columns]
    probes = probes.withColumns({c: F.lit(None).cast("int" if c == "hint_cmc" else "string") for c in missing}) if missing else probes
    catalogue = catalogue if "game" in catalogue.columns else catalogue.withColumn("game", F.lit(""))
    order = F.coalesce(*(F.when(F.col("fallback_reason").eqNullSafe(F.lit(reason)), k) for k, reason in enumerate(_ORDER[o.mode])))
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [_by_hash(probes, catalogue, index, o), *_by_name(probes, catalogue, o)]).withColumn("_branch", order)
    chosen = every.withColumn("_first", F.min("_branch").over(Window.partitionBy("probe_id"))).where("_branch = _first").drop("_first")

    rich = chosen.join(catalogue.select("product_id", *_FACTS).dropDuplicates(["product_id"]), "product_id", "left").withColumn("name", F.coalesce("name", "_said")).drop("_said")
    rich = rich.where(resolve.permissive(F.col("set_code"), list(o.sets)) & resolve.permissive(F.col("subTypeName"), list(o.finishes), ignore_case=False) & resolve.permissive(F.col("rarity"), list(o.rarities)))
    rich = rich.join(probes.select("probe_id", *(["mser_score"] if "mser_score" in probes.columns else [F.lit(None).cast("double").alias("mser_score")])), "probe_id", "left")
    blend = F.when(F.col("phash_confidence").isNotNull(), ranking.blended(F.col("phash_confidence"), F.col("mser_score"), o.region_weight)).otherwise(F.col("confidence"))
    is_relaxed = F.coalesce(F.col("fallback_reason") == ranking.RELAXED, F.lit(False))
    rich = rich.withColumn("confidence", blend).withColumns({
        "market_price": picked_price(F.col("market_price"), F.col("low_price")),
        "confidence_level": F.when(is_relaxed, "low").otherwise(F.coalesce("confidence_level", ranking.level(F.col("confidence")))),
        "manual_review_required": is_relaxed | F.coalesce(F.when(F.col("phash_confidence").isNull(), F.col("manual_review_required")), ranking.needs_review(F.col("confidence"))),
    })
    return ranking.ranked(rich.drop("_branch", "low_price"), "probe_id", "metadata_match_score", "distance", "product_id", o.top_n)
