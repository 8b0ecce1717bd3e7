"""Collection ledger: stock keys, statistics, exports, review queue and name reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import first_truthy, truthy

CONDITIONS = dict(zip(("Near Mint", "Lightly Played", "Moderately Played", "Heavily Played", "Damaged", "Mint"), "NM LP MP HP DMG M".split(), strict=True))
LANGUAGES = dict(zip("EN JP FR DE ES IT PT KR KO CN TW RU".split(), "English Japanese French German Spanish Italian Portuguese Korean Korean".split() + ["Chinese Simplified", "Chinese Traditional", "Russian"], strict=True))


def _mapped(value: Column, table: dict[str, str], default: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for pair in table.items() for x in pair)), value), default)


def sku(product_id: Column, condition: Column, language: Column, foil: Column) -> Column:
    """product_variant_language_finish; graded conditions give their first whole number, or 10."""
    graded = F.coalesce(condition.startswith("PSA") | condition.startswith("BGS"), F.lit(False))
    grade = first_truthy(F.regexp_extract(condition, r"(\d+)", 1), F.lit("10"))
    variant = F.when(graded, grade).otherwise(_mapped(condition, CONDITIONS, F.lit("NM")))
    return F.concat_ws("_", F.coalesce(product_id.cast("string"), F.lit("None")), variant, language, F.when(F.coalesce(foil, F.lit(False)), "F").otherwise("N"))


def language_name(code: Column) -> Column:
    """The language of a code; an unknown code stays as it is."""
    return _mapped(code, LANGUAGES, code)


def export_quantities(ledger: DataFrame, *further: Column) -> DataFrame:
    """(Quantity, SKU) and any further columns."""
    return ledger.select(F.col("quantity").alias("Quantity"), F.col("sku").alias("SKU"), *further)


def export_players(ledger: DataFrame, *further: Column) -> DataFrame:
    """One row a card in the players' format, and any further columns."""
    return ledger.select(
        F.col("quantity").alias("Quantity"), F.col("name").alias("Name"), F.col("set_code").alias("Set Code"), F.when(F.col("is_foil"), "Foil").otherwise("Normal").alias("Printing"),
        F.col("condition").alias("Condition"), language_name(F.col("language")).alias("Language"), *further,
    )


def by_game(ledger: DataFrame) -> DataFrame:
    """Cards of each game, most first."""
    return ledger.groupBy("game").agg(F.count("*").alias("cards")).orderBy(F.desc("cards"), F.asc_nulls_first("game"))


def first_seen(scans: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The first scan of each key: the inventory check over a whole history."""
    return scans.withColumn("_n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_n = 1").drop("_n")


def unseen(scans: DataFrame, inventory: DataFrame, key: list[str]) -> DataFrame:
    """Scans whose key isn't in the inventory yet."""
    return scans.join(inventory.select(*key).distinct(), key, "left_anti")


def batch_stats(results: DataFrame) -> DataFrame:
    """One row of totals over (status, match_found, reused, seconds)."""
    n = F.count("*")
    return results.agg(
        n.alias("total_files"), F.count_if(F.col("status") == "success").alias("successful_scans"), F.count_if(F.col("match_found")).alias("matches_found"),
        F.count_if(F.col("status") == "error").alias("failed_scans"), F.count_if(F.col("reused")).alias("reused_local_files"),
        (F.coalesce(F.sum("seconds"), F.lit(0.0)) / F.greatest(n, F.lit(1))).alias("avg_time_per_scan"),
    )


def scan_stats(scans: DataFrame) -> DataFrame:
    """One row over (seconds, cards_checked, cache_hit): scans, average time and cards checked, and the rate of cache hits in percent; 0 without scans."""
    n = F.count("*")
    per = lambda c: F.coalesce(c, F.lit(0)) / F.greatest(n, F.lit(1))
    return scans.agg(
        n.alias("scans"), per(F.sum("seconds")).alias("average_time"), per(F.sum("cards_checked")).alias("average_cards_checked"), (100.0 * per(F.count_if("cache_hit"))).alias("cache_hit_rate"),
    )


def review_reasons(confidence: Column, name_source: Column, agreement: Column, threshold: float = 75.0, least: float = 0.6) -> Column:
    """Reasons to look at a result, joined by ``;``; null without any. ``agreement`` is null where a name is missing."""
    reasons = F.array_compact(F.array(
        F.when(F.coalesce(confidence, F.lit(0.0)) < threshold, "low_confidence"),
        F.when(name_source.startswith("ocr_"), "ocr_override_applied"),
        F.when(agreement < least, "scanner_ocr_disagreement"),
    ))
    return truthy(F.array_join(reasons, ";"))


def reconciled(matched: Column, top: Column, resolved: Column, confidence: Column, agreement: Column) -> tuple[Column, Column]:
    """The name of a result and where it is from: the recognised name where there is no match, or a weak and unlike one."""
    m, t, r = truthy(F.trim(matched)), truthy(top), truthy(resolved)
    override = (F.coalesce(confidence, F.lit(0.0)) < 75) & (agreement < 0.55) & r.isNotNull()
    name = F.when(t.isNull(), m).when(m.isNull(), F.coalesce(r, t)).when(override, r).otherwise(m)
    source = (
        F.when(t.isNull(), "scanner_match").when(m.isNull() & r.isNotNull(), "ocr_resolved_no_match_name").when(m.isNull(), "ocr_top_band_no_match_name")
        .when(override, "ocr_resolved_override_low_confidence").otherwise("scanner_match")
    )
    return name, source
