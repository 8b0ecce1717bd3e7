"""One object for the usual ways in: identify, scan a batch, route, export."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.similarity import seq_ratio
from .operators import ledger, ranking, routing
from .plans.identify import Options, identify
from .session import importable
from .sources import sinks


@dataclass(frozen=True)
class Identifier:
    """A catalogue in canonical columns, its hash index, and the options of identification."""

    catalogue: DataFrame
    index: DataFrame
    options: Options = Options()

    def __post_init__(self):
        importable(self.catalogue.sparkSession)

    def with_options(self, **changes) -> Identifier:
        return replace(self, options=replace(self.options, **changes))

    def identify(self, probes: DataFrame) -> DataFrame:
        """The ranked matches of each probe."""
        return identify(probes, self.catalogue, self.index, self.options)

    def adaptive(self, probes: DataFrame, last: int = 20, target: int = 5) -> DataFrame:
        """The matches of each probe within the first threshold from 5 on that gives ``target`` of them, or an exact one."""
        found = self.with_options(threshold=float(last), relaxed=float(last), top_n=1 << 30).identify(probes).where(F.col("phash_confidence").isNotNull())
        limits = ranking.adaptive(found, "probe_id", "distance", last=last, target=target)
        return found.join(limits.select("probe_id", "threshold"), "probe_id").where(F.col("distance") <= F.col("threshold")).drop("threshold")

    def refined(self, probes: DataFrame, least: float = 85.0) -> DataFrame:
        """The matches, and for probes whose best has less confidence than ``least`` the adaptive ones, where there are any."""
        plain, tuned = self.identify(probes), self.adaptive(probes)
        weak = plain.groupBy("probe_id").agg(F.max("confidence").alias("_c")).where(F.col("_c") < least).select("probe_id")
        better = tuned.join(weak, "probe_id", "left_semi")
        return plain.join(better.select("probe_id").distinct(), "probe_id", "left_anti").unionByName(better, allowMissingColumns=True)

    def batch(self, files: DataFrame) -> DataFrame:
        """One result for each file: status, the name with its origin, the best match and all matches.

        files: probe_id, source_file, ocr_top_name, ocr_resolved_name, error and
        the columns of probes; a file with an error is a result of status error.
        """
        good = files.where(F.col("error").isNull())
        matches = self.identify(good)
        every = matches.groupBy("probe_id").agg(F.array_sort(F.collect_list(F.struct("rank", "product_id", "name", "distance", "confidence"))).alias("all_matches"))
        best = matches.where("rank = 1").select("probe_id", "product_id", F.col("name").alias("matched_name"), "distance", "confidence", "rarity", "number", "set_code")
        rows = files.select("probe_id", "source_file", "ocr_top_name", "ocr_resolved_name", "error").join(best, "probe_id", "left").join(every, "probe_id", "left")
        heard = F.coalesce("ocr_resolved_name", "ocr_top_name")
        agreement = F.when(F.col("matched_name").isNotNull() & heard.isNotNull(), seq_ratio(F.lower("matched_name"), F.lower(heard)))
        name, source = ledger.reconciled(F.col("matched_name"), F.col("ocr_top_name"), F.col("ocr_resolved_name"), F.col("confidence"), agreement)
        status = F.when(F.col("error").isNotNull(), "error").otherwise("success")
        return rows.withColumns({"status": status, "match_found": F.col("product_id").isNotNull(), "card_name": name, "name_source": source, "_agreement": F.when(F.col("ocr_resolved_name").isNotNull(), agreement)})

    def review(self, results: DataFrame, threshold: float = 75.0) -> DataFrame:
        """The successful results with a match that someone should look at, with the reasons."""
        found = results.where((F.col("status") == "success") & F.col("match_found"))
        reasons = ledger.review_reasons(F.col("confidence"), F.col("name_source"), F.col("_agreement"), threshold)
        return found.withColumn("review_reasons", reasons).where(F.col("review_reasons").isNotNull()).drop("_agreement")

    def routed(self, matches: DataFrame, mode: str, threshold: float = 1_000_000.0, fixed: bool = False) -> DataFrame:
        """The best match of each probe with its bin, by the catalogue's row rather than the narrower match."""
        rows = self.catalogue.select("product_id", "name", "type", "color", "cmc", "set_code", F.col("market_price").alias("price"), "rarity", F.lit(None).cast("array<string>").alias("finishes"), F.col("subTypeName").alias("foil"))
        return matches.where("rank = 1").select("probe_id", "product_id").join(rows.dropDuplicates(["product_id"]), "product_id").select("probe_id", "product_id", routing.route(mode, threshold, fixed).alias("bin"))

    @staticmethod
    def export(entries: DataFrame, path: str, kind: str = "both", by_game: bool = False) -> list[str]:
        return sinks.export(entries, path, kind, by_game)
