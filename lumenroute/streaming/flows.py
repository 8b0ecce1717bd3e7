"""Streams from files to the ledger: observations, telemetry, and the live loop."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.values import telemetry
from ..operators.routing import route
from .gate import gated, required_confirmations, stability_key

OBSERVATIONS = "obs_id long, camera string, ts timestamp, product_id string, name string, set_code string, number string, type string, color string, cmc string, price string, rarity string, foil string, finishes array<string>, fallback_reason string, manual_review_required boolean, manual boolean"


def observations(spark: SparkSession, folder: str, files_per_batch: int = 100) -> DataFrame:
    """Recognised observations that arrive as JSON files."""
    return spark.readStream.schema(OBSERVATIONS).option("maxFilesPerTrigger", files_per_batch).json(folder)


def frames(spark: SparkSession, folder: str) -> DataFrame:
    """Readings of machine frames ``<...>`` that arrive in text files; noise between frames is dropped."""
    lines = spark.readStream.text(folder)
    return lines.select(F.explode(F.regexp_extract_all("value", F.lit("(<[^>]*>)"), 1)).alias("frame")).select(telemetry(F.col("frame")).alias("readings"))


def keyed(observed: DataFrame) -> DataFrame:
    """What the gate needs of observations."""
    return observed.select(
        "obs_id", "camera", "ts", stability_key(F.col("product_id"), F.col("name"), F.col("set_code"), F.col("number")).alias("key"),
        required_confirmations(F.col("fallback_reason"), F.col("manual_review_required")).alias("required"), F.coalesce("manual", F.lit(False)).alias("manual"),
    )


def accepted(observed: DataFrame, late: str = "30 seconds") -> DataFrame:
    """Observations that the gate accepts."""
    return gated(keyed(observed), late=late).where("accepted").select("obs_id", "camera", "ts", "key")


def recorder(details: Callable[[DataFrame], DataFrame], ledger: str, mode: str = "color") -> Callable[[DataFrame, int], None]:
    """For ``foreachBatch``: look accepted observations up, route them, and add them to the ledger.

    The batch number is the folder's name, so that a batch that is run again
    after a failure replaces its own entries.
    """

    def write(batch: DataFrame, number: int) -> None:
        details(batch).withColumn("bin", route(mode)).write.mode("overwrite").parquet(f"{ledger}/batch={number}")

    return write


def start(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, once: bool = False) -> StreamingQuery:
    """Start the loop; ``once`` works off what is there and ends."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="2 seconds")).start()
