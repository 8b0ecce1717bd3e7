"""Writing ledgers, exports, results, reports and indexes."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.ledger import batch_stats, export_players, export_quantities
from .plugins import loaded


def append(ledger: DataFrame, path: str) -> None:
    """Add entries to a ledger; only the new ones are written."""
    ledger.write.mode("append").parquet(path)


def export(ledger: DataFrame, path: str, kind: str = "both", by_game: bool = False) -> list[str]:
    """CSV exports of kind ``quantities``, ``players`` or ``both``; by game, into a folder for each game that has a name."""
    done = []
    for name, make in (("quantities", export_quantities), ("players", export_players)):
        if kind not in (name, "both"):
            continue
        out = f"{path}/{name}"
        if by_game:
            folder = F.regexp_replace(F.regexp_replace("game", " ", "_"), ":", "").alias("folder")
            named = ledger.where(F.coalesce("game", F.lit("")) != "")
            make(named, folder).write.mode("overwrite").partitionBy("folder").option("header", True).csv(out)
        else:
            make(ledger).write.mode("overwrite").option("header", True).csv(out)
        done.append(out)
    return done


def flat(results: DataFrame) -> DataFrame:
    """Columns in alphabetical order, nested ones as JSON texts, for CSV."""
    kinds = dict(results.dtypes)
    return results.select(*((F.to_json(c) if kinds[c].startswith(("array", "struct", "map")) else F.col(c)).alias(c) for c in sorted(results.columns)))


def results_csv(results: DataFrame, path: str) -> None:
    flat(results).write.mode("overwrite").option("header", True).csv(path)


def results_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)


def batch_report(results: DataFrame, path: str) -> None:
    """One JSON document {timestamp, results, stats}, the statistics counted from these results."""
    nested = results.agg(F.sort_array(F.collect_list(F.struct(*results.columns))).alias("results"))
    nested.crossJoin(batch_stats(results).select(F.struct("*").alias("stats"))).select(F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"), "results", "stats").coalesce(1).write.mode("overwrite").json(path)


def crops(images: DataFrame, folder: str, encode: str, overwrite: bool = False) -> DataFrame:
    """Write cropped images and their log, and return the log (file, status, source_width, source_height, width, height).

    images: file, data (RGB bytes row by row), height, width and rect (x1, y1,
    x2, y2), end exclusive, null to leave the image out; the folder must be one
    that all executors mount. ``encode`` is a plug-in that takes pixels and gives a file's bytes. Statuses are
    cropped, skipped (there already) and failed. The log is written beside the
    images as ``_crop_log`` and read back, so the files are written once.
    """
    spark = images.sparkSession
    root = spark._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()
    function = loaded("encode", encode)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for file, data, h, w, rect in zip(*(frame[c] for c in ("file", "data", "height", "width", "rect")), strict=True):
                target, size = Path(root) / file, (None, None)
                if target.exists() and not overwrite:
                    status = "skipped"
                elif rect is None or data is None or len(data) != h * w * 3:
                    status = "failed"
                else:
                    x1, y1, x2, y2 = (int(rect[k]) for k in ("x1", "y1", "x2", "y2"))
                    crop = np.frombuffer(data, np.uint8).reshape(int(h), int(w), 3)[y1:y2, x1:x2]
                    target.parent.mkdir(parents=True, exist_ok=True)
                    part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")  # a task may run twice
                    part.write_bytes(function(crop))
                    part.replace(target)
                    status, size = "cropped", (crop.shape[1], crop.shape[0])
                out.append((file, status, w, h, *size))
            yield pd.DataFrame(out, columns=["file", "status", "source_width", "source_height", "width", "height"])

    log = images.select("file", "data", "height", "width", "rect").mapInPandas(run, "file string, status string, source_width int, source_height int, width int, height int")
    log.write.mode("overwrite").json(f"{folder}/_crop_log")
    return spark.read.schema(log.schema).json(f"{folder}/_crop_log")


def crop_stats(log: DataFrame) -> DataFrame:
    """(total, cropped, skipped, failed)."""
    return log.agg(F.count("*").alias("total"), *(F.count_if(F.col("status") == s).alias(s) for s in ("cropped", "skipped", "failed")))


def swapped(rows: DataFrame, path: str) -> None:
    """Write a table beside the one at a path and put it in its place, which is empty for the moment between two renames only."""
    spark = rows.sparkSession
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    at, staged, old = (fs_path(f"{path}{end}") for end in ("", f".staged-{uuid.uuid4().hex}", f".old-{uuid.uuid4().hex}"))
    files = at.getFileSystem(spark._jsc.hadoopConfiguration())
    rows.write.parquet(staged.toString())
    there = files.exists(at)
    if there and not files.rename(at, old):
        raise OSError(f"can't move {path} aside")
    if not files.rename(staged, at):
        if there:
            files.rename(old, at)
        raise OSError(f"can't put the new table at {path}")
    if there:
        files.delete(old, True)


def saved_frames(frames: DataFrame, folder: str) -> None:
    """Scan images (name, content) of a micro-batch as files; for ``foreachBatch`` beside other outputs."""
    root = frames.sparkSession._jvm.org.apache.hadoop.fs.Path(folder).toUri().getPath()

    def run(rows) -> None:
        for r in rows:
            target = Path(root) / r["name"]
            target.parent.mkdir(parents=True, exist_ok=True)
            part = target.with_name(f".{target.name}.{uuid.uuid4().hex}")
            part.write_bytes(bytes(r["content"]))
            part.replace(target)

    frames.select("name", "content").where("content IS NOT NULL").foreachPartition(run)


def review_report(items: DataFrame, path: str) -> bool:
    """Write the review items beside the results; nothing where there are none."""
    if items.isEmpty():
        return False
    flat(items).write.mode("overwrite").option("header", True).csv(f"{path}_manual_review")
    return True


def upserted(index: DataFrame, new: DataFrame, key: str = "product_id", order: str | None = None) -> DataFrame:
    """The index with new rows put in place of old ones of the same key; of several new ones the last by ``order``."""
    if order is not None:
        new = new.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(F.col(order).desc_nulls_last()))).where("_n = 1").drop("_n")
    return index.join(new.select(key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def appended(index: DataFrame, new: DataFrame, key: str = "product_id") -> DataFrame:
    """The index with those new rows whose key it lacks."""
    return index.unionByName(new.dropDuplicates([key]).join(index.select(key).distinct(), key, "left_anti"), allowMissingColumns=True)


def recent(history: DataFrame, n: int = 50) -> DataFrame:
    """The latest scans with their texts cut to a table's widths."""
    cut = lambda c, k: F.substring(F.coalesce(F.col(c), F.lit("")), 1, k).alias(c)
    return history.orderBy(F.desc("ts"), F.desc("scan_id")).limit(n).select("scan_id", "ts", cut("name", 25), cut("set_name", 12), cut("number", 8), cut("bin", 12))
