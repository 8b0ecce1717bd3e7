"""WARC records, and a Merkle fixity audit of two replicas.

``records`` lays pages out as WARC response records in files of
``FANOUT ** FILE_LEVEL`` page ids, with each record's byte offset in its file,
and hashes every record; ``files`` gives the bytes of those files, and ``parsed``
reads the same records back from the bytes of WARC files. ``tree`` hashes them upwards: a leaf is the record (or
records) of one page id, a node the ordered list of its children, each with its
hash and its range of offsets, counted from the node's beginning; from the roots of the files further levels, of
ranges of files, lead to a single root. A leaf's place is fixed by its id, and
offsets are relative, so a lost record changes the nodes above it but not its
neighbours. ``audit`` compares two replicas from the root down and goes on below
differing nodes only.

All but ``parsed`` is Spark SQL: a record is hashed where it is read, and only ids, lengths
and hashes are shuffled, once for all levels within files. Every level is kept
in a checkpoint, and the audit joins it with the differing nodes above.

Edge cases: pages without an id are left out of the archive. A null url or body
is written as an empty one; a very long one is hashed whole. Repeated ids become separate records of one leaf,
ordered by their hash, so ties don't matter. A leaf that only one replica has is ``missing`` or
``extra``; one whose bytes agree is not damaged by lying at another offset, but
a node none of whose children differs, only their offsets, is ``shifted``. Two
empty replicas, or two equal ones, give an empty audit. Other columns are
ignored, whatever their names. Ids are not negative; a negative one is an error.
A file's bytes are read up to the first that are no record.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .cluster import prepare

FANOUT = 16
#: the level whose nodes are files: 4096 page ids in each
FILE_LEVEL = 3
#: the tables say nothing of when a page was fetched
DATE = "1970-01-01T00:00:00Z"


def record(page_id: Column, url: Column, body: Column, date: str = DATE) -> Column:
    """A WARC response record as a string."""
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), page_id.cast("string"), F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), url,
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"),
    )


def _written(pages: DataFrame) -> DataFrame:
    """(file, page_id, record)."""
    page_id = F.col("page_id").cast("long")
    text = record(page_id, F.coalesce(F.col("url").cast("string"), F.lit("")), F.coalesce(F.col("html").cast("string"), F.lit("")))
    checked = F.when(page_id < 0, F.raise_error(F.lit("a page id is negative"))).otherwise(page_id)
    return pages.where("page_id IS NOT NULL").select(checked.alias("page_id"), text.alias("record")).select(F.expr(f"page_id div {FANOUT**FILE_LEVEL}").alias("file"), "page_id", "record")


def records(pages: DataFrame) -> DataFrame:
    """(file, page_id, begin, end, hash) of every record; begin and end are byte offsets in the file."""
    hashed = _written(pages).select("file", "page_id", F.octet_length("record").cast("long").alias("bytes"), F.sha2("record", 256).alias("hash"))
    end = F.sum("bytes").over(Window.partitionBy("file").orderBy("page_id", "hash").rowsBetween(Window.unboundedPreceding, 0))
    return hashed.withColumn("end", end).select("file", "page_id", (F.col("end") - F.col("bytes")).alias("begin"), "end", "hash")


def files(pages: DataFrame) -> DataFrame:
    """(file, content): the bytes of each WARC file, its records in the order of ``records``."""
    held = F.collect_list(F.struct("page_id", F.sha2("record", 256).alias("hash"), "record"))
    whole = F.array_join(F.transform(F.array_sort(held), lambda x: x["record"]), "")
    return _written(pages).groupBy("file").agg(whole.cast("binary").alias("content"))


_HEAD = re.compile(rb"WARC/1\.[01]\r\n(.*?)\r\n\r\n", re.S)
_ID = re.compile(rb"^WARC-Record-ID:\s*<urn:page:(\d+)>", re.M | re.I)
_LENGTH = re.compile(rb"^Content-Length:\s*(\d+)", re.M | re.I)


def parsed(content: DataFrame) -> DataFrame:
    """(file, page_id, begin, end, hash) of the records in WARC files (file, content)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, blob in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
                data, at, out = blob.as_py() or b"", 0, []
                while (head := _HEAD.match(data, at)) and (name := _ID.search(head[1])) and (size := _LENGTH.search(head[1])):
                    end = head.end() + int(size[1]) + 4
                    if data[end - 4 : end] != b"\r\n\r\n":
                        break
                    out.append((file, int(name[1]), at, end, hashlib.sha256(data[at:end]).hexdigest()))
                    at = end
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
                yield pa.record_batch([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], ["file", "page_id", "begin", "end", "hash"])

    return content.select(F.col("file").cast("long").alias("file"), F.col("content").cast("binary").alias("content")).mapInArrow(run, "file long, page_id long, begin long, end long, hash string")


def _up(level: DataFrame, *keys: str) -> DataFrame:
    """The nodes over those of a level: the hash of the ordered children, with their ranges within the node."""
    children = F.array_sort(F.collect_list(F.struct("node", "begin", "end", "hash"))).alias("children")
    said = F.transform("children", lambda c: F.concat_ws(":", c["node"].cast("string"), F.concat_ws("-", (c["begin"] - F.col("begin")).cast("string"), (c["end"] - F.col("begin")).cast("string")), c["hash"]))
    grouped = level.groupBy(*keys, F.expr(f"node div {FANOUT}").alias("up")).agg(F.min("begin").alias("begin"), F.max("end").alias("end"), children)
    return grouped.select(*keys, F.col("up").alias("node"), "begin", "end", F.sha2(F.array_join(said, "|"), 256).alias("hash")).checkpoint()


def leaves(rows: DataFrame) -> DataFrame:
    """Level 0 of the tree from ``records``: (file, node, begin, end, hash), a node for each page id."""
    return rows.groupBy("file", F.col("page_id").alias("node")).agg(
        F.min("begin").alias("begin"), F.max("end").alias("end"), F.array_join(F.array_sort(F.collect_list("hash")), "+").alias("hash")
    )


def tree(level: DataFrame) -> list[DataFrame]:
    """All levels from the leaves to the root. Above the files, file is null and begin and end number files."""
    levels = [level]
    for _ in range(FILE_LEVEL):
        level = _up(level, "file")
        levels.append(level)
    above = level.select("node", F.col("node").alias("begin"), (F.col("node") + 1).alias("end"), "hash")
    while above.count() > 1:
        above = _up(above)
        levels.append(above.select(F.lit(None).cast("long").alias("file"), "node", "begin", "end", "hash"))
    return levels


def audit_records(ours: DataFrame, replica: DataFrame) -> DataFrame:
    """``audit`` of records that are laid out already."""
    prepare(ours.sparkSession)
    a, b = (tree(leaves(x).checkpoint()) for x in (ours, replica))
    while len(a) != len(b):  # replicas of different height: compare from where both have nodes
        (a if len(a) > len(b) else b).pop()
    found: list[tuple[int, DataFrame]] = []
    for level in range(len(a) - 1, -1, -1):
        sides = [side[level] for side in (a, b)]
        if found:
            differing = found[-1][1].select(F.col("node").alias("up"))
            sides = [rows.withColumn("up", F.expr(f"node div {FANOUT}")).join(differing, "up", "left_semi") for rows in sides]
        x, y = (rows.select("node", *(F.col(c).alias(f"{mark}_{c}") for c in ("file", "begin", "end", "hash"))) for rows, mark in zip(sides, "xy", strict=True))
        found.append((level, x.join(y, "node", "full").where("NOT (x_hash <=> y_hash)").checkpoint()))
    out = []
    for k, (level, rows) in enumerate(found):
        below = F.lit(True)
        if level:
            below = F.col("below").isNotNull()
            rows = rows.join(found[k + 1][1].select(F.expr(f"node div {FANOUT}").alias("node"), F.lit(1).alias("below")).distinct(), "node", "left")
        out.append(
            rows.select(
                F.lit(level).alias("level"), F.coalesce("x_file", "y_file", F.lit(-1)).cast("long").alias("file"), "node",
                *(F.coalesce(f"{side}_{c}", F.lit(-1)).cast("long").alias(prefix + c) for side, prefix in (("x", ""), ("y", "replica_")) for c in ("begin", "end")),
                F.col("x_hash").alias("hash"), F.col("y_hash").alias("replica_hash"),
                F.when(F.col("y_hash").isNull(), "missing").when(F.col("x_hash").isNull(), "extra").when(below, "damaged").otherwise("shifted").alias("state"),
            )
        )
    return reduce(DataFrame.unionAll, out)


def audit(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """(level, file, node, begin, end, hash, replica_hash, replica_begin, replica_end, state) of every differing node.

    At level 0 a node is a page id, and state says what became of its record.
    Numbers that a side doesn't have, and files above the level of files, are -1.
    """
    return audit_records(records(pages), records(replica))


def faulty(pages: DataFrame) -> DataFrame:
    """The pages as a replica with known faults: a changed byte, a lost record and an added one at fixed ids."""
    changed = F.when(F.expr("page_id % 997 = 5"), F.concat(F.lit("#"), F.expr("substring(html, 2)"))).otherwise(F.col("html")).alias("html")
    kept = pages.where("page_id % 1499 <> 7").select("page_id", "url", changed)
    return kept.unionAll(pages.where("page_id % 1999 = 11").select((F.col("page_id") + F.lit(2)).alias("page_id"), "url", "html"))
