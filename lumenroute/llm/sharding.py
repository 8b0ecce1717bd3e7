"""Range sharding by sampled splitters.

Records are ordered by (key, within). In rounds, every range of more than
``full`` times ``target_bytes``, at first the whole table, is divided: a sample
of its records, each drawn with a probability in proportion to its size in
bytes, gives quantiles of the order, which split the range into pieces of about
the target, ``FAN`` of them at most. A splitter lies at the beginning of a key
where that is within the range, so a key is split only where it fills a range,
such as a hot one. Then the exact size of every range is summed, and so on until
none is overfull or the overfull ones can't be divided. Shards are numbered in
the order of their ranges, and the result has one partition for each, sorted.

The samples of the ranges, ``SAMPLES`` records a piece, are drawn and cut by
the executors, a task a range. What reaches the driver is splitters and one size
for each range; splitters are broadcast, some dozen bytes a shard.

Edge cases: a null key sorts as the empty string and a null ``within`` before
all others. Records equal in both stay together, so a range of nothing but
ties or repeated rows, or one very long record over the target, remains overfull. Null and empty texts have size 0;
a table without any text is one shard. An empty table gives an empty result.
Further columns are kept; one that already has the name of the shard column is
replaced.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cluster import prepare
from .linear import share

LEAST = -(1 << 63)
#: pieces into which a round divides a range at most
FAN = 256
#: records in the sample of a range for each of its pieces
SAMPLES = 200


class Splitters:
    """Sorted splitters (key, within): a record's range is the number of splitters at or before it."""

    def __init__(self, at: list[tuple[str, int]]):
        self.at = sorted(set(at))  # strings compare as in Spark: code points and UTF-8 bytes have one order
        self.keys = [k for k, _ in self.at]
        self.within = np.array([w for _, w in self.at], np.int64)

    def ranges(self, keys: pd.Series, within: pd.Series) -> pd.Series:
        codes, distinct = pd.factorize(keys)
        out = np.empty(len(keys), np.int64)
        order = np.argsort(codes, kind="stable")
        ends = np.cumsum(np.bincount(codes, minlength=len(distinct)))
        value = within.to_numpy(np.int64)
        for k, rows in zip(distinct, np.split(order, ends[:-1]), strict=True):
            a, b = bisect_left(self.keys, k), bisect_right(self.keys, k)
            out[rows] = a + np.searchsorted(self.within[a:b], value[rows], "right")
        return pd.Series(out)


def quantiles(sample: pd.DataFrame, pieces: int) -> list[tuple[str, int]]:
    """The (k, w) at which a weighted sample, sorted by them, passes each share of 1/pieces."""
    if pieces < 2 or not len(sample):
        return []
    passed = np.cumsum(sample["weight"].to_numpy(np.float64))
    at = np.searchsorted(passed, passed[-1] * np.arange(1, pieces) / pieces, "right")
    rows = sample[["k", "w"]].iloc[np.unique(np.minimum(at, len(sample) - 1))]
    return [(str(k), int(w)) for k, w in rows.itertuples(index=False, name=None)]


def splitters_of(sample: pd.DataFrame, pieces: int, first: tuple[str, int]) -> list[tuple[str, int]]:
    """Splitters within a range whose first record is ``first``: quantiles, moved to the beginning of their key if that is past the first."""
    moved = ((k, LEAST) if (k, LEAST) > first else (k, w) for k, w in quantiles(sample.sort_values(["k", "w"]), pieces))
    return sorted({s for s in moved if s > first})


def find_splitters(rows: DataFrame, target_bytes: int, full: float, fan: int, samples: int, salt: int) -> Splitters:
    """rows: (k string, w long, size long)."""
    spark = rows.sparkSession
    splitters = Splitters([])
    stuck: set[tuple] = set()
    for turn in count():  # ends: each turn adds a splitter within a range, or marks the range as stuck
        known = spark.sparkContext.broadcast(splitters)
        number = F.pandas_udf(lambda k, w: known.value.ranges(k, w), "long")  # noqa: B023
        placed = rows.withColumn("r", number("k", "w"))
        sizes = placed.groupBy("r").agg(F.sum("size").alias("size"), F.min(F.struct("k", "w")).alias("a"), F.max(F.struct("k", "w")).alias("b")).where(F.col("size") > full * target_bytes).collect()
        over = {x["r"]: x for x in sizes if x["a"] != x["b"] and (tuple(x["a"]), tuple(x["b"])) not in stuck}
        if not over:
            return splitters
        # of each overfull range, by its number: pieces, chance of drawing a byte, first record
        pieces = {r: min(fan, int(-(-x["size"] // target_bytes))) for r, x in over.items()}
        chance = {r: samples * pieces[r] / x["size"] for r, x in over.items()}
        first = {r: tuple(x["a"]) for r, x in over.items()}
        plan = spark.sparkContext.broadcast((pieces, chance, first))
        rate = F.pandas_udf(lambda r: r.map(plan.value[1]).fillna(0.0).astype("float64"), "double")  # noqa: B023

        def divide(sample: pd.DataFrame) -> pd.DataFrame:
            pieces, _, first = plan.value  # noqa: B023
            r = int(sample["r"].iloc[0])
            return pd.DataFrame(splitters_of(sample, pieces[r], first[r]), columns=["k", "w"])

        drawn = placed.withColumn("chance", F.least(F.lit(1.0), F.col("size") * rate("r"))).where(share(F.struct("k", "w"), salt + turn) < F.col("chance"))
        sample = drawn.select("r", "k", "w", (F.col("size") / F.col("chance")).alias("weight"))
        more = [(r["k"], r["w"]) for r in sample.groupBy("r").applyInPandas(divide, "k string, w long").collect()]
        new = Splitters(splitters.at + more)
        for x in over.values():
            a, b = tuple(x["a"]), tuple(x["b"])
            if not bisect_right(new.at, b) - bisect_right(new.at, a):
                stuck.add((a, b))
        splitters = new
    raise AssertionError


def shard(docs: DataFrame, key: str = "source", within: str = "doc_id", content: str = "text", target_bytes: int = 16 << 20, full: float = 1.25, fan: int = FAN, samples: int = SAMPLES, salt: int = 3, column: str = "shard") -> DataFrame:
    """docs with the number of each record's shard, one partition a shard."""
    spark = docs.sparkSession
    prepare(spark)
    k = F.coalesce(F.col(key).cast("string"), F.lit(""))
    w = F.coalesce(F.col(within).cast("long"), F.lit(LEAST))
    rows = docs.select(k.alias("k"), w.alias("w"), F.coalesce(F.octet_length(F.col(content)), F.lit(0)).cast("long").alias("size")).checkpoint()
    splitters = find_splitters(rows, target_bytes, full, fan, samples, salt)
    known = spark.sparkContext.broadcast(splitters)
    number = F.pandas_udf(lambda a, b: known.value.ranges(a, b), "long")
    out = docs.withColumn(column, number(k, w).cast("int"))
    return out.repartitionById(len(splitters.at) + 1, F.col(column)).sortWithinPartitions(column, key, within)
