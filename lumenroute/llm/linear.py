"""Linear classifiers on hashed text features, in numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernel

#: yields (first document, number of features of each document, features) for runs of documents
Features = Callable[[pa.Array], Iterator[tuple[int, np.ndarray, np.ndarray]]]


def sampled(docs: DataFrame, rows: int, total: int, salt: int) -> DataFrame:
    """About ``rows`` of the ``total`` documents, chosen by a hash of the id."""
    if total <= rows:
        return docs
    return docs.where(share(F.col("doc_id"), salt) < rows / total)


def share(key: Column, salt: int) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return (F.xxhash64(key, F.lit(salt)).bitwiseAND(F.lit((1 << 40) - 1))) / F.lit(float(1 << 40))


PACKED = np.dtype([("f", "<u4"), ("v", "<f4")])


def featured(docs: DataFrame, features: Features, kept: str, value: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """The kept columns, and ``f``: the distinct features of each text with the values worked out from them and their counts, packed."""
    names = [c.split()[0] for c in kept.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.split_rows(batches, "text"):
            blobs = []
            for _, sizes, f in features(batch.column("text")):
                ends = np.cumsum(sizes)
                for a, b in zip(ends - sizes, ends, strict=True):
                    index, count = np.unique(f[a:b], return_counts=True)
                    packed = np.empty(len(index), PACKED)
                    packed["f"], packed["v"] = index, value(index, count)
                    blobs.append(packed.tobytes())
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(blobs, pa.binary())], [*names, "f"])

    return docs.select(*names, "text").mapInArrow(run, f"{kept}, f binary")


def document_counts(rows: DataFrame, least: int) -> np.ndarray:
    """(feature, documents) of the features that at least so many rows of ``featured`` have, in order; counted on the executors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.frombuffer(b, PACKED)["f"] for batch in batches for b in batch.column("f").to_pylist()]
        if held:
            f, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.record_batch([pa.array(f.astype(np.int32)), pa.array(n.astype(np.int64))], ["feature", "n"])

    found = rows.select("f").mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).where(F.col("n") >= least).toPandas()
    return found.sort_values("feature").to_numpy(np.int64)


def restricted(rows: DataFrame, chosen: Broadcast, kept: str) -> DataFrame:
    """The rows of ``featured`` with only the chosen features, a sorted array, by their numbers in it."""
    names = [c.split()[0] for c in kept.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for b in batch.column("f").to_pylist():
                packed = np.frombuffer(b, PACKED).copy()
                packed = packed[np.isin(packed["f"], chosen.value)]
                packed["f"] = np.searchsorted(chosen.value, packed["f"])
                out.append(packed.tobytes())
            yield pa.record_batch([*(batch.column(c) for c in names), pa.array(out, pa.binary())], [*names, "f"])

    return rows.mapInArrow(run, f"{kept}, f binary")


#: entries that a step of a fit works on at a time
_CHUNK = 1 << 19


class Rows:
    """Sparse rows of feature values, from the bytes of packed rows and their offsets."""

    def __init__(self, raw: np.ndarray, at: np.ndarray):
        packed = raw.view(PACKED)
        self.n = len(at) - 1
        self.ends = at // PACKED.itemsize
        self.index, self.value = packed["f"].astype(np.int32), packed["v"].copy()

    @staticmethod
    def of(blobs: list[bytes]) -> Rows:
        return Rows(np.frombuffer(b"".join(blobs), np.uint8), np.cumsum([0, *map(len, blobs)]))

    def _chunks(self) -> Iterator[tuple[int, int, slice]]:
        i = 0
        while i < self.n:
            j = max(i + 1, int(np.searchsorted(self.ends, self.ends[i] + _CHUNK, "right")) - 1)
            yield i, j, slice(self.ends[i], self.ends[j])
            i = j

    def dot(self, w: np.ndarray) -> np.ndarray:
        out, w = np.empty(self.n), w.astype(np.float32)
        for i, j, at in self._chunks():
            out[i:j] = _sums(w[self.index[at]] * self.value[at], np.diff(self.ends[i : j + 1]))
        return out

    def back(self, g: np.ndarray, dims: int) -> np.ndarray:
        out, g = np.zeros(dims), g.astype(np.float32)
        for i, j, at in self._chunks():
            out += np.bincount(self.index[at], np.repeat(g[i:j], np.diff(self.ends[i : j + 1])) * self.value[at], dims)
        return out


def collected(rows: DataFrame) -> tuple[Rows, pa.Table]:
    """A bounded table of packed rows ``f`` on the driver: the rows, and the other columns."""
    table = rows.toArrow()
    return Rows(*kernel.utf8(table["f"])), table.drop_columns(["f"])


def _sums(x: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The sums of successive stretches of x of these sizes."""
    out = np.zeros(len(size))
    some = size > 0
    if some.any():
        out[some] = np.add.reduceat(x, (np.cumsum(size) - size)[some], dtype=np.float64)
    return out


class Adam:
    def __init__(self, dims: int, rate: float):
        self.m, self.v, self.t, self.rate = np.zeros(dims), np.zeros(dims), 0, rate

    def step(self, g: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * g
        self.v = 0.999 * self.v + 0.001 * g * g
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def sums(weights: np.ndarray, sizes: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The sum of the weights of each document's features."""
    return _sums(weights[f], sizes)


def scored(docs: DataFrame, score: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], p_name: str) -> DataFrame:
    """(doc_id, p, keep) for every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.split_rows(batches, "text"):
            p, keep = score(batch.column("text"))
            yield pa.record_batch([batch.column("doc_id"), pa.array(p), pa.array(keep)], ["doc_id", p_name, "keep"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id long, {p_name} double, keep boolean")


def filtered(docs: DataFrame, score: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """The rows that the classifier keeps, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.split_rows(batches, "text"):
            _, keep = score(batch.column("text"))
            if keep.any():
                yield batch.filter(pa.array(keep))

    return docs.mapInArrow(run, docs.schema)
