"""Benchmark decontamination with a broadcast hash set of n-grams.

The word n-grams of all benchmark items, in normal form (see
``kernel.normalised``), go into a hash set. Every window of n words of every
document is looked up; a hit is verified on the words themselves. Hit windows
that overlap form a span. Spans are removed, and a document of whose words the
share ``drop_share`` or more is in spans is dropped whole. Removing a word
removes the characters up to the next word.

The set is broadcast if it has at most ``BROADCAST_GRAMS`` n-grams. Beyond
that, windows and n-grams meet in a shuffle join, with the same result.

Edge cases: a benchmark item of fewer than n words is one gram of all its
words; an item without words, or null, matches nothing. Null and empty texts,
and texts without words, are kept as they are; very long ones are searched
whole. An empty benchmark leaves every document alone, an empty table stays
empty. Repeated rows and repeated items are treated alike, each, so ties need
no rule. Other columns pass through ``decontaminate`` untouched, whatever their names; its ``n_chars``
column, if any, is the length of the new text. A text whose normal form can't
be traced back to its characters, which no text of letters and marks is known
to do, is cut in its normal form.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .cluster import prepare
from .kernel import U64

BROADCAST_GRAMS = 4_000_000
_BITS = 22


class Grams:
    """The benchmark's n-grams: for each length, sorted hashes with the words, and a bitmap that most windows fail."""

    def __init__(self, size: np.ndarray, key: np.ndarray, texts: pa.Array):
        self.texts, self.by_size = texts, {}
        for n in np.unique(size).tolist():
            mine = np.flatnonzero(size == n)
            mine = mine[np.argsort(key[mine], kind="stable")]
            bitmap = np.zeros(1 << _BITS, bool)
            bitmap[key[mine] >> U64(64 - _BITS)] = True
            self.by_size[n] = key[mine], mine, bitmap

    def hits(self, w: kernel.Words, raw: np.ndarray) -> list[tuple[int, int]]:
        """(first word, number of words) of each verified window, and of it alone."""
        out = []
        for size, (keys, number, bitmap) in self.by_size.items():
            h, first = kernel.windows(w, size)
            maybe = np.flatnonzero(bitmap[h >> U64(64 - _BITS)])
            at, stop = np.searchsorted(keys, h[maybe]), np.searchsorted(keys, h[maybe], "right")
            for k in np.flatnonzero(stop > at):
                where = first[maybe[k]]
                said = b" ".join(raw[a:b].tobytes() for a, b in zip(w.start[where : where + size], w.end[where : where + size], strict=True))
                if any(self.texts[int(q)].as_py() == said for q in number[at[k] : stop[k]]):
                    out.append((int(where), size))
        return out


def benchmark_grams(benchmark: DataFrame, n: int) -> DataFrame:
    """(gram, size, key): the distinct n-grams of the items, as words joined by spaces in binary, with their lengths and hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.split_rows(batches, "text"):
            raw, at = kernel.utf8(kernel.normalised(batch.column("text")))
            for i, j, w in kernel.words(raw, at):
                local = raw[at[i] : at[j]]
                said = [local[x:y].tobytes() for x, y in zip(w.start, w.end, strict=True)]
                whole = np.diff(w.first)
                for size in {n, *whole[(whole > 0) & (whole < n)].tolist()}:
                    h, first = kernel.windows(w, size)
                    if size < n:  # only items of just so many words
                        mine = whole[np.searchsorted(w.first, first, "right") - 1] == size
                        h, first = h[mine], first[mine]
                    grams = [b" ".join(said[k : k + size]) for k in first]
                    yield pa.record_batch([pa.array(grams, pa.binary()), pa.array(np.full(len(h), size)), pa.array(h.view(np.int64))], ["gram", "size", "key"])

    return benchmark.select(F.col("text").cast("string").alias("text")).where("text IS NOT NULL").mapInArrow(run, "gram binary, size long, key long").distinct()


def _traced(text: str) -> tuple[kernel.Words, np.ndarray]:
    """A text's words in normal form, and the byte in the text at which each begins.

    The text is taken to its normal form one grapheme after another.
    """
    import regex

    parts = regex.findall(r"\X", text)
    raw, at = kernel.utf8(kernel.normalised(pa.array(parts, pa.string())))
    w = kernel.Words(raw, np.array([0, len(raw)]))
    begin = np.r_[0, np.cumsum([len(p.encode()) for p in parts])]
    return w, begin[np.searchsorted(at, w.start, "right") - 1]


def _cut(column: pa.Array, hits_of, share: float):
    """For a column of texts: words, hits, covered words, whether dropped, and the new texts.

    hits_of: for a run of documents [i, j) and its words, the (first word, size) of the hits.
    """
    n = len(column)
    words, hits, covered = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    new: dict[int, bytes] = {}
    normal = kernel.normalised(column)
    raw, at = kernel.utf8(normal)
    plain, plain_at = kernel.utf8(column)
    unusual = kernel.unusual(plain, plain_at)
    for i, j, w in kernel.words(raw, at):
        words[i:j] = np.diff(w.first)
        found = hits_of(i, j, w, raw[at[i] : at[j]])
        if not found:
            continue
        mark = np.zeros(len(w.hash) + 1, np.int64)
        for first, size in found:
            mark[first] += 1
            mark[first + size] -= 1
        inside = np.cumsum(mark)[:-1] > 0
        owner = np.searchsorted(w.first, [f for f, _ in found], "right") - 1
        hits[i:j] += np.bincount(owner, minlength=j - i)
        for k in np.unique(owner):
            mine = inside[w.first[k] : w.first[k + 1]]
            covered[i + k] = mine.sum()
            text = plain[plain_at[i + k] : plain_at[i + k + 1]]
            if unusual[i + k]:
                _, start = _traced(text.tobytes().decode())
                if len(start) != len(mine):
                    text = raw[at[i + k] : at[i + k + 1]]
                    start = kernel.Words(text, np.array([0, len(text)])).start
            else:
                start = kernel.Words(text, np.array([0, len(text)])).start
            stop = np.r_[start[1:], len(text)]
            gone = np.zeros(len(text) + 1, np.int64)
            np.add.at(gone, start[mine], 1)
            np.add.at(gone, stop[mine], -1)
            new[int(i + k)] = text[np.cumsum(gone)[:-1] == 0].tobytes()
    dropped = (covered > 0) & (covered >= share * words)
    if new:
        texts = column.to_pylist()
        for k, text in new.items():
            texts[k] = text.decode()
        column = pa.array(texts, pa.string())
    return words, hits, covered, dropped, column


def _by_join(docs: DataFrame, grams: DataFrame) -> DataFrame:
    """(text, hits) of the distinct texts with hits, packed (first word, size) pairs of the verified windows, found by a shuffle join."""
    sizes = [r[0] for r in grams.select("size").distinct().collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.split_rows(batches, "text", 1 << 20):
            raw, at = kernel.utf8(kernel.normalised(batch.column("text")))
            for i, j, w in kernel.words(raw, at):
                local = raw[at[i] : at[j]]
                said = [local[a:b].tobytes() for a, b in zip(w.start, w.end, strict=True)]
                for size in sizes:
                    h, first = kernel.windows(w, size)
                    row = np.searchsorted(w.first, first, "right") - 1
                    yield pa.record_batch([
                        *(batch.column(c).take(pa.array(i + row)) for c in ("p", "q")), pa.array(first - w.first[row]), pa.array(np.full(len(first), size)),
                        pa.array(h.view(np.int64)), pa.array([b" ".join(said[k : k + size]) for k in first], pa.binary()),
                    ], ["p", "q", "first", "size", "key", "gram"])

    # a text goes by two hashes, of 128 bits in all, and the texts of hits are compared whole
    keyed = docs.select("text", F.xxhash64("text").alias("p"), F.xxhash64(F.lit(8), "text").alias("q")).where("text IS NOT NULL").dropDuplicates(["p", "q"])
    found = (
        keyed.mapInArrow(run, "p long, q long, first long, size long, key long, gram binary").join(grams, ["size", "key", "gram"], "left_semi")
        .groupBy("p", "q").agg(F.array_sort(F.collect_set(F.struct("first", "size"))).alias("hits"))
    )
    return keyed.join(found, ["p", "q"]).select("text", "hits")


def _applied(docs: DataFrame, benchmark: DataFrame, n: int, drop_share: float, broadcast_grams: int, schema, build) -> DataFrame:
    spark = docs.sparkSession
    prepare(spark)
    grams = benchmark_grams(benchmark, n).checkpoint()
    known, source, column = None, docs, "text"
    if grams.count() <= broadcast_grams:
        table = grams.toArrow()
        known = spark.sparkContext.broadcast(Grams(table["size"].to_numpy(), table["key"].to_numpy().view(U64), table["gram"].combine_chunks()))
    else:
        row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("text").cast("string").alias("text"))
        source = row.join(_by_join(row.select("text"), grams), "text", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.split_rows(batches, column):
            if known is not None:
                found = lambda i, j, w, raw: known.value.hits(w, raw)
                rows = batch
            else:
                packed = batch.column("hits").to_pylist()
                rows = pa.RecordBatch.from_struct_array(batch.column("row"))
                found = lambda i, j, w, raw: [(int(w.first[k - i]) + h["first"], h["size"]) for k in range(i, j) for h in packed[k] or ()]  # noqa: B023, E731
            yield build(rows, _cut(batch.column(column).cast(pa.string()), found, drop_share))

    return source.mapInArrow(run, schema)


def contamination(docs: DataFrame, benchmark: DataFrame, n: int = 8, drop_share: float = 0.5, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """(doc_id, words, hits, covered, action, keep, text) for every row; text is the cleaned text, null where dropped."""

    def build(batch, cut):
        words, hits, covered, dropped, text = cut
        if dropped.any():
            text = pa.array([None if gone else t for t, gone in zip(text.to_pylist(), dropped, strict=True)], pa.string())
        action = pa.array(np.where(dropped, "drop", np.where(hits > 0, "cut", "keep")), pa.string())
        return pa.record_batch([batch.column("doc_id"), pa.array(words), pa.array(hits), pa.array(covered), action, pa.array(~dropped), text], ["doc_id", "words", "hits", "covered", "action", "keep", "text"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return _applied(base, benchmark, n, drop_share, broadcast_grams, "doc_id long, words long, hits long, covered long, action string, keep boolean, text string", build)


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 8, drop_share: float = 0.5, broadcast_grams: int = BROADCAST_GRAMS) -> DataFrame:
    """docs without the documents that are dropped, and with the spans removed from the texts."""
    names, schema = docs.columns, docs.schema

    def build(batch, cut):
        _, hits, _, dropped, text = cut
        columns = {name: batch.column(name) for name in names}
        columns["text"] = text.cast(batch.schema.field("text").type)
        if "n_chars" in columns:
            kind = batch.schema.field("n_chars").type
            columns["n_chars"] = pc.if_else(pa.array(hits > 0), pc.utf8_length(text).cast(kind), columns["n_chars"])
        return pa.record_batch(list(columns.values()), names).filter(pa.array(~dropped))

    return _applied(docs, benchmark, n, drop_share, broadcast_grams, schema, build)
