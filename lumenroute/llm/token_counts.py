"""Token counts of byte-level BPE, with overlap resynchronisation of huge documents.

A text of at most ``long_chars`` characters is encoded at once. A longer one is
cut into chunks that overlap their successors and are spread over the cluster;
each chunk is encoded alone, and its tokens' byte offsets give the number of
tokens before any of its word boundaries (the ends of the pattern's matches,
across which no merge goes). Two neighbours are spliced at the first boundary
of the overlap that both have. That boundary is proven: the pattern looks no
further than ``LOOKAHEAD`` characters past a match, so a boundary of the earlier
chunk that is further than this from its end is one of the whole text; and as
matching depends on nothing before a match, the later chunk agrees with the
whole text from there on. Where an overlap has no common boundary, as in one
endless word, the document is cut again with overlaps eight times as wide,
until it needs no cut.

Edge cases: null texts have a null count, empty ones 0. Strings that name
special tokens are ordinary text. Rows are counted one by one, repeated rows
and null ids included; other columns are ignored, whatever their names. An
empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .cluster import prepare

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LOOKAHEAD = 4


@lru_cache(maxsize=2)
def encoding(path: str, pattern: str):
    """The tokenizer, and the length in bytes of each token."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    size = np.zeros(max(ranks.values()) + 1, np.int64)
    for token, rank in ranks.items():
        size[rank] = len(token)
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}), size


@lru_cache(maxsize=2)
def _matcher(pattern: str):
    import regex

    return regex.compile(pattern)


def chunk_counts(chunk: str, head: int, tail: int, path: str, pattern: str) -> tuple[int, list[int], list[int], list[int], list[int]]:
    """Tokens of a chunk; its word boundaries up to ``head`` with the tokens before each, and those from ``tail`` that are stable."""
    enc, size = encoding(path, pattern)
    tokens = enc.encode_ordinary(chunk)
    ends = np.cumsum(size[tokens]) if tokens else np.zeros(0, np.int64)
    bounds = np.fromiter((m.end() for m in _matcher(pattern).finditer(chunk)), np.int64)
    bounds = np.r_[0, bounds]
    points = np.frombuffer(chunk.encode("utf-32-le"), np.uint32)
    width = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
    at = np.r_[0, np.cumsum(width)]
    first, last = bounds[bounds <= head], bounds[(bounds >= tail) & (bounds <= len(chunk) - LOOKAHEAD)]
    before = lambda b: np.searchsorted(ends, at[b], "right")
    return len(tokens), first.tolist(), before(first).tolist(), last.tolist(), before(last).tolist()


def splice(chunks: pd.DataFrame) -> int | None:
    """The tokens of a text from those of its chunks, in order; None where a seam has no common boundary."""
    total, begin, rows = 0, 0, list(chunks.itertuples(index=False))
    done = 0
    for here, there in zip(rows, rows[1:], strict=False):
        tail = dict(zip(here.tail_at, here.tail_n, strict=True))
        head = dict(zip(there.head_at, there.head_n, strict=True))
        common = [p for p in tail if p in head and p >= begin]
        if not common:
            return None
        begin = min(common)
        total += tail[begin] - done
        done = head[begin]
    return total + rows[-1].n - done


_CHUNK = "key long, doc_id long, k int, n long, head_at array<long>, head_n array<long>, tail_at array<long>, tail_n array<long>"


def _long_counts(docs: DataFrame, size: int, overlap: int, path: str, pattern: str) -> DataFrame:
    """(key, doc_id, n_tokens, copies) of long texts; n_tokens is null where the overlap was too narrow."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.split_rows(batches, "text", 1 << 20):
            out = []
            for key, doc, text in zip(*(batch.column(c).to_pylist() for c in ("key", "doc_id", "text")), strict=True):
                out += [(key, doc, k, a == 0, a + size >= len(text), a, text[a : a + size + overlap]) for k, a in enumerate(range(0, len(text), size))]
            yield pa.RecordBatch.from_pydict(
                {name: pa.array([r[q] for r in out], kind) for q, (name, kind) in enumerate((("key", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("first", pa.bool_()), ("last", pa.bool_()), ("start", pa.int64()), ("text", pa.string())))}
            )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.split_rows(batches, "text", 1 << 20):
            out = []
            for r in batch.to_pylist():
                n, first, before, last, upto = chunk_counts(r["text"], overlap, size, path, pattern)
                shift = lambda x: [p + r["start"] for p in x]  # noqa: B023, E731
                ends = ([], []) if r["last"] else (shift(last), upto)
                out.append((r["key"], r["doc_id"], r["k"], n, *(([], []) if r["first"] else (shift(first), before)), *ends))
            many = pa.list_(pa.int64())
            yield pa.RecordBatch.from_pydict(
                {name: pa.array([r[q] for r in out], kind) for q, (name, kind) in enumerate((("key", pa.int64()), ("doc_id", pa.int64()), ("k", pa.int32()), ("n", pa.int64()), ("head_at", many), ("head_n", many), ("tail_at", many), ("tail_n", many)))}
            )

    def join(frame: pd.DataFrame) -> pd.DataFrame:
        copies = int((frame["k"] == 0).sum())
        chunks = frame.drop_duplicates("k").sort_values("k")
        n = splice(chunks)
        doc = frame["doc_id"].iloc[0]
        return pd.DataFrame({"key": frame["key"].iloc[:1], "doc_id": pd.array([None if pd.isna(doc) else int(doc)], "Int64"), "n_tokens": pd.array([n], "Int64"), "copies": [copies]})

    chunks = docs.mapInArrow(cut, "key long, doc_id long, k int, first boolean, last boolean, start long, text string")
    spread = chunks.repartition("key", "k").mapInArrow(count, _CHUNK)
    return spread.groupBy("key").applyInPandas(join, "key long, doc_id long, n_tokens long, copies int")


def token_counts(docs: DataFrame, path: str = RANKS, pattern: str = PATTERN, long_chars: int = 20_000, chunk: int = 16_000, overlap: int = 512) -> DataFrame:
    """(doc_id, n_tokens) for every row."""
    if not 0 < overlap <= chunk:
        raise ValueError("overlap must be positive and at most chunk")
    prepare(docs.sparkSession)

    def short(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, _ = encoding(path, pattern)
        for batch in kernel.split_rows(batches, "text", 1 << 20):
            n = [None if t is None else len(enc.encode_ordinary(t)) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), pa.array(n, pa.int64())], ["doc_id", "n_tokens"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    long = base.where(F.length("text") > long_chars).withColumn("key", F.xxhash64("doc_id", "text"))
    result = base.where((F.length("text") <= long_chars) | F.col("text").isNull()).mapInArrow(short, "doc_id long, n_tokens long")
    left, size = long, chunk
    while True:
        found = _long_counts(left, size, overlap, path, pattern).checkpoint()
        good = found.where("n_tokens IS NOT NULL").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select("doc_id", "n_tokens")
        result = result.unionAll(good)
        failed = found.where("n_tokens IS NULL").select("key")
        if failed.isEmpty():
            return result
        maybe = kernel.may_be_in(failed, F.col("key"))  # so that only texts that failed are shuffled
        left = long.where(maybe).join(failed, "key", "left_semi")
        overlap *= 8
        size = max(size, overlap)
