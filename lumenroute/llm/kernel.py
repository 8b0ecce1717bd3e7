"""Vectorised text kernels over Arrow string buffers.

Everything works on the UTF-8 bytes of a whole Arrow batch with numpy, so no
Python string is made per word. Words are maximal runs of ASCII letters and
digits and of any non-ASCII character. ``normalised`` first brings texts to the
form in which words are compared: NFKC, lower case, without invisible joiners,
every other non-ASCII character a letter, digit or mark, and every ideograph or
kana a word of its own. After it, words are the matches of
``[\\p{L}\\p{N}\\p{M}]+``.

A word's hash is a polynomial over its bytes modulo 2**64, read off prefix
sums, and then mixed.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

U64 = np.uint64
_R = U64(0x9E3779B97F4A7C15 | 1)
_RI = U64(pow(int(_R), -1, 1 << 64))
#: most bits of a Bloom filter, 64 MB; more keys than a sixteenth of them only let more pass
BLOOM_BITS = 1 << 29
#: bits of the part of a filter that one task fills
BLOOM_PART = 1 << 20
#: bytes of text handled at a time: the temporaries stay within the CPU caches
GROUP_BYTES = 1 << 17
#: documents handled at a time, so that a document's number fits 13 bits
GROUP_DOCS = 1 << 13

_TABLE = np.zeros(256, np.uint8)
for _c in b"0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ":
    _TABLE[_c] = _c
_TABLE[128:] = np.arange(128, 256)

_pow = np.ones(1, U64)
_ipow = np.ones(1, U64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse modulo 2**64."""
    global _pow, _ipow
    if len(_pow) < n:
        m = 1 << (n - 1).bit_length()
        a, b = np.full(m, _R, U64), np.full(m, _RI, U64)
        a[0] = b[0] = 1
        _pow, _ipow = np.multiply.accumulate(a), np.multiply.accumulate(b)
    return _pow[:n], _ipow[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = h ^ (h >> U64(31))
    h = h * U64(0x7FB5D329728EA185)
    h ^= h >> U64(27)
    h = h * U64(0x81DADEF4BC2DD44D)
    h ^= h >> U64(33)
    return h


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary column and its n + 1 offsets; null reads as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    if len(at) == 0:
        return raw[:0], np.zeros(1, np.int64)
    return raw[at[0] : at[-1]], at - at[0]


_JOINERS = r"[\x{AD}\x{200B}-\x{200D}\x{2060}\x{FEFF}]"
_NO_WORD = r"[^\p{L}\p{N}\p{M}\x{0}-\x{7F}]+"
_ALONE = r"([\p{Han}\p{Hiragana}\p{Katakana}])"


def unusual(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Rows with characters besides ASCII and the accented letters up to U+00FF, whose normal form is more than lower case."""
    odd = (raw >= 0xC4) | (raw == 0xC2)
    odd[1:] |= (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    return np.diff(np.r_[0, np.cumsum(odd)][at]) > 0


def normalised(column: pa.Array) -> pa.Array:
    """The texts in the form in which words are compared; nulls stay null."""
    low = pc.utf8_lower(column)
    rows = unusual(*utf8(column))
    if not rows.any():
        return low
    joined = pc.replace_substring_regex(column.filter(pa.array(rows)), _JOINERS, "")
    text = pc.utf8_lower(pa.array([unicodedata.normalize("NFKC", t) for t in joined.to_pylist()], column.type))  # Arrow's normal forms don't compose
    text = pc.replace_substring_regex(pc.replace_substring_regex(text, _NO_WORD, " "), _ALONE, r" \1 ")
    return pc.replace_with_mask(low, pa.array(rows), text)


def groups(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    """Runs of documents [i, j) of about GROUP_BYTES; a longer document is a run of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + GROUP_BYTES, "right")) - 1
        j = min(max(j, i + 1), n, i + GROUP_DOCS)
        yield i, j
        i = j


class Words:
    """Words of a run of documents: hashes, byte spans [start, end), and for each document the index of its first word."""

    __slots__ = ("_inverse", "_prefix", "end", "first", "hash", "start")

    def __init__(self, raw: np.ndarray, offsets: np.ndarray):
        n = len(raw)
        cls = _TABLE[raw]
        word = cls != 0
        start = word.copy()
        start[1:] &= ~word[:-1]
        heads = offsets[:-1][offsets[:-1] < n]
        start[heads] |= word[heads]
        stop = np.zeros(n + 1, bool)
        stop[1:] = word
        stop[1:-1] &= ~word[1:] | start[1:]
        self.start, self.end = np.flatnonzero(start), np.flatnonzero(stop)
        power, inverse = powers(n + 1)
        prefix = np.zeros(n + 1, U64)
        np.cumsum(cls * power[:n], out=prefix[1:])
        h = (prefix[self.end] - prefix[self.start]) * inverse[self.start]
        self.hash = mix(h + (self.end - self.start).astype(U64))
        self.first = np.searchsorted(self.start, offsets)
        self._prefix, self._inverse = prefix, inverse

    def head(self, size: int) -> np.ndarray:
        """Hashes of each word's first ``size`` bytes, or of the whole word if it is shorter."""
        stop = np.minimum(self.start + size, self.end)
        return (self._prefix[stop] - self._prefix[self.start]) * self._inverse[self.start]


def words(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int, Words]]:
    """For each run of documents: [i, j) and its words; spans are relative to offsets[i]."""
    for i, j in groups(offsets):
        a, b = offsets[i], offsets[j]
        yield i, j, Words(raw[a:b], offsets[i : j + 1] - a)


def ngrams(w: Words, n: int, whole: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word n-grams and each one's document (within the run).

    With ``whole``, a document of 1 to n - 1 words has one gram, of all its words.
    """
    h, m = w.hash, len(w.hash)
    docs = len(w.first) - 1
    counts = np.diff(w.first)
    owner = np.repeat(np.arange(docs), counts)
    left = np.repeat(w.first[1:], counts) - np.arange(m)  # words from here to the end of the document
    g = np.zeros(m, U64)
    span = np.minimum(left, n)
    for k in range(n):
        inside = left > k
        shifted = np.zeros(m, U64)
        shifted[: m - k] = h[k:]
        g = np.where(inside, g * U64(0xD6E8FEB86659FD93) + shifted, g)
    keep = left >= n
    if whole:
        short = (counts > 0) & (counts < n)
        keep[w.first[:-1][short]] = True
    return mix(g + span.astype(U64))[keep], owner[keep]


def windows(w: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all windows of n words within a document, and the index of each one's first word.

    Equal to ``ngrams`` only in kind: these hashes come from prefix sums over the words.
    """
    m = len(w.hash)
    if m < n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    power, inverse = powers(m + 1)
    prefix = np.zeros(m + 1, U64)
    np.cumsum(w.hash * power[:m], out=prefix[1:])
    h = mix((prefix[n:] - prefix[:-n]) * inverse[: m + 1 - n] + U64(n))
    crossing = np.zeros(m + 2, np.int64)  # window starts whose window runs over a document's end
    ends = w.first[1:-1]
    np.add.at(crossing, np.maximum(ends - n + 1, 0), 1)
    np.add.at(crossing, ends, -1)
    at = np.flatnonzero(np.cumsum(crossing)[: m + 1 - n] == 0)
    return h[at], at


def lists(values: np.ndarray, lengths: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, kind))


def split_rows(batches: Iterator[pa.RecordBatch], column: str, most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that a text column has about ``most`` bytes in each; a longer row is a batch of its own."""
    for batch in batches:
        _, at = utf8(batch.column(column))
        i, n = 0, batch.num_rows
        while i < n:
            j = min(max(int(np.searchsorted(at, at[i] + most, "right")) - 1, i + 1), n)
            yield batch.slice(i, j - i)
            i = j


def _places(keys: np.ndarray, parts: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key's part of a filter and its two places in it."""
    h = mix(keys + U64(0x632BE59BD9B4E019))
    part = ((h >> U64(32)) * U64(parts)) >> U64(32)
    g = mix(h)
    return part.astype(np.int64), (g >> U64(32)) % U64(size), (g & U64(0xFFFFFFFF)) % U64(size)


class Bloom:
    """A filter of integers in equal parts; a key is looked up in one of them."""

    def __init__(self, parts: np.ndarray):
        self.parts = parts  # bytes of packed bits, a row for each part

    def may_hold(self, keys: np.ndarray) -> np.ndarray:
        """Which keys the filter may hold; all that it does are among them."""
        part, *places = _places(keys, len(self.parts), 8 * self.parts.shape[1])
        out = np.ones(len(keys), bool)
        for at in places:
            out &= (self.parts[part, (at >> U64(3)).astype(np.int64)] >> (U64(7) - (at & U64(7))).astype(np.uint8)) & 1 == 1
        return out


def bloom(keys: DataFrame, most_bits: int | None = None) -> Bloom:
    """A filter of the integers in a table of one column, with 16 bits for each row up to ``most_bits`` in all.

    The parts are filled where the keys are shuffled to; the driver only puts them together.
    """
    most_bits = BLOOM_BITS if most_bits is None else most_bits
    (name,) = keys.columns
    bits = max(64, min(16 * keys.count(), most_bits))
    parts = -(-bits // BLOOM_PART)
    size = 8 * -(-bits // (8 * parts))
    number = F.pandas_udf(lambda k: pd.Series(_places(k.to_numpy(np.int64).view(U64), parts, size)[0].astype(np.int32)), "int")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            part, *places = _places(batch.column("k").to_numpy().view(U64), parts, size)
            for p in np.unique(part):
                mine = held.setdefault(int(p), np.zeros(size, bool))
                for at in places:
                    mine[at[part == p]] = True
        if held:
            yield pa.record_batch([pa.array(list(held), pa.int32()), pa.array([np.packbits(x).tobytes() for x in held.values()], pa.binary())], ["part", "bits"])

    out = np.zeros((parts, size // 8), np.uint8)
    keyed = keys.where(F.col(name).isNotNull()).select(F.col(name).cast("long").alias("k"))
    for row in keyed.repartitionById(parts, number("k")).mapInArrow(fill, "part int, bits binary").toLocalIterator():
        out[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    return Bloom(out)


def may_be_in(ids: DataFrame, column: Column) -> Column:
    """Whether a filter of the ids, a table of one column, may hold the column."""
    known = ids.sparkSession.sparkContext.broadcast(bloom(ids))

    @F.pandas_udf("boolean")
    def hit(values: pd.Series) -> pd.Series:
        return pd.Series(known.value.may_hold(values.to_numpy(np.int64).view(U64)))

    return column.isNotNull() & hit(F.coalesce(column, F.lit(0)))
