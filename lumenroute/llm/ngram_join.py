"""N-gram Jaccard self-join with set-relation skipping.

Every document is the set of its distinct word n-grams, of words in normal form
(see ``kernel.normalised``); the join returns all pairs of documents whose sets
have Jaccard similarity of at least ``threshold``. Candidates come from prefix
filtering over a total order of the n-grams, which loses no pair, and each
candidate pair is verified on the whole sets. n-grams are told apart by hashes
of 46 bits: among two sets of a thousand, the chance that a hash stands for
two n-grams is about 10^-8. Equal sets are told apart by 128 bits.

1. *Order.* n-grams that are frequent are put last, so that a passage shared by
   thousands of documents stays out of their prefixes. Any order will do; the
   counts only say which n-grams are worth putting last, and the table of them
   that is broadcast has at most ``ORDER_TERMS`` entries whatever the input.
2. *Clusters.* Sets of about one size that agree in two min-hashes form a
   cluster, equal sets always do. A cluster enters the index once per n-gram,
   with the ranges of its members' sizes and positions.
3. *Index.* Posting lists are partitioned by n-gram, in as many parts as they
   fill. Within a list, entries are
   sorted by size and cut into blocks that carry their bounds on size and on
   position; block pairs whose bounds rule out the required overlap are
   skipped whole, then single entries are. A prefix is longer than it need be
   by ``SPARE``, so that sets over the threshold share several n-grams of their
   prefixes; a cluster pair that shares fewer is dropped.
4. *Answers.* Of equal sets one is shuffled, with the ids of all, and only if its
   cluster has a partner or other sets (by a Bloom filter). Each candidate
   cluster pair is verified where its larger cluster is, in blocks of
   ``Sizes.home`` bytes; the sets that a block is compared with pass by it in a
   stream, so a worker's memory depends on the size of neither cluster.
   The overlaps of one set of the block, the pivot, with those passing are counted
   once; every other one's are derived from the pivot's by the n-grams in
   which the two differ. Sets far from the pivot become pivots themselves.

The number of pairs grows with the square of the size of a group of copies.
``ngram_links`` verifies the same pairs of sets, but adds them up where they are
found, to how many pairs each document is in and to a spanning forest of them.

Edge cases: null and empty texts, and texts without a word, are empty sets and
pair with nothing. A text of fewer than n words has one n-gram, all its words.
Very long texts are sets like any other, of all their n-grams.
Repeated rows (the same id and text twice) count as one document; an id with
several texts pairs with other ids by each of them, a row for each qualifying
pair of texts, and never with itself. Rows with a null id are left out. Ties need no rule, as every pair at
or over the threshold is returned. Other columns are ignored whatever their
names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernel
from .cluster import prepare, shuffle_partitions
from .kernel import U64, mix

#: n-grams whose counts are broadcast at most (12 bytes each); only the order depends on it
ORDER_TERMS = 1 << 20
#: an n-gram counts as frequent from so many documents within one task
LOCAL_FREQUENT = 4
#: entries in a block of a posting list
BLOCK = 64
#: share of a set by which its prefix is longer than the shortest that finds every pair
SPARE = 0.02
#: members whose sets differ from the pivot's by more than this share become pivots
NEAR_PIVOT = 0.5


@dataclass(frozen=True)
class Sizes:
    """How the work is cut; the result doesn't depend on it."""

    #: bytes of postings in a part of the index
    part: int = 32 << 20
    #: bytes of sets in a block of a home cluster
    home: int = 8 << 20
    #: bytes of sets that are compared with such a block at once
    passing: int = 4 << 20
    #: pairs that a worker holds before it hands them on
    pairs: int = 200_000
    #: ids of a set whose pairs with the ids after them one row makes
    copies: int = 4096


_H = U64(46)
_LOW = U64((1 << 46) - 1)
_TOKEN = U64((1 << 51) - 1)
_POSTING = np.dtype([("w", "<u8"), ("c", "<u8"), ("n", "<u2"), ("i", "<u2")])
_BIG = 65535


def _ordered(raw: np.ndarray, at: np.ndarray, n: int, heavy: tuple[np.ndarray, np.ndarray] | None = None):
    """For runs of documents: their first number, set sizes, and all sets one after another in the global order."""
    for i, j, w in kernel.words(raw, at):
        gram, owner = kernel.ngrams(w, n)
        token = gram & _LOW
        key = (owner.astype(U64) << U64(51)) | token
        if heavy is not None and len(heavy[0]):
            found = np.searchsorted(heavy[0], token)
            found[found == len(heavy[0])] = 0
            hit = heavy[0][found] == token
            key[hit] |= heavy[1][found[hit]] << _H
        key.sort()
        if len(key):
            key = key[np.r_[True, key[1:] != key[:-1]]]
        sizes = np.bincount((key >> U64(51)).astype(np.int64), minlength=j - i)
        yield i, sizes, key & _TOKEN


def _clusters(sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A cluster key for each set, from two min-hashes; 0 for empty sets."""
    out = np.zeros(len(sizes), U64)
    some = sizes > 0
    if some.any():
        heads = np.r_[0, np.cumsum(sizes)][:-1][some]
        plain = tokens & _LOW
        a = np.minimum.reduceat(mix(plain + U64(0x51ED270B)), heads)
        b = np.minimum.reduceat(mix(plain ^ U64(0x2545F4914F6CDD1D)), heads)
        size = np.floor(np.log(sizes[some]) / np.log(1.2)).astype(U64)
        out[some] = mix(mix(a * U64(0x9E3779B97F4A7C15) + b) + size) | U64(1)
    return out


def _set_keys(sizes: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each set."""
    heads = np.cumsum(sizes) - sizes
    total = np.r_[U64(0), np.cumsum(mix(tokens & _LOW) + U64(0x5851F42D4C957F2D))]
    return mix(total[heads + sizes] - total[heads] + sizes.astype(U64))


def _frequent(n: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, postings = [], 0, 0

        def flush():
            token, count = np.unique(np.concatenate(held), return_counts=True)
            often = count >= LOCAL_FREQUENT
            return pa.record_batch([pa.array(token[often].view(np.int64)), pa.array(count[often])], ["w", "df"])

        for batch in kernel.split_rows(batches, "text"):
            for _, sizes, tokens in _ordered(*kernel.utf8(kernel.normalised(batch.column("text"))), n):
                held.append(tokens)
                size += len(tokens)
                postings += int(_prefix(sizes, threshold).sum())
            if size > 4_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
        yield pa.record_batch([pa.array([-1]), pa.array([postings])], ["w", "df"])

    return run


def frequent_grams(docs: DataFrame, n: int, threshold: float) -> tuple[tuple[np.ndarray, np.ndarray], int]:
    """The most frequent n-grams over all documents and their classes 1..31, by hash; and the number of all postings."""
    top = (
        docs.mapInArrow(_frequent(n, threshold), "w long, df long").groupBy("w").agg(F.sum("df").alias("df"))
        .orderBy(F.col("w") >= 0, F.desc("df"), "w").limit(ORDER_TERMS + 1).toPandas()
    )
    postings = int(top.loc[top["w"] < 0, "df"].sum())
    top = top[top["w"] >= 0]
    token = top["w"].to_numpy(np.int64).view(U64)
    level = np.minimum(1 + 2 * np.log2(np.maximum(top["df"].to_numpy(np.float64), 1)), 31).astype(U64)
    order = np.argsort(token)
    return (token[order], level[order]), postings


def _postings(n: int, threshold: float, parts: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, order = [], 0, heavy.value
        seen: set[int] = set()

        def flush():
            rows = np.concatenate(held)
            part = (mix(rows["w"]) >> U64(40)) % U64(parts)
            rows = rows[np.lexsort((rows["w"], part))]
            ends = np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))
            begins = np.r_[0, ends[:-1]]
            some = np.flatnonzero(ends > begins)
            blobs = [rows[begins[k] : ends[k]].tobytes() for k in some]
            return pa.record_batch([pa.array(some.astype(np.int32)), pa.array(blobs, pa.binary())], ["part", "blob"])

        for batch in kernel.split_rows(batches, "text"):
            for _, sizes, tokens in _ordered(*kernel.utf8(kernel.normalised(batch.column("text"))), n, order):
                c = _clusters(sizes, tokens)
                new = np.zeros(len(sizes), bool)  # sets equal to one before in this task have the same postings
                for k, key in enumerate(_set_keys(sizes, tokens).tolist()):
                    if key not in seen:
                        seen.add(key)
                        new[k] = True
                pos = np.arange(len(tokens)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                keep = pos < np.repeat(np.where(new, _prefix(sizes, threshold), 0), sizes)
                rows = np.empty(int(keep.sum()), _POSTING)
                rows["w"], rows["c"] = tokens[keep], np.repeat(c, sizes)[keep]
                rows["n"], rows["i"] = np.minimum(np.repeat(sizes, sizes)[keep], _BIG), np.minimum(pos[keep], _BIG)
                held.append(rows)
                size += len(rows)
            if size > 3_000_000:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return run


def spare(n, t: float):
    """Length of the prefix of a set of n, less n: the prefixes of sets over the threshold share this many, and their overlap, at least."""
    return 1 + np.floor(SPARE * n) - np.ceil(t * n - 1e-9)


def _prefix(sizes: np.ndarray, t: float) -> np.ndarray:
    return np.minimum(sizes + spare(sizes, t), sizes)


def least_spare(lo, hi, t: float):
    """The least of spare() over the sizes lo..hi.

    It falls with n but for a step up at each multiple of 1 / SPARE, and its
    values just before the steps all rise or all fall, so the ends and the
    first and last steps are enough.
    """
    steps = [np.ceil(lo * SPARE), np.floor(lo * SPARE) + 1, np.floor(hi * SPARE)]
    near = [np.round(s / SPARE) - back for s in steps for back in (0, 1)]
    return np.minimum.reduce([spare(np.clip(n, lo, hi), t) for n in (lo, hi, *near)])


def _possible(t: float, a, b):
    """Whether sets within these bounds (sizes from, to; positions from, to) can reach the threshold where both have an n-gram.

    Of the common n-grams, at most the lower position's number come before this one.
    """
    lo_a, hi_a, first_a, last_a = a
    lo_b, hi_b, first_b, last_b = b
    most = np.minimum(hi_a - first_a, hi_b - first_b) + np.minimum(last_a, last_b)
    return (lo_b * t <= hi_a + 1e-6) & (lo_a * t <= hi_b + 1e-6) & (most >= t / (1 + t) * (lo_a + lo_b) - 1e-6)


def candidate_pairs(rows: np.ndarray, t: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Cluster pairs that share n-grams of ``rows`` within the bounds on size and position.

    Returns both keys, how many n-grams they share here, and how many they must share in all.
    """
    none = np.zeros(0, U64), np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(rows):
        return none
    rows = rows[np.lexsort((rows["c"], rows["w"]))]
    heads = np.flatnonzero(np.r_[True, (rows["w"][1:] != rows["w"][:-1]) | (rows["c"][1:] != rows["c"][:-1])])
    w, c = rows["w"][heads], rows["c"][heads]
    bounds = np.stack([f.reduceat(rows[k].astype(np.float64), heads) for f, k in ((np.minimum, "n"), (np.maximum, "n"), (np.minimum, "i"), (np.maximum, "i"))])
    bounds[1::2][bounds[1::2] == _BIG] = np.inf
    with np.errstate(invalid="ignore"):
        own = np.where(np.isfinite(bounds[1]), np.minimum(least_spare(bounds[0], bounds[1], t), 0), -np.inf)
    list_heads = np.flatnonzero(np.r_[True, w[1:] != w[:-1]])
    lengths = np.diff(np.r_[list_heads, len(w)])
    found: list[tuple[np.ndarray, ...]] = []
    waiting = 0

    def keep(x, y):
        nonlocal waiting
        ok = _possible(t, bounds[:, x], bounds[:, y])
        x, y = x[ok], y[ok]
        need = np.minimum(own[x], own[y]) + t / (1 + t) * (bounds[0, x] + bounds[0, y])
        a, b = c[x], c[y]
        found.append((np.minimum(a, b), np.maximum(a, b), np.ones(len(a), np.int64), np.ceil(np.maximum(need, 1) - 1e-6).astype(np.int64)))
        waiting += len(a)
        if waiting > 3_000_000:
            compact()

    def compact():
        nonlocal waiting
        a, b, shared, need = (np.concatenate(x) for x in zip(*found, strict=True))
        o = np.lexsort((b, a))
        a, b, shared, need = a[o], b[o], shared[o], need[o]
        new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
        found[:] = [(a[new], b[new], np.add.reduceat(shared, new), np.minimum.reduceat(need, new))] if len(a) else [none]
        waiting = 0

    for length in np.unique(lengths):
        if length < 2:
            continue
        starts = list_heads[lengths == length]
        if length <= BLOCK:
            x, y = np.triu_indices(int(length), 1)
            step = max(1, 1_000_000 // len(x))
            for k in range(0, len(starts), step):
                s = starts[k : k + step, None]
                keep((s + x).ravel(), (s + y).ravel())
            continue
        for s in starts:
            here = np.arange(s, s + length)
            here = here[np.lexsort((bounds[2, here], bounds[1, here], bounds[0, here]))]
            cut = np.arange(0, length, BLOCK)
            block = np.stack([f.reduceat(bounds[k, here], cut) for k, f in enumerate((np.minimum, np.maximum, np.minimum, np.maximum))])
            number = np.arange(length) // BLOCK
            for p in range(len(cut)):
                ahead = _possible(t, block[:, p : p + 1], block)
                ahead[:p] = False
                other = np.flatnonzero(ahead[number])
                mine = np.arange(p * BLOCK, min((p + 1) * BLOCK, length))
                x, y = np.repeat(mine, len(other)), np.tile(other, len(mine))
                keep(here[x[x < y]], here[y[x < y]])
    if not found:
        return none
    compact()
    return found[0]


def _candidates(t: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_part: dict[int, list[bytes]] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("blob"), strict=True):
                by_part.setdefault(part, []).append(blob.as_py())
        for part in list(by_part):
            found = candidate_pairs(np.frombuffer(b"".join(by_part.pop(part)), _POSTING), t)
            for k in range(0, len(found[0]), 300_000):
                yield pa.record_batch([pa.array(x[k : k + 300_000].view(np.int64)) for x in found], ["a", "b", "shared", "need"])

    return run


def _members(n: int):
    """(c, s, size, doc_id) of every set: cluster, hash of the set, number of n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.split_rows(batches, "text"):
            for i, sizes, tokens in _ordered(*kernel.utf8(kernel.normalised(batch.column("text"))), n):
                some = np.flatnonzero(sizes)
                yield pa.record_batch([
                    pa.array(_clusters(sizes, tokens)[some].view(np.int64)), pa.array(_set_keys(sizes, tokens)[some].view(np.int64)),
                    pa.array(sizes[some].astype(np.int64)), batch.column("doc_id").take(pa.array(i + some)),
                ], ["c", "s", "size", "doc_id"])

    return run


def _sets(n: int, wanted):
    """(c, s, doc_id, grams) of the sets that the filter may hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in kernel.split_rows(batches, "text", 4 << 20):
            ids = batch.column("doc_id").to_numpy()
            for i, sizes, tokens in _ordered(*kernel.utf8(kernel.normalised(batch.column("text"))), n):
                key = _set_keys(sizes, tokens)
                pick = np.flatnonzero(wanted.value.may_hold(key ^ ids[i : i + len(sizes)].view(U64)) & (sizes > 0))
                if len(pick):
                    ends = np.cumsum(sizes)
                    blobs = [tokens[ends[k] - sizes[k] : ends[k]].tobytes() for k in pick]
                    yield pa.record_batch([pa.array(_clusters(sizes, tokens)[pick].view(np.int64)), pa.array(key[pick].view(np.int64)), pa.array(ids[i + pick]), pa.array(blobs, pa.binary())], ["c", "s", "doc_id", "grams"])

    return run


def overlaps(home: list[np.ndarray], other: list[np.ndarray]) -> Iterator[tuple[int, np.ndarray]]:
    """For each set of ``home``, its overlap with every set of ``other``.

    The pivot's overlaps are counted from its own n-grams; those of a set near
    it are the pivot's, less the postings of n-grams that only the pivot has,
    plus the postings of n-grams that only the set has.
    """
    m = len(other)
    flat = np.concatenate(other)
    owner = np.repeat(np.arange(m), [len(x) for x in other])
    vocabulary, code = np.unique(flat, return_inverse=True)
    rank = np.argsort(code, kind="stable")
    posting, ends = owner[rank], np.cumsum(np.bincount(code, minlength=len(vocabulary)))
    begins = np.r_[0, ends[:-1]]

    def known(x: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(vocabulary, x), len(vocabulary) - 1)
        return at[vocabulary[at] == x]

    def count(codes: np.ndarray) -> np.ndarray:
        size = ends[codes] - begins[codes]
        total = int(size.sum())
        if not total:
            return np.zeros(m, np.int64)
        at = np.repeat(begins[codes] - (np.cumsum(size) - size), size) + np.arange(total)
        return np.bincount(posting[at], minlength=m)

    mark = np.zeros(len(vocabulary), bool)
    pivot = answer = None
    for k, x in enumerate(home):
        codes = known(x)
        if pivot is not None:
            mark[pivot] = True
            shared = mark[codes]
            plus = codes[~shared]
            mark[codes] = False
            minus = pivot[mark[pivot]]
            mark[pivot] = False
            if len(plus) + len(minus) <= NEAR_PIVOT * len(codes):
                yield k, answer + count(plus) - count(minus)
                continue
        pivot, answer = codes, count(codes)
        yield k, answer


Pairs = tuple[np.ndarray, np.ndarray, np.ndarray]


def _products(x: np.ndarray, y: np.ndarray, j: np.ndarray, piece: int) -> Iterator[Pairs]:
    """Every id of x with every id of y, in pieces, as a < b with y's similarity; an id doesn't pair with itself."""
    for b in range(0, len(y), piece):
        part, jac = y[b : b + piece], j[b : b + piece]
        step = max(1, piece // len(part))
        for a in range(0, len(x), step):
            left = np.repeat(x[a : a + step], len(part))
            right, value = np.tile(part, len(left) // len(part)), np.tile(jac, len(left) // len(part))
            apart = left != right
            yield np.minimum(left, right)[apart], np.maximum(left, right)[apart], value[apart]


class Home:
    """A block of a home cluster: its own sets, and the qualifying pairs of them and of those that pass by.

    ``forest`` returns a spanning forest of those pairs instead of all.
    """

    def __init__(self, sets: list[bytes], docs: list[np.ndarray], t: float, forest: bool, piece: int):
        order = sorted(range(len(sets)), key=sets.__getitem__)
        self.sets, self.docs = [np.frombuffer(sets[k], U64) for k in order], [docs[k] for k in order]
        self.t, self.forest, self.piece = t, forest, piece
        self.label = np.arange(len(order))
        self.alone = True

    def compared(self, docs: list) -> list:
        """What the block is compared with: these, and, the first time, its own sets before them."""
        return self.docs + docs if self.alone else docs

    def similar(self, sets: list[bytes]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """For each set of the block which of those compared are similar, by how much, and, with ``forest``, which of them it takes to connect them."""
        other = [np.frombuffer(x, U64) for x in sets]
        own = len(self.sets) if self.alone else 0
        self.alone = False
        if own:
            other = self.sets + other
        if not other or (own == 1 and len(other) == 1):
            return
        size = np.array([len(x) for x in other])
        m = len(self.sets)
        label = np.r_[self.label, m + np.arange(len(other) - own)]  # of the block's sets and those passing by
        place = np.r_[np.arange(own), np.arange(m, m + len(other) - own)]
        for k, common in overlaps(self.sets, other):
            jac = common / (len(self.sets[k]) + size - common)
            if own:
                jac[: k + 1] = 0
            hit = np.flatnonzero(jac >= self.t - 1e-12)
            tree = hit
            if self.forest:
                tree = hit[label[place[hit]] != label[k]]
                tree = tree[np.unique(label[place[tree]], return_index=True)[1]]
                label[np.isin(label, label[place[tree]])] = label[k]
            if len(hit):
                yield k, hit, jac, tree
        self.label = label[:m]

    def meet(self, sets: list[bytes], docs: list[np.ndarray]) -> Iterator[Pairs]:
        """The pairs with these sets, and, the first time, those within the block."""
        ids = self.compared(docs)
        copies = np.array([len(d) for d in ids], np.int64)
        flat, at = np.concatenate([*ids, np.zeros(0, np.int64)]), np.cumsum(copies) - copies
        for k, _, jac, hit in self.similar(sets):
            if len(hit):
                n = copies[hit]
                y = flat[np.repeat(at[hit] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
                yield from _products(self.docs[k], y, np.repeat(jac[hit], n), self.piece)


class Holders(NamedTuple):
    """The documents of a set: its cluster and hash, their least id, how many they are, and the ids that have other sets too."""

    c: int
    s: int
    least: int
    copies: int
    several: np.ndarray


#: rows that Links makes: an edge of the forest between ids a and b; links of each document of set (a, b); links of the id a
EDGE, OF_SET, OF_ID = 0, 1, 2


class Links(Home):
    """A block of a home cluster that counts its pairs instead of listing them.

    Two similar sets give each document of the one as many links as the other
    has documents. An id that has both is not its own partner, on either side.
    """

    def meet(self, sets: list[bytes], docs: list[Holders]) -> Iterator[tuple[np.ndarray, ...]]:
        met = self.compared(docs)
        copies, least = np.array([d.copies for d in met], np.int64), np.array([d.least for d in met], np.int64)
        several = np.array([len(d.several) > 0 for d in met], bool)
        mine, theirs = np.zeros(len(self.docs), np.int64), np.zeros(len(met), np.int64)
        ends: list[tuple[np.ndarray, np.ndarray]] = []
        for k, hit, _, tree in self.similar(sets):
            one = self.docs[k]
            mine[k] += copies[hit].sum()
            theirs[hit] += one.copies
            if len(tree):
                ends.append((np.full(len(tree), one.least), least[tree]))
            if len(one.several):
                for j in hit[several[hit]]:
                    both = np.intersect1d(one.several, met[j].several)
                    yield _links(OF_ID, both, both, -2)
        if ends:
            yield _links(EDGE, *map(np.concatenate, zip(*ends, strict=True)), 0)
        for of, links in ((self.docs, mine), (met, theirs)):
            some = np.flatnonzero(links)
            yield _links(OF_SET, np.array([of[k].c for k in some], np.int64), np.array([of[k].s for k in some], np.int64), links[some])


def _links(what: int, a: np.ndarray, b: np.ndarray, links) -> tuple[np.ndarray, ...]:
    return np.full(len(a), what, np.int32), a, b, np.broadcast_to(np.asarray(links, np.int64), len(a))


def _verify(t: float, kind: str, sizes: Sizes):
    """Pairs, or links, from sets sorted by home and block, a block's own sets first."""
    block, pack = (Links, _counted) if kind == "links" else (Home, _pairs)
    forest = kind != "pairs"

    def holders(batch: pa.RecordBatch) -> Iterator[np.ndarray | Holders]:
        ids = batch.column("ids")
        flat, at = ids.flatten().to_numpy(), np.r_[0, np.cumsum(pc.list_value_length(ids).to_numpy())]
        listed = (flat[at[k] : at[k + 1]].copy() for k in range(batch.num_rows))
        return map(Holders, *(batch.column(c).to_pylist() for c in ("c", "s", "least", "copies")), listed) if kind == "links" else listed

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, ...]]:
        key = home = last = None
        sets: list[bytes] = []
        docs: list = []
        waiting, filling = 0, True

        def settle():
            nonlocal home, sets, docs, waiting
            if filling:
                home = block(sets, docs, t, forest, sizes.pairs)
                sets, docs = [], []
            yield from home.meet(sets, docs)
            sets, docs, waiting = [], [], 0

        for batch in batches:
            grams = batch.column("grams")
            for k, (h, i, own, s, held) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("home", "i", "own", "s")), holders(batch), strict=True)):
                if last == (h, i, own, s):  # of a repeated row
                    continue
                last = h, i, own, s
                if key != (h, i):
                    if key is not None:
                        yield from settle()
                    key, filling = (h, i), True
                if filling and not own:
                    home, filling = block(sets, docs, t, forest, sizes.pairs), False
                    sets, docs, waiting = [], [], 0
                sets.append(grams[k].as_py())
                docs.append(held)
                waiting += len(sets[-1])
                if not filling and waiting > sizes.passing:
                    yield from settle()
        if key is not None:
            yield from settle()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for piece in pieces(batches):
            held.append(piece)
            rows += len(piece[0])
            if rows > sizes.pairs:
                yield pack(held)
                held, rows = [], 0
        if rows:
            yield pack(held)

    return run


def _counted(held: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["what", "a", "b", "links"])


def _pairs(held: list[Pairs]) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.concatenate(x)) for x in zip(*held, strict=True)], ["doc_a", "doc_b", "jaccard"])


def _copies(size: int, piece: int):
    """The pairs of ids of equal sets: each of ``size`` ids from ``first`` on with all after it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, rows = [], 0
            for ids, first in zip(batch.column("ids"), batch.column("first").to_pylist(), strict=True):
                d = np.sort(ids.values.to_numpy())
                stop = min(first + size, len(d))
                step = max(1, piece // len(d))
                for k in range(first, stop, step):
                    x, y = np.meshgrid(np.arange(k, min(k + step, stop)), np.arange(k + 1, len(d)), indexing="ij")
                    keep = x < y
                    held.append((d[x[keep]], d[y[keep]], np.ones(int(keep.sum()))))
                    rows += len(held[-1][0])
                    if rows > piece:
                        yield _pairs(held)
                        held, rows = [], 0
            if rows:
                yield _pairs(held)

    return run


def _compared(docs: DataFrame, n: int, threshold: float, kind: str, cut: Sizes) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What ``kind`` asks for of the pairs of different sets ("pairs", "forest" or "links"), every document's sets, and all sets."""
    if not 0 < threshold <= 1 or n < 1:
        raise ValueError("threshold must be in (0, 1] and n at least 1")
    spark: SparkSession = docs.sparkSession
    prepare(spark)
    least = shuffle_partitions(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    texts = base.select("text")

    heavy, postings = frequent_grams(texts, n, threshold)
    heavy = spark.sparkContext.broadcast(heavy)
    parts = max(least, -(-postings * _POSTING.itemsize // cut.part))
    pairs = (
        texts.mapInArrow(_postings(n, threshold, parts, heavy), "part int, blob binary")
        .repartitionById(parts, F.col("part"))
        .mapInArrow(_candidates(threshold), "a long, b long, shared long, need long")
        .groupBy("a", "b")
        .agg(F.sum("shared").alias("shared"), F.min("need").alias("need"))
        .where("shared >= need")
        .select("a", "b")
        .checkpoint()
    )
    members = base.mapInArrow(_members(n), "c long, s long, size long, doc_id long")
    # a forest needs one id of equal sets, and is spared the list of all of them; links need their number, and the ids that have several sets
    if kind == "links":
        members = members.distinct().checkpoint()
        several = members.groupBy("doc_id").count().where("count > 1").select("doc_id", F.lit(True).alias("several"))
        known = members.join(several, "doc_id", "left")
        ids = [F.collect_list(F.when(F.col("several"), F.col("doc_id"))).alias("ids"), F.count("*").alias("copies")]
    else:
        known = members = members.checkpoint()
        ids = [(F.array(F.min("doc_id")) if kind == "forest" else F.collect_set("doc_id")).alias("ids"), F.lit(None).cast("long").alias("copies")]
    sets = known.groupBy("c", "s").agg(F.min("size").alias("size"), F.min("doc_id").alias("least"), *ids).checkpoint()

    clusters = sets.groupBy("c").agg(F.count("*").alias("k"), F.sum("size").alias("size"))
    sized = (
        pairs.join(clusters.select(F.col("c").alias("a"), F.col("size").alias("na")), "a")
        .join(clusters.select(F.col("c").alias("b"), F.col("size").alias("nb")), "b")
        .select(F.when(F.expr("na >= nb"), F.struct("a", "b")).otherwise(F.struct(F.col("b").alias("a"), F.col("a").alias("b"))).alias("p"))
        .select(F.col("p.a").alias("home"), F.col("p.b").alias("c"))
    )
    homes = clusters.where("k > 1").select(F.col("c").alias("home")).union(sized.select("home")).distinct()
    blocks = homes.join(clusters.select(F.col("c").alias("home"), F.ceil(F.col("size") * 8 / cut.home).cast("int").alias("blocks")), "home")
    goes = sized.unionAll(homes.select("home", F.col("home").alias("c"))).join(blocks, "home")
    # a set goes to all blocks of another cluster's home; of its own cluster's, to its own block and those before it
    block = F.pmod("s", "blocks").cast("int")
    shipped = (
        goes.join(sets, "c").withColumn("own", F.col("home") == F.col("c"))
        .withColumn("i", F.explode(F.sequence(F.lit(0), F.when(F.col("own"), block).otherwise(F.col("blocks") - 1))))
        .select("c", "s", "least", "size", "ids", "home", "i", (F.col("own") & (F.col("i") == block)).alias("own"), "copies")
        .checkpoint()
    )
    wanted = spark.sparkContext.broadcast(kernel.bloom(shipped.select(F.col("s").bitwiseXOR(F.col("least")).alias("k")).distinct().checkpoint()))
    total = shipped.agg(F.sum("size")).first()[0] or 0
    found = (
        base.mapInArrow(_sets(n, wanted), "c long, s long, doc_id long, grams binary")
        .join(shipped.withColumnRenamed("least", "doc_id"), ["c", "s", "doc_id"])
        .repartition(max(least, -(-total * 8 // cut.part)), "home", "i")
        .sortWithinPartitions("home", "i", F.desc("own"), "s")
        .select("home", "i", "own", "s", "ids", "grams", "c", F.col("doc_id").alias("least"), "copies")
        .mapInArrow(_verify(threshold, kind, cut), "what int, a long, b long, links long" if kind == "links" else "doc_a long, doc_b long, jaccard double")
    )
    return found, members, sets


def _equal(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Of equal sets the pairs of the least id with all others."""
    return members.join(sets.select("c", "s", "least"), ["c", "s"]).where("doc_id > least").select(F.col("least").alias("doc_a"), F.col("doc_id").alias("doc_b"), F.lit(1.0).alias("jaccard")).distinct()


def ngram_jaccard_join(docs: DataFrame, n: int = 3, threshold: float = 0.6, forest: bool = False, cut: Sizes = Sizes()) -> DataFrame:
    """All pairs (doc_a < doc_b, jaccard) at or over the threshold.

    With ``forest``, only enough of the pairs to connect each group of
    documents. See the module for the method and the edge cases.
    """
    found, members, sets = _compared(docs, n, threshold, "forest" if forest else "pairs", cut)
    if forest:
        return found.unionAll(_equal(members, sets))
    several = sets.where("size(ids) > 1").select("ids")
    many = several.where(F.size("ids") > cut.copies).select("ids", F.explode(F.sequence(F.lit(0), F.size("ids") - 1, F.lit(cut.copies))).alias("first")).repartition("first", "ids")
    equal = several.where(F.size("ids") <= cut.copies).select("ids", F.lit(0).alias("first")).unionAll(many).mapInArrow(_copies(cut.copies, cut.pairs), "doc_a long, doc_b long, jaccard double")
    return found.unionAll(equal)


def ngram_links(docs: DataFrame, n: int = 3, threshold: float = 0.6, cut: Sizes = Sizes()) -> tuple[DataFrame, DataFrame]:
    """Pairs (doc_a, doc_b) that connect each group of documents, and (doc_id, links): in how many rows of the join each id is.

    The links are of every id with a set, also those that are in none. No pair is left out of the count; none is listed for it.
    """
    found, members, sets = _compared(docs, n, threshold, "links", cut)
    found = found.checkpoint()
    edges = found.where(F.col("what") == EDGE).select(F.col("a").alias("doc_a"), F.col("b").alias("doc_b")).unionAll(_equal(members, sets).drop("jaccard"))
    other = found.where(F.col("what") == OF_SET).groupBy(F.col("a").alias("c"), F.col("b").alias("s")).agg(F.sum("links").alias("other"))
    each = sets.join(other, ["c", "s"], "left").select("c", "s", (F.col("copies") - 1 + F.coalesce("other", F.lit(0))).alias("links"))
    links = members.join(each, ["c", "s"]).select("doc_id", "links").unionAll(found.where(F.col("what") == OF_ID).select("a", "links"))
    return edges, links.groupBy("doc_id").agg(F.sum("links").alias("links"))
