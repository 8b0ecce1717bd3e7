"""Comparison of all rows of two tables by numpy, in packed blocks.

Rows are dealt into blocks of about ``ROWS``, each one row with an Arrow stream
of bytes. The blocks of the two sides are laid in partitions that meet as a
Cartesian product, so that each task holds a few blocks of either side,
whatever the size of the tables, and nothing is broadcast or copied on disk.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: rows of a block, blocks of one side in a task, partitions of one side where there are blocks for them
ROWS, IN_TASK, LEAST = 4096, 8, 6
#: pairs compared at once, columns of which only the least is looked at first
PAIRS, RUN = 1 << 17, 64


def packed(rows: DataFrame, name: str, size: int = ROWS, alone: bool | None = None) -> DataFrame:
    """(name, name_data): the rows in blocks, laid in partitions of ``IN_TASK``; or each alone, or all in one partition."""
    blocks = max(1, -(-rows.count() // size))
    parts = min(blocks, max(LEAST, -(-blocks // IN_TASK))) if alone is None else blocks if alone else 1

    def pack(key: tuple, table: pa.Table) -> pa.Table:
        sink = pa.BufferOutputStream()
        table = table.drop_columns(["_block"]).combine_chunks()
        with pa.ipc.new_stream(sink, table.schema) as out:
            out.write_table(table)
        return pa.table({name: pa.array([key[0].as_py()], pa.int32()), f"{name}_data": pa.array([sink.getvalue().to_pybytes()], pa.binary())})

    dealt = rows.withColumn("_block", F.pmod(F.xxhash64(*rows.columns), F.lit(blocks)).cast("int"))
    return dealt.groupBy("_block").applyInArrow(pack, f"{name} int, {name}_data binary").repartitionById(parts, F.col(name) % parts)


def unpacked(data: pa.Scalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all().combine_chunks()


def compared(left: DataFrame, right: DataFrame, read_left: Callable, read_right: Callable, compare: Callable, result: Callable, schema: str, alone: int | None = None) -> DataFrame:
    """The results of all blocks of the left side, each after it met the blocks of one partition of the right side.

    ``compare`` gets what ``read_left`` and ``read_right`` made of two blocks
    and keeps in the left one what it found; ``result`` gives this as a record batch.
    With ``alone``, each block of so many rows of the left side meets all of the right side in one task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lefts: dict = {}
        rights: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = batch.column(0)[i].as_py(), batch.column(2)[i].as_py()
                if a not in lefts:
                    lefts[a] = read_left(unpacked(batch.column(1)[i]))
                if b not in rights:
                    if len(rights) >= 2 * IN_TASK:
                        rights.pop(next(iter(rights)))
                    rights[b] = read_right(unpacked(batch.column(3)[i]))
                compare(lefts[a], rights[b])
        for a in lefts.values():
            yield result(a)

    sides = (packed(left, "_l"), packed(right, "_r")) if alone is None else (packed(left, "_l", alone, True), packed(right, "_r", ROWS, False))
    pairs = sides[0].crossJoin(sides[1].hint("shuffle_replicate_nl"))
    return pairs.select("_l", "_l_data", "_r", "_r_data").mapInArrow(run, schema)


class Vectors:
    """A block of vectors in the order of their ids; nulls are marked, and where all rows are plain numbers there is a matrix for products."""

    def __init__(self, table: pa.Table) -> None:
        ids, lists = table.column(0).to_numpy(), table.column(1).combine_chunks()
        order = np.argsort(ids, kind="stable")
        lengths = np.nan_to_num(lists.value_lengths().to_numpy(zero_copy_only=False)).astype(np.int64)
        flat = lists.flatten()
        self.ids, self.width = ids[order], int(lengths.max(initial=0))
        x, known = np.zeros((len(ids), self.width)), np.zeros((len(ids), self.width), bool)
        where = np.arange(self.width)[None, :] < lengths[:, None]
        x[where] = flat.cast(pa.float64()).fill_null(0.0).to_numpy(zero_copy_only=False)
        known[where] = flat.is_valid().to_numpy(zero_copy_only=False)
        self.x, self.known = x[order], known[order]
        with np.errstate(all="ignore"):
            self.norm = (self.x * self.x).sum(1)
        self.plain = self.known.all(1) & (self.norm < 1e30)
        self.cls, self.d, self.item = np.full(len(ids), 9, np.int8), np.zeros(len(ids)), np.zeros(len(ids), np.int64)

    def widened(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        more = ((0, 0), (0, width - self.width))
        return (self.x, self.known) if width == self.width else (np.pad(self.x, more), np.pad(self.known, more))

    def product(self, scale: float, squares: bool) -> np.ndarray:
        """Vectors in single precision with one more component, so that a product of two sides is the right one's square less twice the product."""
        x = np.where(self.plain[:, None], self.x, 0.0)
        last = np.where(self.plain, self.norm, np.inf) if squares else np.ones(len(x))
        return np.concatenate([x * scale, last[:, None]], 1).astype(np.float32)


def _distances(a: np.ndarray, a_known: np.ndarray, b: np.ndarray, b_known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Squared distances of rows, summed in the order of the components, and their class: 0 a number, 1 NaN, 2 null; null components don't count."""
    d, n = np.zeros(len(a)), np.zeros(len(a), np.int64)
    if a_known.all() and b_known.all() and a.shape[1]:
        with np.errstate(all="ignore"):
            for step in np.ascontiguousarray((a - b).T):
                d += step * step
        return d, np.isnan(d).astype(np.int8)
    with np.errstate(all="ignore"):
        for k in range(a.shape[1]):
            both = a_known[:, k] & b_known[:, k]
            step = a[:, k] - b[:, k]
            d += np.where(both, step * step, 0.0)
            n += both
    return d, np.where(n == 0, 2, np.where(np.isnan(d), 1, 0)).astype(np.int8)


def nearer(a: Vectors, b: Vectors, tile: int = 128) -> None:
    """Keep in ``a`` the nearest of ``b`` by squared distance, then id, where it is nearer than the one before; equal ids don't count.

    Products in single precision leave out what can't be the nearest, by a
    bound on their rounding; what is left is compared in double precision.
    """
    width = max(a.width, b.width)
    (ax, ak), (bx, bk) = a.widened(width), b.widened(width)
    found: list = []

    def verify(i: np.ndarray, j: np.ndarray) -> None:
        for s in range(0, len(i), PAIRS):
            r, c = i[s : s + PAIRS], j[s : s + PAIRS]
            other = a.ids[r] != b.ids[c]
            r, c = r[other], c[other]
            d, cls = _distances(ax[r], ak[r], bx[c], bk[c])
            d[cls > 0] = 0.0
            order = np.lexsort((b.ids[c], d, cls, r))
            r, c, d, cls = r[order], c[order], d[order], cls[order]
            first = np.ones(len(r), bool)
            first[1:] = r[1:] != r[:-1]
            r, item, d, cls = r[first], b.ids[c[first]], d[first], cls[first]
            old = (a.cls[r], a.d[r], a.item[r])
            better = (cls < old[0]) | ((cls == old[0]) & ((d < old[1]) | ((d == old[1]) & (item < old[2]))))
            a.cls[r[better]], a.d[r[better]], a.item[r[better]] = cls[better], d[better], item[better]

    def settle() -> None:
        if found:
            verify(*(np.concatenate(x) for x in zip(*found, strict=True)))
            found.clear()

    def every(rows: np.ndarray, columns: np.ndarray) -> None:
        step = max(1, PAIRS // max(1, len(columns)))
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            verify(np.repeat(part, len(columns)), np.tile(columns, len(part)))

    if a.width != b.width or not (a.plain.any() and b.plain.any()):
        return every(np.arange(len(a.ids)), np.arange(len(b.ids)))
    if not hasattr(a, "left"):
        a.left = a.product(-2.0, False)
    if not hasattr(b, "right"):
        right = b.product(1.0, True)
        empty = np.zeros((-len(right) % RUN, right.shape[1]), np.float32)
        empty[:, -1] = np.inf
        b.right, b.most = np.ascontiguousarray(np.concatenate([right, empty]).T), b.norm[b.plain].max()
    low, high = np.searchsorted(b.ids, a.ids, "left"), np.searchsorted(b.ids, a.ids, "right")
    scores = np.empty((tile, b.right.shape[1]), np.float32)
    rows = np.flatnonzero(a.plain)
    error = (width + 20) * 2.0**-23 * (a.norm + 2 * b.most) + 1e-37
    for s in range(0, len(rows), tile):
        r = rows[s : s + tile]
        with np.errstate(all="ignore"):
            got = np.matmul(a.left[r], b.right, out=scores[: len(r)])
        for k in np.flatnonzero(high[r] > low[r]):
            got[k, low[r[k]] : high[r[k]]] = np.inf
        runs = got.reshape(len(r), -1, RUN).min(2)
        least = runs.min(1).astype(np.float64)
        most = np.minimum(least + 2 * error[r], np.where(a.cls[r] == 0, a.d[r] - a.norm[r] + error[r], np.inf))
        most[~np.isfinite(least) | (least > most)] = -np.inf
        # rounded up, as the comparison is in single precision
        limit = np.nextafter(most.astype(np.float32), np.float32(np.inf))
        limit[most == -np.inf] = -np.inf
        i, run = np.nonzero(runs <= limit[:, None])
        k, j = np.nonzero(got.reshape(len(r), -1, RUN)[i, run] <= limit[i, None])
        found.append((r[i[k]], run[k] * RUN + j))
        if sum(len(x) for x, _ in found) > PAIRS:
            settle()
    settle()
    every(np.flatnonzero(~a.plain), np.arange(len(b.ids)))
    every(rows, np.flatnonzero(~b.plain))


def nearest_of(a: Vectors) -> pa.RecordBatch:
    found = a.cls < 9
    cls = a.cls[found]
    values = np.where(cls == 1, np.nan, a.d[found])
    return pa.record_batch([pa.array(a.ids[found]), pa.array(cls.astype(np.int32)), pa.array(values, mask=cls == 2), pa.array(a.item[found])], ["_probe", "_class", "_d", "_item"])


class Words:
    """A block of hashes of 64 bits (columns: id, word and, for items, score and group), in the order of group, score from the highest, and id."""

    def __init__(self, table: pa.Table) -> None:
        ids = table.column(0).to_numpy()
        n = len(ids)
        items = table.num_columns > 2
        score = table.column(2).to_numpy() if items else np.zeros(n, np.int64)
        group = table.column(3).combine_chunks() if items else pa.nulls(n)
        codes = group.dictionary_encode(null_encoding="encode").indices.to_numpy() if items else np.zeros(n, np.int32)
        order = np.lexsort((ids, -score, codes))
        self.ids, self.words, self.score, self.group = ids[order], table.column(1).to_numpy()[order].view(np.uint64), score[order], group.take(pa.array(order))
        codes = codes[order]
        self.starts = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
        self.by_id = np.argsort(self.ids, kind="stable")
        rank = np.unique(-self.score, return_inverse=True)[1]
        #: the place in the order of score, distance and id is this plus n times the distance
        base = rank.astype(np.int64) * 65 * n + np.arange(n)
        self.base = base.astype(np.int32) if 65 * n * (int(rank.max(initial=0)) + 1) < 2**31 - 1 else base
        self.kept: list = []

    def settle(self, k: int) -> None:
        """Of what was kept, the first k of each row and group."""
        if len(self.kept) > 1:
            rows, total, ids, score = (np.concatenate([x[c] for x in self.kept]) for c in range(4))
            group = pa.concat_arrays([x[4] for x in self.kept])
            codes = group.dictionary_encode(null_encoding="encode").indices.to_numpy()
            order = np.lexsort((ids, total, -score, codes, rows))
            first = np.r_[True, (rows[order][1:] != rows[order][:-1]) | (codes[order][1:] != codes[order][:-1])]
            at = np.arange(len(order))
            order = order[at - np.maximum.accumulate(np.where(first, at, 0)) < k]
            self.kept = [(rows[order], total[order], ids[order], score[order], group.take(pa.array(order)))]


def first_few(k: int, most: int, tile: int = 64) -> tuple[Callable, Callable]:
    """How two blocks of words are compared for the first k items of each probe and group within ``most`` bits, and the result."""

    def compare(a: Words, b: Words) -> None:
        n = len(b.ids)
        none = np.iinfo(b.base.dtype).max
        bits, count, place = np.empty((tile, n), np.uint64), np.empty((tile, n), np.uint8), np.empty((tile, n), b.base.dtype)
        low, high = (np.searchsorted(b.ids[b.by_id], a.ids, side) for side in ("left", "right"))
        ends = [*b.starts[1:], n]
        for s in range(0, len(a.ids), tile):
            m = min(tile, len(a.ids) - s)
            x, c, p = bits[:m], count[:m], place[:m]
            np.bitwise_xor(a.words[s : s + m, None], b.words[None, :], out=x)
            np.bitwise_count(x, out=c)
            np.multiply(c, b.base.dtype.type(n), out=p, dtype=b.base.dtype)
            p += b.base
            if most < 64:
                p[c > most] = none
            for r in np.flatnonzero(high[s : s + m] > low[s : s + m]):
                p[r, b.by_id[low[s + r] : high[s + r]]] = none
            if k == 1:
                best = [np.minimum.reduceat(p, b.starts, axis=1)]
            else:
                best = [np.partition(p[:, u:v], k - 1, axis=1)[:, :k] if v - u > k else p[:, u:v] for u, v in zip(b.starts, ends, strict=True)]
            for chosen in best:
                row, _ = np.nonzero(chosen < none)
                value = chosen[chosen < none]
                at = value % n
                a.kept.append((row + s, c[row, at].astype(np.int64), b.ids[at], b.score[at], b.group.take(pa.array(at))))
        if sum(len(x[0]) for x in a.kept) > PAIRS:
            a.settle(k)

    def result(a: Words) -> pa.RecordBatch:
        a.settle(k)
        rows, total, ids, score, group = a.kept[0]
        return pa.record_batch([pa.array(a.ids[rows]), pa.array(ids), pa.array(total), pa.array(score), group], ["probe_id", "item_id", "total", "score", "label"])

    return compare, result
