"""Language identification by interpolated Kneser-Ney character language models.

One model for each language of the labelled documents, of order 5, over the
characters of words in normal form (see ``kernel.normalised``) with a mark before and after each. n-grams are
counted over all documents that have a language. A lower order counts in how
many contexts an n-gram continues another one; n-grams at a word's start,
which nothing precedes, keep their raw counts there. Each order's discount is
estimated from its numbers of n-grams that occur once and twice. The
probabilities of a language, interpolated, lie in sorted arrays of the hashes of
its own n-grams, so a language costs memory for its n-grams only; each is built
in a task of its own.

A text's language is the one with the lowest cross-entropy a character (nats).
It is rejected, as ``und``, where that entropy exceeds what is usual for the
language: mean + ``slack`` + ``z`` standard errors for the text's length. Mean
and deviation are those of the characters of held-out documents, a
``held_out`` share by a hash of the text, under a model of the others; the
model that scores is of all. A language without documents on both sides is
calibrated on all it has.

A worker keeps a table of the distinct words it has met with their scores; it
is emptied beyond ``TABLE_WORDS``, which costs time but changes no result. The models hold every n-gram of
the corpus, so the tasks that build them and what is broadcast
grow with the number of distinct n-grams.

Edge cases: null and empty texts, and texts without a word, are ``und`` with a
null entropy; very long texts are scored whole. Rows without a language don't train; with no language at all
every row is ``und``. Of equal entropies the language first in the alphabet
wins, with a margin of 0; with one language the margin is null. Repeated rows
count as often as they occur and are scored alike. Other columns are ignored,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel
from .cluster import prepare
from .kernel import U64, mix
from .linear import share

ORDER = 5
#: words in a worker's table, about 12 bytes each and 4 for each language
TABLE_WORDS = 1_000_000
_START, _STOP = 2, 3
_B = U64(0xA24BAED4963EE407)
_POWERS = [U64(pow(int(_B), k, 1 << 64)) for k in range(ORDER + 1)]


def spelled(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The code points of words with marks around each, and the place of each character in its word (0: the mark)."""
    size = end - start + 2
    at = np.cumsum(size) - size
    out = np.empty(int(size.sum()), np.uint8)
    inner = np.repeat(start - at - 1, size) + np.arange(len(out))
    out[:] = raw[np.clip(inner, 0, max(len(raw) - 1, 0))] if len(raw) else 0
    out[at] = _START
    out[at + size - 1] = _STOP
    points = np.frombuffer(out.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero(points == _START)
    place = np.arange(len(points)) - np.repeat(heads, np.diff(np.r_[heads, len(points)]))
    return points, place


def _distinct(w: kernel.Words, salt: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the words told apart by hash and salt: one occurrence of each, each word's number, and the counts."""
    _, first, code, count = np.unique(w.hash + salt, return_index=True, return_inverse=True, return_counts=True)
    return first, code, count


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n, n_late) from (lang, late, text): occurrences in all documents and in held-out ones."""
    held: dict[tuple[str, bool], list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting = 0

    def merge(parts):
        rows = np.concatenate([r for r, _ in parts])
        acc = sum(rows[:, k].astype(U64) * _POWERS[k] for k in range(ORDER))
        _, first, code = np.unique(mix(acc), return_index=True, return_inverse=True)
        return rows[first], np.bincount(code, np.concatenate([c for _, c in parts]))

    def flush():
        for (lang, late), parts in held.items():
            rows, count = merge(parts)
            blobs = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * ORDER), len(rows), [None, pa.py_buffer(np.ascontiguousarray(rows).tobytes())])
            n = count.astype(np.int64)
            yield pa.record_batch([pa.array([lang] * len(rows), pa.string()), blobs.cast(pa.binary()), pa.array(n), pa.array(n * late)], ["lang", "gram", "n", "n_late"])

    for batch in kernel.split_rows(batches, "text"):
        text = kernel.normalised(batch.column("text"))
        kinds = list(zip(batch.column("lang").to_pylist(), batch.column("late").to_pylist(), strict=True))
        for kind in sorted(set(kinds)):
            raw, at = kernel.utf8(text.filter(pa.array([x == kind for x in kinds])))
            parts = held.setdefault(kind, [])
            for i, j, w in kernel.words(raw, at):
                if not len(w.hash):
                    continue
                first, _, count = _distinct(w, U64(0))
                points, place = spelled(raw[at[i] : at[j]], w.start[first], w.end[first])
                rows = np.zeros((len(points), ORDER), np.uint32)
                for k in range(ORDER):
                    have = np.flatnonzero(place >= k)
                    rows[have, ORDER - 1 - k] = points[have - k]
                word = np.cumsum(place == 0) - 1
                chosen = place > 0
                parts.append((rows[chosen], count[word[chosen]].astype(np.float64)))
                waiting += int(chosen.sum())
            if waiting > 2_000_000:
                held = {k: [merge(v)] for k, v in held.items() if v}
                waiting = sum(len(v[0][1]) for v in held.values())
                if waiting > 1_500_000:
                    yield from flush()
                    held, waiting = {}, 0
    held = {k: v for k, v in held.items() if v}
    yield from flush()


def _hash(rows: np.ndarray, k: int, drop: int = 0) -> np.ndarray:
    """Hash of the k characters before the last ``drop`` ones."""
    acc = np.zeros(len(rows), U64)
    for j in range(k):
        acc += rows[:, ORDER - 1 - drop - j].astype(U64) * _POWERS[j]
    return mix(acc)


class Model:
    """The Kneser-Ney model of one language in sorted hash arrays."""

    def __init__(self, rows: np.ndarray, count: np.ndarray, unseen: float):
        self.unseen = unseen
        length = (rows != 0).sum(1)
        full = length == ORDER
        level = rows[full], count[full]
        levels = [level]
        for k in range(ORDER - 1, 0, -1):
            shorter = level[0].copy()
            shorter[:, : ORDER - k] = 0
            _, first, times = np.unique(_hash(shorter, k), return_index=True, return_counts=True)
            raw = length == k
            level = np.concatenate([shorter[first], rows[raw]]), np.concatenate([times.astype(np.float64), count[raw]])
            levels.append(level)
        self.keys, self.logp, self.contexts, self.back, self.discount = [None], [None], [None], [None], [None]
        for k, (grams, c) in enumerate(reversed(levels), 1):
            key = _hash(grams, k)
            order = np.argsort(key)
            grams, c, key = grams[order], c[order], key[order]
            before = _hash(grams, k - 1, 1)
            contexts, at = np.unique(before, return_inverse=True)
            if k > 1:
                lower = self.logp[k - 1][np.searchsorted(self.keys[k - 1], _hash(grams, k - 1))]
            else:
                lower = np.full(len(grams), unseen)
            once, twice = (c == 1).sum(), (c == 2).sum()
            discount = once / (once + 2 * twice) if once and twice else 0.75
            total = np.bincount(at, c, len(contexts))
            left = discount * np.bincount(at, minlength=len(contexts)) / total
            self.keys.append(key)
            self.logp.append(np.log((c - discount) / total[at] + left[at] * np.exp(lower)).astype(np.float32))
            self.contexts.append(contexts)
            self.back.append(np.log(left).astype(np.float32))
            self.discount.append(float(discount))

    def score(self, points: np.ndarray, place: np.ndarray) -> np.ndarray:
        """The log-probability of every character after its context; 0 for the marks before words."""
        m = len(points)
        acc = [np.zeros(m, U64)]
        for k in range(ORDER):
            shifted = np.zeros(m, U64)
            shifted[k:] = points[: max(m - k, 0)]
            acc.append(acc[-1] + shifted * _POWERS[k])
        out = np.full(m, self.unseen, np.float32)
        out[place == 0] = 0
        level = np.zeros(m, np.int64)
        todo = np.flatnonzero(place > 0)
        top = np.minimum(place + 1, ORDER)
        for k in range(ORDER, 0, -1):
            ask = todo[top[todo] >= k]
            if not len(ask) or not len(self.keys[k]):
                continue
            key = mix(acc[k][ask])
            at = np.searchsorted(self.keys[k], key)
            at[at == len(self.keys[k])] = 0
            hit = self.keys[k][at] == key
            out[ask[hit]] = self.logp[k][at[hit]]
            level[ask[hit]] = k
            todo = todo[level[todo] == 0]
        for k in range(1, ORDER + 1):
            ask = np.flatnonzero((place > 0) & (level < k) & (top >= k))
            if not len(ask) or not len(self.contexts[k]):
                continue
            key = mix(acc[k - 1][ask - 1])
            at = np.searchsorted(self.contexts[k], key)
            at[at == len(self.contexts[k])] = 0
            hit = self.contexts[k][at] == key
            out[ask[hit]] += self.back[k][at[hit]]
        return out

    def usual(self, rows: np.ndarray, count: np.ndarray) -> tuple[float, float]:
        """Mean and deviation of the entropy of characters that end these n-grams."""
        points, place = rows.ravel(), np.tile(np.arange(ORDER), len(rows))
        length = np.repeat((rows != 0).sum(1), ORDER)
        s = -self.score(points, np.maximum(place - (ORDER - length), 0))[ORDER - 1 :: ORDER].astype(np.float64)
        mean = (s * count).sum() / count.sum()
        return mean, np.sqrt(max((s * s * count).sum() / count.sum() - mean**2, 0.0))


def fitted(rows: np.ndarray, n: np.ndarray, late: np.ndarray, unseen: float) -> Model:
    """The model of a language with its calibration, from its n-grams and their counts in all and in held-out documents."""
    model = Model(rows, n, unseen)
    early = n > late
    if early.any() and late.any():
        model.mean, model.deviation = Model(rows[early], (n - late)[early], unseen).usual(rows[late > 0], late[late > 0])
    else:
        model.mean, model.deviation = model.usual(rows, n)
    return model


class Models:
    """The models of all languages, and a table of the words they have scored."""

    def __init__(self, models: dict[str, Model], z: float, slack: float):
        self.langs = sorted(models)
        self.models = [models[x] for x in self.langs]
        self.z, self.slack = z, slack
        self.mean, self.deviation = (np.array([getattr(m, x) for m in self.models]) for x in ("mean", "deviation"))
        self._empty()

    def _empty(self) -> None:
        self.word, self.chars, self.scores = np.zeros(0, U64), np.zeros(0, np.int32), np.zeros((0, len(self.langs)), np.float32)

    def score(self, points: np.ndarray, place: np.ndarray) -> np.ndarray:
        """``Model.score`` by language."""
        return np.stack([m.score(points, place) for m in self.models], 1)

    def _learn(self, hashes: np.ndarray, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> None:
        """Score the words that aren't in the table."""
        points, place = spelled(raw, start, end)
        heads = np.flatnonzero(place == 0)
        word = np.concatenate([self.word, hashes])
        order = np.argsort(word, kind="stable")
        self.word = word[order]
        self.chars = np.concatenate([self.chars, (np.diff(np.r_[heads, len(points)]) - 1).astype(np.int32)])[order]
        self.scores = np.concatenate([self.scores, np.add.reduceat(self.score(points, place), heads, axis=0)])[order]

    def identify(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For each text: the number of its characters and their log-probability by language."""
        raw, at = kernel.utf8(kernel.normalised(column))
        length, total = np.zeros(len(column), np.int64), np.zeros((len(column), len(self.langs)))
        pending: list = []
        size = 0

        def work():
            hashes = np.concatenate([w.hash for _, _, w, _ in pending])
            distinct, first, code = np.unique(hashes, return_index=True, return_inverse=True)
            if len(self.word) > TABLE_WORDS:
                self._empty()
            known = np.minimum(np.searchsorted(self.word, distinct), max(len(self.word) - 1, 0))
            new = np.flatnonzero(self.word[known] != distinct) if len(self.word) else np.arange(len(distinct))
            if len(new):
                starts = np.concatenate([w.start + base for _, _, w, base in pending])[first[new]]
                ends = np.concatenate([w.end + base for _, _, w, base in pending])[first[new]]
                self._learn(distinct[new], raw, starts, ends)
            row = np.searchsorted(self.word, distinct)
            by_word, chars = self.scores[row], self.chars[row]
            seen = 0
            for i, j, w, _ in pending:
                mine = code[seen : seen + len(w.hash)]
                seen += len(w.hash)
                owner = np.repeat(np.arange(j - i), np.diff(w.first))
                length[i:j] = np.bincount(owner, chars[mine], j - i)
                for q in range(len(self.langs)):
                    total[i:j, q] = np.bincount(owner, by_word[mine, q], j - i)
            pending.clear()

        for i, j, w in kernel.words(raw, at):
            if len(w.hash):
                pending.append((i, j, w, at[i]))
                size += len(w.hash)
            if size > 1_000_000:
                work()
                size = 0
        if pending:
            work()
        return length, total

    def __getstate__(self):
        return self.langs, self.models, self.z, self.slack, self.mean, self.deviation

    def __setstate__(self, state):
        self.langs, self.models, self.z, self.slack, self.mean, self.deviation = state
        self._empty()


def train(docs: DataFrame, z: float = 8.0, slack: float = 0.5, held_out: float = 0.1, salt: int = 1) -> Models | None:
    """Count over all rows of (lang, text) and build the models, a task for each language; None without any language."""
    prepare(docs.sparkSession)
    base = docs.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    flagged = base.select("lang", (share(F.col("text"), salt) < held_out).alias("late"), "text")
    grams = flagged.mapInArrow(_count, "lang string, gram binary, n long, n_late long").groupBy("lang", "gram").agg(F.sum("n").alias("n"), F.sum("n_late").alias("n_late")).checkpoint()
    alphabet = grams.select(F.expr(f"substring(gram, {4 * ORDER - 3}, 4)").alias("c")).distinct().count()
    unseen = float(np.log(1.0 / (alphabet + 1)))

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        raw, _ = kernel.utf8(table["gram"])
        rows = np.frombuffer(raw.tobytes(), np.uint32).reshape(-1, ORDER)
        model = fitted(rows, *(table[c].to_numpy().astype(np.float64) for c in ("n", "n_late")), unseen)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.string()), pa.array([pickle.dumps(model)], pa.binary())], ["lang", "model"])

    found = grams.groupBy("lang").applyInArrow(build, "lang string, model binary").collect()
    return Models({r["lang"]: pickle.loads(r["model"]) for r in found}, z, slack) if found else None


def identify(docs: DataFrame, training: DataFrame | None = None, **params) -> DataFrame:
    """(doc_id, lang_id, nearest, cross_entropy, margin, keep) for every row; keep is false where the text is rejected."""
    spark = docs.sparkSession
    known = train(docs if training is None else training, **params)
    model = spark.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in kernel.split_rows(batches, "text"):
            n = batch.num_rows
            if m is None:
                none = pa.nulls(n, pa.float64())
                yield pa.record_batch([batch.column("doc_id"), pa.array(["und"] * n), pa.nulls(n, pa.string()), none, none, pa.array([False] * n)], ["doc_id", "lang_id", "nearest", "cross_entropy", "margin", "keep"])
                continue
            length, total = m.identify(batch.column("text"))
            entropy = -total / np.maximum(length, 1)[:, None]
            best = entropy.argmin(1)
            lowest = entropy[np.arange(n), best]
            bound = m.mean[best] + m.slack + m.z * m.deviation[best] / np.sqrt(np.maximum(length, 1))
            keep = (length > 0) & (lowest <= bound)
            names = np.array(m.langs, object)[best]
            empty = length == 0
            margin = np.partition(entropy, 1, axis=1)[:, 1] - lowest if len(m.langs) > 1 else np.zeros(n)
            yield pa.record_batch(
                [
                    batch.column("doc_id"), pa.array(np.where(keep, names, "und"), pa.string()), pa.array(names, pa.string(), mask=empty),
                    pa.array(lowest, mask=empty), pa.array(margin, mask=empty | (len(m.langs) < 2)), pa.array(keep),
                ],
                ["doc_id", "lang_id", "nearest", "cross_entropy", "margin", "keep"],
            )

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(run, "doc_id long, lang_id string, nearest string, cross_entropy double, margin double, keep boolean")
