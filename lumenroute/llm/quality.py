"""Quality filter: hashed word and character n-gram logistic regression.

Trained on the labelled quality rows (a sample of at most about
``most_labelled`` documents, the classes alike as far as there are labels),
calibrated on held-out rows by Platt scaling, where each row weighs by the
inverse of its class's sampling rate, and scored in Arrow batches: a document stays if its calibrated probability of
good quality is at least ``threshold``, a fixed number.

The features of a text are its character 3-grams (case kept, so that shouting and
symbol noise show), its words, and its word 2-grams with a mark for a word that
repeats the one before. Each kind is averaged over the text, so the score
doesn't depend on the length. Features of fewer than ``least_documents`` documents
of the sample get no weight, so that the driver needn't hold them.

Edge cases: a null or empty text has no features and gets the calibrated
probability of the bias alone. A very long text is scored whole. With no labels, or one class only, there is
no model: every probability is 1 and every row is kept. Labels without a
document or with a null flag are ignored; an id with several flags counts by
their lowest. Repeated rows are scored alike, each; a probability at the
threshold keeps its row. An empty table stays empty. Other columns pass through
``keep_good`` untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, linear
from .cluster import prepare
from .kernel import U64, mix

BITS = 18
KINDS = 3
SCALE = 10.0


def features(column: pa.Array) -> Iterator[tuple[int, list[np.ndarray], list[np.ndarray]]]:
    """For runs of documents and each kind of feature: sizes and hashed features."""
    raw, at = kernel.utf8(column)
    shift = U64(64 - BITS)
    for i, j, w in kernel.words(raw, at):
        sizes, found = [], []
        said = raw[at[i] : at[j]]
        text = np.frombuffer(said.tobytes().decode().encode("utf-32-le"), np.uint32).astype(U64)
        local = np.r_[0, np.cumsum((said & 0xC0) != 0x80)][at[i : j + 1] - at[i]]  # where each text begins, in characters
        n = len(text)
        gram = np.zeros(max(n - 2, 0), U64)
        if n > 2:
            gram = (text[:-2] << U64(42)) | (text[1:-1] << U64(21)) | text[2:]
        inside = np.ones(len(gram), bool)
        for back in (1, 2):  # grams that would run over a document's end
            cut = local[1:-1] - back
            inside[cut[(cut >= 0) & (cut < len(inside))]] = False
        found.append(mix(gram[inside] | U64(1 << 63)) >> shift)
        bounds = np.r_[0, np.cumsum(inside)]
        sizes.append(np.diff(bounds[np.minimum(local, len(inside))]))
        found.append(w.hash >> shift)
        sizes.append(np.diff(w.first))
        owner_change = np.zeros(len(w.hash), bool)
        owner_change[w.first[:-1][w.first[:-1] < len(w.hash)]] = True
        same = np.zeros(len(w.hash), bool)
        same[1:] = w.hash[1:] == w.hash[:-1]
        pair = np.zeros(len(w.hash), U64)
        pair[1:] = mix(w.hash[:-1] * U64(0xD6E8FEB86659FD93) + w.hash[1:])
        pair[same] = U64(0xABCDEF0123456789)
        found.append(pair[~owner_change] >> shift)
        sizes.append(np.maximum(np.diff(w.first) - 1, 0))
        yield i, sizes, found


def _labelled(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """All kinds in one list of features of each document; the kind is in the bits over BITS."""
    for i, sizes, found in features(column):
        total = sum(sizes)
        out = np.empty(int(total.sum()), np.uint32)
        base = np.cumsum(total) - total
        for kind, (size, f) in enumerate(zip(sizes, found, strict=True)):
            at = np.repeat(base - (np.cumsum(size) - size), size) + np.arange(len(f))
            out[at] = f.astype(np.uint32) | np.uint32(kind << BITS)
            base = base + size
        yield i, total, out


def _averages(index: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The share of each feature among those of its kind in the text."""
    kind = index >> BITS
    return SCALE * count / np.bincount(kind, count, KINDS)[kind]


def fit_logistic(rows: linear.Rows, y: np.ndarray, dims: int, steps: int = 300, rate: float = 0.1, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by full-batch Adam, with the classes weighing alike."""
    w, adam = np.zeros(dims + 1), linear.Adam(dims + 1, rate)
    weight = np.where(y == 1, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    for _ in range(steps):
        g = weight * (linear.sigmoid(rows.dot(w) + w[dims]) - y)
        w -= adam.step(np.r_[rows.back(g, dims) + decay * w[:dims], g.sum()])
    return w[:dims], float(w[dims])


def platt(z: np.ndarray, y: np.ndarray, steps: int = 50, weight: np.ndarray | None = None) -> tuple[float, float]:
    """a and b of the calibrated probability sigmoid(a z + b), by Newton's method on smoothed targets.

    ``weight`` is how many rows each one stands for, up to a factor.
    """
    weight = np.ones(len(y)) if weight is None else weight * (len(y) / weight.sum())
    good, bad = y.sum(), (1 - y).sum()
    t = np.where(y == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    x = np.stack([z, np.ones_like(z)], 1)
    c = np.array([1.0, 0.0])
    loss = lambda v: (weight * (np.logaddexp(0, x @ v) - t * (x @ v))).sum()
    for _ in range(steps):
        p = linear.sigmoid(x @ c)
        grad = x.T @ (weight * (p - t))
        hess = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        move, k = np.linalg.solve(hess, grad), 1.0
        while k > 1e-6 and loss(c - k * move) > loss(c):
            k /= 2
        c = c - k * move
        if np.abs(k * move).max() < 1e-9:
            break
    return float(c[0]), float(c[1])


class Scorer:
    """Calibrated probabilities of good quality, and which texts stay."""

    def __init__(self, model, threshold: float):
        self.model, self.threshold = model, threshold

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        p = np.ones(len(column))
        if self.model is not None:
            weights, bias, a, b = self.model.value
            for i, sizes, found in features(column):
                z = np.full(len(sizes[0]), bias)
                for kind, (size, f) in enumerate(zip(sizes, found, strict=True)):
                    z += SCALE * linear.sums(weights[kind << BITS : (kind + 1) << BITS], size, f) / np.maximum(size, 1)
                p[i : i + len(z)] = linear.sigmoid(a * z + b)
        return p, p >= self.threshold


def train(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, most_labelled: int = 8000, least_documents: int = 2, held_out: float = 0.25, salt: int = 10) -> Scorer:
    """Fit on about most_labelled labelled documents, a held_out share of which only calibrates."""
    spark = docs.sparkSession
    prepare(spark)
    flags = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    counts = {r[0]: r[1] for r in flags.groupBy("quality").count().collect()}
    if not (counts.get(0) and counts.get(1)):
        return Scorer(None, threshold)
    half = most_labelled / 2  # so that what is broadcast has about most_labelled rows, whatever the input
    rate = {c: min(1.0, half / counts[c]) for c in (0, 1)}
    picked = flags.where(linear.share(F.col("doc_id"), salt) < F.when(F.col("quality") == 1, rate[1]).otherwise(rate[0]))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL AND text IS NOT NULL")
    chosen = base.join(F.broadcast(picked), "doc_id").select("doc_id", "quality", linear.share(F.col("doc_id"), salt + 1).alias("u"), "text")
    sample = linear.featured(chosen, _labelled, "doc_id long, quality int, u double", _averages).checkpoint()
    used = linear.document_counts(sample, least_documents)[:, 0].astype(np.uint32)
    known = spark.sparkContext.broadcast(used)
    rows = linear.restricted(sample, known, "doc_id long, quality int, u double").checkpoint()
    per_class = {(r["late"], r["quality"]): r["count"] for r in rows.groupBy((F.col("u") < held_out).alias("late"), "quality").count().collect()}
    both = lambda late: all(per_class.get((late, y)) for y in (0, 1))
    fit_on = F.col("u") >= held_out if both(False) and any(late for late, _ in per_class) else F.lit(True)
    if not all(any(per_class.get((late, y)) for late in (False, True)) for y in (0, 1)):
        return Scorer(None, threshold)
    part, facts = linear.collected(rows.where(fit_on).orderBy("doc_id"))
    w, bias = fit_logistic(part, facts["quality"].to_numpy().astype(np.float64), len(used))
    del part
    part, facts = linear.collected(rows.where(F.col("u") < held_out if both(True) and both(False) else F.lit(True)).orderBy("doc_id"))
    y = facts["quality"].to_numpy().astype(np.float64)
    # the classes are sampled at different rates, the probabilities are those of all labelled rows
    a, b = platt(part.dot(w) + bias, y, weight=np.where(y == 1, 1 / rate[1], 1 / rate[0]))
    weights = np.zeros(KINDS << BITS, np.float32)
    weights[used] = w
    return Scorer(spark.sparkContext.broadcast((weights, bias, a, b)), threshold)


def quality_rules(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """(doc_id, p_good, keep) for every row; keep is false where the quality is low."""
    return linear.scored(docs, train(docs, labels, **params), "p_good")


def keep_good(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs whose quality is good."""
    return linear.filtered(docs, train(docs, labels, **params))
