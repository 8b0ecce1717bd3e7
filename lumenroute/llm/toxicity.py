"""Toxicity filter by non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; all documents, of unknown
toxicity, are the unlabelled set. With class prior pi and logistic loss, the
classifier minimises

    pi * R_p(+1) + max(0, R_u(-1) - pi * R_p(-1)),

stepping back along the second part whenever it turns negative, so that the
classifier can't fit the unlabelled texts that are toxic as clean. The prior
is a parameter; by default it is the toxic share over all labels, which
supposes that the labels are a random sample.

Features are words in normal form (see ``kernel.normalised``) and their
prefixes, hashed, present or absent. Only features that are more frequent
among positives than among all documents by ``min_z`` standard errors, and of
whose documents at least the share ``min_toxic`` is toxic by Bayes' rule, get a
weight: a long clean text must not collect many small ones. The document
frequencies are counted, and the risk is taken, over every document. What is
left of a document is its pattern, the set of such features in it; documents of
one pattern are one row with a count, so the mean over all of them is a short
sum. Up to ``LOCAL_PATTERNS`` patterns are summed on the driver; beyond that
each step's gradient is summed by the executors, with the same result.
Of the labelled positives about ``most_positive`` are used.

Edge cases: a null or empty text has no features and is scored by the bias
alone, which is under the threshold. A very long text is read whole. Labels without a document, with a null
flag or repeated are ignored or counted once; an id that has both flags counts
as toxic. With no positive example or no document there is no model: every
probability is 0 and every row is kept. Repeated rows are counted and scored
alike, each; a probability at the threshold rejects its row. An empty table stays
empty. Other columns pass through ``keep_clean`` untouched, whatever their names.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernel, linear
from .cluster import prepare
from .kernel import U64, mix

BITS = 20
PREFIXES = (4, 6)
#: patterns that the driver holds, some 100 bytes each
LOCAL_PATTERNS = 500_000


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    raw, at = kernel.utf8(kernel.normalised(column))
    k = 1 + len(PREFIXES)
    for i, _, w in kernel.words(raw, at):
        f = np.empty((len(w.hash), k), np.uint32)
        f[:, 0] = w.hash >> U64(64 - BITS)
        for q, size in enumerate(PREFIXES, 1):
            f[:, q] = mix(w.head(size) + U64(q << 20)) >> U64(64 - BITS)
        yield i, np.diff(w.first) * k, f.ravel()


def _present(column: pa.Array, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For runs of documents: their first number and number, and the distinct wanted features of each, as document and feature."""
    for i, sizes, f in features(column):
        hit = np.flatnonzero(wanted[f])
        row = np.searchsorted(np.cumsum(sizes), hit, "right")
        once = np.unique((row << BITS) | f[hit].astype(np.int64))
        yield i, len(sizes), once >> BITS, once & ((1 << BITS) - 1)


def _ones(index: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.ones(len(index), np.float32)


def document_frequencies(texts: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """Of each wanted feature, in how many of all texts it is; counted where the texts are."""
    mask = np.zeros(1 << BITS, bool)
    mask[wanted] = True
    known = texts.sparkSession.sparkContext.broadcast(mask)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << BITS, np.int64)
        for batch in kernel.split_rows(batches, "text"):
            for _, _, _, f in _present(batch.column("text"), known.value):
                np.add.at(total, f, 1)
        some = np.flatnonzero(total)
        yield pa.record_batch([pa.array(some.astype(np.int32)), pa.array(total[some])], ["feature", "n"])

    found = texts.mapInArrow(run, "feature int, n long").groupBy("feature").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(1 << BITS, np.int64)
    out[found["feature"].to_numpy(np.int64)] = found["n"]
    return out[wanted]


def informative(a: np.ndarray, b: np.ndarray, positives: int, unlabelled: int, prior: float, min_z: float, min_toxic: float) -> np.ndarray:
    """Which features have a higher document rate p among positives than q among unlabelled, and prior * p / q of min_toxic or more."""
    p, q = a / positives, b / unlabelled
    pooled = (a + b) / (positives + unlabelled)
    error = np.sqrt(np.maximum(pooled * (1 - pooled), 1e-12) * (1 / positives + 1 / unlabelled))
    return (a >= 3) & (p - q >= min_z * error) & (prior * p >= min_toxic * q)


def patterns(texts: DataFrame, chosen: np.ndarray) -> DataFrame:
    """(f, n): the sets of chosen features that documents have, packed as rows of ``linear.Rows``, and how many documents have each."""
    mask = np.zeros(1 << BITS, bool)
    mask[chosen] = True
    known = texts.sparkSession.sparkContext.broadcast((mask, chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, order = known.value
        held: Counter[bytes] = Counter()
        for batch in kernel.split_rows(batches, "text"):
            for _, n, row, f in _present(batch.column("text"), wanted):
                packed = np.empty(len(f), linear.PACKED)
                packed["f"], packed["v"] = np.searchsorted(order, f), 1
                ends = np.cumsum(np.bincount(row, minlength=n))
                some = np.flatnonzero(np.diff(np.r_[0, ends]))
                held[b""] += n - len(some)
                held.update(packed[a:b].tobytes() for a, b in zip(np.r_[0, ends][some], ends[some], strict=True))
            if len(held) > 200_000:
                yield pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["f", "n"])
                held.clear()
        yield pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["f", "n"])

    return texts.mapInArrow(run, "f binary, n long").groupBy("f").agg(F.sum("n").alias("n")).where("n > 0")


def part_of_risk(rows: linear.Rows, count: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Sums over rows that stand for ``count`` documents each: the loss of calling them clean, its gradient by the weights and by the bias."""
    m = len(w) - 1
    g = rows.dot(w) + w[m]
    d = count * linear.sigmoid(g)
    return np.r_[(count * np.logaddexp(0, g)).sum(), rows.back(d, m), d.sum()]


def unlabelled_risk(table: DataFrame, local: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function of the weights that sums ``part_of_risk`` over all patterns."""
    spark = table.sparkSession
    size = table.count()
    if size <= local:
        held, facts = linear.collected(table.orderBy("f"))
        count = facts["n"].to_numpy().astype(np.float64)
        return lambda w: part_of_risk(held, count, w)
    spread = table.repartition(-(-size // max(local, 1)), "f").checkpoint()

    def summed(w: np.ndarray) -> np.ndarray:
        known = spark.sparkContext.broadcast(w)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                part = part_of_risk(linear.Rows(*kernel.utf8(batch.column("f"))), batch.column("n").to_numpy().astype(np.float64), known.value)
                yield pa.record_batch([pa.array([part.tobytes()], pa.binary())], ["part"])

        out = sum((np.frombuffer(r["part"], np.float64) for r in spread.mapInArrow(run, "part binary").toLocalIterator()), np.zeros(len(w) + 1))
        known.destroy()
        return out

    return summed


def fit_nnpu(positive: linear.Rows, unlabelled: Callable[[np.ndarray], np.ndarray], total: int, dims: int, prior: float, steps: int = 400, rate: float = 0.05, decay: float = 1e-5, beta: float = 0.0, gamma: float = 1.0) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk, by full-batch Adam; ``unlabelled`` sums over ``total`` documents."""
    w = np.zeros(dims + 1)
    w[dims] = np.log(prior / (1 - prior))
    adam = linear.Adam(dims + 1, rate)
    for _ in range(steps):
        gp = positive.dot(w) + w[dims]
        part = unlabelled(w) / total
        dn = -prior * linear.sigmoid(gp) / positive.n
        negative, grad = part[0] - prior * np.logaddexp(0, gp).mean(), part[1:] + np.r_[positive.back(dn, dims), dn.sum()]
        if negative >= -beta:
            dp = -prior * linear.sigmoid(-gp) / positive.n
            grad += np.r_[positive.back(dp, dims), dp.sum()]
        else:
            grad *= -gamma
        grad[:dims] += decay * w[:dims]
        w -= adam.step(grad)
    return w[:dims], float(w[dims])


class Scorer:
    """Probabilities of toxicity, and which texts stay."""

    def __init__(self, model, threshold: float):
        self.model, self.threshold = model, threshold

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        p = np.zeros(len(column))
        if self.model is not None:
            weights, bias = self.model.value
            for i, n, row, f in _present(column, weights != 0):
                p[i : i + n] = linear.sigmoid(np.bincount(row, weights[f], n) + bias)
        return p, p < self.threshold


def train(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, prior: float | None = None, most_positive: int = 5000, min_z: float = 5.0, min_toxic: float = 0.7, salt: int = 4, local_patterns: int = LOCAL_PATTERNS) -> Scorer:
    """Fit on at most about most_positive labelled positives and all documents."""
    spark = docs.sparkSession
    prepare(spark)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text IS NOT NULL")
    flags = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    known = flags.agg(F.count("*"), F.sum(F.expr("cast(toxic = 1 AS int)"))).first()
    toxic = known[1] or 0
    if not toxic:
        return Scorer(None, threshold)
    prior = min(max(toxic / known[0] if prior is None else prior, 1e-4), 0.95)
    ids = linear.sampled(flags.where("toxic = 1").select("doc_id"), most_positive, toxic, salt)
    positive = linear.featured(base.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text"), features, "doc_id long", _ones).checkpoint()
    positives = positive.count()
    if not positives:
        return Scorer(None, threshold)
    wanted, a = linear.document_counts(positive, 3).T
    texts = base.select("text")
    total = texts.count()
    chosen = wanted[informative(a, document_frequencies(texts, wanted), positives, total, prior, min_z, min_toxic)]
    of, _ = linear.collected(linear.restricted(positive, spark.sparkContext.broadcast(chosen.astype(np.uint32)), "doc_id long").orderBy("doc_id"))
    risk = unlabelled_risk(patterns(texts, chosen).checkpoint(), local_patterns)
    w, bias = fit_nnpu(of, risk, total, len(chosen), prior)
    weights = np.zeros(1 << BITS, np.float32)
    weights[chosen] = w
    return Scorer(spark.sparkContext.broadcast((weights, bias)), threshold)


def toxicity(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """(doc_id, p_toxic, keep) for every row; keep is false where the document is toxic."""
    return linear.scored(docs, train(docs, labels, **params), "p_toxic")


def keep_clean(docs: DataFrame, labels: DataFrame, **params) -> DataFrame:
    """The rows of docs that aren't toxic."""
    return linear.filtered(docs, train(docs, labels, **params))
