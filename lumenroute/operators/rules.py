"""Rules texts against descriptions in blocks: the pairs that share a strong word and can decide which description is accepted."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa

from ..functions import text

#: of a score that is accepted, and its lead on the second (the defaults of accepted_by_margin)
LEAST, MARGIN = 0.50, 0.05


def _counts(texts: list[str]) -> np.ndarray:
    """How often each letter, and the space, occurs."""
    out = np.zeros((len(texts), 27), np.int32)
    for k, t in enumerate(texts):
        codes = np.frombuffer(t.encode(), np.uint8).astype(np.int64)
        out[k] = np.bincount(np.where(codes == 32, 0, codes - 96), minlength=27)
    return out


def _phrases(t: str) -> frozenset[str]:
    return frozenset(w for w in text.RULES_PHRASES if w in t)


class Asked:
    """A block of (key, text, strongest words); each distinct text has the descriptions found so far."""

    def __init__(self, table: pa.Table) -> None:
        self.keys = table.column(0).combine_chunks()
        self.rows: dict[str, list[int]] = {}
        self.words: dict[str, list[str]] = {}
        for k, (q, words) in enumerate(zip(table.column(1).to_pylist(), table.column(2).to_pylist(), strict=True)):
            self.rows.setdefault(q, []).append(k)
            self.words[q] = words
        self.counts = _counts(list(self.rows))
        self.best = dict.fromkeys(self.rows, 0.0)
        self.found: dict[str, list] = {q: [] for q in self.rows}
        self.kind: pa.DataType | None = None


class Described:
    """A block of (product_id, description); descriptions are told apart, and words lead to them."""

    def __init__(self, table: pa.Table) -> None:
        self.kind = table.column(0).type
        products: dict[str, dict] = {}
        for p, d in zip(table.column(0).to_pylist(), table.column(1).to_pylist(), strict=True):
            of = products.setdefault(d, {})
            if len(of) < 2:  # two with one score decide as well as more
                of[p] = None
        self.texts, self.products = list(products), [list(p) for p in products.values()]
        self.counts, self.lengths = _counts(self.texts), np.array([len(d) for d in self.texts])
        index: dict[str, list[int]] = {}
        for k, d in enumerate(self.texts):
            for w in set(d.split(" ")):
                index.setdefault(w, []).append(k)
        self.index = index
        self.phrases = [_phrases(d) for d in self.texts]


def _common(masks: dict[str, int], full: int, d: str) -> int:
    """Length of the longest common subsequence of d and the text with these masks of its characters, by bits of integers."""
    v = full
    for c in d:
        m = masks.get(c, 0)
        if m:
            u = v & m
            v = ((v + u) | (v - u)) & full
    return full.bit_length() - v.bit_count()


def compare(a: Asked, b: Described) -> None:
    """Scores from the highest bound down, while the bound isn't further below the best than the margin, nor the least that counts.

    Matching blocks are a common subsequence and use no character more often
    than either text has it, which bounds the ratio from above twice.
    """
    a.kind = b.kind
    for n, q in enumerate(a.rows):
        at = np.array(sorted(set().union(*(b.index.get(w, ()) for w in a.words[q]))), np.int64)
        if not len(at):
            continue
        has = _phrases(q)
        bonus = np.array([text.rules_bonus_of(has, b.phrases[j]) for j in at]) if has else np.zeros(len(at))
        bound = 2.0 * np.minimum(a.counts[n], b.counts[at]).sum(1) / (len(q) + b.lengths[at]) + bonus
        masks: dict[str, int] = {}
        for k, c in enumerate(q):
            masks[c] = masks.get(c, 0) | 1 << k
        full = (1 << len(q)) - 1
        for k in np.argsort(-bound, kind="stable"):
            least = max(LEAST, a.best[q]) - MARGIN - 1e-9
            if bound[k] < least:
                break
            d, extra = b.texts[at[k]], float(bonus[k])
            if 2.0 * _common(masks, full, d) / (len(q) + len(d)) + extra < least:
                continue
            score = SequenceMatcher(None, q, d).ratio() + extra
            if score >= least:
                a.best[q] = max(a.best[q], score)
                a.found[q] += [(score, p) for p in b.products[at[k]]]


def result(a: Asked) -> pa.RecordBatch:
    """(key, product, score) of those that are near the best enough to decide, two for each text."""
    rows, products, scores = [], [], []
    for q, found in a.found.items():
        for score, p in sorted(found, key=lambda x: -x[0])[:2]:
            for k in a.rows[q]:
                rows.append(k)
                products.append(p)
                scores.append(score)
    return pa.record_batch([a.keys.take(pa.array(rows, pa.int64())), pa.array(products, a.kind), pa.array(scores, pa.float64())], ["_k", "product_id", "score"])
