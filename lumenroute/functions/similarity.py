"""Text similarity that no built-in expresses, in Arrow batches, and the bounded edit distance that one does."""

from __future__ import annotations

import re
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ratio(a: str | None, b: str | None) -> float:
    """Matching-block ratio of two texts; the second may have its popular characters ignored from 200 on."""
    return SequenceMatcher(None, a or "", b or "").ratio()


@F.pandas_udf(T.DoubleType())
def seq_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """``ratio`` for columns; each distinct pair of a batch is compared once."""
    seen: dict = {}
    out = []
    for pair in zip(a, b, strict=True):
        if pair not in seen:
            seen[pair] = ratio(*pair)
        out.append(seen[pair])
    return pd.Series(out, dtype="float64")


def within(a: Column, b: Column, most: int | Column) -> Column:
    """Whether the edit distance of two texts is at most ``most``."""
    if isinstance(most, int):
        return F.levenshtein(a, b, most) >= 0
    return F.levenshtein(a, b) <= most


def grams(a: Column, n: int = 3, pad: str = "$") -> Column:
    """The distinct character n-grams of a text; with ``pad``, also those over its ends."""
    padded = F.concat(F.lit(pad * (n - 1)), a, F.lit(pad * (n - 1))) if pad else a
    return F.array_distinct(F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.length(padded) - (n - 1)), lambda k: F.substr(padded, k, F.lit(n)))).otherwise(F.array(padded)))


def fuzzy_overlap(raw: list[str], candidate: list[str], least: float = 0.72) -> int:
    """How many raw words of three letters or more have a similar candidate word of their own, taken greedily in order."""
    used: set[int] = set()
    for word in raw:
        if len(word) < 3:
            continue
        scores = [(ratio(word, c), -k) for k, c in enumerate(candidate) if k not in used]
        if scores and max(scores)[0] >= least:
            used.add(-max(scores)[1])
    return len(used)


_WORD = re.compile(r"[A-Za-z']+")


@F.pandas_udf(T.StructType([T.StructField("ratio", T.DoubleType()), *(T.StructField(c, T.IntegerType()) for c in ("fuzzy", "overlap", "prefix", "gap"))]))
def name_score(raw: pd.Series, fixed: pd.Series, name: pd.Series) -> pd.DataFrame:
    """How well a catalogue name fits a recognised name, given raw and with slips fixed; to be compared in this order, highest first."""
    rows = []
    for r, f, n in zip(raw, fixed, name, strict=True):
        variants = [v for v in dict.fromkeys(((r or "").lower().strip(), (f or "").lower().strip())) if v]
        n = (n or "").strip().lower()
        if not variants or not n:
            rows.append((0.0, 0, 0, 0, 0))
            continue
        words = sorted({w for v in variants for w in _WORD.findall(v)})
        there = _WORD.findall(n)
        rows.append((max(ratio(v, n) for v in variants), fuzzy_overlap(words, there), len(set(words) & set(there)), int(n.startswith(variants[0].split(" ")[0])), -abs(len(n) - len(variants[0]))))
    return pd.DataFrame(rows, columns=["ratio", "fuzzy", "overlap", "prefix", "gap"])


def name_accepted(score: Column) -> Column:
    """A close match, or a fair one that shares words."""
    return (score["ratio"] >= 0.72) | ((score["ratio"] >= 0.60) & ((score["fuzzy"] >= 2) | (score["overlap"] >= 2))) | ((score["ratio"] >= 0.52) & (score["fuzzy"] >= 2))
