"""Indel similarities; meant for distinct names and predicates, not for every row."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, with one integer as a bit vector."""
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = (row + hit | row - hit) & full
    return len(a) - row.bit_count()


def ratio(a: str | None, b: str | None) -> float:
    if not a or not b:
        return 0.0
    return 200.0 * _common(a, b) / (len(a) + len(b))


def partial_ratio(a: str | None, b: str | None) -> float:
    """Best ratio of the shorter text with a window of the longer one, windows over its ends included."""
    if not a or not b:
        return 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n = len(short)
    return max(ratio(short, long[max(0, i) : i + n]) for i in range(1 - n, len(long)))


def token_sort_ratio(a: str | None, b: str | None) -> float:
    """Ratio of the texts with their words sorted."""
    return ratio(*(" ".join(sorted((x or "").split())) for x in (a, b)))


def token_set_ratio(a: str | None, b: str | None) -> float:
    """Best ratio among the shared words, and these with the words that only one text has."""
    x, y = set((a or "").split()), set((b or "").split())
    if not x or not y:
        return 0.0
    both, left, right = (" ".join(sorted(w)) for w in (x & y, x - y, y - x))
    if both and (not left or not right):
        return 100.0
    first, second = f"{both} {left}".strip(), f"{both} {right}".strip()
    return max(ratio(first, second), ratio(both, first), ratio(both, second))


def sequence_ratio(a: str | None, b: str | None) -> float:
    """Share of characters in matching blocks, 0 to 1."""
    return SequenceMatcher(None, a or "", b or "").ratio()


def _udf(measure):
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([measure(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")

    return pandas_udf(run, DoubleType())


token_sort_udf, token_set_udf, sequence_udf = _udf(token_sort_ratio), _udf(token_set_ratio), _udf(sequence_ratio)


@pandas_udf(DoubleType())
def ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@pandas_udf(DoubleType())
def partial_ratio_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([partial_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")
