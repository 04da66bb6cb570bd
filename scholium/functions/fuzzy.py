"""String similarities that Spark lacks, as Arrow UDFs; each distinct pair is compared once by the callers."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def indel_ratio(a: str, b: str) -> float:
    """100 * 2 LCS / (|a| + |b|), with the longest common subsequence by bit vectors; 100 for two empty strings."""
    if not a and not b:
        return 100.0
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return 100.0 * 2 * (full ^ row).bit_count() / (len(a) + len(b))


def token_sort(a: str | None, b: str | None) -> float | None:
    """``indel_ratio`` of the white-space tokens in sorted order."""
    if a is None or b is None:
        return None
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    used = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, u in zip(b, used) if u]
    swaps = sum(x != y for x, y in zip(left, right)) // 2
    m = len(left)
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler_of(a: str | None, b: str | None) -> float | None:
    """Jaro similarity, raised by up to four equal first letters where it is over 0.7."""
    if a is None or b is None:
        return None
    base = jaro(a, b)
    if base <= 0.7:
        return base
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return base + 0.1 * prefix * (1 - base)


@lru_cache(maxsize=1 << 12)
def _letters(text: str) -> list[tuple[str, int]]:
    """Letters and their counts, the commonest first."""
    return Counter(text).most_common()


def jaro_winkler_from(a: str, b: str, least: float) -> float:
    """``jaro_winkler_of`` where it reaches ``least``; where letters alone show that it does not, 0 without a comparison.

    Letters that one text has and the other lacks match nothing, and the similarity leaves only so many unmatched.
    """
    if not a or not b:
        return jaro_winkler_of(a, b)
    prefix = 0
    if a[0] == b[0]:
        prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(len(a), len(b), 4))
    base = (least - 0.1 * prefix) / (1 - 0.1 * prefix)
    spare = len(a) - (3 * base - 1) / (1 / len(a) + 1 / len(b)) + 1e-9
    for c, n in _letters(a):
        lacking = n - b.count(c)
        if lacking > 0:
            spare -= lacking
            if spare < 0:
                return 0.0
    return jaro_winkler_of(a, b)


@F.pandas_udf(DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([token_sort(x, y) for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x, y) for x, y in zip(a, b)], dtype="float64")
