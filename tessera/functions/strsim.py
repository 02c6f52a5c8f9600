"""String similarities that Spark has no function for, in Arrow batches.

Conventions for two empty strings: ratio 1, Jaro-Winkler 1, token-set ratio 0. All are in 0 to 1.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence, a bit for each character of a."""
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        both = row & where.get(c, 0)
        row = (row + both | row - both) & full
    return len(a) - row.bit_count()


def ratio(a: str, b: str) -> float:
    """Twice the common subsequence over both lengths (normalised insertions and deletions)."""
    return 2 * lcs(a, b) / (len(a) + len(b)) if a or b else 1.0


def partial_ratio(a: str, b: str) -> float:
    """The best ratio of the shorter string with a window of its length in the longer one, or a shorter window at an end."""
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if not short:
        return 1.0 if not long else 0.0
    n = len(short)
    best = _windows(short, long)
    if len(a) == len(b) and best < 1:
        best = max(best, _windows(long, short))
    return best if n else 0.0


def _windows(short: str, long: str) -> float:
    n, chars, best = len(short), set(short), 0.0
    for i in range(1, n):
        if long[i - 1] in chars:
            best = max(best, ratio(short, long[:i]))
    for i in range(len(long) - n + 1):
        if long[i + n - 1] in chars:
            best = max(best, ratio(short, long[i : i + n]))
            if best == 1:
                return best
    for i in range(len(long) - n + 1, len(long)):
        if long[i] in chars:
            best = max(best, ratio(short, long[i:]))
    return best


def token_sort_ratio(a: str, b: str) -> float:
    return ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def token_set_ratio(a: str, b: str) -> float:
    """The best of: common words against each side's words, and both sides' words, each with the common ones first."""
    x, y = set(a.split()), set(b.split())
    if not x or not y:
        return 0.0
    both = " ".join(sorted(x & y))
    left, right = " ".join(sorted(x - y)), " ".join(sorted(y - x))
    if both and (not left or not right):
        return 1.0
    one, two = f"{both} {left}".strip(), f"{both} {right}".strip()
    best = ratio(one, two)
    if both:
        best = max(best, ratio(both, one), ratio(both, two))
    return best


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity, with a bonus for up to four equal leading characters where it exceeds 0.7."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    used, left = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == c:
                used[j] = True
                left.append(c)
                break
    m = len(left)
    if not m:
        return 0.0
    right = [c for j, c in enumerate(b) if used[j]]
    swaps = sum(x != y for x, y in zip(left, right, strict=True)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    while prefix < min(4, len(a), len(b)) and a[prefix] == b[prefix]:
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro) if jaro > 0.7 else jaro


SCORERS: dict[str, Callable[[str, str], float]] = {"jaro_winkler": jaro_winkler, "ratio": ratio, "partial_ratio": partial_ratio, "token_sort_ratio": token_sort_ratio, "token_set_ratio": token_set_ratio}


@lru_cache(maxsize=None)
def _udf(name: str):
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        scorer = SCORERS[name]
        known: dict[tuple[str, str], float] = {}
        out = []
        for pair in zip(a.fillna(""), b.fillna(""), strict=True):
            if pair not in known:
                known[pair] = scorer(*pair)
            out.append(known[pair])
        return pd.Series(out, dtype="float64")

    return score


def similarity(name: str, a: Column, b: Column) -> Column:
    """The scorer of that name on two string columns; each distinct pair of a batch is scored once."""
    return _udf(name)(a, b)


def register(spark) -> None:
    """The scorers as SQL functions."""
    for name in SCORERS:
        spark.udf.register(name, _udf(name))
