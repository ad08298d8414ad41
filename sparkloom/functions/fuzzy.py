"""Weighted fuzzy similarity of short texts (0 to 100), after its published definition.

Built on the Indel similarity 200 * LCS / (len(a) + len(b)); the LCS is bit-parallel.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def lcs(a: str, b: str) -> int:
    """Length of the longest common subsequence."""
    if len(a) > len(b):
        a, b = b, a
    masks: dict[str, int] = {}
    for i, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    rows = full
    for c in b:
        hit = rows & masks.get(c, 0)
        rows = ((rows + hit) | (rows - hit)) & full
    return len(a) - rows.bit_count()


def ratio(a: str, b: str) -> float:
    return 200.0 * lcs(a, b) / (len(a) + len(b)) if a or b else 100.0


def partial_ratio(a: str, b: str) -> float:
    """Best ratio of the shorter text with a window of the longer one, shorter at its ends."""
    if not a or not b:
        return 100.0 if a == b else 0.0
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    n, best = len(short), 0.0
    windows = [long[max(0, i) : i + n] for i in range(1 - n, len(long))]
    for window in dict.fromkeys(windows):
        if 200.0 * min(n, len(window)) / (n + len(window)) > best:
            best = max(best, ratio(short, window))
    if len(a) == len(b) and best < 100:
        best = max([best, *(ratio(long, short[max(0, i) : i + n]) for i in range(1 - n, n))])
    return best


def _parts(a: str, b: str) -> tuple[list[str], list[str], list[str]]:
    left, right = set(a.split()), set(b.split())
    return sorted(left & right), sorted(left - right), sorted(right - left)


def _sorted(text: str) -> str:
    return " ".join(sorted(text.split()))


def token_set_ratio(a: str, b: str) -> float:
    if not a.split() or not b.split():
        return 0.0
    both, only_a, only_b = _parts(a, b)
    if both and not (only_a and only_b):
        return 100.0
    left, right = " ".join(only_a), " ".join(only_b)
    shared = len(" ".join(both))
    gap = 1 if shared else 0
    with_a, with_b = shared + gap + len(left), shared + gap + len(right)
    apart = len(left) + len(right) - 2 * lcs(left, right)
    found = [100 - 100 * apart / (with_a + with_b)]
    if shared:
        found += [100 - 100 * (gap + len(x)) / (shared + shared + gap + len(x)) for x in (left, right)]
    return max(found)


def token_ratio(a: str, b: str) -> float:
    return max(ratio(_sorted(a), _sorted(b)), token_set_ratio(a, b))


def partial_token_ratio(a: str, b: str) -> float:
    both, only_a, only_b = _parts(a, b)
    if both:
        return 100.0
    return max(partial_ratio(_sorted(a), _sorted(b)), partial_ratio(" ".join(only_a), " ".join(only_b)))


def weighted_ratio(a: str | None, b: str | None) -> float:
    """The largest of the plain, partial and token ratios by their weights; 0 for an empty text."""
    if not a or not b:
        return 0.0
    lengths = max(len(a), len(b)) / min(len(a), len(b))
    whole = ratio(a, b)
    if lengths < 1.5:
        return max(whole, 0.95 * token_ratio(a, b))
    scale = 0.9 if lengths <= 8 else 0.6
    return max(whole, scale * partial_ratio(a, b), 0.95 * scale * partial_token_ratio(a, b))


@F.pandas_udf(T.DoubleType())
def fuzzy_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([weighted_ratio(x, y) for x, y in zip(a, b, strict=True)], index=a.index, dtype="float64")
