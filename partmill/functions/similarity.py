"""Token similarity on pairs (0-100) as Arrow-batched functions.

Both scores rest on the Indel ratio 200 * LCS(a, b) / (len(a) + len(b)); the LCS
length is counted bit-parallel over Python integers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_subsequence(a: str, b: str) -> int:
    if not a or not b:
        return 0
    where: dict[str, int] = {}
    for i, ch in enumerate(a):
        where[ch] = where.get(ch, 0) | (1 << i)
    full = (1 << len(a)) - 1
    state = full
    for ch in b:
        hit = state & where.get(ch, 0)
        state = ((state + hit) | (state - hit)) & full
    return len(a) - state.bit_count()


def indel_ratio(a: str, b: str) -> float:
    total = len(a) + len(b)
    return 100.0 if total == 0 else 200.0 * common_subsequence(a, b) / total


def sort_ratio(a: str, b: str) -> float:
    return indel_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))


def set_ratio(a: str, b: str) -> float:
    left, right = set(a.split()), set(b.split())
    if not left or not right:
        return 0.0
    shared = left & right
    only_left, only_right = sorted(left - right), sorted(right - left)
    if shared and (not only_left or not only_right):
        return 100.0
    x, y = " ".join(only_left), " ".join(only_right)
    common = len(" ".join(shared))
    gap = 1 if shared else 0
    len_x, len_y = common + gap + len(x), common + gap + len(y)
    distance = len(x) + len(y) - 2 * common_subsequence(x, y)
    best = 100.0 - 100.0 * distance / (len_x + len_y)
    if shared:
        best = max(best,
                   100.0 - 100.0 * (gap + len(x)) / (common + len_x),
                   100.0 - 100.0 * (gap + len(y)) / (common + len_y))
    return best


@F.pandas_udf(T.DoubleType())
def token_sort_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([sort_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def token_set_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([set_ratio(x or "", y or "") for x, y in zip(a, b)], dtype="float64")


# A filter on a score must not cost a second evaluation of it.
token_sort_ratio = token_sort_ratio.asNondeterministic()
token_set_ratio = token_set_ratio.asNondeterministic()
