"""Similarities of strings, token lists and values."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from cellweave.functions.quantity import _c
from cellweave.functions.text import PUNCTUATION, STOP_WORDS


def edit_similarity(a, b) -> Column:
    """1 for equal strings, else 1 / (edit distance + 0.2)."""
    d = F.levenshtein(_c(a), _c(b))
    return F.when(d == 0, 1.0).otherwise(1.0 / (d + 0.2))


def unit_similarity(a, b, mismatch: float = -1.0) -> Column:
    """As edit_similarity, but ``mismatch`` where the distance reaches the shorter unit's length."""
    d = F.levenshtein(_c(a), _c(b))
    return F.when(d >= F.least(F.length(_c(a)), F.length(_c(b))), F.lit(mismatch)).otherwise(edit_similarity(a, b))


def function_similarity(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(a.eqNullSafe(b) | (a.eqNullSafe(F.lit("rat")) & b.eqNullSafe(F.lit("dif"))), 1).otherwise(-1)


def live_function_similarity(text_func, cell_func, text_unit) -> Column:
    """1 only for a percentage cell that a text percentage without a named function meets."""
    hit = _c(cell_func).eqNullSafe(F.lit("percentage")) & _c(text_func).isNull() & _c(text_unit).eqNullSafe(F.lit("%"))
    return F.when(hit, 1).otherwise(0)


def jaro_of(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    if a == b:
        return 1.0 if a else 0.0
    reach = max(0, max(len(a), len(b)) // 2 - 1)
    taken = [False] * len(b)
    left = []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                left.append(c)
                break
    if not left:
        return 0.0
    right = [c for c, t in zip(b, taken) if t]
    m, swaps = len(left), sum(x != y for x, y in zip(left, right)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


@F.pandas_udf(DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity in Arrow batches; two empty strings have 0."""
    return pd.Series([jaro_of(x, y) for x, y in zip(a, b)], dtype="float64")


def nearest_phrase(a, b) -> Column:
    """edit_similarity of the two closest phrases of two lists, 0 if one is empty."""
    d = F.array_min(F.flatten(F.transform(_c(a), lambda x: F.transform(_c(b), lambda y: F.levenshtein(x, y)))))
    return F.when((F.size(_c(a)) == 0) | (F.size(_c(b)) == 0), 0.0).when(d == 0, 1.0).otherwise(1.0 / (d + 0.2))


def _counts(t: Column, stop) -> Column:
    """Whether a token is neither empty nor a stop word nor a punctuation mark."""
    return ~t.isin("", *stop, *PUNCTUATION)


def _content(x: Column, stop) -> Column:
    return F.filter(x, lambda t: _counts(t, stop))


def content_length(a, stop=STOP_WORDS) -> Column:
    return F.size(_content(_c(a), stop))


def overlap(a, b, stop=STOP_WORDS) -> Column:
    """Hits of a's content tokens in b, over the larger of hits and b's content tokens; 0 if a side is empty, 1 if nothing counts."""
    words = _c(b)
    hits = F.size(F.filter(_content(_c(a), stop), lambda t: F.array_contains(words, t)))
    most = F.greatest(hits, content_length(b, stop))
    return F.when((F.size(_c(a)) == 0) | (F.size(_c(b)) == 0), 0.0).when(most == 0, 1.0).otherwise(hits / most)


def set_overlap(a, b) -> Column:
    return F.size(F.array_intersect(_c(a), _c(b)))


def jaccard(a, b, stop=STOP_WORDS) -> Column:
    words = _c(b)
    n, m = content_length(a, stop), content_length(b, stop)
    hits = F.size(F.filter(_content(_c(a), stop), lambda t: F.array_contains(words, t)))
    return F.coalesce(F.try_divide(hits.cast("double"), n + m - hits), F.lit(0.0))


def position_of(offset, toks) -> Column:
    """Index of the token at a character offset, each token longer than 1 counting one separator; at most the last."""
    step = lambda acc, t: F.when(acc["at"] >= _c(offset), acc).otherwise(
        F.struct((acc["at"] + F.length(t) + F.when(F.length(t) > 1, 1).otherwise(0)).alias("at"), (acc["pos"] + 1).alias("pos"))
    )
    found = F.aggregate(_c(toks), F.struct(F.lit(0).alias("at"), F.lit(0).alias("pos")), step)["pos"]
    return F.least(found, F.size(_c(toks)) - 1)


def weighted_overlap(offset, a, b, step: int, weight: float, stop=STOP_WORDS) -> Column:
    """Hits weighted by distance from the mention, over b's content tokens."""
    words = _c(b)
    pos = position_of(offset, a)
    sums = F.aggregate(
        F.transform(
            _c(a),
            lambda t, i: F.when(
                _counts(t, stop) & F.array_contains(words, t),
                F.greatest(F.lit(0.0), 1.0 - F.floor(F.abs(pos - i) / step) * weight),
            ).otherwise(0.0),
        ),
        F.lit(0.0),
        lambda x, y: x + y,
    )
    n = content_length(b, stop)
    return F.when((content_length(a, stop) == 0) | (n == 0), 0.0).otherwise(sums / n)


def relative(d, denominator) -> Column:
    """A difference over the absolute denominator, or the difference itself if that is 0."""
    return F.when(_c(denominator) == 0, _c(d)).otherwise(_c(d) / F.abs(_c(denominator)))
