"""Dice similarity of character bigrams as an expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bigrams(c: Column) -> Column:
    """All bigrams of a text, in order, as often as they come; none where it is shorter than 2."""
    return F.when(F.length(c) >= 2, F.transform(F.sequence(F.lit(1), F.length(c) - 1), lambda i: F.substring(c, i, F.lit(2)))).otherwise(F.array().cast("array<string>"))


def dice(a: Column, b: Column) -> Column:
    """2 * common / (bigrams of a + bigrams of b), counting repeats; equal texts 1, else 0 if one is shorter than 2."""
    x, y = bigrams(a), bigrams(b)
    count = lambda items, e: F.size(F.filter(items, lambda z: z == e))
    common = F.aggregate(F.array_intersect(x, y), F.lit(0), lambda s, e: s + F.least(count(x, e), count(y, e)))
    share = 2.0 * common / (F.length(a) + F.length(b) - 2)
    return F.when(a == b, 1.0).when((F.length(a) < 2) | (F.length(b) < 2), 0.0).otherwise(share)
