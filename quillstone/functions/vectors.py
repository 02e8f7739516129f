"""Column functions on arrays of doubles: all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where either vector is zero."""
    size = norm(a) * norm(b)
    return F.when(size > 0, dot(a, b) / size).otherwise(0.0)


def pearson(a: Column, b: Column) -> Column:
    """Correlation of two vectors of one length; 0 where one is constant."""
    centred = lambda x: F.transform(x, lambda e: e - total(x) / F.size(x))
    return cosine(centred(a), centred(b))


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(total(F.zip_with(a, b, lambda x, y: (x.cast("double") - y) * (x.cast("double") - y))))


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-clip(x, -60.0, 60.0)))


def softmax(a: Column, temperature: float = 1.0) -> Column:
    """Of an array; one without positive values is uniform."""
    e = F.transform(a, lambda x: F.exp((x - F.array_max(a)) / temperature))
    return F.when(F.array_max(a) > 0, F.transform(e, lambda x: x / total(e))).otherwise(F.transform(a, lambda _: 1 / F.size(a)))


def shares(a: Column) -> Column:
    """Negative values count as 0; a row without positive ones stays 0."""
    up = F.transform(a, lambda x: F.greatest(x, F.lit(0.0)))
    return F.transform(up, lambda x: F.when(total(up) > 0, x / total(up)).otherwise(0.0))


def entropy(a: Column) -> Column:
    """Of scores: they are brought to sum 1 with a floor of 1e-15 each."""
    n = F.size(a)
    return -total(F.transform(a, lambda s: (s + 1e-15) / (total(a) + 1e-15 * n) * F.ln((s + 1e-15) / (total(a) + 1e-15 * n) + 1e-9)))


def jensen_shannon(a: Column, b: Column, floor: float = 1e-12) -> Column:
    """In bits, of two rows of shares, each with a floor and brought to sum 1; 0 to 1."""
    p = F.transform(a, lambda x: (F.greatest(x, F.lit(0.0)) + floor) / (total(a) + floor * F.size(a)))
    q = F.transform(b, lambda x: (F.greatest(x, F.lit(0.0)) + floor) / (total(b) + floor * F.size(b)))
    half = F.zip_with(p, q, lambda x, y: x * F.log2(2 * x / (x + y)) / 2 + y * F.log2(2 * y / (x + y)) / 2)
    return clip(total(half), 0.0, 1.0)
