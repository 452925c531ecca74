"""Vector columns: hashing, quantising, cosine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fnv(word: Column, seed: int = 2166136261) -> Column:
    """32-bit FNV-1a of an ASCII word, unsigned, as a long."""
    codes = F.slice(F.split(word, ""), F.lit(1), F.length(word))  # a split into letters ends in an empty one
    step = lambda h, c: (h.bitwiseXOR(F.ascii(c).cast("long")) * F.lit(16777619)).bitwiseAND(F.lit(4294967295))
    return F.when(F.length(word) > 0, F.aggregate(codes, F.lit(seed).cast("long"), step)).otherwise(F.lit(seed).cast("long"))


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def dot(a: Column, b: Column) -> Column:
    """Dot product over the shorter length."""
    n = F.least(F.size(a), F.size(b))
    return F.aggregate(F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _with(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: inside a lambda it would be computed for every element."""
    return F.get(F.transform(F.array(value), use), 0)


def unit(v: Column) -> Column:
    """L2-normalised; a zero vector stays."""
    n = norm(v)
    return _with(F.when(n == 0, 1.0).otherwise(n), lambda m: F.transform(v, lambda x: x.cast("double") / m))


def quantised(v: Column) -> Column:
    """int8 by the largest magnitude, halves rounded up."""
    top = F.aggregate(v, F.lit(0.0), lambda a, x: F.greatest(a, F.abs(x.cast("double"))))
    return _with(F.when(top == 0, 1.0).otherwise(top), lambda m: F.transform(v, lambda x: F.floor(x.cast("double") / m * 127 + 0.5).cast("tinyint")))


def dequantised(q: Column) -> Column:
    return unit(q)
