"""Vector scalar functions as native column expressions.

Quantization: one scale per vector, scale = max|x| / 127 in float32, codes in [-127, 127]. Vectors whose scale is under
1e-30 have scale 0 and zero codes. Dots are taken in int (products of tinyint overflow under ANSI)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def _f(x) -> Column:
    return x.cast("float")


def pad_dim(d) -> Column:
    """Dimension rounded up to a multiple of 16."""
    return (F.ceil(d / 16) * 16).cast("int")


def bytes_per_vector(d) -> Column:
    return pad_dim(d) + 4


def float_bytes(d) -> Column:
    return d * 4


def pq_bytes(m) -> Column:
    """Bytes of m codes of 4 bits."""
    return m * 4 / 8


def synthetic(spark, n: int, dim: int, seed: int = 0):
    """(id, v): n vectors of normal components, L2-normalized; the same for a seed, however they are dealt to tasks."""
    two = lambda i, salt: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), i, F.lit(salt)), F.lit(1 << 52)) + 1) / float((1 << 52) + 1)
    normal = F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), lambda i: F.sqrt(-2 * F.log(two(i, 1))) * F.cos(2 * math.pi * two(i, 2)))
    rows = spark.range(n).select("id", normal.alias("v"))
    return rows.select("id", F.transform(l2_normalize(F.col("v")), _f).alias("v"))


def max_abs(v: Column) -> Column:
    return F.array_max(F.transform(v, lambda x: F.abs(_f(x))))


def scale(v: Column) -> Column:
    s = _f(max_abs(v) / F.lit(127.0).cast("float"))
    return F.when(s < 1e-30, F.lit(0.0).cast("float")).otherwise(s)


def codes(v: Column, s: Column, rounding: str = "away") -> Column:
    """rounding: "away" (half away from zero) or "even"."""
    inv = F.when(s > 0, _f(F.lit(1.0).cast("float") / s)).otherwise(F.lit(0.0).cast("float"))
    near = (lambda x: F.rint(x)) if rounding == "even" else (lambda x: F.signum(x) * F.floor(F.abs(x).cast("double") + 0.5))
    return F.transform(v, lambda x: F.greatest(F.lit(-127.0), F.least(F.lit(127.0), near(_f(_f(x) * inv)))).cast("tinyint"))


def dequantize(c: Column, s: Column) -> Column:
    return F.transform(c, lambda x: _f(_f(x) * s))


def int_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda t, x: t + x)


def float_dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda t, x: t + x)


def rescale(dot: Column, qs: Column, vs: Column) -> Column:
    """(float)dot * query scale * vector scale, in float32, left to right."""
    return _f(_f(_f(dot) * qs) * vs)


def l2_normalize(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") / F.greatest(F.sqrt(float_dot(v, v)), F.lit(1e-12)))


def mean_pool(states: Column, mask: Column) -> Column:
    """Mean of the token vectors (array of arrays) whose mask is 1; the divisor is at least 1e-9."""
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda t, m: t + m), F.lit(1e-9))
    kept = F.filter(F.zip_with(states, mask, lambda s, m: F.when(m > 0, s)), lambda s: s.isNotNull())
    zero = F.transform(F.element_at(states, 1), lambda x: F.lit(0.0))
    return F.transform(F.aggregate(kept, zero, lambda t, s: F.zip_with(t, s, lambda a, b: a + b.cast("double"))), lambda x: x / n)


def reconstruction_error(v: Column, c: Column, s: Column) -> Column:
    return F.array_max(F.zip_with(v, dequantize(c, s), lambda a, b: F.abs(_f(a) - b)))


def requantize_global(v: Column, gscale: Column, low: int = -127, high: int = 127) -> Column:
    """Codes on one scale for all vectors."""
    return F.transform(v, lambda x: F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.rint(_f(_f(_f(x) / gscale) * F.lit(127.0).cast("float"))))).cast("int"))


def affine_codes(v: Column, gscale: Column, low: int, high: int) -> Column:
    """x / scale * (high - low) / 2 + (high + low) / 2, rounded: the direct signed and unsigned forms."""
    return F.transform(v, lambda x: F.rint(x.cast("double") / gscale * ((high - low) / 2) + (high + low) / 2).cast("int"))


def invalid(v: Column, dim: int) -> Column:
    """Whether a vector is null, of another length, or holds null or non-finite values."""
    return v.isNull() | (F.size(v) != dim) | F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
