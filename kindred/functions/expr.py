"""Column expressions that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit_array(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def squared(x: list[Column], center) -> Column:
    """Squared Euclidean distance of feature columns to a literal point, as one flat sum."""
    total = F.lit(0.0)
    for c, v in zip(x, center, strict=True):
        total = total + (c - F.lit(float(v))) * (c - F.lit(float(v)))
    return total


def argmin(distances: Column) -> Column:
    """1-based position of the least; of equal ones the first."""
    return F.array_position(distances, F.array_min(distances)).cast("int")


def array_distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    return F.sqrt(F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, v: s + v))


def signif(c: Column, digits: int = 4) -> Column:
    """Rounded to significant digits; zero, null and NaN stay."""
    power = F.pow(F.lit(10.0), F.lit(float(digits - 1)) - F.floor(F.log10(F.abs(c))))
    return F.when((c == 0) | c.isNull() | F.isnan(c), c).otherwise(F.round(c * power) / power)


def missing(c: Column, numeric: bool) -> Column:
    return (c.isNull() | F.isnan(c)) if numeric else c.isNull()


def hash_uniform(*keys) -> Column:
    """A number in (0, 1) from an md5 of the keys as text: it depends on nothing else."""
    digest = F.md5(F.concat_ws(":", *(k.cast("string") for k in keys)))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / F.lit(16.0**13)


def hash_normal(*keys) -> Column:
    """A standard normal draw by Box and Muller from two hashes of the keys."""
    return F.sqrt(-2 * F.log(hash_uniform(*keys, F.lit("r")))) * F.cos(2 * F.lit(3.141592653589793) * hash_uniform(*keys, F.lit("t")))
