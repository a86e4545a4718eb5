"""Exact order statistics by group, of groups of any size.

A sketch gives a bracket about the wanted place first; then one aggregate counts what lies below the
bracket and each distinct value in it, and only these few counts are put in order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ACCURACY, MOST_GROUPS = 10_000, 10_000


def _ordered(df: DataFrame, groups: list[str], value: str, share: float) -> DataFrame:
    """(groups, n, _v, below, through) of the distinct values about ``share`` of the way, of 1, in order. The brackets of at most
    MOST_GROUPS groups are sent to all tasks, so that no rows are shuffled by group, of which there may be few."""
    rows = df.select(*groups, F.col(f"`{value}`").cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    ends = [max(0.0, share - 2 / ACCURACY), min(1.0, share + 2 / ACCURACY)]
    sketch = rows.groupBy(*groups).agg(F.count("*").alias("n"), F.percentile_approx("_v", ends, ACCURACY).alias("_b"))
    found = sketch.limit(MOST_GROUPS + 1).collect()
    few = len(found) <= MOST_GROUPS
    sketch = df.sparkSession.createDataFrame(found, sketch.schema) if few else sketch
    near = F.broadcast if few else (lambda t: t)
    low = F.lit(float("-inf")) if ends[0] == 0 else F.get("_b", F.lit(0))
    high = F.lit(float("inf")) if ends[1] == 1 else F.get("_b", F.lit(1))
    ends_of = near(sketch.select(*groups, low.alias("_low"), high.alias("_high")))
    bounded = rows.join(ends_of, groups) if groups else rows.join(ends_of)
    counts = bounded.where("_v <= _high").groupBy(*groups, F.when(F.col("_v") >= F.col("_low"), F.col("_v")).alias("_v")).agg(F.count("*").alias("_c"))
    through = F.sum("_c").over(Window.partitionBy(*groups).orderBy(F.col("_v").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.select(*groups, "_v", through.alias("through"), (through - F.col("_c")).alias("below"))
    sized = near(sketch.select(*groups, "n"))
    return placed.join(sized, groups) if groups else placed.join(sized)


def at_place(df: DataFrame, groups: list[str], value: str, share: float, place: Callable[[Column], Column], name: str) -> DataFrame:
    """(groups, n, name, below, through): the value at ``place`` (from 0, of n values that are not null or NaN) in
    order, with the numbers of values below it and up to it. ``share`` is about where the place lies, of 1."""
    wanted = place(F.col("n"))
    return _ordered(df, groups, value, share).where((F.col("below") <= wanted) & (wanted < F.col("through"))).select(*groups, "n", F.col("_v").alias(name), "below", "through")


def medians(df: DataFrame, groups: list[str], value: str, name: str = "median") -> DataFrame:
    """(groups, name): groups without any value have no row."""
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    both = _ordered(df, groups, value, 0.5).where((F.col("below") <= hi) & (lo < F.col("through")))
    ends = both.groupBy(*groups).agg(F.min("_v").alias("_lo"), F.max("_v").alias("_hi")).where("_lo is not null")
    return ends.select(*groups, (F.col("_lo") + (F.col("_hi") - F.col("_lo")) / 2).alias(name))


def trimmed_means(df: DataFrame, groups: list[str], value: str, share: float = 0.1, name: str = "trimmed") -> DataFrame:
    """(groups, name): the mean without the floor(share * n) least and greatest values."""
    cut = lambda n: F.floor(n * F.lit(share))
    lo = at_place(df, groups, value, share, cut, "_a").select(*groups, "n", "_a", F.col("through").alias("_upto"))
    hi = at_place(df, groups, value, 1 - share, lambda n: n - 1 - cut(n), "_b").select(*groups, "_b", F.col("below").alias("_under"))
    ends = lo.join(hi, groups) if groups else lo.join(F.broadcast(hi))
    rows = df.select(*groups, F.col(f"`{value}`").cast("double").alias("_v")).where("_v is not null and not isnan(_v)")
    rows = rows.join(ends, groups) if groups else rows.join(F.broadcast(ends))
    inner = F.sum(F.when((F.col("_v") > F.col("_a")) & (F.col("_v") < F.col("_b")), F.col("_v")).otherwise(0.0))
    kept = F.col("n") - 2 * cut(F.col("n"))
    # of the values equal to the ends, those within the kept places
    edge = (F.col("_upto") - cut(F.col("n"))) * F.col("_a") + (F.col("n") - cut(F.col("n")) - F.col("_under")) * F.col("_b")
    total = F.when(F.col("_a") == F.col("_b"), kept * F.col("_a")).otherwise(F.col("_inner") + edge)
    return rows.groupBy(*groups, "n", "_a", "_b", "_upto", "_under").agg(inner.alias("_inner")).select(*groups, (total / kept).alias(name))
