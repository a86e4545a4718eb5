"""Places of rows in a global order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.operators.graph import ensure_checkpoint_dir


def ranked(df: DataFrame, order: list[str]) -> DataFrame:
    """Adds place, 0 to n - 1 in the given order: a range sort, written once, and an offset for each of its
    partitions. Rows equal in ``order`` take their places as they come."""
    ensure_checkpoint_dir(df)
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}).checkpoint()
    # a row for each partition
    counts = ordered.groupBy("_p").agg(F.count("*").alias("_n"), F.min("_i").alias("_lo"))
    shifts = counts.select("_p", (F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n") - F.col("_lo")).alias("_o"))
    return ordered.join(F.broadcast(shifts), "_p").withColumn("place", F.col("_i") + F.col("_o")).drop("_p", "_i", "_o")
