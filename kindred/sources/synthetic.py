"""Generated Gaussian groups; the same rows on any partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.functions.expr import hash_normal


def synthetic_clusters(spark: SparkSession, n_per_cluster: int = 40, centers=((0.0, 0.0), (3.0, 3.0), (-3.0, 3.0)), sd: float = 0.5, seed: int = 1) -> DataFrame:
    """(row_id, x1, x2, y)."""
    rows = spark.range(n_per_cluster * len(centers)).withColumn("y", (F.floor(F.col("id") / n_per_cluster) + 1).cast("int"))
    mean = lambda i: F.element_at(F.array(*(F.lit(float(c[i])) for c in centers)), F.col("y"))
    x = [(mean(i) + F.lit(float(sd)) * hash_normal(F.lit(seed), F.col("id"), F.lit(i))).alias(f"x{i + 1}") for i in range(2)]
    return rows.select(F.col("id").alias("row_id"), *x, "y")
