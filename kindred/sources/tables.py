"""Readers of input tables and sinks of result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def write_results(tables: dict[str, DataFrame], folder: str, kind: str = "csv") -> None:
    """Each table to its own folder; as csv, arrays and structs are written as JSON."""
    for name, table in tables.items():
        if kind == "csv":
            flat = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in table.dtypes]
            table.select(*flat).write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            table.write.mode("overwrite").parquet(f"{folder}/{name}")
