"""Pairwise distances. Pairs are i < j, of any number of rows: a task takes two blocks of them.
Neighbourhoods within a radius are in ``partition`` and have none."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.expr import array_distance, missing
from kindred.functions.preprocess import feature_types
from kindred.operators.partition import distances_to

MOST_ROWS = 5000
PAIR_ROWS, MOST_PAIR_ROWS, MOST_BLOCKS, MOST_TASKS, MOST_FLAT = 1024, 16_384, 32, 20_000, 32


@dataclass(frozen=True)
class Origin:
    """What a table of distances is made of, where that is known (its attribute ``origin``): (row_id, x) and the distances of
    two blocks of rows. Who reduces the table may then make it piece by piece within tasks, and none of it is written."""

    rows: DataFrame
    between: Callable[[np.ndarray, np.ndarray], np.ndarray]


def origin_of(pairs: DataFrame) -> Origin | None:
    """The origin of a table of all pairs of two rows and more; None where values are missing or rows share an id, or of other tables."""
    found = getattr(pairs, "origin", None)
    if found is None:
        return None
    gap = F.exists("x", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    n, ids, gaps, widths = found.rows.agg(F.count("*"), F.countDistinct("row_id"), F.count(F.when(F.col("x").isNull() | gap, 1)), F.countDistinct(F.size("x"))).first()
    return found if n > 1 and ids == n and not gaps and widths == 1 else None


def check_rows(df: DataFrame, most: int, what: str) -> int:
    n = df.limit(most + 1).count()
    if n > most:
        raise ValueError(f"{what} is quadratic in the rows and limited to {most} of them (max_exact_rows)")
    return n


def vectors(df: DataFrame, id_col: str, features: list[str]) -> DataFrame:
    """(row_id, x)."""
    return df.select(F.col(id_col).alias("row_id"), F.array(*(F.col(f"`{f}`").cast("double") for f in features)).alias("x"))


def row_pairs(df: DataFrame, most_rows: int | None = None) -> DataFrame:
    """Each two rows once, as columns a_ and b_ with the lesser id in a_row_id. Rows are dealt by hash to blocks of about
    PAIR_ROWS and a task joins two blocks, so no task and no broadcast grows with the rows; the pairs do, with their square.
    A row is shuffled once for each block, so beyond MOST_BLOCKS of them blocks grow, up to MOST_PAIR_ROWS, and not their number."""
    df = df.where("row_id IS NOT NULL")
    n = df.count() if most_rows is None else check_rows(df, most_rows, "a pairwise distance")
    blocks = max(1, -(-n // min(MOST_PAIR_ROWS, max(PAIR_ROWS, -(-n // MOST_BLOCKS)))))
    tasks = min(MOST_TASKS, blocks * (blocks + 1) // 2)
    own = F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int")
    side = lambda c: df.select(own.alias("_own"), *(F.col(f"`{n}`").alias(f"{c}_{n}") for n in df.columns))
    left = side("a").withColumn("_with", F.explode(F.sequence(F.col("_own"), F.lit(blocks - 1)))).withColumn("_task", F.col("_own") * blocks + F.col("_with"))
    right = side("b").withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_own")))).withColumn("_task", F.col("_with") * blocks + F.col("_own"))
    left, right = left.withColumn("_same", F.col("_own") == F.col("_with")).drop("_own", "_with"), right.drop("_own", "_with")
    both = left.repartition(tasks, "_task").hint("merge").join(right.repartition(tasks, "_task"), "_task").where(~F.col("_same") | (F.col("a_row_id") < F.col("b_row_id")))
    return both.withColumns({"a_row_id": F.least("a_row_id", "b_row_id"), "b_row_id": F.greatest("a_row_id", "b_row_id")})


def euclidean_pairs(x: DataFrame, max_exact_rows: int | None = None) -> DataFrame:
    """(i, j, d) of a (row_id, x) table."""
    p = x.agg(F.max(F.size("x"))).first()[0] or 0
    flat = [f"x{f}" for f in range(p)] if p <= MOST_FLAT else None
    own = x.select("row_id", *("x" if flat is None else F.get("x", F.lit(f)).alias(c) for f, c in enumerate(flat or ["x"])))
    terms = [F.col(f"a_{c}") - F.col(f"b_{c}") for c in flat or []]
    d = array_distance(F.col("a_x"), F.col("b_x")) if flat is None else F.sqrt(sum((t * t for t in terms), F.lit(0.0)))
    pairs = row_pairs(own, max_exact_rows).select(F.col("a_row_id").alias("i"), F.col("b_row_id").alias("j"), d.alias("d"))
    pairs.origin = Origin(x.where("row_id IS NOT NULL").select("row_id", "x"), distances_to)
    return pairs


def mixed_distance(df: DataFrame, id_col: str, features: list[str], metric: str = "gower", ordinal: dict[str, list] | None = None, weights: dict[str, float] | None = None, max_exact_rows: int | None = None) -> DataFrame:
    """(i, j, d): Gower's dissimilarity, or euclidean or manhattan of numeric columns.

    A feature counts for a pair that has both values; a pair without any has null. Ordinal features,
    given with their levels in order, count by rank. A feature without range contributes 0.
    """
    types = feature_types(df, features, ordinal=tuple(ordinal or ()), promote=False)
    if metric in ("euclidean", "manhattan"):
        rows = row_pairs(df.select(F.col(id_col).alias("row_id"), *(F.col(f).cast("double").alias(f) for f in features)), max_exact_rows)
        terms = [F.col(f"a_{f}") - F.col(f"b_{f}") for f in features]
        total = sum((t * t if metric == "euclidean" else F.abs(t) for t in terms), F.lit(0.0))
        return rows.select(F.col("a_row_id").alias("i"), F.col("b_row_id").alias("j"), (F.sqrt(total) if metric == "euclidean" else total).alias("d"))
    if metric != "gower":
        raise ValueError(f"unknown metric {metric}")
    own: dict[str, Column] = {}
    for f in features:
        if types[f] == "ordinal":
            own[f] = F.array_position(F.array(*(F.lit(str(v)) for v in ordinal[f])), F.col(f).cast("string")).cast("double")
        elif types[f] == "numeric":
            c = F.col(f).cast("double")
            own[f] = F.when(missing(c, True), None).otherwise(c)
        else:
            own[f] = F.col(f).cast("string")
    base = df.select(F.col(id_col).alias("row_id"), *(c.alias(f) for f, c in own.items()))
    scaled = [f for f in features if types[f] != "categorical"]
    ranges = base.agg(F.lit(1), *((F.max(f) - F.min(f)).alias(f) for f in scaled)).first()
    top, bottom = F.lit(0.0), F.lit(0.0)
    for f in features:
        a, b, w = F.col(f"a_{f}"), F.col(f"b_{f}"), float((weights or {}).get(f, 1.0))
        both = a.isNotNull() & b.isNotNull()
        s = (F.abs(a - b) / F.lit(float(ranges[f])) if ranges[f] else F.lit(0.0)) if f in scaled else F.when(a != b, 1.0).otherwise(0.0)
        top, bottom = top + F.when(both, F.lit(w) * s).otherwise(0.0), bottom + F.when(both, F.lit(w)).otherwise(0.0)
    pairs = row_pairs(base, max_exact_rows).select(F.col("a_row_id").alias("i"), F.col("b_row_id").alias("j"), F.when(bottom > 0, top / bottom).alias("d"))
    shares = [float((weights or {}).get(f, 1.0)) for f in features]
    if features and len(scaled) == len(features) and min(shares) > 0:
        each = [(w, float(ranges[f] or 0.0)) for f, w in zip(features, shares, strict=True)]

        def between(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.zeros((len(x), len(y)))
            for f, (w, r) in enumerate(each):
                if r:
                    out += w * (np.abs(x[:, f, None] - y[None, :, f]) / r)
            return out / sum(shares)

        pairs.origin = Origin(vectors(base.where("row_id IS NOT NULL"), "row_id", features), between)
    return pairs
