"""Assignment of a stream of rows to a fit's clusters.

Labels and scores of a fixed sigma are a stateless projection of literal expressions. What needs more than the row
goes by micro-batch (``by_batch``): a density fit joins each batch with its training rows through the cells of pivots,
and scores of no fixed sigma take the median distance of all rows so far from a running sketch, a table of counts by
logarithmic bucket (RATIO apart, so the median is off by less than that). Every batch writes its rows and its
sketch under its own number, from the sketch of the batch before, so a batch that is run again writes the same again.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kindred.operators.api import predict
from kindred.operators.explain import score_rows
from kindred.operators.methods import ClusterFit


def assign_stream(fit: ClusterFit, stream: DataFrame, sigma: float | None = None) -> DataFrame:
    """(row_id, cluster) and, with a fixed sigma (the batch median is not known on a stream), scores."""
    if fit.method == "dbscan":
        raise ValueError("dbscan assigns by a join with its training rows; use by_batch()")
    if sigma is None:
        return predict(fit, stream).clusters
    from kindred.operators.api import feature_columns

    rows = stream.select(F.col(fit.info.id_col).alias("row_id"), *fit.info.features)
    return score_rows(fit, rows, feature_columns(fit), sigma=sigma).select("row_id", "cluster", "scores")


def start(assigned: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    return assigned.writeStream.format("memory").queryName(name).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def to_files(assigned: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All that has arrived, appended to Parquet files at ``path``."""
    return assigned.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


RATIO = 1.001


def sketch_of(distances: DataFrame) -> DataFrame:
    """(bucket, n) of a column v of distances; a distance of nought has no bucket."""
    found = distances.where("v < double('inf')").select(F.when(F.col("v") > 0, F.floor(F.log("v") / math.log(RATIO))).cast("long").alias("bucket"))
    return found.groupBy("bucket").agg(F.count("*").alias("n"))


def sketched_median(sketch: DataFrame) -> float:
    """Of merged sketches; a row for each bucket, some 70,000 between the least and the greatest number at most."""
    rows = sorted((r.bucket is not None, r.bucket or 0, r.n) for r in sketch.groupBy("bucket").agg(F.sum("n").alias("n")).collect())
    total = sum(n for *_, n in rows)

    def at(place: int) -> float:
        for known, bucket, n in rows:
            if place < n:
                return RATIO ** (bucket + 0.5) if known else 0.0
            place -= n
        return 0.0

    return (at((total - 1) // 2) + at(total // 2)) / 2 if total else 0.0


def by_batch(fit: ClusterFit, stream: DataFrame, path: str, scores: bool = False) -> StreamingQuery:
    """All that has arrived, under path: rows (row_id, cluster), with scores by a running sigma where asked for."""
    from kindred.operators.api import feature_columns

    spark = stream.sparkSession

    def one(batch: DataFrame, number: int) -> None:
        if not scores:
            predict(fit, batch).clusters.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
            return
        rows = batch.select(F.col(fit.info.id_col).alias("row_id"), *fit.info.features).persist()
        raw = fit.distances(feature_columns(fit))
        each = rows.select(F.explode(F.transform(raw, lambda v: F.sqrt(v)) if fit.method in ("kproto", "kmm") else raw).alias("v"))
        now = sketch_of(each)
        if number:
            now = now.unionByName(spark.read.schema("bucket long, n long").parquet(f"{path}/sketch/{number - 1}")).groupBy("bucket").agg(F.sum("n").alias("n"))
        now.coalesce(1).write.mode("overwrite").parquet(f"{path}/sketch/{number}")
        sigma = sketched_median(spark.read.parquet(f"{path}/sketch/{number}"))
        scored = score_rows(fit, rows, feature_columns(fit), sigma=sigma).select("row_id", "cluster", "scores", F.lit(sigma).alias("sigma"))
        scored.write.mode("overwrite").parquet(f"{path}/rows/batch={number}")
        rows.unpersist()

    if scores and not fit.distances:
        raise ValueError("scores by distances need a fit with centers")
    return stream.writeStream.foreachBatch(one).option("checkpointLocation", f"{path}/progress").trigger(availableNow=True).start()


def assigned(spark: SparkSession, path: str) -> DataFrame:
    """What by_batch has written, with the number of each row's batch."""
    return spark.read.parquet(f"{path}/rows")
