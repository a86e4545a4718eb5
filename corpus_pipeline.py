"""From documents to a training order, in five stages that are each written and read again.

Each stage is a function of (spark, docs, sf_dir) and works on all rows that its predecessor kept. All
but the last return the columns of documents; the last adds the epoch and training position of a copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from kindred.llm import contain, curriculum, minhash, pii, quality_rules
from kindred.llm.common import Shelf, released


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a quality rule rejects go."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words a shingle, similarity 0.8)."""
    return minhash.keep_first(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain a benchmark item go (five words a shingle, containment 0.8)."""
    return contain.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def redact_personal(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data in texts is replaced by its kind."""
    return pii.redact(docs)


def order_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix to target weights: a row for each copy, range-sorted by training position."""
    return curriculum.training_order(docs)


STAGES = [
    ("quality_rules", quality),
    ("minhash_near_dedup", near_dedup),
    ("decontamination", decontaminate),
    ("pii_redaction", redact_personal),
    ("curriculum_mix", order_mix),
]

#: The field of the fourth stage is trained, which SQL can't express; tests/llm holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet under the shared folder and reread."""
    shelf = Shelf(spark, "pipeline")
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        with released():  # what a stage wrote for itself goes when its result is written
            docs = shelf.put(stage(spark, docs, sf_dir), name)
        if before:
            shelf.drop(before)
        before = name
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
