"""Registered queries of the corpus operators and their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import contain, curriculum, fim, html_diff, lm_diff, merkle, mil, minhash, pii, quality_rules, secrets_scan, url_filter, warc


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_cross_entropy_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    return lm_diff.score(_read(spark, sf_dir, "documents"), good)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality_rules.judge(_read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op3_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_diff.extract(_read(spark, sf_dir, "pages"))


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_read(spark, sf_dir, "pages"))


def op5_curriculum_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = curriculum.mix(_read(spark, sf_dir, "documents"), keep=["doc_id"])
    return mixed.select("row.doc_id", "size", "source_size", "target", "taken", *(F.round(F.get("positions", F.lit(i)), 6).alias(c) for i, c in enumerate(("position", "position_2"))))


def op6_pii_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(_read(spark, sf_dir, "documents"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_read(spark, sf_dir, "documents"), k=3, percent=85)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contain.search(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op9_secret_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets_scan.find(_read(spark, sf_dir, "documents"))


def op10_quality_attention(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return mil.score(docs, mil.train(docs, _read(spark, sf_dir, "labels")))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.prove(_read(spark, sf_dir, "documents"), merkle.tampered())


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digests(_read(spark, sf_dir, "documents"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(_read(spark, sf_dir, "pages"), url_filter.train(url_filter.labelled_table(spark)))


QUERIES = {f.__name__: f for f in (op1_cross_entropy_difference, op2_quality_rules, op3_page_differencing, op4_warc_chunks, op5_curriculum_mix, op6_pii_field, op7_minhash_near_dedup, op8_decontamination, op9_secret_automata, op10_quality_attention, op11_merkle_manifest, op12_fill_in_middle, op13_url_filter)}

ORACLES = {
    "op2_quality_rules": "WITH " + quality_rules.oracle_cte() + " SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept FROM judged",
    "op5_curriculum_mix": curriculum.oracle(),
    "op7_minhash_near_dedup": minhash.oracle(),
    "op4_warc_chunks": warc.oracle(),
    "op11_merkle_manifest": merkle.oracle(),
    "op12_fill_in_middle": fim.oracle(),
    "op13_url_filter": url_filter.oracle(),
}
