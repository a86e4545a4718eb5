"""Steps that must not grow with the rows in one place: held against plans and small brute-force results."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions.quantile import medians
from kindred.operators import api, explain


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def fitted(spark):
    v = np.random.default_rng(1).normal(size=(60, 2))
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(v)], "row_id long, a double, b double")
    return df, api.cluster(df, "kmeans", 3, features=["a", "b"], starts=[[[-1.0, 0.0], [0.0, 1.0], [1.0, 0.0]]], iter_max=0)


def test_profile_scores_join_nothing(spark, fitted):
    """A profile's sigma comes from its own row, so nothing of all observations is joined or broadcast."""
    df, fit = fitted
    found = explain.ceteris_paribus(fit, df, ["a"], grid={"a": [-1.0, 0.5]}, target="score", cluster=1).profiles
    assert "Join" not in plan(found) and "Exchange" not in plan(found)
    mean, centers = np.array([df.agg(F.avg(c)).first()[0] for c in "ab"]), np.array(fit.centers)
    want = {}
    for r in df.collect():
        d = np.array([np.sqrt(((np.array([v, r.b]) - mean - centers) ** 2).sum(axis=1)) for v in (-1.0, 0.5)])
        e = np.exp(-(d**2) / (2 * np.median(d) ** 2))
        want |= {(r.row_id, v): pytest.approx(e[i, 0] / e[i].sum()) for i, v in enumerate((-1.0, 0.5))}
    assert {(r.observation, r.feature_value_num): r.value for r in found.collect()} == want


@pytest.mark.parametrize("target", ["cluster", "score"])
def test_local_slopes_of_whole_observations(spark, fitted, target):
    """Batches that end within an observation do not cut it; nothing is joined for a cluster's slopes."""
    df, fit = fitted
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "17")
    try:
        found = explain.lime_explain(fit, df, n_permutations=40, target=target)
        assert target == "score" or "Join" not in plan(found.explanations)
        rows = {(r.observation, r.feature): r.estimate for r in found.explanations.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    again = explain.lime_explain(fit, df, n_permutations=40, target=target).explanations.collect()
    assert len(rows) == 120 and rows == {(r.observation, r.feature): pytest.approx(r.estimate) for r in again}


def test_medians_of_few_groups_shuffle_no_rows(spark):
    df = spark.range(3001).select((F.col("id") % 3).alias("g"), ((F.col("id") * 7919) % 3001).cast("double").alias("v"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = medians(df, ["g"], "v")
        assert "SortMergeJoin" not in plan(found)
        rows = {r.g: r["median"] for r in found.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert rows == {g: float(np.median([(i * 7919) % 3001 for i in range(g, 3001, 3)])) for g in range(3)}
