"""Fits of a grid and of resamples in one pass, and the silhouette estimate."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import api, metrics


def table(spark, x):
    return spark.createDataFrame([(i, *map(float, v)) for i, v in enumerate(x)], "row_id long, " + ", ".join(f"f{j} double" for j in range(len(x[0]))))


@pytest.fixture(scope="module")
def blobs(spark):
    rng = np.random.default_rng(6)
    return table(spark, np.concatenate([rng.normal(size=(60, 2)) + c for c in ((0, 0), (6, 1), (1, 7))])).repartition(3).persist()


def test_grid_is_the_fits(blobs):
    options = {"features": ["f0", "f1"], "scale": True, "nstart": 3}
    together = api.cluster_grid(blobs, [2, 3, 5], seeds=[4, 5, 6], **options)
    for fit, k, seed in zip(together, (2, 3, 5), (4, 5, 6), strict=True):
        alone = api.cluster(blobs, "kmeans", k, seed=seed, **options)
        assert np.allclose(fit.centers, alone.centers) and fit.extras["tot_withinss"] == pytest.approx(alone.extras["tot_withinss"])
    found = api.validate(blobs, k=[2, 3], metrics_wanted=["total_within"], seed=4, **options).metrics_table.collect()
    assert {r.k: r.value for r in found}.keys() == {2, 3}
    with pytest.raises(ValueError, match="exceed"):
        api.cluster_grid(blobs.limit(4), [2, 9], features=["f0"])


def test_resamples_at_once_are_the_resamples(blobs):
    """Weights stand for repeated rows: the same agreement as from refits of the drawn rows, one after another."""
    for scale in (False, True):
        fit = api.cluster(blobs, "kmeans", 3, features=["f0", "f1"], scale=scale, seed=2)
        # in the units that refits have, which are those of each resample where it is scaled
        one = api.bootstrap_ari(fit, 3, seed=5)
        two = api.bootstrap_ari(fit, 3, seed=5, refit=lambda s, scale=scale: api.cluster(s, "kmeans", 3, id_col="draw_id", features=["f0", "f1"], scale=scale, seed=5).clusters)
        assert one == pytest.approx(two)


def test_weighted_round_brute(blobs):
    fit = api.cluster(blobs, "kmeans", 2, features=["f0"], center=False, starts=[[[0.0], [5.0]]], iter_max=1)
    got = api.bootstrap_ari(fit, 2, seed=3, starts=[[[0.0], [5.0]]], iter_max=1)[0]
    x = np.array([r.f0 for r in blobs.orderBy("row_id").collect()])
    label = lambda v, c: (np.abs(v - c[0]) > np.abs(v - c[1])).astype(int)
    means = lambda v: (lambda g: (v[g == 0].mean(), v[g == 1].mean()))(label(v, (0.0, 5.0)))
    values = []
    for b in range(2):
        at = [r.place for r in api.draws_of(blobs.sparkSession, len(x), 3000 + b).orderBy("draw").collect()]
        one, two = label(x[at], means(x)), label(x[at], means(x[at]))
        cells = [(a, c, int(((one == a) & (two == c)).sum())) for a in (0, 1) for c in (0, 1)]
        values.append(metrics.ari_of_counts([c for c in cells if c[2]]))
    assert got == pytest.approx(np.mean(values))


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_silhouette_estimate_within_its_bound(spark, seed):
    rng = np.random.default_rng(seed)
    sizes, centers = (400, 150, 60, 1), rng.normal(size=(4, 3)) * 2
    x = np.concatenate([rng.normal(size=(n, 3)) + c for n, c in zip(sizes, centers, strict=True)])
    rows = [(i, int(g), v.tolist()) for i, (g, v) in enumerate(zip(np.repeat([1, 2, 3, 7], sizes), x, strict=True))]
    labelled = spark.createDataFrame(rows, "row_id long, cluster int, x array<double>").repartition(5)
    exact = {r.row_id: r.width for r in metrics.silhouette_rows(labelled).collect()}
    found = {r.row_id: r for r in metrics.silhouette_estimates(labelled, per_cluster=80, seed=seed).collect()}
    assert found.keys() == exact.keys()
    mean, error = np.mean([r.width for r in found.values()]), np.mean([r.error for r in found.values()])
    assert abs(mean - np.mean(list(exact.values()))) <= error < 0.5
    assert np.mean([abs(r.width - exact[i]) <= r.error + 1e-9 for i, r in found.items()]) > 0.97
    # samples that hold whole clusters leave no error
    whole = {r.row_id: r for r in metrics.silhouette_estimates(labelled, per_cluster=1000).collect()}
    assert all(abs(r.width - exact[i]) < 1e-9 and r.error < 1e-9 for i, r in whole.items())


def test_silhouette_by_parameter(blobs):
    fit = api.cluster(blobs, "kmeans", 3, features=["f0", "f1"], seed=1)
    exact = api.validate(fit, metrics_wanted=["silhouette"])
    assert exact.settings["silhouette"] == "exact" and "silhouette_error" not in exact.extras
    for how in ({"silhouette": "estimate"}, {"silhouette_rows": 50}):
        found = api.validate(fit, metrics_wanted=["silhouette"], **how)
        assert found.settings["silhouette"] == "estimate"
        assert abs(found.metrics_table.first().value - exact.metrics_table.first().value) <= found.extras["silhouette_error"] + 1e-9
    with pytest.raises(ValueError, match="silhouette"):
        api.validate(fit, metrics_wanted=["silhouette"], silhouette="fast")
    with pytest.raises(ValueError, match="most_values"):
        metrics.silhouette_estimates(blobs.select("row_id", F.lit(1).alias("cluster"), F.array("f0").alias("x")), most_values=10)
    one = metrics.silhouette_estimates(blobs.select("row_id", F.lit(1).alias("cluster"), F.array("f0").alias("x")))
    assert {r.width for r in one.collect()} == {None}
