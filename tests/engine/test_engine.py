import json
import random
from dataclasses import replace
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.functions import preprocess, quantile
from kindred.functions.expr import signif
from kindred.operators import api, consensus, embed, explain, kernels, methods, metrics, plotspec
from kindred.operators.distance import mixed_distance
from kindred.operators.partition import eps_pairs
from kindred.operators.methods import estimate_lambda, fit_dbscan, mixed_distances, predict_dbscan
from kindred.sources.synthetic import synthetic_clusters
from kindred.sources.tables import write_results
from kindred.streaming import assign

NAMES = ["sepal_length", "sepal_width", "petal_length", "petal_width"]
ROWS = [tuple(map(float, r.split(","))) for r in (Path(__file__).parent / "iris.csv").read_text().split()]


@pytest.fixture(scope="module")
def iris(spark):
    kinds = ("setosa", "versicolor", "virginica")
    df = spark.createDataFrame([(i + 1, *r, kinds[i // 50]) for i, r in enumerate(ROWS)], "row_id long, sepal_length double, sepal_width double, petal_length double, petal_width double, species string")
    return df.coalesce(2).persist()


@pytest.fixture(scope="module")
def fit3(iris):
    return api.cluster(iris, "kmeans", 3, features=NAMES, seed=1)


@pytest.fixture(scope="module")
def mixed6(spark):
    rows = [(1, 1.0, 0.0, "a"), (2, 1.2, 0.1, "a"), (3, 5.0, 3.0, "b"), (4, 5.2, 3.2, "b"), (5, 1.1, 0.2, "a"), (6, 5.1, 3.1, "b")]
    return spark.createDataFrame(rows, "row_id long, x double, y double, group string")


def groups(labels):
    out = {}
    for r in labels.collect():
        out.setdefault(r.cluster, set()).add(r.row_id)
    return sorted(map(sorted, out.values()))


@pytest.mark.parametrize("k,want", [(2, (0.681, 513.9, 0.4043, 152.3)), (3, (0.5528, 561.6, 0.662, 78.85)), (4, (0.4981, 530.8, 0.7803, 57.23)), (6, (0.3648, 473.9, 0.9142, 39.04))])
def test_published_metrics(iris, k, want):
    v = api.validate(api.cluster(iris, "kmeans", k, features=NAMES, seed=1), n_boot=0)
    got = {r.metric: r.value for r in v.rounded().collect()}
    assert (got["silhouette"], got["calinski_harabasz"], got["davies_bouldin"], got["total_within"]) == want


def test_moves_lower_the_cost(spark):
    """Where rounds of means are at rest, moving the row still lowers the cost."""
    x = [0.0, 1.0, 2.6, 4.0]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x)], "row_id long, x double")
    fit = api.cluster(df, "kmeans", 2, features=["x"], center=False, starts=[[[0.0], [2.5333333]]])
    best = min(sum(np.var(part) * len(part) for part in (x[:i], x[i:])) for i in (1, 2, 3))
    assert fit.extras["tot_withinss"] == pytest.approx(best)


def test_kmeans_sizes_predict_and_truth(iris, fit3):
    assert sorted(r["size"] for r in api.sizes(fit3).collect()) == [38, 50, 62]
    p = api.predict(fit3, iris)
    assert groups(p.clusters) == groups(fit3.clusters) and p.prediction_type == "nearest_centroid"
    truth = iris.select("row_id", F.col("species").alias("cluster"))
    v = {r.metric: r.value for r in api.validate(fit3, truth=truth, metrics_wanted=["ari", "nmi"]).metrics_table.collect()}
    assert abs(v["ari"] - 0.7302) < 1e-3 and abs(v["nmi"] - 0.7582) < 1e-3
    assert api.describe(fit3) == "<cluster_fit>\n  Method: kmeans\n  Observations: 150\n  Clusters: 3"
    text = api.describe(api.summary(fit3))
    assert text.startswith("Cluster fit summary\n  Method: kmeans") and text.count("=") == 3 and not api.summary(fit3).values["has_prototypes"]
    assert "<cluster_prediction>\n  Method: kmeans\n  Predictions: 150" == api.describe(p) and len(api.centers(fit3)) == 3 and api.method_used(fit3) == "kmeans"


def test_trees(spark, iris):
    fits = {link: api.cluster(iris, "hclust", 3, features=NAMES, linkage=link) for link in ("complete", "single", "average", "ward.D2")}
    got = {k: sorted(r["size"] for r in api.sizes(f).collect()) for k, f in fits.items()}
    assert got["average"] == [36, 50, 64] and got["ward.D2"] == [36, 50, 64] and got["complete"] == [28, 50, 72] and got["single"] == [2, 50, 98]
    agnes = api.cluster(iris, "agnes", 3, features=NAMES)
    assert groups(agnes.clusters) == groups(fits["average"].clusters) and 0 < agnes.extras["agglomerative_coefficient"] < 1
    assert plotspec.plot_dendrogram(agnes).data.count() == 149
    four = spark.createDataFrame([(1, 1.0, "a"), (2, 2.0, "a"), (3, 8.0, "b"), (4, 9.0, "b")], "row_id long, x double, group string")
    d = mixed_distance(four, "row_id", ["x", "group"])
    assert {(r.i, r.j): r.d for r in d.collect()}[1, 2] == pytest.approx(1 / 16)
    fit = api.cluster(d, "hclust", 2)
    assert groups(fit.clusters) == [[1, 2], [3, 4]]
    with pytest.raises(ValueError, match="distance"):
        api.validate(fit)
    assert api.explore(fit).feature_summary is None and api.explore(fit).embedding_method == "mds"


def test_merge_heights_brute():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(12, 2))
    d = kernels.distances(x)
    for link in ("single", "complete", "average"):
        parts = [[i] for i in range(12)]
        heights = []
        while len(parts) > 1:
            how = {"single": np.min, "complete": np.max, "average": np.mean}[link]
            h, a, b = min((how(d[np.ix_(p, q)]), i, j) for i, p in enumerate(parts) for j, q in enumerate(parts) if i < j)
            heights.append(h)
            parts = [p for i, p in enumerate(parts) if i not in (a, b)] + [parts[a] + parts[b]]
        assert np.allclose(kernels.agglomerate(d, link)[1], heights)


def test_pam(iris):
    fit = api.cluster(iris, "pam", 3, features=NAMES)
    assert sorted(r["size"] for r in api.sizes(fit).collect()) == [38, 50, 62] and sorted(fit.extras["medoid_ids"]) == [8, 79, 113]
    assert api.cluster(iris, "pam", 3, features=NAMES, max_exact_rows=100).extras["medoid_ids"] == fit.extras["medoid_ids"]
    assert api.cluster(iris, "pam", 3, features=NAMES, max_exact_rows=100, approximate=True).extras["cost"] < 1.15 * fit.extras["cost"]


def test_dbscan(spark):
    df = synthetic_clusters(spark)
    fit = api.cluster(df, "dbscan", id_col="row_id", features=["x1", "x2"], eps=0.9, minPts=5)
    truth = {r.row_id: r.y for r in df.collect()}
    assert fit.n_clusters == 3
    x = np.array([(r.x1, r.x2) for r in df.orderBy("row_id").collect()])
    near = kernels.distances(x) <= 0.9
    core = near.sum(axis=1) >= 5
    for r in fit.clusters.collect():
        assert (r.cluster > 0) == bool((near[r.row_id] & core).any())
        assert r.cluster in (0, truth[r.row_id])
    train = spark.createDataFrame([(1, [0.0]), (2, [0.1]), (3, [10.0]), (4, [10.1])], "row_id long, x array<double>")
    labels = spark.createDataFrame([(1, 1), (2, 1), (3, 2), (4, 2)], "row_id long, cluster int")
    four = synthetic_clusters(spark, 900)  # more rows than a block
    big = api.cluster(four, "dbscan", id_col="row_id", features=["x1", "x2"], eps=0.3, minPts=5)
    y = np.array([(r.x1, r.x2) for r in four.orderBy("row_id").collect()])
    close = kernels.distances(y) <= 0.3
    solid = close.sum(axis=1) >= 5
    assert all((r.cluster > 0) == bool((close[r.row_id] & solid).any()) for r in big.clusters.collect())
    own = api.ClusterFit("dbscan", {"eps": 0.5}, labels, 2, fit.info, training=train)
    new = spark.createDataFrame([(1, [0.05]), (2, [100.0])], "row_id long, x array<double>")
    assert {r.row_id: r.cluster for r in predict_dbscan(own, new).collect()} == {1: 1, 2: 0}
    for bad in ({"eps": 0, "min_pts": 2}, {"eps": 1.0, "min_pts": 0}):
        with pytest.raises(ValueError):
            fit_dbscan(train, fit.info, **bad)


def test_eps_pairs_brute(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, list(map(float, r))) for i, r in enumerate(x)], "row_id long, x array<double>")
    d = kernels.distances(x)
    assert {(r.i, r.j) for r in eps_pairs(df, df, 0.8).collect()} == {(i, j) for i in range(60) for j in range(60) if d[i, j] <= 0.8}


def test_gmm(iris):
    assert all(api.cluster(iris, "gmm", 2, features=NAMES, seed=1, families=(f,), iter_max=3).extras["model_name"] == f for f in ("EVE", "VVE"))
    fit = api.cluster(iris, "gmm", 3, features=NAMES, seed=1, families=("EII", "VVV"), iter_max=25)
    assert fit.extras["model_name"] == "VVV" and sorted(r["size"] for r in api.sizes(fit).collect())[1] in (45, 46, 47, 48, 49, 50)
    assert all(abs(sum(r.membership) - 1) < 1e-9 for r in fit.membership.collect())
    assert groups(api.predict(fit, iris).clusters) == groups(fit.clusters)


def test_covariance_families():
    """Each family's covariances have its form, and no small step within it is likelier."""
    rng = np.random.default_rng(7)
    n, p = np.array([40.0, 25.0, 35.0]), 3
    s = np.stack([(lambda a: a @ a.T * m)(rng.normal(size=(p, p)) + np.eye(p)) for m in n])
    loss = lambda cov: sum(m * np.linalg.slogdet(c)[1] + np.trace(w @ np.linalg.inv(c)) for m, w, c in zip(n, s, cov))
    found = {f: methods._shape(f, n, s, 0.0) for f in methods.FAMILIES}
    inside = {"EII": ("VII", "EEI"), "EEI": ("VEI", "EVI", "EEE"), "VEI": ("VVI",), "EVI": ("VVI",), "EEE": ("VEE", "EVE", "EEV"), "VEE": ("VVE", "VEV"), "EVE": ("VVE", "EVV"), "EEV": ("VEV", "EVV"), "VEV": ("VVV",), "EVV": ("VVV",), "VVE": ("VVV",)}
    for small, more in inside.items():
        assert all(loss(found[m]) <= loss(found[small]) + 1e-6 for m in more)
    for f, cov in found.items():
        sizes, turns = np.array([np.linalg.det(c) ** (1 / p) for c in cov]), [np.linalg.eigh(c) for c in cov]
        shapes = np.stack([v for v, _ in turns]) / sizes[:, None]
        if f[0] == "E":
            assert np.allclose(sizes, sizes[0])
        if f[1] == "E":
            assert np.allclose(shapes, shapes[0], atol=1e-6)
        if f[2] == "I":
            assert all(np.allclose(c, np.diag(np.diag(c))) for c in cov)
        if f[2] == "E":  # one orientation: the matrices commute
            assert all(np.allclose(a @ b, b @ a, atol=1e-5 * np.abs(a @ b).max()) for a in cov for b in cov)
        for _ in range(40):  # turning and sizing all components alike stays in the family
            a = rng.normal(size=(p, p)) * 0.02
            turn = np.linalg.qr(np.eye(p) + (a - a.T))[0] if f[2] != "I" else np.eye(p)
            again = np.stack([turn @ c @ turn.T for c in cov]) * np.exp(0.02 * rng.normal())
            assert loss(again) >= loss(cov) - 1e-6 * abs(loss(cov))
    assert methods._free("EEI", 3, 4) == 3 - 1 + 12 + 4 and methods._free("VVV", 3, 4) == 2 + 12 + 30 and methods._free("EVE", 2, 3) == 1 + 6 + 1 + 4 + 3


def test_names_of_features_meet_no_helper(spark, mixed6):
    """Columns named like what a step adds (d, g, ds, s, e, r) are features like others."""
    want = groups(api.cluster(mixed6, "kmm", 2, features=["x", "y", "group"], seed=1, nstart=3).clusters)
    renamed = mixed6.withColumnsRenamed({"x": "d", "y": "s", "group": "g"})
    for center in ("mean", "median", "trimmed"):
        fit = api.cluster(renamed, "kmm", 2, features=["d", "s", "g"], seed=1, nstart=3, center_num=center)
        assert groups(fit.clusters) == want and set(fit.prototypes[0]) == {"d", "s", "g"}
        num, cat = methods.within_split(fit)
        assert center != "mean" or num + cat == pytest.approx(fit.extras["objective"])


def test_order_statistics(spark):
    rng = np.random.default_rng(5)
    rows = [("hot", float(v)) for v in rng.integers(0, 50, 4000)] + [("fine", float(v)) for v in rng.normal(size=3001)] + [("one", 3.0), ("gap", None), ("gap", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double")
    values = {g: np.array([v for h, v in rows if h == g]) for g in ("hot", "fine", "one")}
    assert {r.g: r.median for r in quantile.medians(df, ["g"], "v").collect()} == pytest.approx({g: np.median(v) for g, v in values.items()})
    trimmed = {g: np.sort(v)[int(len(v) * 0.1) : len(v) - int(len(v) * 0.1)].mean() for g, v in values.items()}
    assert {r.g: r.trimmed for r in quantile.trimmed_means(df, ["g"], "v").collect()} == pytest.approx(trimmed)
    assert quantile.medians(df.where("g = 'hot'"), [], "v").first()[0] == np.median(values["hot"])
    assert quantile.medians(df.where("g = 'gap'"), [], "v").count() == 0


def test_validation_of_mixed_fits(spark, mixed6):
    """On imputed indicators that are not standardised."""
    fit = api.cluster(mixed6, "kproto", 2, features=["x", "y", "group"], seed=1, nstart=2)
    got = {r.metric: r.value for r in api.validate(fit).metrics_table.collect()}
    m = np.array([(r.x, r.y, r.group == "a", r.group == "b") for r in mixed6.orderBy("row_id").collect()], float)
    labels = np.array([r.cluster for r in fit.clusters.orderBy("row_id").collect()])
    assert got["total_within"] == pytest.approx(sum(((m[labels == g] - m[labels == g].mean(axis=0)) ** 2).sum() for g in (1, 2)))
    assert got["silhouette"] == pytest.approx(kernels.silhouette(kernels.distances(m), labels))


def test_silhouette_of_many_rows(spark):
    """More rows than one block, against the matrix of all distances of some of them."""
    n = 24_000
    df = spark.range(n).select(F.col("id").alias("row_id"), F.array(F.sin("id") * 3, F.cos(F.col("id") * 7)).alias("x"), (F.col("id") % 3).cast("int").alias("cluster"))
    some = {r.row_id: r.width for r in metrics.silhouette_rows(df, block_rows=3000).where("row_id % 3001 = 5").collect()}
    ids = np.arange(n)
    x = np.stack([np.sin(ids) * 3, np.cos(ids * 7)], axis=1)
    for i, width in some.items():
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        own = d[(ids % 3 == i % 3) & (ids != i)].mean()
        other = min(d[ids % 3 == g].mean() for g in range(3) if g != i % 3)
        assert width == pytest.approx((other - own) / max(own, other))
    assert len(some) == 8


def test_biplot_geometry(spark, iris):
    fit = api.cluster(iris, "kmeans", 3, features=NAMES, seed=1, nstart=2)
    e = api.explore(fit)
    x = np.array([r[:4] for r in ROWS])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    u, s, vt = np.linalg.svd(z, full_matrices=False)
    scores, eig = u * s, s**2 / 149
    coord = vt.T * np.sqrt(eig)
    share = 100 * coord[:, :2] ** 2 / (coord[:, :2] ** 2).sum(axis=0)
    want = dict(zip(NAMES, share @ eig[:2] / eig[:2].sum()))
    spec = plotspec.plot_biplot(e, "cos2")
    assert {a["variable"]: a["contribution"] for a in spec.layers[0]["data"]} == pytest.approx(want)
    cos2 = (scores[:, :2] ** 2).sum(axis=1) / (z**2).sum(axis=1)
    assert [r.cos2 for r in spec.data.orderBy("row_id").collect()] == pytest.approx(cos2)
    ratio = 0.7 * min(np.ptp(scores[:, i]) / np.ptp(coord[:, i]) for i in (0, 1))
    arrow = {a["variable"]: abs(a["x"]) for a in spec.layers[0]["data"]}
    assert arrow == pytest.approx(dict(zip(NAMES, abs(coord[:, 0]) * ratio)))
    other = api.explore(fit, data=iris.select("row_id", "petal_width", "sepal_width"))
    assert {r.feature for r in other.separation_table.collect()} == {"petal_width", "sepal_width"}


def test_mixed_methods(spark, mixed6):
    for method in ("kproto", "kmm"):
        fit = api.cluster(mixed6, method, 2, features=["x", "y", "group"], seed=1, nstart=3)
        assert groups(fit.clusters) == [[1, 2, 5], [3, 4, 6]]
        assert groups(api.predict(fit, mixed6).clusters) == [[1, 2, 5], [3, 4, 6]]
    assert sorted(round(p["x"], 6) for p in fit.prototypes) == [1.1, 5.1] and {p["group"] for p in fit.prototypes} == {"a", "b"}
    with pytest.raises(ValueError, match="missing columns"):
        api.predict(fit, mixed6.drop("y"))
    with pytest.raises(ValueError, match="lambda"):
        api.cluster(mixed6, "kmm", 2, features=["x", "group"], **{"lambda": -1})
    assert estimate_lambda(mixed6, {"x": "numeric"}) == 0.0
    d = mixed_distances([{"x": 1.0, "group": "a"}], {"x": "numeric", "group": "categorical"}, 2.0)
    gaps = spark.createDataFrame([(3.0, "b"), (3.0, None), (None, "b"), (None, None)], "x double, group string")
    assert [r[0][0] for r in gaps.select(d({"x": F.col("x"), "group": F.col("group")})).collect()] == [6.0, 12.0, 3.0, float("inf")]


def test_errors(spark, iris):
    for bad in ({"k": 1}, {"k": None}, {"k": 151}):
        with pytest.raises(ValueError):
            api.cluster(iris, "kmeans", features=NAMES, **bad)
    with pytest.raises(ValueError, match="prepare_mixed_data"):
        api.cluster(iris, "kmeans", 2, features=["sepal_length", "species"])
    with pytest.raises(ValueError, match="method"):
        api.cluster(iris, "nope", 2)
    with pytest.raises(preprocess.UnsupportedFeatureType):
        preprocess.feature_types(spark.createDataFrame([(1, [1.0])], "row_id long, v array<double>"), ["v"])


def test_encoding(spark):
    df = spark.createDataFrame([(1, 1.0, "a b"), (2, None, None), (3, 3.0, "1c"), (4, float("nan"), "a b")], "row_id long, x double, g string")
    rows = preprocess.prepare_mixed_data(df, "row_id", ["x", "g"], center=False, scale=False).orderBy("row_id").collect()
    assert rows[0].asDict() == {"row_id": 1, "x": 1.0, "g_X1c": 0.0, "g_a.b": 1.0, "g_missing": 0.0} and rows[1].x == 2.0 and rows[3].x == 2.0
    z = preprocess.prepare_mixed_data(df, "row_id", ["x", "g"])
    for c in z.columns[1:]:
        m, s = z.agg(F.avg(f"`{c}`"), F.stddev_samp(f"`{c}`")).first()
        assert abs(m) < 1e-12 and abs(s - 1) < 1e-12
    with pytest.raises(ValueError):
        preprocess.fit_encoder(df, "row_id", ["x"], na_action="fail")
    values = [0.0, 561.59, 0.0123456, -98765.0, None]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v double").select(signif(F.col("v"))).collect()]
    assert got == [0.0, 561.6, 0.01235, -98770.0, None]


def test_external_metrics_invariants(spark):
    rng = random.Random(5)
    rows = [(i, rng.randint(1, 4), rng.randint(1, 4)) for i in range(500)]
    df = spark.createDataFrame(rows, "row_id long, a int, b int")
    same = df.select("row_id", "a", (10 - F.col("a")).alias("b"))
    assert metrics.adjusted_rand_index(same).first()[0] == pytest.approx(1) and metrics.normalized_mutual_information(same).first()[0] == pytest.approx(1)
    assert abs(metrics.adjusted_rand_index(df).first()[0]) < 0.05
    a, b = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    want = ((a[:, None] == a[None, :]) == (b[:, None] == b[None, :])).mean()
    assert metrics.partition_agreement(df).first()[0] == pytest.approx(want)
    flipped = df.select("row_id", F.col("b").alias("a"), F.col("a").alias("b")).repartition(7)
    assert metrics.adjusted_rand_index(flipped).first()[0] == pytest.approx(metrics.adjusted_rand_index(df).first()[0])


def test_summaries(spark, iris):
    df = spark.createDataFrame([(1, 1.0, 5.0, 1), (2, 2.0, 5.0, 1), (3, 3.0, 5.0, 1), (4, 10.0, 1.0, 2), (5, 11.0, 1.0, 2), (6, 12.0, 1.0, 2)], "row_id long, x double, y double, cluster int")
    by = {(r.cluster, r.feature): r for r in metrics.feature_summary(df, ["x", "y"]).collect()}
    r = by[1, "x"]
    assert (r["mean"], r["sd"], r["median"], r["min"], r["max"]) == (2, 1, 2, 1, 3) and (by[2, "y"]["mean"], by[2, "y"]["sd"]) == (1, 0)
    eta = {r.feature: r.separation for r in metrics.separation(iris.withColumn("cluster", F.col("species")), NAMES).collect()}
    assert eta["petal_length"] > 0.9 and all(0 <= v <= 1 for v in eta.values())


def test_consensus(iris):
    meta = consensus.metacluster(iris, ("kmeans", "hclust"), range(2, 4), features=NAMES, seed=1, nstart=2)
    assert meta.final_k in (2, 3) and meta.final_clusters.count() == 150 and meta.candidate_table.count() == 4
    rows = {(r.i, r.j): r.agreement for r in meta.coassociation().collect()}
    c = np.eye(150)
    for (i, j), v in rows.items():
        c[i - 1, j - 1] = c[j - 1, i - 1] = v
    # the signatures' tree and silhouettes are those of the whole matrix
    merge, _, _ = kernels.agglomerate(1 - c, "average")
    for r in meta.selection_summary.collect():
        own = kernels.cut(merge, 150, r.k)
        assert kernels.silhouette(1 - c, own) == pytest.approx(r.silhouette)
    s = meta.stability_summary.first()
    assert 0 < s.min_ppa <= s.mean_ppa <= s.max_ppa <= 1
    assert plotspec.plot_coassoc(meta).data.count() == 2 * len(rows) + 150
    v = api.validate(meta)
    table = {r.metric: r for r in v.metrics_table.collect()}
    assert set(table) == {"silhouette", "calinski_harabasz", "davies_bouldin", "pairwise_partition_agreement"} and table["pairwise_partition_agreement"].value == pytest.approx(s.mean_ppa)
    assert table["silhouette"].direction == "higher is better" and table["pairwise_partition_agreement"].scale is None
    assert v.object_type == "metacluster_fit" and v.extras["selection_summary"].count() == 2 and "  Metrics: 4" in api.describe(v)
    assert plotspec.plot_dendrogram(meta).title == "Consensus dendrogram" and plotspec.plot_dendrogram(meta).data.count() > 0
    assert api.describe(meta).startswith("<metacluster_fit>\n  Methods: kmeans, hclust\n  Candidate fits: 4") and api.describe(api.summary(meta)).startswith("Meta-cluster summary")
    assert plotspec.plot_consensus(meta).title == "Consensus clusters"


def test_importance(iris, fit3):
    runs = [explain.feature_importance(fit3, iris, ["petal_length", "sepal_width"], n_repeats=2, seed=3) for _ in range(2)]
    a, b = ([tuple(r) for r in x.summary.collect()] for x in runs)
    assert a == b and runs[0].results.count() == 4 and a[0][0] == "petal_length" and all(0 <= r[1] <= 1 for r in a)
    assert api.describe(runs[0]) == "<feature_importance>\n  Metric: instability\n  Features: 2\n  Repeats: 2"
    moved = explain.permuted(iris, "row_id", "petal_length", [1, 2], 3)
    assert moved.count() == 300 and sorted(r[0] for r in moved.where("repeat_id = 2").select("value").collect()) == sorted(r[2] for r in ROWS)
    loss = explain.feature_importance(fit3, iris, [3], loss=lambda data, labels, fit: labels.where("cluster = 1").count(), n_repeats=1)
    assert loss.settings["metric"] == "custom"


def test_ceteris_paribus(iris, fit3):
    two = iris.where("row_id <= 2")
    cp = explain.ceteris_paribus(fit3, two, ["petal_length", "petal_width"], grid_size=4)
    assert cp.profiles.count() == 16 and api.describe(cp) == "<ceteris_paribus>\n  Target: cluster\n  Profiles: 16"
    assert len(plotspec.plot(cp).layers[0]["data"]) == 4
    assert explain.grid_values(iris, "petal_length", True, None, 6) == pytest.approx([1, 1.5, 3.9, 4.653, 5.36, 6.9], abs=1e-3)
    score = explain.ceteris_paribus(fit3, two, ["petal_length"], grid_size=6, target="score").profiles.collect()
    assert all(0 <= r.value <= 1 for r in score)


def test_published_profile(iris, fit3):
    """The first row's score profile over the petal length grid, from fixed values."""
    rows = explain.ceteris_paribus(fit3, iris.where("row_id <= 2"), ["petal_length"], grid_size=6, target="score").profiles.where("observation = 1").orderBy("feature_value_num").collect()
    assert [round(r.value, 4) for r in rows][1:] == pytest.approx([0.5688, 0.3362, 0.2714, 0.2177, 0.1273], abs=2e-4)
    assert round(rows[0].baseline_value, 3) == pytest.approx(0.516, abs=1e-3)


def test_lime(iris, fit3, mixed6):
    x = explain.lime_explain(fit3, iris.where("row_id in (1, 100)"), n_features=2, n_permutations=30, seed=2)
    rows = x.explanations.collect()
    assert len(rows) == 4 and x.neighborhoods.count() == 60
    assert {r["weight"] for r in x.neighborhoods.where("sample = 1").collect()} == {1.0}
    assert all((r.direction == "positive") == (r.estimate >= 0) for r in rows)
    fit = api.cluster(mixed6, "kproto", 2, features=["x", "y", "group"], seed=1, nstart=2)
    assert explain.lime_explain(fit, mixed6.limit(2), n_permutations=20, target="score").explanations.count() > 0
    z = np.random.default_rng(0).normal(size=(50, 2))
    assert np.allclose(explain.weighted_fit(np.column_stack([z, z[:, 0]]), 1 + z @ [2, -3], np.ones(50)), [2, -3, 0])


def test_embeddings(spark, iris, mixed6):
    points, _, extra = embed.pca(iris, "row_id", NAMES)
    x = np.array([r[:4] for r in ROWS])
    z = (x - x.mean(axis=0)) / x.std(axis=0, ddof=1)
    _, s, vt = np.linalg.svd(z - z.mean(axis=0), full_matrices=False)
    got = np.array([(r.x, r.y) for r in points.orderBy("row_id").collect()])
    assert np.allclose(np.abs(got), np.abs(z @ vt[:2].T)) and np.allclose(extra["sdev"], s / np.sqrt(149))
    mds = np.array([(r.x, r.y) for r in embed.mds(iris, "row_id", NAMES)[0].orderBy("row_id").collect()])
    assert np.allclose(np.abs(mds), np.abs(kernels.classical_mds(kernels.distances(x))), atol=1e-6)
    assert embed.embed(mixed6, "row_id", ["x", "group"])[1] == "famd"
    cats = spark.createDataFrame([(1, "x", "u"), (2, "x", "v"), (3, "y", "u"), (4, "y", "v")], "row_id long, a string, b string")
    points, method, _, extra = embed.embed(cats, "row_id", ["a", "b"])
    assert method == "mca" and points.count() == 4 and len(embed.biplot(extra)) == 4
    with pytest.raises(ValueError):
        embed.famd(iris, "row_id", NAMES)


def test_plots_stream_and_sinks(spark, iris, fit3, tmp_path):
    e = api.explore(fit3)
    spec = plotspec.plot_clusters(e)
    with pytest.raises(ValueError, match="most_rows"):
        spec.to_json(most_rows=100)
    spec.save(str(tmp_path / "plot"))
    assert spark.read.json(str(tmp_path / "plot" / "data")).count() == 150 and json.loads(spark.read.text(str(tmp_path / "plot" / "spec")).first()[0])["mark"] == "point"
    assert json.loads(spec.to_json())["mark"] == "point" and e.separation_table.count() == 4
    assert len(plotspec.plot_biplot(e, top_n=2).layers[0]["data"]) == 2 and plotspec.plot_cluster_sizes(e).data.count() == 3
    assert plotspec.plot_feature_profiles(e, ["petal_length"]).data.count() == 3 and plotspec.plot_silhouette(fit3).data.count() == 150
    assert len(plotspec.palette(12)) == 12
    write_results({"sizes": e.size_table}, str(tmp_path / "out"))
    assert spark.read.csv(str(tmp_path / "out" / "sizes"), header=True).count() == 3
    iris.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(iris.schema).parquet(str(tmp_path / "in"))
    q = assign.start(assign.assign_stream(fit3, stream), "assigned", str(tmp_path / "cp"))
    q.awaitTermination(60)
    assert groups(spark.table("assigned")) == groups(fit3.clusters)


def test_bootstrap(iris, fit3):
    runs = [api.bootstrap_ari(f, 2) for f in (fit3, replace(fit3, info=replace(fit3.info, data=iris.repartition(7))))]
    assert 0.5 < runs[0][0] <= 1 and runs[0][1] >= 0 and runs[0] == pytest.approx(runs[1])
