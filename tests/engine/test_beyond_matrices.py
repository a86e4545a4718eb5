"""What used to need a square matrix: held against kernels that have one, on small tables."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import api, consensus, distance, embed, kernels, medoids, methods, partition, spanning
from kindred.operators.methods import cut_at
from kindred.sources.shelf import Shelf


def points(spark, x, ids=None):
    ids = ids or list(range(len(x)))
    return spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "row_id long, x array<double>").repartition(4)


def dense(x):
    return np.sqrt(((x[:, None, :] - x[None, :, :]) ** 2).sum(axis=2))


@pytest.mark.parametrize(("p", "eps", "block"), [(1, 0.05, 40), (2, 0.5, 30), (7, 2.0, 25), (30, 6.5, 20)])
def test_neighbours_brute(spark, p, eps, block, monkeypatch):
    rng = np.random.default_rng(p)
    x = np.concatenate([rng.normal(size=(150, p)), np.zeros((60, p)), rng.normal(size=(40, p)) * 0.01 + 5])
    df, d = points(spark, x), dense(x)
    real = partition.eps_blocks
    monkeypatch.setattr(partition, "eps_blocks", lambda a, b, e, run, schema: real(a, b, e, run, schema, block))
    assert {r.row_id: r.n for r in partition.eps_counts(df, df, eps).collect()} == dict(enumerate((d <= eps).sum(axis=1).tolist()))
    other = df.where("row_id % 3 = 0")
    found = [(r.i, r.j) for r in partition.eps_pairs(df, other, eps).collect()]
    assert len(found) == len(set(found)) and set(found) == {(i, j) for i in range(len(x)) for j in range(0, len(x), 3) if d[i, j] <= eps}


def test_blocks_are_even(spark):
    """A dense cell is cut: no task takes more rows than a few times what the others do."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(size=(1500, 64)), rng.normal(size=(1500, 64)) * 0.01])
    df = points(spark, x)
    sizes = [r.n for r in partition.eps_blocks(df, df, 0.5, lambda a, b: __import__("pyarrow").table({"n": [a.num_rows + b.num_rows]}), "n long", 100).collect()]
    assert max(sizes) <= 4 * np.median(sizes)


def test_neighbours_of_nothing(spark):
    some = points(spark, np.zeros((3, 2)))
    assert partition.eps_pairs(some.limit(0), some, 1.0).collect() == []
    assert [r.n for r in partition.eps_counts(some, some.limit(0), 1.0).collect()] == [0, 0, 0]


@pytest.mark.parametrize(("p", "n", "block", "piece"), [(2, 300, 40, 200), (6, 200, 30, 1_000_000), (1, 150, 20, 100)])
def test_spanning_tree_brute(spark, p, n, block, piece):
    rng = np.random.default_rng(n)
    x = np.round(np.concatenate([rng.normal(size=(n - 5, p)), rng.normal(size=(5, p)) * 40]), 1)
    tree = spanning.spanning_tree(points(spark, x), block_rows=block, piece=piece).collect()
    d = dense(x)
    assert all(abs(d[r.i, r.j] - r.d) < 1e-9 and r.i < r.j for r in tree)
    assert np.allclose(sorted(r.d for r in tree), np.sort(kernels.agglomerate(d, "single")[1]))
    assert len(set(kernels.cut(spanning.merges(n, [(r.i, r.j, r.d) for r in sorted(tree, key=lambda r: r.d)])[0], n, 1))) == 1


def test_forest_of_a_table(spark):
    rng = random.Random(4)
    edges = [(rng.randrange(80), rng.randrange(80), rng.randrange(30) / 7) for _ in range(500)] + [(200, 201, 1.0), (300, 300, 0.0), (1, 2, None)]
    df = spark.createDataFrame(edges, "i long, j long, d double").repartition(4)
    want, root = [], list(range(400))

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for d, i, j in sorted((d, min(i, j), max(i, j)) for i, j, d in edges if d is not None and i != j):
        if find(i) != find(j):
            root[find(i)] = find(j)
            want.append((i, j, d))
    for piece in (60, 1_000_000):
        assert sorted((r.i, r.j, r.d) for r in spanning.forest(df, Shelf(spark, "test"), "f", piece).collect()) == sorted(want)
    assert spanning.forest(df.limit(0), Shelf(spark, "test"), "f").collect() == []


def test_single_linkage_is_the_kernels(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 2))
    df = spark.createDataFrame([(int(i), float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double")
    for k in (1, 2, 7, 120):
        if k == 1:
            continue
        one, two = (api.cluster(df, "hclust", k, features=["a", "b"], linkage="single", spanning=way) for way in (False, True))
        assert {r.row_id: r.cluster for r in one.clusters.collect()} == {r.row_id: r.cluster for r in two.clusters.collect()}
        assert np.allclose(one.extras["tree"]["height"], two.extras["tree"]["height"])
        assert one.extras["tree"]["merge"].tolist() == two.extras["tree"]["merge"].tolist()
        assert np.allclose(sorted(map(tuple, one.centers)), sorted(map(tuple, two.centers)))
        assert one.extras["agglomerative_coefficient"] == pytest.approx(two.extras["agglomerative_coefficient"])
    h = float(np.sort(two.extras["tree"]["height"])[-4]) + 1e-9
    assert len({r.cluster for r in cut_at(two, h).collect()}) == 4
    # beyond the limit without being asked for, and from a table of distances
    assert "spanning_tree" in api.cluster(df, "agnes", 3, features=["a", "b"], linkage="single", max_exact_rows=50).extras
    d = dense(x)
    pairs = spark.createDataFrame([(i, j, float(d[i, j])) for i in range(120) for j in range(i)], "i long, j long, d double")
    of = api.cluster(pairs, "agnes", 7, linkage="single", spanning=True)
    want = api.cluster(df, "hclust", 7, features=["a", "b"], linkage="single")
    assert {r.row_id: r.cluster for r in of.clusters.collect()} == {r.row_id: r.cluster for r in want.clusters.collect()}
    with pytest.raises(ValueError, match="apart"):
        api.cluster(pairs.where("(i < 60) = (j < 60)"), "agnes", 3, linkage="single", spanning=True)


@pytest.mark.parametrize(("k", "block"), [(1, 50), (2, 1000), (5, 30)])
def test_medoids_are_the_kernels(spark, k, block):
    x = np.random.default_rng(k).normal(size=(130, 3))
    ids, rows, cost = medoids.k_medoids(points(spark, x, [7 * i for i in range(130)]), k, block)
    at, want = kernels.k_medoids(dense(x), k)
    assert ids == [7 * int(i) for i in at]
    assert np.allclose(rows, x[at]) and cost == pytest.approx(want)


def test_single_linkage_of_known_distances_makes_no_pairs(spark, monkeypatch):
    """the spanning tree of a table of Gower's dissimilarities comes from its rows; equal ones hang on the least."""
    r = random.Random(3)
    df = spark.createDataFrame([(i, round(r.gauss(0, 9), 1), r.randrange(12)) for i in range(150)], "id long, a double, b int").repartition(3)
    for features, weights in ((["a"], None), (["a", "b"], {"a": 2.0})):
        pairs = distance.mixed_distance(df, "id", features, weights=weights)
        want = api.cluster(pairs.select("i", "j", "d"), "agnes", 5, linkage="single", spanning=True)
        with monkeypatch.context() as m:
            m.setattr(methods, "forest", None)
            found = api.cluster(pairs, "agnes", 5, linkage="single", spanning=True)
        assert sorted(map(tuple, found.clusters.collect())) == sorted(map(tuple, want.clusters.collect()))
        assert np.allclose(found.extras["tree"]["height"], want.extras["tree"]["height"], atol=1e-12)


def test_blocks_of_pairs_grow_with_the_rows(spark, monkeypatch):
    """a row is shuffled once a block, so their number stays."""
    monkeypatch.setattr(distance, "PAIR_ROWS", 7)
    monkeypatch.setattr(distance, "MOST_BLOCKS", 4)
    x = np.random.default_rng(6).normal(size=(150, 2))
    pairs = distance.euclidean_pairs(points(spark, x))
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "[_task" in plan and all(line.strip().endswith(", 10") for line in plan.splitlines() if "RepartitionByExpression" in line)
    want = dense(x)
    found = {(r.i, r.j): r.d for r in pairs.collect()}
    assert len(found) == 150 * 149 // 2 and all(i < j and abs(d - want[i, j]) < 1e-12 for (i, j), d in found.items())


def test_coassociation_by_few_blocks(spark, monkeypatch):
    """its pairs come from the same blocks."""
    monkeypatch.setattr(distance, "PAIR_ROWS", 7)
    monkeypatch.setattr(distance, "MOST_BLOCKS", 3)
    labels = spark.createDataFrame([(c, i, i % m + 1) for c, m in ((1, 2), (2, 3)) for i in range(60)], "candidate int, row_id long, cluster int")
    pairs = consensus.coassociation(labels)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert "[_task" in plan and all(line.strip().endswith(", 6") for line in plan.splitlines() if "RepartitionByExpression" in line)
    want = {(i, j): ((i % 2 == j % 2) + (i % 3 == j % 3)) / 2 for i in range(60) for j in range(i + 1, 60)}
    assert {(r.i, r.j): r.agreement for r in pairs.collect()} == {k: v for k, v in want.items() if v}


def test_distances_are_rounded_as_in_sql(spark):
    """by the nearest whole number of millionths, halves up."""
    from kindred.plans.registry import d6

    values = [0.0, 0.1234565, 2.5e-6, 1.5e-6, 0.5e-6, 3.0000005, 12345.678901, 1 / 3, float("nan"), None]
    found = [r[0] for r in spark.createDataFrame([(v,) for v in values], "d double").select(d6(F.col("d"), "d")).collect()]
    scaled = [v * 1e6 for v in values[:-2]]
    assert found[:-2] == [(np.floor(v) + (v - np.floor(v) >= 0.5)) / 1e6 for v in scaled] and found[-2] != found[-2] and found[-1] is None


def test_medoids_of_one_column_need_no_pairs(spark, monkeypatch):
    """equal rows are one candidate, and the changes of one column come from sums along its order."""
    x = np.repeat(np.random.default_rng(4).permutation(40).astype(float) ** 1.7, 3)[:, None]
    want = {k: medoids.k_medoids(points(spark, x), k, most_values=39) for k in (1, 3, 5)}  # by passes
    monkeypatch.setattr(medoids, "_pass", None)
    for k, (ids, rows, cost) in want.items():
        found = medoids.k_medoids(points(spark, x), k)
        assert found[0] == ids and (found[1] == rows).all() and abs(found[2] - cost) < 1e-6
        assert abs(kernels.k_medoids(dense(x), k)[1] - cost) < 1e-6


def test_medoids_of_many_equal_rows(spark):
    """a pass has the different vectors, not the rows."""
    x = np.random.default_rng(2).normal(size=(60, 2))[np.arange(600) % 60]
    met, one_pass = [], medoids._pass
    try:
        medoids._pass = lambda data, *of: met.append(data.count()) or one_pass(data, *of)
        ids, _, cost = medoids.k_medoids(points(spark, x), 2)
    finally:
        medoids._pass = one_pass
    assert set(met) == {60} and abs(cost - kernels.k_medoids(dense(x), 2)[1]) < 1e-9 and max(ids) < 60
    same = points(spark, np.ones((5, 2)))
    assert medoids.k_medoids(same, 3)[0] == [0, 1, 2]


def test_swap_gains_brute():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(40, 2))
    d, m = dense(x), [3, 11, 20]
    near = np.sort(d[:, m], axis=1)
    got = medoids.swap_gains(d, d[:, m].argmin(axis=1), near[:, 0], near[:, 1], 3)
    for c in range(40):
        for i in range(3):
            other = [c if j == i else v for j, v in enumerate(m)]
            assert got[c, i] == pytest.approx(d[:, other].min(axis=1).sum() - d[:, m].min(axis=1).sum())


def test_medoids_beyond_the_limit(spark):
    x = np.concatenate([np.random.default_rng(0).normal(size=(60, 2)) * 0.1 + c for c in ((0, 0), (5, 5))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double")
    one, two = (api.cluster(df, "pam", 2, features=["a", "b"], max_exact_rows=n) for n in (5000, 50))
    assert one.extras["medoid_ids"] == two.extras["medoid_ids"]


def table_of(spark, labels):
    return spark.createDataFrame([(c + 1, i, int(v)) for i, row in enumerate(labels) for c, v in enumerate(row)], "candidate int, row_id long, cluster int")


def apart(labels):
    d = sum((labels[:, None, c] != labels[None, :, c]) | (labels[:, None, c] == 0) for c in range(labels.shape[1])) / labels.shape[1]
    np.fill_diagonal(d, 0)
    return d


@pytest.mark.parametrize("noise", [0.0, 0.25])
def test_consensus_is_average_linkage(spark, noise):
    """Against the matrix of all rows: each merge is of two clusters at the least average distance of any two. (Ties
    are many, so one tree is not like another.)"""
    rng = np.random.default_rng(3)
    labels = rng.integers(1, 6, (60, 5)) * (rng.random((60, 5)) >= noise)
    labels = np.concatenate([labels, labels[:15], labels[:15]])
    d = apart(labels)
    _, _, scores, tree = consensus.consensus(table_of(spark, labels), [2, 3, 20])
    leaves: list[list[int]] = []
    of: dict = {}
    for i, row in enumerate(labels.tolist()):
        of.setdefault(tuple(row), []).append(i)
    for s, rows in of.items():
        leaves += [[i] for i in rows] if 0 in s else [rows]
    own = {-i - 1: rows for i, rows in enumerate(leaves)}
    assert len(tree["merge"]) == len(leaves) - 1
    for step, ((a, b), height) in enumerate(zip(tree["merge"].tolist(), tree["height"], strict=True)):
        means = {(p, q): d[np.ix_(own[p], own[q])].mean() for p in own for q in own if p < q}
        assert means[min(a, b), max(a, b)] == pytest.approx(height)
        assert min(means.values()) == pytest.approx(height)
        own[step + 1] = own.pop(a) + own.pop(b)
    for k, score in scores:
        final = {r.row_id: r.cluster for r in consensus.consensus(table_of(spark, labels), [k])[0].collect()}
        assert len(set(final.values())) == k
        assert score == pytest.approx(kernels.silhouette(d, np.array([final[i] for i in range(len(labels))])))


def test_rows_of_noise_split_last_in(spark):
    """Four rows of one signature with noise: more clusters than signatures split them, the last rows first."""
    labels = np.array([[1, 1], [1, 0], [1, 0], [1, 0], [1, 0], [2, 2]])
    found = {k: [r.cluster for r in consensus.consensus(table_of(spark, labels), [k])[0].orderBy("row_id").collect()] for k in (2, 3, 4, 6)}
    assert found[2] == [1, 1, 1, 1, 1, 2] and found[3] == [1, 2, 2, 2, 2, 3]
    assert found[4] == [1, 2, 2, 2, 3, 4] and found[6] == [1, 2, 3, 4, 5, 6]


def test_many_rows_of_noise(spark):
    """100,000 rows that each are a signature of their own: noise of one candidate."""
    base = spark.range(100_000).select(F.col("id").alias("row_id"))
    labels = base.select(F.lit(1).alias("candidate"), "row_id", (F.col("row_id") % 4 + 1).cast("int").alias("cluster")).unionByName(base.select(F.lit(2).alias("candidate"), "row_id", F.lit(0).alias("cluster")))
    final, k, scores, tree = consensus.consensus(labels, [2, 3, 4])
    assert k == 4 and {r["count"] for r in final.groupBy("cluster").count().collect()} == {25_000}
    assert len(tree["height"]) == 99_999 and sorted(set(np.round(tree["height"], 9))) == [0.5, 1.0]


def test_coassociation_is_bounded(spark):
    labels = np.random.default_rng(1).integers(0, 4, (40, 3))
    df = table_of(spark, labels)
    want = {(i, j): 1 - v for (i, j), v in np.ndenumerate(apart(labels)) if i < j and v < 1}
    assert {(r.i, r.j): pytest.approx(r.agreement) for r in consensus.coassociation(df).collect()} == want
    with pytest.raises(ValueError, match="most_pairs"):
        consensus.coassociation(df, most_pairs=5)
    pairs, rows = consensus.signature_coassociation(df)
    head, found = {r.row_id: r.i for r in rows.collect()}, {(r.i, r.j): r.agreement for r in pairs.collect()}
    for (i, j), v in np.ndenumerate(apart(labels)):
        a, b = sorted((head[i], head[j]))
        if a < b:
            assert found.get((a, b), 0.0) == pytest.approx(1 - v)


def test_pairs_of_many_blocks(spark, monkeypatch):
    """Every pair once, beyond one block and beyond the rows that a matrix on the driver may have."""
    rng = np.random.default_rng(3)
    x = rng.normal(size=(60, 2))
    monkeypatch.setattr(distance, "PAIR_ROWS", 7)
    d, found = dense(x), distance.euclidean_pairs(points(spark, x)).collect()
    assert len(found) == 60 * 59 // 2 and all(r.i < r.j and r.d == pytest.approx(d[r.i, r.j]) for r in found)
    monkeypatch.undo()
    many = spark.range(distance.MOST_ROWS + 1).select(F.col("id").alias("row_id"), F.array(F.col("id").cast("double")).alias("x"))
    assert distance.euclidean_pairs(many).count() == (distance.MOST_ROWS + 1) * distance.MOST_ROWS // 2


def test_gower_of_many_blocks(spark, monkeypatch):
    x = np.random.default_rng(3).normal(size=(60, 1))
    monkeypatch.setattr(distance, "PAIR_ROWS", 7)
    mixed = distance.mixed_distance(spark.createDataFrame([(i, float(v), "ab"[i % 2]) for i, v in enumerate(x[:, 0])], "row_id long, v double, g string"), "row_id", ["v", "g"]).collect()
    want = {(i, j): (abs(x[i, 0] - x[j, 0]) / np.ptp(x[:, 0]) + (i % 2 != j % 2)) / 2 for i in range(60) for j in range(i + 1, 60)}
    assert {(r.i, r.j): pytest.approx(r.d) for r in mixed} == want and len(mixed) == len(want)
    monkeypatch.undo()
    many = spark.range(distance.MOST_ROWS + 1).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("v"))
    assert distance.mixed_distance(many, "row_id", ["v"]).count() == (distance.MOST_ROWS + 1) * distance.MOST_ROWS // 2


@pytest.mark.parametrize("share", [0.0, 2.0])
def test_coassociation_ways(spark, monkeypatch, share):
    """Pairs found among all pairs of blocks and pairs joined by cluster are the same; noise never agrees."""
    labels = np.random.default_rng(5).integers(0, 3, (50, 3))
    monkeypatch.setattr(consensus, "SPARSE", share)
    monkeypatch.setattr(distance, "PAIR_ROWS", 9)
    want = {(i, j): ((labels[i] == labels[j]) & (labels[i] > 0)).mean() for i in range(50) for j in range(i + 1, 50)}
    found = consensus.coassociation(table_of(spark, labels)).collect()
    assert len(found) == len({(r.i, r.j) for r in found}) and {(r.i, r.j): pytest.approx(r.agreement) for r in found} == {k: v for k, v in want.items() if v}


def test_coassociation_beyond_a_limit_of_pairs(spark):
    """More pairs than a fixed limit let through: nothing of them is made before they are read."""
    rows = spark.range(30_000).select(F.lit(1).alias("candidate"), F.col("id").alias("row_id"), F.lit(1).alias("cluster"))
    assert consensus.coassociation(rows).where("j = 1 AND i = 0").columns == ["i", "j", "agreement"]


def test_forest_writes_no_pairs(spark):
    """Of a table of all pairs only the forests of its pieces are written."""
    x = np.random.default_rng(9).normal(size=(120, 1))
    shelf = Shelf(spark, "few")
    found = spanning.forest(distance.euclidean_pairs(points(spark, x)), shelf, "t")
    assert found.count() == 119 and spark.read.parquet(shelf.path("t-edges")).count() < 120 * 119 // 8
    assert np.allclose(sorted(r.d for r in found.collect()), np.sort(np.diff(np.sort(x[:, 0]))))


def test_squares_by_one_product(monkeypatch):
    """Near and equal rows, and rows about the radius, are as exact as feature by feature; what is not finite stays so."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(40, 12)) + 1000
    y = np.concatenate([x[:10], x[10:20] + 1e-7, rng.normal(size=(20, 12)) + 1000])
    plain = ((x[:, None] - y[None]) ** 2).sum(axis=2)
    at = float(plain[3, 35])
    found = partition.squares(x, y, at)
    assert np.allclose(found, plain, rtol=1e-9, atol=1e-18) and found[0, 0] == 0
    y[5] = np.nan
    odd = partition.squares(x, y)
    assert np.isnan(odd[:, 5]).all() and np.isfinite(np.delete(odd, 5, axis=1)).all()


def test_scaling_of_more_pairs_than_a_matrix(spark):
    """Distances of more rows than a matrix on the driver may have are scaled by passes: one column comes back."""
    x = np.random.default_rng(2).normal(size=(distance.MOST_ROWS + 100, 1))
    pairs = distance.euclidean_pairs(points(spark, x))
    rows = {r.row_id: r.x for r in embed.mds_of_pairs(pairs, iterated=True)[0].collect()}
    got = np.array([rows[i] for i in range(len(x))])
    assert np.abs(np.abs(got) - np.abs(x[:, 0] - x.mean())).max() < 1e-6


@pytest.mark.parametrize("linkage", ["complete", "average"])
def test_one_column_beyond_a_matrix(spark, linkage):
    """Trees of one column from its values in order are those of a matrix, equal values included."""
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=80), np.repeat(rng.normal(size=5), 4)])
    df = spark.createDataFrame([(i, float(v)) for i, v in enumerate(x)], "row_id long, a double")
    few, many = (api.cluster(df, "hclust", 6, features=["a"], linkage=linkage, max_exact_rows=n) for n in (5000, 50))
    assert {tuple(r) for r in few.clusters.collect()} == {tuple(r) for r in many.clusters.collect()}
    positive = few.extras["tree"]["height"][few.extras["tree"]["height"] > 1e-7]
    assert np.allclose(positive, many.extras["tree"]["height"], atol=1e-6) and np.allclose(few.centers, many.centers)
    assert many.extras["agglomerative_coefficient"] == pytest.approx(few.extras["agglomerative_coefficient"], abs=1e-6)


def test_wide_rows_are_sent_by_larger_blocks(spark, monkeypatch):
    """Where pivots leave all cells to all rows, rows are sent once for each of few large blocks, and counts are those of all pairs."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(2000, 64))
    x = np.concatenate([x / np.linalg.norm(x, axis=1)[:, None], np.eye(64)[:2], -np.eye(64)[:2]]).astype(np.float32).astype(float)
    df, d, eps = points(spark, x), partition.distances_to(x, x), float(np.float32(1.3))
    sides = lambda a, b: __import__("pyarrow").table({"n": [a.num_rows + b.num_rows]})
    assert sum(r.n for r in partition.eps_blocks(df, df, eps, sides, "n long", 50).collect()) <= 2 * len(x) * 13
    assert {r.row_id: r.n for r in partition.eps_counts(df, df, eps).collect()} == dict(enumerate((d <= eps).sum(axis=1).tolist()))


@pytest.mark.parametrize("p", [2, 9, 64])
def test_counts_within_by_one_product(p):
    """Pairs exactly at the radius, copies, far offsets and weights."""
    rng = np.random.default_rng(p)
    for x in (rng.integers(0, 3, size=(300, p)).astype(float), rng.normal(size=(300, p)) + 1e6, rng.normal(size=(300, p)) * 1e-3):
        d = partition.distances_to(x, x)
        for eps in (float(d[0, 1]), float(d[5, 250]), float(np.median(d))):
            assert (partition.counts_within(x, x, eps) == (d <= eps).sum(axis=1)).all()
            w = rng.integers(1, 5, len(x))
            assert (partition.counts_within(x, x, eps, w) == (d <= eps) @ w).all()


@pytest.fixture
def repeated(spark):
    """Nine places, each of 40 rows and more, one of them alone."""
    rng = np.random.default_rng(4)
    x = np.concatenate([np.repeat(np.array([[i, j] for i in (0.0, 1.0, 5.0) for j in (0.0, 1.0, 5.0)]), 40, axis=0), [[20.0, 20.0]]])
    x = x[rng.permutation(len(x))]
    return x, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id int, a double, b double")


def test_copies_go_through_density_once(repeated, monkeypatch):
    x, df = repeated
    real, seen = methods.eps_blocks, []
    monkeypatch.setattr(methods, "eps_blocks", lambda a, b, *more: seen.append((a.count(), b.count())) or real(a, b, *more))
    fit = api.cluster(df, "dbscan", id_col="id", features=["a", "b"], eps=1.0, minPts=41)
    assert max(max(v) for v in seen) <= 10  # of 361 rows
    d = dense(x)
    near = d <= 1.0
    core = near.sum(axis=1) >= 41
    found = {r.row_id: r.cluster for r in fit.clusters.collect()}
    assert {r.row_id for r in fit.extras["core"].collect()} == set(np.flatnonzero(core).tolist()) and sorted(found) == list(range(len(x)))
    groups = {}
    for i in range(len(x)):
        assert (found[i] == 0) == (not (near[i] & core).any())
        groups.setdefault(found[i], []).append(i)
    assert all(found[i] == found[j] for i in np.flatnonzero(core) for j in np.flatnonzero(core & near[i]))
    own = [min(v) for g, v in sorted(groups.items()) if g]
    assert own == sorted(own) and len(own) == 3


def test_copies_are_one_leaf_of_the_spanning_tree(repeated, monkeypatch):
    x, df = repeated
    real, seen = methods.spanning_tree, []
    monkeypatch.setattr(methods, "spanning_tree", lambda a, *more: seen.append(a.count()) or real(a, *more))
    for k in (5, 12):  # whole classes of equal edges between places go, and the last two of length 0
        fit = api.cluster(df, "hclust", k, id_col="id", features=["a", "b"], linkage="single", spanning=True)
        assert seen == [10]  # of 361 rows
        seen.clear()
        d = dense(x)
        order = sorted((d[i, j], i, j) for i in range(len(x)) for j in range(i + 1, len(x)))
        root, tree = list(range(len(x))), []

        def top(i):
            while root[i] != i:
                i = root[i]
            return i

        for w, i, j in order:  # Kruskal
            if top(i) != top(j):
                root[max(top(i), top(j))] = min(top(i), top(j))
                tree.append((i, j, w))
        edges = [(r.i, r.j, r.d) for r in fit.extras["spanning_tree"].collect()]
        assert [e[2] for e in sorted(edges, key=lambda e: e[2])] == [e[2] for e in tree] and sorted(e for e in edges if not e[2]) == sorted(e for e in tree if not e[2])
        for labels, kept in ((fit.clusters, tree[: len(tree) - k + 1]), (cut_at(fit, 4.5), [e for e in tree if e[2] <= 4.5]), (cut_at(fit, -1.0), [])):
            root = list(range(len(x)))
            for i, j, _ in kept:
                root[max(top(i), top(j))] = min(top(i), top(j))
            tops = [top(i) for i in range(len(x))]
            number = {r: c + 1 for c, r in enumerate(sorted(set(tops)))}
            assert {r.row_id: r.cluster for r in labels.collect()} == {i: number[t] for i, t in enumerate(tops)}
