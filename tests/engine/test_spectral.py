import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import distance, embed, kernels, spectral


def upto_sign(a, b):
    return all(min(np.abs(a[:, c] - b[:, c]).max(), np.abs(a[:, c] + b[:, c]).max()) < 1e-6 for c in range(a.shape[1]))


def test_leading_brute():
    rng = np.random.default_rng(3)
    m = rng.normal(size=(60, 60))
    m = m @ m.T
    values, vectors = spectral.leading(lambda v: m @ v, 60, 3)
    want, axes = np.linalg.eigh(m)
    assert np.allclose(values[:3], want[::-1][:3]) and upto_sign(vectors[:, :3], axes[:, ::-1][:, :3])
    with pytest.raises(ValueError, match="MOST_VALUES"):
        spectral.leading(lambda v: v, 1 << 24)


def test_scaling_of_pairs_is_the_kernels(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 3)) * (4, 2, 0.5)
    d = kernels.distances(x)
    rows = [(f"r{j:02}", f"r{i:02}", float(d[i, j])) for i in range(90) for j in range(i)]
    pairs = spark.createDataFrame(rows, "i string, j string, d double").repartition(4)
    for iterated in (False, True):
        points = embed.mds_of_pairs(pairs, iterated=iterated)[0].orderBy("row_id").collect()
        assert [r.row_id for r in points] == [f"r{i:02}" for i in range(90)]
        assert upto_sign(np.array([(r.x, r.y) for r in points]), kernels.classical_mds(d))
    assert len(embed.mds_of_pairs(pairs, max_exact_rows=50)[0].collect()) == 90  # beyond the limit
    ids, xy = spectral.scaling_of_pairs(pairs.limit(0))
    assert ids == [] and xy.shape == (0, 2)


def test_many_levels_are_the_burt_table(spark):
    rng = np.random.default_rng(9)
    rows = [(i, *(f"v{int(v)}" if v else None for v in rng.integers(0, (5, 9, 4)))) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, a string, b string, c string").repartition(3)
    dense, names, fit = embed.mca(df, "id", ["a", "b", "c"])
    wide, wide_names, other = embed.mca(df, "id", ["a", "b", "c"], dense_levels=3)
    one, two = (np.array([(r.x, r.y) for r in t.orderBy("row_id").collect()]) for t in (dense, wide))
    assert upto_sign(one, two) and names == wide_names
    at = [other["columns"].index(c) for c in fit["columns"]]
    assert np.allclose(fit["eig"][:2], other["eig"][:2]) and upto_sign(fit["var_coord"][:, :2], other["var_coord"][at])
    for part in ("contrib", "cos2"):
        assert np.allclose(fit[part][:, :2], other[part][at], atol=1e-6)
    far = lambda e: [r.norm2 for r in e["norm2"].orderBy("row_id").collect()]
    assert np.allclose(far(fit), far(other))


def test_twenty_thousand_levels(spark):
    """Two strong groups of rows, told apart by one feature; the other has 20,000 levels."""
    df = spark.range(40_000).select("id", F.concat(F.lit("u"), F.col("id") % 20_000).alias("many"), (F.col("id") % 2).cast("string").alias("side"), (F.col("id") % 2 + F.when(F.col("id") % 97 == 0, 1).otherwise(0)).cast("string").alias("again"))
    points, names, fit = embed.mca(df, "id", ["many", "side", "again"])
    assert len(fit["columns"]) == 20_000 + 2 + 3
    rows = points.withColumn("side", F.col("row_id") % 2).groupBy("side").agg(F.avg("x").alias("x"), F.stddev("x").alias("s")).orderBy("side").collect()
    assert abs(rows[0].x - rows[1].x) > 3 * max(r.s for r in rows)


def test_scaling_of_known_origin_writes_no_table(spark, monkeypatch):
    """the distances of two rows each are made within the tasks of a round."""
    x = np.random.default_rng(8).normal(size=(130, 3)) * [3, 2, 1]
    df = spark.createDataFrame([(5 * i, v.tolist()) for i, v in enumerate(x)], "row_id long, x array<double>").repartition(3)
    pairs = distance.euclidean_pairs(df)
    table = pairs.select("i", "j", "d")
    ids, want = spectral.scaling_of_pairs(table)
    monkeypatch.setattr(spectral.Shelf, "put", None)
    found = spectral.scaling_of_pairs(pairs)
    assert found[0] == ids == [5 * i for i in range(130)] and np.abs(found[1] - want).max() < 1e-6
    gap = df.select("row_id", F.when(F.col("row_id") > 5, F.col("x")).otherwise(F.array(F.lit(None).cast("double"), F.lit(1.0), F.lit(1.0))).alias("x"))
    assert distance.origin_of(pairs) is not None and distance.origin_of(table) is None
    assert distance.origin_of(distance.euclidean_pairs(gap)) is None and distance.origin_of(distance.euclidean_pairs(df.union(df))) is None
