import numpy as np
import pytest
from pyspark.sql import functions as F

from kindred.operators import api
from kindred.streaming import assign


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    rng = np.random.default_rng(12)
    x = np.concatenate([rng.normal(size=(150, 2)) + c for c in ((0, 0), (8, 8))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "row_id long, a double, b double")
    path = str(tmp_path_factory.mktemp("arriving"))
    df.repartition(4).write.mode("overwrite").parquet(path)
    return df, lambda: spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_density_fit_on_a_stream(spark, arriving, tmp_path):
    df, stream = arriving
    fit = api.cluster(df, "dbscan", features=["a", "b"], eps=0.8, minPts=5)
    assign.by_batch(fit, stream(), str(tmp_path)).awaitTermination()
    found = assign.assigned(spark, str(tmp_path))
    assert found.select("batch").distinct().count() == 4
    assert {r.row_id: r.cluster for r in found.collect()} == {r.row_id: r.cluster for r in api.predict(fit, df).clusters.collect()}
    with pytest.raises(ValueError, match="by_batch"):
        assign.assign_stream(fit, stream())


def test_running_sigma(spark, arriving, tmp_path):
    df, stream = arriving
    fit = api.cluster(df, "kmeans", 2, features=["a", "b"], seed=1)
    assign.by_batch(fit, stream(), str(tmp_path), scores=True).awaitTermination()
    rows = assign.assigned(spark, str(tmp_path)).collect()
    x = {r.row_id: (r.a, r.b) for r in df.collect()}
    mean = np.mean(list(x.values()), axis=0)
    seen: list[int] = []
    for batch in sorted({r.batch for r in rows}):
        own = [r for r in rows if r.batch == batch]
        seen += [r.row_id for r in own]
        d = [np.sqrt(((np.array(x[i]) - mean - c) ** 2).sum()) for i in seen for c in fit.centers]
        assert {round(r.sigma / np.median(d), 2) for r in own} == {1.0}
        assert all(abs(sum(r.scores) - 1) < 1e-9 and r.scores[r.cluster - 1] == max(r.scores) for r in own)
    assert sorted(seen) == sorted(x)


def test_sketch_brute(spark):
    v = np.concatenate([np.random.default_rng(4).lognormal(size=501), np.zeros(20)])
    df = spark.createDataFrame([(float(a),) for a in v], "v double")
    parts = [assign.sketch_of(df.where(F.pmod(F.xxhash64("v"), F.lit(3)) == i)) for i in range(3)]
    got = assign.sketched_median(parts[0].unionByName(parts[1]).unionByName(parts[2]))
    assert got == pytest.approx(np.median(v), rel=assign.RATIO - 1)
    assert assign.sketched_median(parts[0].limit(0)) == 0.0
