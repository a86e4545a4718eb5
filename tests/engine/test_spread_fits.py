"""Fits of a table of one file use all cores, and their rounds shuffle sums instead of rows."""

import numpy as np
import pytest

from kindred.operators import api, methods, partition


@pytest.fixture
def one_task(spark):
    rng = np.random.default_rng(5)
    rows = [(i, float(a), float(b), "xyz"[i % 3] if i % 11 else None) for i, (a, b) in enumerate(rng.normal(size=(400, 2)) + np.repeat([[0, 0], [9, 9]], 200, axis=0))]
    return spark.createDataFrame(rows, "id int, a double, b double, c string").coalesce(1)


@pytest.mark.parametrize(("method", "step", "features"), [("kmeans", "means_round", ["a", "b"]), ("gmm", "em_statistics", ["a", "b"]), ("kproto", "prototype_round", ["a", "c"]), ("kmm", "prototype_round", ["a", "c"])])
def test_rounds_of_a_one_file_table_use_all_cores(one_task, monkeypatch, method, step, features):
    monkeypatch.setattr(partition, "LEAST_TASK_ROWS", 100, raising=False)
    real, seen = getattr(methods, step), []

    def watched(x, *args, **named):
        seen.append(x.rdd.getNumPartitions())
        return real(x, *args, **named)

    monkeypatch.setattr(methods, step, watched)
    df = one_task.dropna() if method == "kproto" else one_task
    assert api.cluster(df, method, 2, id_col="id", features=features, seed=1).n_clusters == 2
    assert set(seen) == {4}


def test_prototype_rounds_give_back_sums(one_task, spark, monkeypatch):
    """Of 400 rows and 2 runs: the rows of the first shuffle are values, not rows."""
    runs = {7: [{"a": 0.0, "c": "x"}, {"a": 9.0, "c": "y"}], 8: [{"a": 1.0, "c": "z"}, {"a": None, "c": "z"}]}
    rows = one_task.selectExpr("id AS row_id", "a", "c")
    types = {"a": "numeric", "c": "categorical"}
    whole = methods.prototype_round(rows, types, runs, 0.5)
    for s, (new, cost) in whole.items():
        own, total = {0: [], 1: []}, 0.0
        for r in rows.collect():
            d = []
            for p in runs[s]:
                parts = [((r.a - p["a"]) ** 2, 1.0)] if p["a"] is not None else []
                parts += [(0.5 * (r.c != p["c"]), 0.5)] if r.c is not None else []
                d.append(sum(v for v, _ in parts) * 1.5 / sum(w for _, w in parts) if parts else np.inf)
            own[int(np.argmin(d))].append(r)
            total += min(d)
        assert cost == pytest.approx(total)
        for g, members in own.items():
            if members:
                texts = [r.c for r in members if r.c is not None]
                assert new[g]["a"] == pytest.approx(np.mean([r.a for r in members]))
                assert new[g]["c"] == (min(set(texts), key=lambda v: (-texts.count(v), v)) if texts else None)
    monkeypatch.setattr(methods, "HELD", 1)  # did not exist before: rows were shuffled, one for each run
    again = methods.prototype_round(rows, types, runs, 0.5)
    assert {s: (new, pytest.approx(cost)) for s, (new, cost) in whole.items()} == {s: ([{"a": pytest.approx(p["a"]), "c": p["c"]} for p in new], cost) for s, (new, cost) in again.items()}


def test_starts_that_end_alike_are_taken_in_order():
    assert methods.least_cost({3: 1.0 + 1e-14, 4: 1.0, 5: 2.0}) == (1.0 + 1e-14, 3)
