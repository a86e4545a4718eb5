import random

import numpy as np
import pytest

from kindred.operators import graph
from kindred.sources.shelf import Shelf


def brute(links):
    root = {x: x for e in links for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    return {x: find(x) for x in root}


@pytest.mark.parametrize(("nodes", "links", "piece", "hub"), [(60, 40, 1_000_000, 1000), (300, 200, 20, 1000), (300, 260, 17, 2), (40, 400, 30, 3)])
def test_components_brute(spark, monkeypatch, nodes, links, piece, hub):
    monkeypatch.setattr(graph, "LEAST_HUB", hub)
    rng = random.Random(nodes + links)
    edges = [(rng.randrange(nodes), rng.randrange(nodes)) for _ in range(links)] + [(1000 + i, 1001 + i) for i in range(50)] + [(2000, 3000 + i) for i in range(40)]
    odd = [(None, 3), (5, None), (5000, 5000), edges[0], edges[0][::-1]]
    table = spark.createDataFrame(edges + odd, "a long, b long").repartition(5)
    found = {r.node: r.root for r in graph.components(table, Shelf(spark, "test"), "x", piece).collect()}
    assert found == brute([e for e in edges if e[0] != e[1]])


def test_long_path_settles_in_few_rounds(spark):
    """Rounds grow with the logarithm of a path's length, and a round's size estimate stays that of its table."""
    shelf, n = Shelf(spark, "test"), 20_000
    path = spark.range(n - 1).selectExpr("id * 7919 % 20011 a", "(id + 1) * 7919 % 20011 b")
    found = graph.components(path, shelf, "path", 1000)
    assert {(r.node, r.root) for r in found.collect()} == {(i * 7919 % 20011, 0) for i in range(n)}
    names = {p.getPath().getName() for p in shelf._at(shelf.root)[0].listStatus(shelf._at(shelf.root)[1])}
    rounds = max(int(x.rsplit("-", 1)[1]) for x in names if x.rsplit("-", 1)[1].isdigit())
    assert rounds <= 15
    size = int(str(found._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    assert size < 10_000_000


def test_strings_and_nodes_without_links(spark):
    nodes = spark.createDataFrame([(c,) for c in "abcdef"], "row_id string")
    links = spark.createDataFrame([("f", "c"), ("c", "b"), ("e", "e")], "i string, j string")
    for piece in (1, 100):
        assert {r.row_id: r.root for r in graph.connected(nodes, links, piece=piece).collect()} == {"a": "a", "b": "b", "c": "b", "d": "d", "e": "e", "f": "b"}
    assert graph.connected(nodes.limit(0), links.limit(0)).collect() == []


def test_least_of_brute():
    rng = np.random.default_rng(1)
    for _ in range(50):
        u, v = rng.integers(0, 30, (2, int(rng.integers(0, 40))))
        node, root = graph.least_of(u, v)
        assert dict(zip(node.tolist(), root.tolist(), strict=True)) == brute(list(zip(u.tolist(), v.tolist(), strict=True)))
