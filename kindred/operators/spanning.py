"""Minimum spanning trees of points and of distance tables, and single linkage from them.

No matrix is made. Points are dealt to cells of pivots and these to blocks; a task takes two blocks and gives back
the spanning tree of their rows, for an edge that is not in the tree of a part is in no tree of the whole. Pairs of cells
come in rounds of growing distance. A bound from below of the distances between two cells follows from the
triangle inequality, and a pair of cells is left out for good where the bound is above the longest edge of a tree
that is already spanning, or where all their rows hang together by edges shorter than the bound.

``forest`` reduces a table of edges to its spanning forest: pieces of at most ``piece`` edges are reduced within tasks
(Borůvka's rounds on arrays) until the table stops shrinking; one piece left is the end, otherwise a round of Borůvka
is made on the whole table: the shortest edge of every component is taken, components are merged and their
inner edges dropped. Edges are in the order (d, i, j), so the tree is one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.graph import PIECE, components, least_of
from kindred.operators.partition import celled, distances_to, pivots, vectors_of
from kindred.sources.shelf import Shelf

BLOCK_ROWS = 1024


def local_forest(u: np.ndarray, v: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Places of the edges (u, v) of the spanning forest, by the order of ``rank``."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    order = np.argsort(rank, kind="stable")
    a, b = code[: len(u)][order], code[len(u) :][order]
    label, left, taken = np.arange(len(nodes)), np.flatnonzero(a != b), []
    while len(left):
        x, y = label[a[left]], label[b[left]]
        left, x, y = left[x != y], x[x != y], y[x != y]
        if not len(left):
            break
        best = np.full(len(nodes), len(order))
        np.minimum.at(best, x, left)
        np.minimum.at(best, y, left)
        chosen = np.unique(best[best < len(order)])
        taken.append(chosen)
        node, root = least_of(label[a[chosen]], label[b[chosen]])
        new = np.arange(len(nodes))
        new[node] = root
        label = new[label]
    return order[np.concatenate(taken)] if taken else np.zeros(0, int)


def _ranks(d: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    ids = np.unique(np.concatenate([i, j]), return_inverse=True)[1]
    order = np.lexsort((ids[len(i) :], ids[: len(i)], d))
    rank = np.empty(len(d), int)
    rank[order] = np.arange(len(d))
    return rank


def _reduced(edges: DataFrame, piece: int) -> DataFrame:
    """Of (u, v, d, i, j), the forests of each task's pieces."""
    names = edges.columns

    def run(batches):
        held, size = [], 0

        def done() -> pa.RecordBatch:
            table = pa.Table.from_batches(held)
            u, v, d, i, j = (table[c].to_numpy() for c in ("u", "v", "d", "i", "j"))
            kept = local_forest(u, v, _ranks(d, i, j))
            held.clear()
            return table.take(pa.array(np.sort(kept))).combine_chunks().to_batches()

        for batch in batches:
            while batch.num_rows:
                held.append(batch.slice(0, piece - size))
                size, batch = size + held[-1].num_rows, batch.slice(held[-1].num_rows)
                if size == piece:
                    yield from done()
                    size = 0
        if size:
            yield from done()

    return edges.mapInArrow(run, ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in names))


def forest(edges: DataFrame, shelf: Shelf, name: str, piece: int = PIECE) -> DataFrame:
    """(i, j, d), i < j: the minimum spanning forest of the edges (i, j, d). Self-loops and null distances are left out."""
    i, j = F.least("i", "j"), F.greatest("i", "j")
    one = edges.where("i <> j AND d IS NOT NULL").select(i.alias("i"), j.alias("j"), F.col("d").cast("double").alias("d"))
    # pieces are reduced before anything is written: of all pairs of n rows only about n edges a piece are
    now = shelf.put(_reduced(one.select(F.col("i").alias("u"), F.col("j").alias("v"), "d", "i", "j"), piece), f"{name}-edges")
    n, step, parts = now.count(), 0, []
    while n:
        if n <= piece:
            parts.append(_reduced(now.coalesce(1), piece).select("i", "j", "d"))
            break
        step += 1
        less = shelf.put(_reduced(now, piece).repartition(max(1, -(-n // (2 * piece))), "u"), f"{name}-pieces-{step}")
        m = less.count()
        now, shrunk, n = less, m <= 0.7 * n, m
        if shrunk or n <= piece:
            continue
        key = F.struct("d", "i", "j")
        both = now.select(F.col("u").alias("c"), key.alias("e"), "u", "v").union(now.select(F.col("v").alias("c"), key, "u", "v"))
        chosen = shelf.put(both.groupBy("c").agg(F.min(F.struct("e", "u", "v")).alias("m")).select("m.e.*", "m.u", "m.v").distinct(), f"{name}-tree-{step}")
        parts.append(chosen.select("i", "j", "d"))
        roots = components(chosen.select(F.col("u").alias("a"), F.col("v").alias("b")), shelf, f"{name}-roots-{step}", piece)
        to = lambda c: roots.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))  # noqa: E731, B023
        moved = now.join(to("u"), "u").join(to("v"), "v").where("u_root <> v_root")
        low, high = F.least("u_root", "v_root"), F.greatest("u_root", "v_root")
        least = moved.groupBy(low.alias("u"), high.alias("v")).agg(F.min(F.struct("d", "i", "j")).alias("e"))
        now = shelf.put(least.select("u", "v", "e.*"), f"{name}-merged-{step}")
        n = now.count()
    if not parts:
        return one.limit(0)
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return shelf.put(out, f"{name}-forest")


def _prim(x: np.ndarray, between=distances_to) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(from, to, d) of a spanning tree of the rows of x."""
    n = len(x)
    left = np.arange(1, n)
    near, least = np.zeros(n - 1, int), between(x[:1], x[1:])[0]
    a, b, d = np.zeros(n - 1, int), np.zeros(n - 1, int), np.zeros(n - 1)
    for step in range(n - 1):
        at = int(least.argmin())
        a[step], b[step], d[step] = near[at], left[at], least[at]
        new = left[at]
        left[at], near[at], least[at] = left[-1], near[-1], least[-1]
        left, near, least = left[:-1], near[:-1], least[:-1]
        if len(left):
            far = between(x[new : new + 1], x[left])[0]
            closer = far < least
            near[closer], least[closer] = new, far[closer]
    return a, b, d


def _block_trees(rows: DataFrame, cells: list[tuple[int, int]], parts: dict[int, int], between=distances_to) -> DataFrame:
    """Trees of the pairs of blocks of the given pairs of cells; of (row_id, x, cell, part)."""
    kind = rows.schema["row_id"].dataType.simpleString()
    spark = rows.sparkSession
    sides = [(one, two, side) for one, two in cells for side in ((one,) if one == two else (one, two))]
    table = spark.createDataFrame([(s, o, t, s == o, parts[t if s == o else o]) for o, t, s in sides], "cell int, one int, two int, first boolean, others int")
    dealt = rows.join(F.broadcast(table), "cell").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
    own = F.col("one") == F.col("two")
    p = F.when(own, F.least("part", "with")).when(F.col("first"), F.col("part")).otherwise(F.col("with"))
    q = F.when(own, F.greatest("part", "with")).when(F.col("first"), F.col("with")).otherwise(F.col("part"))

    def run(table: pa.Table) -> pa.Table:
        a, b, d = _prim(vectors_of(table["x"]), between) if table.num_rows > 1 else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        return pa.table({"i": table["row_id"].take(pa.array(a)), "j": table["row_id"].take(pa.array(b)), "d": pa.array(d, pa.float64())})

    return dealt.select("one", "two", p.alias("p"), q.alias("q"), "row_id", "x").groupBy("one", "two", "p", "q").applyInArrow(run, f"i {kind}, j {kind}, d double")


def _bounds(rows: DataFrame, points: np.ndarray, between=distances_to) -> np.ndarray:
    """Of each two cells, a number that no distance between their rows is below."""
    names, k = rows.columns, len(points)

    def run(batches):
        margin, radius = np.full((k, k), np.inf), np.full(k, -np.inf)
        for batch in batches:
            if batch.num_rows:
                d = between(vectors_of(batch.column(names.index("x"))), points)
                cell = batch.column(names.index("cell")).to_numpy()
                own = d[np.arange(len(d)), cell]
                np.maximum.at(radius, cell, own)
                np.minimum.at(margin, cell, d - own[:, None])
        for c in np.flatnonzero(radius >= 0):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(k, c), pa.int32()), pa.array(np.arange(k), pa.int32()), pa.array(margin[c]), pa.array(np.full(k, radius[c]))], ["a", "b", "m", "r"])

    margin, radius = np.full((k, k), np.inf), np.full(k, -np.inf)
    for r in rows.mapInArrow(run, "a int, b int, m double, r double").groupBy("a", "b").agg(F.min("m").alias("m"), F.max("r").alias("r")).collect():  # a row a pair of pivots
        margin[r.a, r.b], radius[r.a] = r.m, r.r
    low = np.maximum((margin + margin.T) / 2, between(points, points) - radius[:, None] - radius[None, :])
    # of rounding, not of the metric
    return np.maximum(0, low * (1 - 1e-9) - 1e-12)


def spanning_tree(x: DataFrame, shelf: Shelf | None = None, block_rows: int = BLOCK_ROWS, piece: int = PIECE, between=distances_to) -> DataFrame:
    """(i, j, d), i < j: the minimum spanning tree of (row_id, x) by Euclidean distances, or those of another metric
    (``between`` two blocks of rows). One row or none has no edges."""
    shelf = shelf or Shelf(x.sparkSession, "tree")
    n = x.count()
    points = pivots(x, -(-n // block_rows))
    cells = shelf.put(celled(x.select("row_id", "x"), points, between), "cells")
    parts = {r.cell: -(-r["count"] // block_rows) for r in cells.groupBy("cell").count().collect()}  # a row a pivot
    cut = F.create_map(*(F.lit(v) for item in parts.items() for v in item)) if parts else F.create_map()
    rows = cells.withColumn("part", F.pmod(F.xxhash64("row_id"), cut[F.col("cell")]).cast("int") if parts else F.lit(0))
    if n < 2:
        return forest(x.select(F.col("row_id").alias("i"), F.col("row_id").alias("j"), F.lit(0.0).alias("d")), shelf, "none")
    bound = _bounds(cells, points, between)
    known = sorted(parts)
    pairs = {(a, b): bound[a, b] for i, a in enumerate(known) for b in known[i + 1 :]}
    # cells alone, then with what is as near as the nearest cell of any
    edges = shelf.put(_block_trees(rows, [(a, a) for a in known], parts, between), "round-0")
    reach, step = max((min(v for k, v in pairs.items() if a in k) for a in known), default=0.0) if pairs else 0.0, 0
    tree = forest(edges, shelf, "forest-0", piece)
    while pairs:
        step += 1
        now = [k for k, v in pairs.items() if v <= reach]
        for k in now:
            del pairs[k]
        if now:
            more = shelf.put(_block_trees(rows, now, parts, between), f"round-{step}")
            tree = forest(tree.unionByName(more), shelf, f"forest-{step}", piece)
        count, longest = tree.agg(F.count("*"), F.max("d")).first()
        if count == n - 1:
            # nothing above the longest edge of a spanning tree belongs to the least one
            pairs = {k: v for k, v in pairs.items() if v <= longest}
        if not pairs:
            break
        # cells whose rows hang together by edges that are shorter than what is between them
        roots = components(tree.where(F.col("d") <= reach).select(F.col("i").alias("a"), F.col("j").alias("b")), shelf, f"near-{step}", piece)
        of = cells.select("row_id", "cell").join(roots, F.col("row_id") == F.col("node"), "left").select("cell", F.coalesce("root", "row_id").alias("root"))
        whole = {r.cell: (r.lo, r.hi) for r in of.groupBy("cell").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).collect()}
        pairs = {(a, b): v for (a, b), v in pairs.items() if not (whole[a] == whole[b] and whole[a][0] == whole[a][1])}
        if pairs:
            reach = longest if count == n - 1 else max(2 * reach, min(pairs.values()))
    return tree


def merges(n: int, edges: list[tuple[int, int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(merge, height, size) of the edges in order, between leaves 0 to n - 1; negative numbers are leaves from 1, others earlier steps."""
    root, name, size = list(range(n)), [-i - 1 for i in range(n)], [1] * n

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    merge, height, count = np.zeros((len(edges), 2), int), np.zeros(len(edges)), np.zeros(len(edges), int)
    for step, (a, b, d) in enumerate(edges):
        p, q = find(a), find(b)
        one, two = name[p], name[q]
        merge[step] = sorted((one, two)) if (one < 0) == (two < 0) else sorted((one, two), key=lambda v: v > 0)
        root[max(p, q)], low = min(p, q), min(p, q)
        size[low] = size[p] + size[q]
        name[low], height[step], count[step] = step + 1, d, size[low]
    return merge, height, count
