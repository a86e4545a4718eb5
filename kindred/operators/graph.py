"""Connected components of a link table.

Links are written once, each as (u, v) with u > v. A round first replaces the links of each piece of at most
``piece`` links that a task holds by stars of the piece's own components (a vectorised union-find), then makes
a large and a small star (of every node: the larger neighbours are linked to the least one, then the
smaller ones). A table of at most ``piece`` links is one piece, which settles it at once. Each round is written
and read again, so plans and size estimates stay those of one round, and the number of rounds grows with the
logarithm of a component's width.

A node of many links does not stand in one task: nodes of more than ``hub`` links, of which there are at most
HUBS since hub is at least 2 * links / HUBS, are sent to all tasks with their least neighbour, and only the
links of the others are shuffled for their join.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.sources.shelf import Shelf, shared_folder

PIECE = 1_000_000
HUBS, LEAST_HUB = 100_000, 1_000


def ensure_checkpoint_dir(df: DataFrame) -> None:
    """The folder of spark.checkpoint.dir; where that is unset, one in the warehouse."""
    spark = df.sparkSession
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(shared_folder(spark))


def least_of(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, least node of its component) of every node of the links (u, v)."""
    nodes, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = code[: len(u)], code[len(u) :]
    root = np.arange(len(nodes))
    while len(a):
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        open_ = low != high
        a, b, low, high = a[open_], b[open_], low[open_], high[open_]
        np.minimum.at(root, high, low)
        while True:
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
    return nodes, nodes[root]


def _pieces(edges: DataFrame, piece: int) -> DataFrame:
    """Stars of the components of each piece of a task's links."""

    def run(batches):
        held: list[pa.RecordBatch] = []
        schema = None

        def stars() -> pa.RecordBatch:
            table = pa.Table.from_batches(held, schema)
            u, v = (table[c].to_numpy() for c in ("u", "v"))
            node, root = least_of(u, v)
            own = node != root
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(x[own], schema.field(0).type) for x in (node, root)], ["u", "v"])

        size = 0
        for batch in batches:
            schema = batch.schema
            while batch.num_rows:
                part = batch.slice(0, piece - size)
                held.append(part)
                size, batch = size + part.num_rows, batch.slice(part.num_rows)
                if size == piece:
                    yield stars()
                    size = 0
        if held:
            yield stars()

    kind = edges.schema["u"].dataType.simpleString()
    return edges.select("u", "v").mapInArrow(run, f"u {kind}, v {kind}")


def _joined(links: DataFrame, least: DataFrame, hub: int) -> DataFrame:
    """``links`` with the least neighbour m of their u; hubs' links are not shuffled."""
    known = links.join(F.broadcast(least.where(F.col("n") > hub).select("u", F.col("m").alias("hub_m"))), "u", "left")
    rest = known.where("hub_m IS NULL").drop("hub_m").join(least.where(F.col("n") <= hub).select("u", "m"), "u")
    return rest.unionByName(known.where("hub_m IS NOT NULL").withColumnRenamed("hub_m", "m"))


def _large(edges: DataFrame, hub: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.min("u")).alias("m"), F.count("*").alias("n"))
    return _joined(both, least, hub).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")


def _small(edges: DataFrame, hub: int) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
    moved = _joined(edges, least, hub).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    return least.select("u", F.col("m").alias("v")).union(moved)


def components(links: DataFrame, shelf: Shelf, name: str, piece: int = PIECE, values: int | None = None) -> DataFrame:
    """(node, root) of every node with a link; root is the least node of its component.

    ``links`` has the columns a and b of one type. Self-links, repeated links and null ends are left out.
    ``values`` is a guess of the numbers in the links, for the number of files."""
    edges = links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    edges, step, seal = shelf.put(edges.distinct(), f"{name}-0", values), 0, None
    while True:
        n = edges.count()
        if n <= piece:
            if n:
                edges = shelf.put(_pieces(edges.coalesce(1), piece), f"{name}-whole")
                shelf.drop(f"{name}-{step}")
            break
        hub = max(LEAST_HUB, 2 * n // HUBS)
        stars = shelf.put(_pieces(edges, piece).distinct(), f"{name}-stars-{step}", 2 * n)
        large = shelf.put(_large(stars, hub).distinct(), f"{name}-large-{step}", 2 * n)
        edges = shelf.put(_small(large, hub).distinct(), f"{name}-{step + 1}", 2 * n)
        shelf.drop(f"{name}-{step}", f"{name}-stars-{step}", f"{name}-large-{step}")
        step += 1
        now = edges.agg(F.count("*"), F.coalesce(F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1_000_000_007))), F.lit(0))).first()
        if now == seal:
            break
        seal = now
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())


def connected(nodes: DataFrame, links: DataFrame, shelf: Shelf | None = None, piece: int = PIECE) -> DataFrame:
    """(row_id, root) of all nodes: the least row_id that can be reached over links (i, j)."""
    own = shelf or Shelf(nodes.sparkSession, "components")
    found = components(links.select(F.col("i").alias("a"), F.col("j").alias("b")), own, "links", piece)
    return nodes.select("row_id").join(found, nodes.row_id == found.node, "left").select("row_id", F.coalesce("root", "row_id").alias("root"))
