"""Leading eigenvectors of large symmetric operators, by products that are made where the data are.

A block of vectors is multiplied with the operator in one pass over a table; the residuals of the Ritz vectors of all
blocks so far are the next one, and after KEPT blocks the best vectors are kept (block Lanczos with restarts). The driver holds
these blocks, KEPT * BLOCK numbers for each row or column of the operator and at most MOST_VALUES in all, never the
operator.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.distance import Origin, origin_of
from kindred.operators.partition import vectors_of
from kindred.sources.shelf import Shelf

BLOCK, KEPT, MOST_VALUES = 8, 6, 1 << 27
PIECE_ROWS = 4096
TOLERANCE, ROUNDS = 1e-10, 300


def leading(product: Callable[[np.ndarray], np.ndarray], n: int, wanted: int = 2, seed: int = 0, tolerance: float = TOLERANCE, most_rounds: int = ROUNDS, center: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors) of the ``wanted`` greatest eigenvalues, and some more, of a symmetric operator on n numbers."""
    q = min(n, max(BLOCK, wanted))
    if n * q * (KEPT + 1) > MOST_VALUES:
        raise ValueError(f"{n} rows of {q * (KEPT + 1)} numbers are more than MOST_VALUES")
    v = np.random.default_rng(seed).normal(size=(n, q))
    v = np.linalg.qr(v - v.mean(axis=0) if center else v)[0]
    z = product(v)
    for _ in range(most_rounds):
        h = v.T @ z
        values, turn = np.linalg.eigh((h + h.T) / 2)
        best = np.argsort(-values)[:q]
        values, ritz, image = values[best], v @ turn[:, best], z @ turn[:, best]
        left = image - ritz * values
        if np.abs(left[:, :wanted]).max(initial=0) <= tolerance * max(1e-300, float(np.abs(h).max(initial=0))):
            return values, ritz
        if v.shape[1] > KEPT * q - q:
            v, z = ritz, image
        for _ in range(2):  # of rounding
            left = left - v @ (v.T @ left)
        basis, size, _ = np.linalg.svd(left, full_matrices=False)
        new = basis[:, size > 1e-14 * max(1e-300, float(np.abs(h).max()))]
        if not new.shape[1] or v.shape[1] >= n:
            return values, ritz
        new = np.linalg.qr(new - v @ (v.T @ new))[0]
        v, z = np.hstack([v, new]), np.hstack([z, product(new)])
    raise RuntimeError(f"eigenvectors have not settled after {most_rounds} rounds (most_rounds)")


def signed(vectors: np.ndarray) -> np.ndarray:
    """Each vector signed so that its largest entry (the first of equal ones) is positive."""
    size = np.abs(vectors)
    sign = np.sign(vectors[(size > size.max(axis=0, initial=0) - 1e-9).argmax(axis=0), np.arange(vectors.shape[1])])
    return vectors * np.where(sign == 0, 1, sign)


def _summed(parts: DataFrame, n: int, q: int) -> np.ndarray:
    """The block that tasks have summed up in parts: rows (i, v)."""
    out = np.zeros((n, q))
    sums = parts.groupBy("i").agg(F.array(*(F.sum(F.get("v", F.lit(c))) for c in range(q))).alias("v"))
    for batch in sums.toArrow().to_batches():
        out[batch.column(0).to_numpy()] = batch.column(1).flatten().to_numpy().reshape(-1, q)
    return out


def scaling_of_pairs(pairs: DataFrame, shelf: Shelf | None = None, k: int = 2) -> tuple[list, np.ndarray]:
    """Ids and coordinates by classical scaling of a distance table (i, j, d); a pair that is not in it is at distance 0.

    The doubly centred table of squares is not made: a centred block times it is the table's squares times the
    block, centred again. Where the table's origin is known, tasks make it again in each round, a few rows at a time
    against all of them, and nothing is written; any other table is written once, each pair once, and read once a round."""
    spark, origin = pairs.sparkSession, origin_of(pairs)
    nodes = pairs.select("i").union(pairs.select("j")).distinct() if origin is None else origin.rows.select("row_id")
    ids = sorted(r[0] for r in nodes.limit(MOST_VALUES // (BLOCK * (KEPT + 1)) + 1).collect())
    n = len(ids)
    if n * BLOCK * (KEPT + 1) > MOST_VALUES:
        raise ValueError("more rows than MOST_VALUES allows")
    if not n:
        return ids, np.zeros((0, k))
    product = _of_table(pairs, ids, shelf or Shelf(spark, "scaling")) if origin is None else _of_rows(origin, n)
    values, vectors = leading(product, n, min(k, n), center=True)
    out = signed(vectors[:, :k]) * np.sqrt(np.maximum(values[:k], 0))
    return ids, np.pad(out, ((0, 0), (0, max(0, k - out.shape[1]))))


def _of_rows(origin: Origin, n: int) -> Callable[[np.ndarray], np.ndarray]:
    """The product with the table of two rows each, which is made within tasks. All rows are sent to all tasks, as the blocks are."""
    found, spark = origin.rows.orderBy("row_id").select("x").toArrow(), origin.rows.sparkSession
    x = vectors_of(found["x"])
    if x.size > MOST_VALUES:
        raise ValueError("more values than MOST_VALUES allows")
    every, between, cores = spark.sparkContext.broadcast(x), origin.between, spark.sparkContext.defaultParallelism
    pieces = max(cores, -(-n // PIECE_ROWS))

    def product(v: np.ndarray) -> np.ndarray:
        q, w = v.shape[1], spark.sparkContext.broadcast(v - v.mean(axis=0))

        def run(batches):
            for batch in batches:
                for piece in batch.column(0).to_pylist():
                    begin, end = piece * n // pieces, (piece + 1) * n // pieces
                    out = np.zeros((end - begin, q))
                    for lo in range(begin, end, 64):
                        rows = every.value[lo : min(end, lo + 64)]
                        for at in range(0, n, 2048):
                            d = between(rows, every.value[at : at + 2048])
                            d *= d
                            out[lo - begin : lo - begin + len(rows)] += d @ w.value[at : at + 2048]
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(begin, end), pa.int32()), pa.FixedSizeListArray.from_arrays(pa.array(out.ravel()), q).cast(pa.list_(pa.float64()))], ["i", "v"])

        z = np.zeros((n, q))
        for batch in spark.range(0, pieces, 1, pieces).mapInArrow(run, "i int, v array<double>").toArrow().to_batches():
            z[batch.column(0).to_numpy()] = batch.column(1).flatten().to_numpy().reshape(-1, q)
        w.unpersist()
        return -0.5 * (z - z.mean(axis=0))

    return product


def _of_table(pairs: DataFrame, ids: list, shelf: Shelf) -> Callable[[np.ndarray], np.ndarray]:
    """The product with a table of any origin."""
    spark, n = pairs.sparkSession, len(ids)
    kind = pairs.schema["i"].dataType.simpleString()
    places = shelf.put(spark.createDataFrame(list(zip(ids, range(n), strict=True)), f"id {kind}, place int"), "places")
    at = lambda c: places.select(F.col("id").alias(c), F.col("place").alias(f"{c}_place"))
    half = pairs.where("i <> j AND d IS NOT NULL").join(at("i"), "i").join(at("j"), "j").select("i_place", "j_place", F.pow(F.col("d").cast("double"), 2).alias("s"))
    table = shelf.put(half.toDF("i", "j", "s"), "squares")

    def product(v: np.ndarray) -> np.ndarray:
        q, w = v.shape[1], spark.sparkContext.broadcast(v - v.mean(axis=0))

        def run(batches):
            for batch in batches:
                i, j, s = (batch.column(c).to_numpy() for c in range(3))
                rows, of = np.unique(np.concatenate([i, j]), return_inverse=True)
                s, to = np.concatenate([s, s]), np.concatenate([j, i])
                out = np.zeros((len(rows), q))
                for c in range(q):
                    out[:, c] = np.bincount(of, s * w.value[to, c], len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(out.tolist(), pa.list_(pa.float64()))], ["i", "v"])

        z = _summed(table.mapInArrow(run, "i int, v array<double>"), n, q)
        return -0.5 * (z - z.mean(axis=0))

    return product


def correspondence(df: DataFrame, features: list[str], levels: list[tuple[int, str]], counts: np.ndarray, n: int, wanted: int = 2) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors over the levels) of multiple correspondence analysis: a row of the table is its level of each
    feature (``levels``: feature number and level, in the order of the vectors' rows), and a pass adds each row's sum over its
    levels to these levels, so neither indicators nor the table of pairs of levels are made."""
    q, place = len(features), {key: i for i, key in enumerate(levels)}
    root = np.sqrt(counts / (n * q))
    spark = df.sparkSession
    coded = df.select(*(F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("missing")).alias(f"c{i}") for i, f in enumerate(features)))
    codes = spark.sparkContext.broadcast(place)

    def product(v: np.ndarray) -> np.ndarray:
        w = spark.sparkContext.broadcast(v / root[:, None])
        b, size = v.shape[1], len(levels)

        def run(batches):
            out = np.zeros((size, b))
            for batch in batches:
                at = np.array([[codes.value[i, x] for x in batch.column(i).to_pylist()] for i in range(q)], int).reshape(q, -1)
                total = w.value[at].sum(axis=0)
                for i in range(q):
                    for c in range(b):
                        out[:, c] += np.bincount(at[i], total[:, c], size)
            met = np.flatnonzero(out.any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(met, pa.int32()), pa.array(out[met].tolist(), pa.list_(pa.float64()))], ["i", "v"])

        z = _summed(coded.mapInArrow(run, "i int, v array<double>"), size, b) / (n * q * q) / root[:, None]
        return z - root[:, None] * (root @ v)

    return leading(product, len(levels), wanted)
