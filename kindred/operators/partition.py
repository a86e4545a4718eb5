"""Partitions of a metric space by pivots, for neighbourhoods in any number of dimensions.

A row belongs to the cell of its nearest pivot. What may lie near the rows of a cell follows from the triangle
inequality alone: a row y within eps of some row of cell q is at most eps beyond the cell's radius from q's
pivot, and at most 2 * eps farther from it than from its own. Pivots are the means of a bounded sample of
rows, as many as there are blocks of rows, MOST_PIVOTS at most; cells of more rows are cut by a hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MOST_PIVOTS, SAMPLE, ROUNDS = 256, 4096, 5
WIDE = 8
KEPT, MOST_BLOCK, LEAST_BLOCKS = 0.5, 32_768, 12
LEAST_TASK_ROWS, MOST_TASK_ROWS = 8192, 250_000


def spread(df: DataFrame, n: int) -> DataFrame:
    """``df``, of about n rows, dealt by a hash of row_id to all cores where it has the rows for them: a table of one file is one task."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    tasks = max(min(cores, -(-n // LEAST_TASK_ROWS)), -(-n // MOST_TASK_ROWS))
    return df.repartition(tasks, "row_id") if tasks > 1 else df


def vectors_of(column: pa.ChunkedArray | pa.Array, p: int | None = None) -> np.ndarray:
    """A column of arrays as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(float)
    return flat.reshape(len(column), -1 if p is None or len(column) else p)


def distances_to(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean, summed up feature by feature."""
    d = np.zeros((len(x), len(points)))
    for f in range(points.shape[1]):
        d += (x[:, f, None] - points[None, :, f]) ** 2
    return np.sqrt(d)


def squares(x: np.ndarray, y: np.ndarray, at: float = 0.0) -> np.ndarray:
    """Squared Euclidean distances; of WIDE features and more by one product, where what rounding could move across ``at``
    (or is small beside its parts) is summed up feature by feature after all."""
    if x.shape[1] < WIDE or not len(x) or not len(y) or not (np.isfinite(x).all() and np.isfinite(y).all()):
        return sum(((x[:, f, None] - y[None, :, f]) ** 2 for f in range(x.shape[1])), np.zeros((len(x), len(y))))
    center, raw, others = y.mean(axis=0), x, y
    x, y = x - center, y - center
    own, far = (x * x).sum(axis=1)[:, None], (y * y).sum(axis=1)[None, :]
    d = x @ y.T
    d *= -2
    d += own
    d += far
    slack = 1e-12 * (own.max() + far.max())
    i, j = np.nonzero((d <= 1e6 * slack) | (np.abs(d - at) <= 100 * slack) if at else d <= 1e6 * slack)
    for lo in range(0, len(i), 1 << 16):
        a, b = i[lo : lo + (1 << 16)], j[lo : lo + (1 << 16)]
        total = np.zeros(len(a))
        for f in range(x.shape[1]):
            total += (raw[a, f] - others[b, f]) ** 2
        d[a, b] = total
    return d


def _plain_counts(x: np.ndarray, y: np.ndarray, eps: float, weight: np.ndarray | None) -> np.ndarray:
    at, out = max(1, min(256, (1 << 20) // max(1, len(y)))), np.zeros(len(x), np.int64)
    for lo in range(0, len(x), at):
        close = distances_to(x[lo : lo + at], y) <= eps
        out[lo : lo + at] = close.sum(axis=1) if weight is None else close @ weight
    return out


def counts_within(x: np.ndarray, y: np.ndarray, eps: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Of each row of x, the rows of y within eps (or their weights). Of WIDE features and more by one product in single
    precision; pairs that its rounding could move across eps are summed up feature by feature."""
    p = x.shape[1] if len(x) else 0
    out = np.zeros(len(x), np.int64)
    if not len(x) or not len(y):
        return out
    if p < WIDE or not (np.isfinite(x).all() and np.isfinite(y).all()):
        return _plain_counts(x, y, eps, weight)
    center = y.mean(axis=0)
    a, b = x - center, y - center
    own, far = (a * a).sum(axis=1), (b * b).sum(axis=1)
    # of the roundings of p + 2 products and sums, of the parts, and of the distance summed up below
    slack = 4 * (p + 4) * 2.0**-24 * (own.max() + far.max() + eps * eps)
    if not 1e-30 < slack < 1e30:
        return _plain_counts(x, y, eps, weight)
    # own + far - 2 a b as one product
    left = np.concatenate([a, own[:, None], np.ones((len(a), 1))], axis=1).astype(np.float32)
    right = np.concatenate([-2 * b, np.ones((len(b), 1)), far[:, None]], axis=1).astype(np.float32).T
    low, high = np.float32(eps * eps - slack), np.float32(eps * eps + slack)
    for at in range(0, len(y), 2048):
        piece, w = np.ascontiguousarray(right[:, at : at + 2048]), None if weight is None else weight[at : at + 2048]
        for lo in range(0, len(x), 256):
            d = left[lo : lo + 256] @ piece
            close = d <= high
            cell = np.flatnonzero(close)
            open_ = cell[d.ravel()[cell] > low]
            i, j = np.divmod(open_, d.shape[1])
            exact = np.zeros(len(i))
            for f in range(p):
                exact += (x[lo + i, f] - y[at + j, f]) ** 2
            far_off = open_[np.sqrt(exact) > eps]
            out[lo : lo + 256] += np.bincount(cell // d.shape[1], None if w is None else w[cell % d.shape[1]], len(d)).astype(np.int64)
            out[lo : lo + 256] -= np.bincount(far_off // d.shape[1], None if w is None else w[far_off % d.shape[1]], len(d)).astype(np.int64)
    return out


def pivots(x: DataFrame, blocks: int, seed: int = 0) -> np.ndarray:
    """At most ``blocks`` and MOST_PIVOTS points among which the rows of (row_id, x) spread about evenly."""
    count = min(MOST_PIVOTS, max(1, blocks))
    part = x.select("x", F.xxhash64("row_id", F.lit(seed)).alias("h"), "row_id").orderBy("h", "row_id").limit(SAMPLE)
    m = np.array([r.x for r in part.select("x").collect()], float)
    m = m[np.isfinite(m).all(axis=1)] if len(m) else m
    if not len(m):
        return np.zeros((0, 1))
    points = np.unique(m, axis=0)
    points = points[np.random.default_rng(seed).permutation(len(points))[:count]]
    for _ in range(ROUNDS):
        own = distances_to(m, points).argmin(axis=1)
        points = np.array([m[own == g].mean(axis=0) if (own == g).any() else points[g] for g in range(len(points))])
    return np.unique(points, axis=0)


def celled(x: DataFrame, points: np.ndarray, between=distances_to) -> DataFrame:
    """``x`` with its cell and the distance to the cell's pivot (near). ``between``: the metric."""
    names = x.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                d = between(vectors_of(batch.column(names.index("x"))), points)
                cell = d.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int32()), pa.array(d[np.arange(len(d)), cell])], [*names, "cell", "near"])

    return x.mapInArrow(run, _schema(x) + ", cell int, near double")


def _schema(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)


def near_cells(d: np.ndarray, radius: np.ndarray, eps: float) -> np.ndarray:
    """Which cells may hold a row within eps of the rows, by their distances d to the pivots."""
    # of rounding, not of the metric
    slack = eps * (1 + 1e-9) + 1e-9 * d.max()
    return (radius >= 0) & (d <= radius + slack) & (d <= d.min(axis=1)[:, None] + 2 * slack)


def cells_kept(x: DataFrame, points: np.ndarray, radius: np.ndarray, eps: float) -> float:
    """The share of the cells that a row of (row_id, x) is sent to, from a sample. It decides on blocks, not on results."""
    part = x.select("x", F.xxhash64("row_id", F.lit(1)).alias("h"), "row_id").orderBy("h", "row_id").limit(SAMPLE // 4)
    m = np.array([r.x for r in part.select("x").collect()], float)
    return float(near_cells(distances_to(m, points), radius, eps).mean() * len(points) / max(1, (radius >= 0).sum())) if len(m) else 0.0


def replicated(x: DataFrame, points: np.ndarray, radius: np.ndarray, eps: float) -> DataFrame:
    """``x`` with a row for each cell that may hold a row within eps of it; ``radius`` by cell, below 0 where it is empty."""
    names = x.columns

    def run(batches):
        for batch in batches:
            if batch.num_rows and len(points):
                d = distances_to(vectors_of(batch.column(names.index("x"))), points)
                row, cell = np.nonzero(near_cells(d, radius, eps))
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(cell, pa.int32())], [*names, "cell"])

    return x.mapInArrow(run, _schema(x) + ", cell int")


def eps_blocks(left: DataFrame, right: DataFrame, eps: float, run, schema: str, block_rows: int = 2048) -> DataFrame:
    """What ``run`` (rows, others: Arrow tables) gives back for blocks of left rows and of the right rows that may lie
    within eps of them; both have row_id and x. A task gets two blocks of about ``block_rows`` rows at most, or
    of MOST_BLOCK where the pivots leave most cells to most rows (what is sent is the square of the rows over a block's)."""
    n = left.count()
    left, right = spread(left, n), spread(right, n if left is right else right.count())
    points = pivots(left, -(-n // block_rows))
    radius = np.full(len(points), -1.0)
    for r in celled(left.select("row_id", "x"), points).groupBy("cell").agg(F.max("near").alias("r")).collect():  # a row a pivot
        radius[r.cell] = r.r
    if len(points) > 1 and points.shape[1] >= WIDE and cells_kept(right, points, radius, float(eps)) > KEPT:
        # pivots tell too little apart in so many dimensions: one cell, whose larger blocks are sent to fewer others
        points, radius, block_rows = points.mean(axis=0)[None], np.array([np.inf]), min(MOST_BLOCK, max(block_rows, -(-n // LEAST_BLOCKS)))
    a = celled(left, points).drop("near")
    b = replicated(right, points, radius, float(eps))
    parts = [df.groupBy("cell").agg(F.ceil(F.count("*") / block_rows).cast("int").alias(n)) for df, n in ((a, "na"), (b, "nb"))]
    cut = F.broadcast(parts[0].join(F.broadcast(parts[1]), "cell"))  # a row a pivot
    place, every = (lambda n: F.pmod(F.xxhash64("row_id"), F.col(n)).cast("int")), (lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1)))
    a = a.join(cut, "cell").withColumn("one", place("na")).withColumn("two", every("nb")).drop("na", "nb")
    b = b.join(cut, "cell").withColumn("two", place("nb")).withColumn("one", every("na")).drop("na", "nb")
    keys = ["cell", "one", "two"]
    return a.groupBy(*keys).cogroup(b.groupBy(*keys)).applyInArrow(run, schema)


def eps_pairs(left: DataFrame, right: DataFrame, eps: float) -> DataFrame:
    """(i, j, d) of rows of two (row_id, x) tables within eps of one another, self pairs included."""
    kinds = [df.schema["row_id"].dataType.simpleString() for df in (left, right)]

    def run(rows: pa.Table, others: pa.Table) -> pa.Table:
        x, y, out = vectors_of(rows["x"]), vectors_of(others["x"]), []
        at = max(1, min(256, (1 << 20) // max(1, len(y))))
        for lo in range(0, len(x), at):
            d = distances_to(x[lo : lo + at], y)
            i, j = np.nonzero(d <= eps)
            out.append((i + lo, j, d[i, j]))
        i, j, d = (np.concatenate(c) for c in zip(*out, strict=True)) if out else (np.zeros(0, int),) * 3
        return pa.table({"i": rows["row_id"].take(pa.array(i)), "j": others["row_id"].take(pa.array(j)), "d": pa.array(d, pa.float64())})

    return eps_blocks(left.select("row_id", "x"), right.select("row_id", "x"), eps, run, f"i {kinds[0]}, j {kinds[1]}, d double")


def eps_counts(left: DataFrame, right: DataFrame, eps: float, weight: str | None = None) -> DataFrame:
    """(row_id, n) of each left row: the right rows within eps of it, or the sum of their ``weight``. No pairs are written."""
    kind = left.schema["row_id"].dataType.simpleString()

    def run(rows: pa.Table, others: pa.Table) -> pa.Table:
        w = None if weight is None else others[weight].to_numpy()
        return pa.table({"row_id": rows["row_id"], "n": pa.array(counts_within(vectors_of(rows["x"]), vectors_of(others["x"]), eps, w), pa.int64())})

    found = eps_blocks(left.select("row_id", "x"), right.select("row_id", "x", *([weight] if weight else [])), eps, run, f"row_id {kind}, n long").groupBy("row_id").agg(F.sum("n").alias("n"))
    return left.select("row_id").join(found, "row_id", "left").select("row_id", F.coalesce("n", F.lit(0)).alias("n"))
