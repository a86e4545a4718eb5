"""Exact k-medoids of any number of rows: the greedy build and the best swap, a pass over all pairs of rows each.

In a pass a task takes a block of candidates and a block of rows and gives back, of each candidate, its gains
summed over the rows: one number while medoids are being added, k of them (one a medoid that it may replace)
when they are swapped. The latter come from one distance a pair: with a row's nearest and second nearest medoid
known, the change of its cost is the same for all medoids but its own. Equal vectors are one candidate and one
weighted row, so passes are quadratic in the different vectors, results linear; nothing is sampled.

One column needs no passes: what a candidate takes over are the values between the middles to the medoids beside it,
so its change follows from sums along the order of the values (``line_medoids``). At most MOST_VALUES of them are on the
driver; beyond, passes are made.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.operators.partition import distances_to, vectors_of

BLOCK_ROWS, MOST_VALUES = 8192, 1_000_000


def swap_gains(d: np.ndarray, own: np.ndarray, least: np.ndarray, second: np.ndarray, k: int, weight: np.ndarray) -> np.ndarray:
    """(rows of d) x k: how the cost changes over the weighted columns of d where the candidate replaces medoid m."""
    shared = np.minimum(d - least, 0)
    instead = np.minimum(d, second) - least - shared
    out = np.zeros((len(d), k))
    for m in range(k):
        out[:, m] = instead[:, own == m] @ weight[own == m]
    return out + (shared @ weight)[:, None]


def line_medoids(v: np.ndarray, weight: np.ndarray, k: int) -> tuple[list[int], float]:
    """Places of k medoids among the different values v, at most as many as there are, and the cost. Of equal changes (but for
    rounding) the first medoid and the first value are taken."""
    n, order = len(v), np.argsort(v, kind="stable")
    y, w = v[order], weight[order].astype(np.longdouble)
    mass, total = (np.concatenate([[0], np.cumsum(c)]) for c in (w, w * y))
    after = np.argsort(order) + 1

    def above(m, lo, hi):
        """The distances to m, summed over places lo to hi - 1, of values that are not below it."""
        return total[hi] - total[lo] - m * (mass[hi] - mass[lo])

    def ends(kept: np.ndarray) -> np.ndarray:
        return np.concatenate([[0], np.searchsorted(y, (kept[:-1] + kept[1:]) / 2, "right"), [n]])

    def cost(kept: np.ndarray) -> np.longdouble:
        if not len(kept):
            return np.longdouble(0)
        end, at = ends(kept), np.searchsorted(y, kept, "right")
        return (above(kept, at, end[1:]) - above(kept, end[:-1], at)).sum()

    def gains(kept: np.ndarray, begin: int = 0, end: int = n) -> np.ndarray:
        """How the cost changes where the values of places begin to end - 1 are added to ``kept``, which is in order."""
        c, own = y[begin:end], np.arange(begin + 1, end + 1)
        lo, hi, taken = np.zeros(len(c), int), np.full(len(c), n), 0
        if len(kept):
            place = np.searchsorted(kept, c, "right")
            mid = ends(kept)[place]
            left, right = kept[np.maximum(place - 1, 0)], kept[np.minimum(place, len(kept) - 1)]
            lo = np.where(place > 0, np.searchsorted(y, (left + c) / 2, "right"), 0)
            hi = np.where(place < len(kept), np.searchsorted(y, (c + right) / 2, "right"), n)
            mid = np.clip(mid, lo, hi)
            taken = above(left, lo, mid) - above(right, mid, hi)
        return above(c, own, hi) - above(c, lo, own) - taken

    def least(found: np.ndarray, now: float) -> int:
        return int(np.flatnonzero(found <= found.min() + 1e-12 * max(1.0, now))[0])

    chosen, now = [], 0.0
    while len(chosen) < min(k, n):
        found = (now + gains(np.sort(v[chosen])))[after - 1]
        found[chosen] = np.inf
        at = least(found, now)
        chosen, now = [*chosen, at], float(found[at])
    while len(chosen) < n:
        kept = np.sort(v[chosen])
        shared, places, best = gains(kept), np.searchsorted(y, kept), []
        for m in chosen:
            # only values between the medoids beside the one that goes gain otherwise than with it
            at, rest = int(np.searchsorted(kept, v[m])), kept[kept != v[m]]
            begin, end = 0 if at == 0 else int(places[at - 1]), n if at == k - 1 else int(places[at + 1]) + 1
            found = shared.copy()
            found[begin:end] = gains(rest, begin, end)
            found = (found + cost(rest))[after - 1]
            found[chosen] = np.inf
            best.append((least(found, now), found))
        m = least(np.array([found[at] for at, found in best]), now)
        at, found = best[m]
        if found[at] - now >= -1e-12 * max(1.0, now):
            break
        chosen[m], now = at, float(found[at])
    return chosen, now


def _pass(x: DataFrame, medoids: np.ndarray, adding: bool, blocks: int) -> DataFrame:
    """(row_id, x, m, change) of the best m of each candidate; without medoids the change is its sum of distances."""
    kind, k = x.schema["row_id"].dataType.simpleString(), max(1, 0 if adding else len(medoids))
    own, every = F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = x.select("row_id", "x", own.alias("one"), every.alias("two"))
    right = x.select(F.col("x").alias("y"), "n", every.alias("one"), own.alias("two"))

    def run(rows: pa.Table, others: pa.Table) -> pa.Table:
        out = np.zeros((rows.num_rows, k))
        if rows.num_rows and others.num_rows:
            c, y, weight = vectors_of(rows["x"]), vectors_of(others["y"]), others["n"].to_numpy().astype(float)
            near = np.sort(distances_to(y, medoids), axis=1) if len(medoids) else np.zeros((len(y), 0))
            nearest = distances_to(y, medoids).argmin(axis=1) if len(medoids) else np.zeros(len(y), int)
            second = near[:, 1] if near.shape[1] > 1 else np.full(len(y), np.inf)
            for lo in range(0, len(c), 128):
                d = distances_to(c[lo : lo + 128], y)
                if not len(medoids):
                    out[lo : lo + 128, 0] = d @ weight
                elif adding:
                    out[lo : lo + 128, 0] = np.minimum(d - near[:, 0], 0) @ weight
                else:
                    out[lo : lo + 128] = swap_gains(d, nearest, near[:, 0], second, k, weight)
        again = pa.array(np.repeat(np.arange(rows.num_rows), k))
        return pa.table({"row_id": rows["row_id"].take(again), "m": pa.array(np.tile(np.arange(k), rows.num_rows), pa.int32()), "change": pa.array(out.ravel(), pa.float64())})

    found = left.groupBy("one", "two").cogroup(right.groupBy("one", "two")).applyInArrow(run, f"row_id {kind}, m int, change double")
    return found.groupBy("row_id", "m").agg(F.sum("change").alias("change"))


def k_medoids(x: DataFrame, k: int, block_rows: int = BLOCK_ROWS, most_values: int = MOST_VALUES) -> tuple[list, np.ndarray, float]:
    """Ids and vectors of the medoids of (row_id, x), by id, and the cost. Of equal changes the first medoid and the least id
    are taken; where there are fewer than k different vectors, the least other rows make up for them."""
    data = x.groupBy("x").agg(F.min("row_id").alias("row_id"), F.count("*").alias("n")).persist()
    try:
        count, width = data.agg(F.count("*"), F.max(F.size("x"))).first()
        if width == 1 and count <= most_values:
            found = data.orderBy("row_id").select("row_id", F.get("x", F.lit(0)).alias("v"), "n").toArrow()
            at, cost = line_medoids(found["v"].to_numpy(), found["n"].to_numpy(), k)
            ids, points = found["row_id"].take(pa.array(at)).to_pylist(), found["v"].to_numpy()[at][:, None]
        else:
            ids, points, cost = _by_passes(data, count, k, block_rows)
    finally:
        data.unpersist()
    if len(ids) < k:
        more = x.where(~F.col("row_id").isin(ids)).orderBy("row_id").limit(k - len(ids)).collect()
        ids, points = [*ids, *(r.row_id for r in more)], np.vstack([points, *(np.array(r.x, float) for r in more)])
    order = sorted(range(k), key=ids.__getitem__)
    return [ids[i] for i in order], points[order], cost


def _by_passes(data: DataFrame, count: int, k: int, block_rows: int) -> tuple[list, np.ndarray, float]:
    """Of (row_id, x, n), different vectors with their numbers of rows."""
    blocks = max(1, -(-count // block_rows))
    ids, points = [], np.zeros((0, 0))

    def best(adding: bool) -> tuple:
        found = _pass(data, points, adding, blocks).where(~F.col("row_id").isin(ids) if ids else F.lit(True))
        r = found.agg(F.min(F.struct("change", "m", "row_id")).alias("b")).first().b
        return r.change, r.m, r.row_id, np.array(data.where(F.col("row_id") == F.lit(r.row_id)).first().x, float)

    cost = 0.0
    for i in range(min(k, count)):
        change, _, row_id, v = best(True)
        cost += change
        ids, points = [*ids, row_id], np.vstack([points, v]) if i else v[None]
    while count > k:
        change, m, row_id, v = best(False)
        if change >= -1e-12 * max(1.0, cost):
            break
        cost += change
        ids[m], points[m] = row_id, v
    return ids, points, cost
