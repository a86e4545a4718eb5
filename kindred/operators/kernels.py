"""Exact in-memory kernels for inputs of a checked number of rows: agglomeration, k-medoids, silhouettes."""

from __future__ import annotations

import heapq

import numpy as np

LINKAGES = ("complete", "single", "average", "ward.D", "ward.D2", "mcquitty", "median", "centroid")


def distances(x: np.ndarray) -> np.ndarray:
    sq = (x * x).sum(axis=1)
    d = np.sqrt(np.maximum(sq[:, None] + sq[None, :] - 2 * x @ x.T, 0))
    np.fill_diagonal(d, 0)
    return d


def agglomerate(d: np.ndarray, linkage: str, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(merge, height, size) by Lance and Williams' updates; negative numbers are leaves (1-based),
    positive ones earlier steps. Ties go to the pair of the least leaves."""
    if linkage not in LINKAGES:
        raise ValueError(f"unknown linkage {linkage}")
    n = len(d)
    d = d.astype(float).copy()
    if linkage == "ward.D2":
        d = d * d
    np.fill_diagonal(d, np.inf)
    size = np.ones(n) if weights is None else weights.astype(float).copy()
    name = -np.arange(1, n + 1)
    alive = np.ones(n, bool)
    nearest, least = d.argmin(axis=1), d.min(axis=1)
    merge, height, counts = np.zeros((n - 1, 2), int), np.zeros(n - 1), np.zeros(n - 1, int)
    members = np.ones(n, int)
    for step in range(n - 1):
        i = int(np.argmin(np.where(alive, least, np.inf)))
        j = int(nearest[i])
        i, j = min(i, j), max(i, j)
        dij, ni, nj = d[i, j], size[i], size[j]
        di, dj, nk = d[i], d[j], size
        if linkage == "single":
            new = np.minimum(di, dj)
        elif linkage == "complete":
            new = np.maximum(di, dj)
        elif linkage == "average":
            new = (ni * di + nj * dj) / (ni + nj)
        elif linkage == "mcquitty":
            new = (di + dj) / 2
        elif linkage == "median":
            new = (di + dj) / 2 - dij / 4
        elif linkage == "centroid":
            new = (ni * di + nj * dj) / (ni + nj) - ni * nj * dij / (ni + nj) ** 2
        else:
            new = ((ni + nk) * di + (nj + nk) * dj - nk * dij) / (ni + nj + nk)
        merge[step] = sorted((name[i], name[j])) if (name[i] < 0) == (name[j] < 0) else sorted((name[i], name[j]), key=lambda v: v > 0)
        height[step] = np.sqrt(dij) if linkage == "ward.D2" else dij
        members[i] += members[j]
        counts[step] = members[i]
        alive[j] = False
        new = np.where(alive, new, np.inf)
        new[i] = np.inf
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        size[i], name[i] = ni + nj, step + 1
        nearest[i], least[i] = new.argmin(), new.min()
        closer = alive & (new < least)
        nearest[closer], least[closer] = i, new[closer]
        for r in np.flatnonzero(alive & ((nearest == i) | (nearest == j)) & ~closer):
            if r != i:
                nearest[r], least[r] = d[r].argmin(), d[r].min()
        least[j] = np.inf
    return merge, height, counts


def agglomerate_line(x: np.ndarray, weights: np.ndarray, linkage: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """agglomerate() of one column by complete or average linkage, without distances: clusters are intervals and only
    neighbours merge. Linear in memory; a row of x counts for ``weights`` equal rows."""
    n = len(x)
    order = np.lexsort((np.arange(n), x)).tolist()
    low, high = x[order].tolist(), x[order].tolist()
    w = weights[order].astype(float).tolist()
    total, leaf, name, stamp = [v * m for v, m in zip(low, w, strict=True)], list(order), [-i - 1 for i in order], [0] * n
    left, right = list(range(-1, n - 1)), [*range(1, n), -1]

    def entry(a: int, b: int) -> tuple:
        h = high[b] - low[a] if linkage == "complete" else total[b] / w[b] - total[a] / w[a]
        return (max(h, 0.0), min(leaf[a], leaf[b]), max(leaf[a], leaf[b]), a, b, stamp[a], stamp[b])

    heap = [entry(i, i + 1) for i in range(n - 1)]
    heapq.heapify(heap)
    merge, height, size = np.zeros((max(n - 1, 0), 2), int), np.zeros(max(n - 1, 0)), np.zeros(max(n - 1, 0), int)
    step = 0
    while heap:
        h, _, _, a, b, one, two = heapq.heappop(heap)
        if stamp[a] != one or stamp[b] != two:
            continue
        pair = (name[a], name[b])
        merge[step] = sorted(pair) if (pair[0] < 0) == (pair[1] < 0) else sorted(pair, key=lambda v: v > 0)
        high[a], total[a], w[a], leaf[a] = high[b], total[a] + total[b], w[a] + w[b], min(leaf[a], leaf[b])
        height[step], size[step], name[a] = max(h, height[step - 1] if step else 0.0), round(w[a]), step + 1
        stamp[a], stamp[b], right[a] = stamp[a] + 1, -1, right[b]
        if right[a] >= 0:
            left[right[a]] = a
            heapq.heappush(heap, entry(a, right[a]))
        if left[a] >= 0:
            heapq.heappush(heap, entry(left[a], a))
        step += 1
    return merge, height, size


def cut(merge: np.ndarray, n: int, k: int) -> np.ndarray:
    """k clusters, numbered by first appearance in row order. Steps are taken as listed."""
    root, of = list(range(n)), [0] * len(merge)

    def find(a: int) -> int:
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    for step in range(max(0, n - k)):
        a, b = (find(-v - 1 if v < 0 else of[v - 1]) for v in merge[step].tolist())
        of[step] = root[max(a, b)] = min(a, b)
    seen: dict[int, int] = {}
    return np.array([seen.setdefault(find(v), len(seen) + 1) for v in range(n)])


def agglomerative_coefficient(merge: np.ndarray, height: np.ndarray) -> float:
    top = height[-1]
    first = [h for row, h in zip(merge, height, strict=True) for v in row if v < 0]
    return float(np.mean([1 - h / top for h in first])) if top else 0.0


def leaf_order(merge: np.ndarray) -> list[int]:
    """Leaves from left to right, 1-based."""
    out, stack = [], [len(merge)]
    while stack:
        v = stack.pop()
        if v < 0:
            out.append(-v)
        else:
            stack += [int(x) for x in merge[v - 1][::-1]]
    return out


def k_medoids(d: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Medoids (sorted row numbers) by the greedy build and the best swap until none improves."""
    n = len(d)
    chosen = [int(d.sum(axis=1).argmin())]
    near = d[chosen[0]].copy()
    while len(chosen) < k:
        gain = np.maximum(near[None, :] - d, 0).sum(axis=1)
        gain[chosen] = -1
        chosen.append(int(gain.argmax()))
        near = np.minimum(near, d[chosen[-1]])
    while True:
        rows = d[chosen]
        order = rows.argsort(axis=0, kind="stable")
        first, least = order[0], np.take_along_axis(rows, order[:1], 0)[0]
        second = np.take_along_axis(rows, order[1:2], 0)[0] if k > 1 else np.full(n, np.inf)
        best = (-1e-12, None)
        for m in range(k):
            base = np.where(first == m, second, least)
            change = np.minimum(d, base[None, :]).sum(axis=1) - least.sum()
            change[chosen] = 0
            h = int(change.argmin())
            if change[h] < best[0]:
                best = (change[h], (m, h))
        if best[1] is None:
            return np.array(sorted(chosen)), float(least.sum())
        chosen[best[1][0]] = best[1][1]


def silhouette(d: np.ndarray, labels: np.ndarray, weights: np.ndarray | None = None) -> float:
    """Mean width; a point of weight w stands for w rows at distance 0 of one another."""
    w = np.ones(len(d)) if weights is None else weights.astype(float)
    ids = np.unique(labels)
    if len(ids) < 2:
        return float("nan")
    mass = np.array([w[labels == g].sum() for g in ids])
    sums = np.stack([(d[:, labels == g] * w[labels == g]).sum(axis=1) for g in ids], axis=1)
    own = np.searchsorted(ids, labels)
    at = np.arange(len(d))
    inner = mass[own] - 1
    a = np.where(inner > 0, sums[at, own] / np.maximum(inner, 1e-300), 0)
    other = sums / mass
    other[at, own] = np.inf
    b = other.min(axis=1)
    top = np.maximum(a, b)
    s = np.where((inner > 0) & (top > 0), (b - a) / np.where(top > 0, top, 1), 0)
    return float((s * w).sum() / w.sum())


def eigen(cov: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues in descending order and loadings, each signed so that its largest entry (the first of equal ones) is positive."""
    values, vectors = np.linalg.eigh(cov)
    values, vectors = np.maximum(values[::-1], 0), vectors[:, ::-1]
    size = np.abs(vectors)
    sign = np.sign(vectors[(size > size.max(axis=0, initial=0) - 1e-9).argmax(axis=0), np.arange(vectors.shape[1])])
    return values, vectors * np.where(sign == 0, 1, sign)


def classical_mds(d: np.ndarray, k: int = 2) -> np.ndarray:
    n = len(d)
    j = np.eye(n) - 1 / n
    values, vectors = eigen(-0.5 * j @ (d * d) @ j)
    out = vectors[:, :k] * np.sqrt(values[:k])
    return np.pad(out, ((0, 0), (0, max(0, k - out.shape[1]))))
