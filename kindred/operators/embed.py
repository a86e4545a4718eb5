"""Two-dimensional embeddings. Moments come from one aggregate; eigenproblems of the features' size are
solved on the driver; rows are projected by literal expressions."""

from __future__ import annotations

from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.functions.preprocess import feature_types, fit_encoder, fit_scaler, make_name
from kindred.operators import kernels
from kindred.operators.distance import MOST_ROWS
from kindred.operators.methods import square_form
from kindred.operators.spectral import correspondence, scaling_of_pairs, signed

DENSE_LEVELS, MOST_LEVELS = 1_000, 500_000


def covariance(df: DataFrame, columns: list[str], population: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Means and covariance matrix. Products are summed about the means in Arrow batches, a matrix for a task,
    and the matrices of the tasks by an aggregate."""
    p = len(columns)
    row = df.agg(F.count("*"), *(F.avg(f"`{c}`") for c in columns)).first()
    n, mean = row[0], np.array([v or 0.0 for v in row[1:]])
    out = moments(df, columns, mean)
    return mean, out.reshape(p, p) / max(1, n if population else n - 1)


def moments(df: DataFrame, columns: list[str], about: np.ndarray) -> np.ndarray:
    """The sums of products of all pairs of columns, less ``about``."""
    p = len(columns)

    def run(batches):
        total = np.zeros((p, p))
        for batch in batches:
            x = np.column_stack([np.asarray(c.to_numpy(zero_copy_only=False), float) for c in batch.columns]) - about
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(range(p)), pa.array(total.tolist(), pa.list_(pa.float64()))], ["i", "v"])

    parts = df.select(*(F.col(f"`{c}`").cast("double").alias(f"c{i}") for i, c in enumerate(columns))).mapInArrow(run, "i long, v array<double>")
    out = np.zeros((p, p))
    for r in parts.select("i", F.posexplode("v").alias("j", "v")).groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r.i, r.j] = r.v
    return out


def project(df: DataFrame, id_col: str, columns: list[str], mean: np.ndarray, loadings: np.ndarray) -> DataFrame:
    """(row_id, x, y); y is 0 where there is one component."""
    dims = []
    for k in range(2):
        total = F.lit(0.0)
        if k < loadings.shape[1]:
            for i, c in enumerate(columns):
                total = total + (F.col(f"`{c}`") - F.lit(float(mean[i]))) * F.lit(float(loadings[i, k]))
        dims.append(total)
    return df.select(F.col(id_col).alias("row_id"), dims[0].alias("x"), dims[1].alias("y"))


def _axes(values: np.ndarray, prefix: str) -> tuple[str, str]:
    share = values / values.sum() * 100 if values.sum() > 0 else np.zeros(len(values))
    return tuple(f"{prefix}{k + 1} ({share[k] if k < len(share) else 0:.1f}%)" for k in range(2))


def pca(df: DataFrame, id_col: str, columns: list[str], scale: bool = True):
    """Centred, scaled by sample deviations; columns without variance are left out."""
    scaler = fit_scaler(df, columns, True, True)
    used = [c for i, c in enumerate(columns) if scaler.sd[i] > 0] if scale else list(columns)
    if not used:
        raise ValueError("no column has variance")
    table = fit_scaler(df, used, True, scale).apply(df, [id_col])
    mean, cov = covariance(table, used)
    values, loadings = kernels.eigen(cov)
    norm2 = table.select(F.col(id_col).alias("row_id"), sum((F.pow(F.col(f"`{c}`") - F.lit(float(m)), 2) for c, m in zip(used, mean, strict=True)), F.lit(0.0)).alias("norm2"))
    return project(table, id_col, used, mean, loadings[:, :2]), _axes(values, "PC"), {"columns": used, "sdev": np.sqrt(values), "rotation": loadings, "mean": scaler.mean, "kind": "pca", "norm2": norm2}


def mds(df: DataFrame, id_col: str, columns: list[str]):
    """Of Euclidean distances: the scores of centred, unscaled principal components."""
    points, names, extra = pca(df, id_col, columns, scale=False)
    return points, ("MDS1", "MDS2"), extra | {"kind": "mds"}


def mds_of_pairs(pairs: DataFrame, max_exact_rows: int = MOST_ROWS, iterated: bool = False):
    """With a matrix on the driver for at most max_exact_rows rows, beyond (or where ``iterated``) by passes over the table."""
    kind = pairs.schema["i"].dataType.simpleString()
    few = not iterated and pairs.select("i").union(pairs.select("j")).distinct().limit(max_exact_rows + 1).count() <= max_exact_rows
    if few:
        ids, d = square_form(pairs, max_exact_rows)
        xy = kernels.classical_mds(d)
    else:
        ids, xy = scaling_of_pairs(pairs)
    points = pairs.sparkSession.createDataFrame([(i, float(a), float(b)) for i, (a, b) in zip(ids, xy, strict=True)], f"row_id {kind}, x double, y double")
    return points, ("MDS1", "MDS2"), {"kind": "mds"}


def _indicators(df: DataFrame, id_col: str, features: list[str]):
    encoder = fit_encoder(df, id_col, features, False, False)
    return encoder, encoder.apply(df, id_col)


def famd(df: DataFrame, id_col: str, features: list[str]):
    """Numeric columns by population deviation, indicators over the root of their share, centred."""
    types = feature_types(df, features)
    if len(set(types.values())) < 2:
        raise ValueError("famd needs numeric and categorical columns")
    encoder, table = _indicators(df, id_col, features)
    columns = list(encoder.columns)
    numeric = {f for f, t in types.items() if t == "numeric"}
    mean, cov = covariance(table, columns, population=True)
    weight = np.array([(np.sqrt(cov[i, i]) if c in numeric else np.sqrt(mean[i])) for i, c in enumerate(columns)])
    keep = [i for i in range(len(columns)) if weight[i] > 0 and cov[i, i] > 0]
    w = 1 / weight[keep]
    values, loadings = kernels.eigen(cov[np.ix_(keep, keep)] * w[:, None] * w[None, :])
    used = [columns[i] for i in keep]
    points = project(table, id_col, used, mean[keep], loadings[:, :2] * w[:, None])
    return points, _axes(values, "Dim"), {"kind": "famd", "columns": used, "eig": values}


def burt(df: DataFrame, id_col: str, features: list[str]) -> tuple[list[str], np.ndarray, int]:
    """Joint counts of the levels of all pairs of features."""
    encoder, _ = _indicators(df, id_col, features)
    columns = list(encoder.columns)
    place = {(i, level): columns.index(f"{f}_{make_name(level)}") for i, f in enumerate(features) for level in encoder.levels[f]}
    own = F.array(*(F.struct(F.lit(i).alias("f"), F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("missing")).alias("v")) for i, f in enumerate(features)))
    pairs = df.select(own.alias("own")).select("own", F.explode("own").alias("a")).select("a", F.explode("own").alias("b"))
    out = np.zeros((len(columns), len(columns)))
    for r in pairs.groupBy("a", "b").agg(F.count("*").alias("n")).collect():  # a row for two levels that meet
        out[place[r.a.f, r.a.v], place[r.b.f, r.b.v]] = r.n
    return columns, out, df.count()


def mca_wide(df: DataFrame, id_col: str, features: list[str], axes: int = 2, most_levels: int = MOST_LEVELS):
    """mca() for many levels: the first ``axes`` only, by passes over the rows. A level is one row on the driver, at most most_levels."""
    q, n = len(features), df.count()
    text = [F.coalesce(F.col(f"`{f}`").cast("string"), F.lit("missing")) for f in features]
    each = df.select(F.explode(F.array(*(F.struct(F.lit(i).alias("f"), t.alias("v")) for i, t in enumerate(text)))).alias("c"))
    found = each.groupBy("c.f", "c.v").agg(F.count("*").alias("n")).orderBy("f", "v").limit(most_levels + 1).collect()
    if len(found) > most_levels:
        raise ValueError(f"more than {most_levels} levels (most_levels)")
    levels, counts = [(r.f, r.v) for r in found], np.array([r.n for r in found], float)
    mass = counts / (n * q)
    axes = max(1, min(axes, len(levels) - q))
    values, vectors = correspondence(df, features, levels, counts, n, axes)
    lam = np.maximum(values[:axes], 0)
    coord = signed(vectors[:, :axes]) / np.sqrt(mass)[:, None] * np.sqrt(lam)
    scale = np.where(lam > 0, 1 / np.sqrt(np.maximum(lam, 1e-300)), 0) / q
    table = {key: (float(c[0] * scale[0]), float(c[1] * scale[1]) if axes > 1 else 0.0, float(1 / (q * q * m))) for key, c, m in zip(levels, coord, mass, strict=True)}
    shared, kind = df.sparkSession.sparkContext.broadcast(table), df.schema[id_col].dataType.simpleString()

    def run(batches):
        for batch in batches:
            at = [[shared.value[i, x] for x in batch.column(i + 1).to_pylist()] for i in range(q)]
            total = np.array(at, float).reshape(q, -1, 3).sum(axis=0)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(total[:, c] - (c == 2)) for c in range(3))], ["row_id", "x", "y", "norm2"])

    placed = df.select(F.col(f"`{id_col}`").alias("row_id"), *(t.alias(f"c{i}") for i, t in enumerate(text))).mapInArrow(run, f"row_id {kind}, x double, y double, norm2 double")
    # all axes together: of a level its squared distance to the center, of the table the total inertia
    dist2, inertia = np.maximum(1 / (mass * q) - 1, 1e-300), len(levels) / q - 1
    share = lam / inertia * 100 if inertia > 0 else lam * 0
    names = tuple(f"Dim{k + 1} ({share[k] if k < len(share) else 0:.1f}%)" for k in range(2))
    columns = [f"{features[i]}_{make_name(v)}" for i, v in levels]
    extra = {"kind": "mca", "columns": columns, "eig": lam, "var_coord": coord, "contrib": 100 * mass[:, None] * coord**2 / np.maximum(lam, 1e-300), "cos2": coord**2 / dist2[:, None], "norm2": placed.select("row_id", "norm2")}
    return placed.select("row_id", "x", "y"), names, extra


def mca(df: DataFrame, id_col: str, features: list[str], dense_levels: int = DENSE_LEVELS):
    """Correspondence analysis of the indicator matrix, from the Burt table; of more than ``dense_levels`` levels by mca_wide()."""
    types = feature_types(df, features)
    if "numeric" in types.values():
        raise ValueError("mca needs categorical columns only")
    if df.agg(sum((F.countDistinct(F.col(f"`{f}`")) for f in features), F.lit(0))).first()[0] > dense_levels:
        return mca_wide(df, id_col, features)
    columns, table, n = burt(df, id_col, features)
    q = len(features)
    mass = np.diag(table) / (n * q)
    s = table / (n * q * q) / np.sqrt(mass[:, None] * mass[None, :]) - np.sqrt(mass[:, None] * mass[None, :])
    values, vectors = kernels.eigen(s)
    lam = values[: max(1, len(columns) - q)]
    coord = vectors[:, : len(lam)] / np.sqrt(mass)[:, None] * np.sqrt(lam)
    _, indicators = _indicators(df, id_col, features)
    scale = np.where(lam > 0, 1 / np.sqrt(np.maximum(lam, 1e-300)), 0)
    points = project(indicators, id_col, columns, np.zeros(len(columns)), coord[:, :2] * scale[:2] / q)
    contrib = 100 * mass[:, None] * coord**2 / np.maximum(lam, 1e-300)
    dist2 = (coord**2).sum(axis=1, keepdims=True)
    # a row's squared distance to the center
    far = sum((F.col(f"`{c}`") * F.lit(float(1 / (q * q * m))) for c, m in zip(columns, mass, strict=True)), F.lit(-1.0))
    norm2 = indicators.select(F.col(id_col).alias("row_id"), far.alias("norm2"))
    return points, _axes(lam, "Dim"), {"kind": "mca", "columns": columns, "eig": lam, "var_coord": coord, "contrib": contrib, "cos2": coord**2 / np.maximum(dist2, 1e-300), "norm2": norm2}


def embed(df: DataFrame, id_col: str, features: list[str], method: str = "auto"):
    """(points, method, axis names, fit); auto takes pca for numeric, mca for categorical, famd for mixed columns."""
    types = feature_types(df, features)
    kinds = {"numeric" if t == "numeric" else "categorical" for t in types.values()}
    if method == "auto":
        method = "famd" if len(kinds) == 2 else "pca" if kinds == {"numeric"} else "mca"
    if method in ("pca", "mds") and kinds != {"numeric"}:
        encoder, df = _indicators(df, id_col, features)
        features = list(encoder.columns)
    makers: dict[str, Any] = {"pca": pca, "mds": mds, "famd": famd, "mca": mca}
    if method not in makers:
        raise ValueError(f"unknown embedding {method}")
    points, names, extra = makers[method](df, id_col, features)
    return points, method, names, extra


def biplot(extra: dict[str, Any], top_n: int | None = None) -> list[dict]:
    """Variables with coordinates and contribution (percent, of the two axes weighed by their eigenvalues), largest first."""
    if extra["kind"] not in ("pca", "mca"):
        raise ValueError("a biplot is for pca and mca only")
    wide = lambda m: np.pad(m[:, :2], ((0, 0), (0, max(0, 2 - m.shape[1]))))
    if extra["kind"] == "pca":
        eig = extra["sdev"] ** 2
        coord = wide(extra["rotation"] * extra["sdev"])
        share = coord**2 * 100 / np.maximum((coord**2).sum(axis=0), 1e-300)
    else:
        eig, coord, share = extra["eig"], wide(extra["var_coord"]), wide(extra["contrib"])
    weight = np.pad(eig[:2], (0, max(0, 2 - len(eig))))
    contribution = share @ weight / max(weight.sum(), 1e-300)
    rows = [{"variable": v, "x": float(c[0]), "y": float(c[1]), "contribution": float(t)} for v, c, t in zip(extra["columns"], coord, contribution, strict=True)]
    rows.sort(key=lambda r: (-r["contribution"], r["variable"]))
    return rows[:top_n] if top_n else rows
