"""Entry points: cluster, predict, validate, explore and the accessors."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kindred.functions.expr import argmin, signif
from kindred.functions.preprocess import check_input, check_numeric, feature_type, feature_types, fit_encoder, fit_scaler
from kindred.operators import embed, metrics
from kindred.operators.distance import vectors
from kindred.operators.methods import SAMPLE, ClusterFit, DataInfo, fit_dbscan, fit_gmm, fit_kmeans_grid, fit_pam, fit_prototypes, fit_tree, means_of, means_round, mixed_frame, nearest, predict_dbscan, runs_from, sampled, softmax, starts_among
from kindred.operators.order import ranked

METHODS = ("kmeans", "pam", "hclust", "agnes", "dbscan", "gmm", "kproto", "kmm")
MIXED = ("kproto", "kmm")
ALIASES = {"iter.max": "iter_max", "minPts": "min_pts", "lambda": "lam", "missing": "missing_rule"}


def _method(name: str) -> str:
    own = name.lower() if isinstance(name, str) else ""
    if own not in METHODS:
        raise ValueError(f"method must be one of {', '.join(METHODS)}")
    return own


def _check_k(k) -> int:
    if k is None or isinstance(k, bool) or int(k) != k or k < 2:
        raise ValueError("`k` must be a whole number of at least 2")
    return int(k)


def is_distance(df: DataFrame) -> bool:
    return set(df.columns) == {"i", "j", "d"}


def cluster(df: DataFrame, method: str = "kmeans", k: int | None = None, *, id_col: str = "row_id", features: list[str] | None = None, scale: bool = False, center: bool = True, seed: int | None = None, **options) -> ClusterFit:
    """Fits one of METHODS. A table (i, j, d) is a distance input, for hclust and agnes only."""
    method = _method(method)
    if seed is not None and (isinstance(seed, bool) or not isinstance(seed, int)):
        raise ValueError("`seed` must be a single whole number")
    options = {ALIASES.get(o, o): v for o, v in options.items()}
    if method != "dbscan":
        k = _check_k(k)
    if is_distance(df):
        if method not in ("hclust", "agnes"):
            raise ValueError("a distance input is for hclust and agnes only")
        info = DataInfo(0, "i", (), "dist", None, df)
        return fit_tree(method, df, info, k, options.pop("linkage", "complete" if method == "hclust" else "average"), **options)
    features = features or [c for c in df.columns if c != id_col]
    if method in MIXED:
        n = check_input(df, id_col, features)
        types = feature_types(df, features)
        if k > n:
            raise ValueError("`k` cannot exceed the number of observations")
        numeric = [f for f in features if types[f] == "numeric"]
        own_scale = options.pop("scale_numeric", True) if method == "kmm" else scale
        source = df
        if method == "kproto":  # values are imputed before fitting, categories get a level of their own
            encoder = fit_encoder(df, id_col, features, False, False)
            source = df.select(id_col, *(F.coalesce(F.when(F.isnan(F.col(f).cast("double")), None).otherwise(F.col(f).cast("double")), F.lit(encoder.medians[f])).alias(f) if types[f] == "numeric" else F.coalesce(F.col(f).cast("string"), F.lit("missing")).alias(f) for f in features))
        scaler = fit_scaler(source, numeric, center or own_scale, own_scale) if numeric and (center or own_scale) else None
        info = DataInfo(n, id_col, tuple(features), "mixed", scaler, df, types, encoder if method == "kproto" else None)
        return fit_prototypes(method, mixed_frame(source, id_col, types, scaler), info, k, seed, restore=method == "kmm", **options)
    if method == "kmeans":
        return cluster_grid(df, [k], id_col=id_col, features=features, scale=scale, center=center, seeds=[seed], **options)[0]
    n = check_numeric(df, id_col, features)
    if k is not None and k > n and method in ("kmeans", "pam", "gmm"):
        raise ValueError("`k` cannot exceed the number of observations")
    scaler = fit_scaler(df, features, center or scale, scale)
    info = DataInfo(n, id_col, tuple(features), "matrix", scaler, df, {f: "numeric" for f in features})
    x = vectors(scaler.apply(df, [id_col]), id_col, features)
    if method == "pam":
        return fit_pam(x, info, k, seed, **options)
    if method == "gmm":
        return fit_gmm(x, info, k, seed, **options)
    if method == "dbscan":
        return fit_dbscan(x, info, options.pop("eps", None), options.pop("min_pts", None), **options)
    return fit_tree(method, x, info, k, options.pop("linkage", "complete" if method == "hclust" else "average"), **options)


def cluster_grid(df: DataFrame, ks: list[int], *, id_col: str = "row_id", features: list[str] | None = None, scale: bool = False, center: bool = True, seeds: list[int | None] | None = None, **options) -> list[ClusterFit]:
    """A k-means fit for each k, all of them and all their starts in one pass a round."""
    features = features or [c for c in df.columns if c != id_col]
    n = check_numeric(df, id_col, features)
    if max(ks) > n:
        raise ValueError("`k` cannot exceed the number of observations")
    scaler = fit_scaler(df, features, center or scale, scale)
    info = DataInfo(n, id_col, tuple(features), "matrix", scaler, df, {f: "numeric" for f in features})
    return fit_kmeans_grid(vectors(scaler.apply(df, [id_col]), id_col, features), info, ks, seeds or [None] * len(ks), **options)


@dataclass(frozen=True)
class ClusterPrediction:
    clusters: DataFrame
    membership: DataFrame | None
    distances: DataFrame | None
    method: str
    prediction_type: str


def feature_columns(fit: ClusterFit, override: dict[str, Column] | None = None) -> dict[str, Column]:
    """Preprocessed columns by feature, of a table that has the features by name."""
    info, out = fit.info, {}
    for f in info.features:
        c = (override or {}).get(f, F.col(f))
        if info.types[f] == "numeric":
            c = c.cast("double")
            c = F.when(F.isnan(c), None).otherwise(c)
            if info.encoder:
                c = F.coalesce(c, F.lit(info.encoder.medians[f]))
            out[f] = info.scaler.column(f, c) if info.scaler and f in info.scaler.features else c
        else:
            c = c.cast("string")
            out[f] = F.coalesce(c, F.lit("missing")) if info.encoder else c
    return out


def check_new(fit: ClusterFit, new: DataFrame) -> None:
    gone = [f for f in fit.info.features if f not in new.columns]
    if gone:
        raise ValueError(f"missing columns: {', '.join(gone)}")


def cluster_expr(fit: ClusterFit, cols: dict[str, Column]) -> Column:
    """The cluster of a row as one expression; not for dbscan or distance fits."""
    if fit.log_density:
        logs = fit.log_density(cols)
        return F.array_position(logs, F.array_max(logs)).cast("int")
    if fit.distances is None:
        raise ValueError(f"a {fit.method} fit on distances has no rule for new rows")
    return argmin(fit.distances(cols))


def predict(fit: ClusterFit, new: DataFrame, id_col: str | None = None) -> ClusterPrediction:
    """Assigns new rows by name; works on a stream for all methods but dbscan."""
    check_new(fit, new)
    id_col = id_col or fit.info.id_col
    kinds = {"kmeans": "nearest_centroid", "hclust": "nearest_centroid", "agnes": "nearest_centroid", "pam": "nearest_prototype", "kproto": "nearest_prototype", "kmm": "native", "gmm": "native", "dbscan": "nearest_non_noise"}
    cols = feature_columns(fit)
    if fit.method == "dbscan":
        placed = predict_dbscan(fit, new.select(F.col(id_col).alias("row_id"), F.array(*cols.values()).alias("x")))
        return ClusterPrediction(placed.select("row_id", "cluster"), None, placed.select("row_id", "distance"), fit.method, kinds[fit.method])
    labels = new.select(F.col(id_col).alias("row_id"), cluster_expr(fit, cols).alias("cluster"))
    member = new.select(F.col(id_col).alias("row_id"), softmax(fit.log_density(cols)).alias("membership")) if fit.log_density else None
    dist = new.select(F.col(id_col).alias("row_id"), fit.distances(cols).alias("distances")) if fit.distances else None
    return ClusterPrediction(labels, member, dist, fit.method, kinds[fit.method])


# -- accessors ------------------------------------------------------------------------------------


def clusters(fit) -> DataFrame:
    return fit.clusters if hasattr(fit, "clusters") else fit.final_clusters


def membership(fit: ClusterFit) -> DataFrame | None:
    return fit.membership


def _rounded(v):
    return float(f"{v:.4g}") if isinstance(v, float) else v


def centers(fit: ClusterFit, rounded: bool = True) -> list[dict] | None:
    if fit.centers is None:
        return None
    return [{"cluster": f"cluster_{g}", **{f: (_rounded(v) if rounded else v) for f, v in zip(fit.info.features, c, strict=True)}} for g, c in enumerate(fit.centers, 1)]


def prototypes(fit: ClusterFit, rounded: bool = True) -> list[dict] | None:
    if fit.prototypes is None:
        return None
    return [{k: (_rounded(v) if rounded else v) for k, v in p.items()} for p in fit.prototypes]


def sizes(fit) -> DataFrame:
    return metrics.sizes(clusters(fit))


def n_clusters(fit) -> int:
    return fit.n_clusters if hasattr(fit, "n_clusters") else fit.final_k


def method_used(fit) -> str:
    return fit.method


# -- validation -----------------------------------------------------------------------------------


@dataclass(frozen=True)
class ClusterValidation:
    metrics_table: DataFrame
    per_cluster_table: DataFrame | None
    settings: dict[str, Any]
    object_type: str
    extras: dict[str, Any] = field(default_factory=dict)

    def rounded(self, digits: int = 4) -> DataFrame:
        return self.metrics_table.withColumn("value", signif(F.col("value"), digits))


INTERNAL = {"calinski_harabasz": metrics.calinski_harabasz, "davies_bouldin": metrics.davies_bouldin, "total_within": metrics.total_within}
EXTERNAL = {"ari": metrics.adjusted_rand_index, "nmi": metrics.normalized_mutual_information}


def original_vectors(info: DataInfo) -> DataFrame:
    """Metrics are taken on the original data; mixed data imputed and one-hot encoded, not standardised."""
    if info.input_type == "dist":
        raise ValueError("a fit on distances alone can't be validated; its data are needed")
    if info.input_type == "mixed":
        encoder = fit_encoder(info.data, info.id_col, list(info.features), False, False)
        return vectors(encoder.apply(info.data, info.id_col), info.id_col, list(encoder.columns))
    return vectors(info.data, info.id_col, list(info.features))


def _label_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("row_id", F.col("cluster").alias("a")).join(b.select("row_id", F.col("cluster").alias("b")), "row_id")


def validate(obj, *, truth: DataFrame | None = None, metrics_wanted: list[str] | None = None, n_boot: int = 10, k: list[int] | None = None, method: str = "kmeans", silhouette: str = "auto", silhouette_rows: int = 100_000, **options) -> ClusterValidation:
    """Of a fit, or of raw data over a grid of k. ``truth`` is a table (row_id, cluster). Only wanted
    metrics are computed; bootstrap refits (kmeans, pam, gmm) only where bootstrap_ari is wanted or
    metrics_wanted is not given and n_boot is positive. ``silhouette`` is exact (quadratic), estimate, or auto: exact
    for at most ``silhouette_rows`` rows. settings say which it was, and extras what the estimate may be wrong by."""
    options |= {"silhouette": silhouette, "silhouette_rows": silhouette_rows} if isinstance(obj, DataFrame) else {}
    if isinstance(obj, DataFrame):
        grid = sorted(set(k or range(2, 7)))
        if not grid or grid[0] < 2:
            raise ValueError("`k` must hold whole numbers of at least 2")
        own = {ALIASES.get(o, o): v for o, v in options.items() if o not in ("seed", "silhouette", "silhouette_rows")}
        fits = cluster_grid(obj, grid, seeds=[options.get("seed")] * len(grid), **own) if _method(method) == "kmeans" else [cluster(obj, method, value, seed=options.get("seed"), **own) for value in grid]
        tables = []
        for value, fit in zip(grid, fits, strict=True):
            one = validate(fit, truth=truth, metrics_wanted=metrics_wanted, n_boot=n_boot, **{o: options[o] for o in ("silhouette", "silhouette_rows") if o in options})
            tables.append(one.metrics_table.withColumn("k", F.lit(value)))
        out = tables[0]
        for t in tables[1:]:
            out = out.unionByName(t)
        return ClusterValidation(out, None, {"k": grid, "method": method}, "grid")
    fit, consensus = obj, not isinstance(obj, ClusterFit)
    labels = clusters(fit)
    labelled = original_vectors(fit.info).join(labels, "row_id")
    wanted = lambda m: metrics_wanted is None or m in metrics_wanted
    rows: list[tuple[str, float | None]] = []
    per, extras = None, {"selection_summary": fit.selection_summary} if consensus else {}
    number = lambda row: None if row is None or row[0] is None else float(row[0])
    if wanted("silhouette"):
        if silhouette not in ("auto", "exact", "estimate"):
            raise ValueError("silhouette must be auto, exact or estimate")
        if silhouette == "auto":
            silhouette = "exact" if labelled.limit(silhouette_rows + 1).count() <= silhouette_rows else "estimate"
        widths = (metrics.silhouette_rows(labelled) if silhouette == "exact" else metrics.silhouette_estimates(labelled)).persist()
        rows.append(("silhouette", number(widths.agg(F.avg("width")).first())))
        if silhouette == "estimate":
            extras["silhouette_error"] = number(widths.agg(F.avg("error")).first())
        per = labels.sparkSession.createDataFrame(widths.groupBy("cluster").agg(F.avg("width").alias("silhouette")).collect(), f"cluster {labels.schema['cluster'].dataType.simpleString()}, silhouette double")
        widths.unpersist()
    for name, make in INTERNAL.items():
        if wanted(name) and not (consensus and name == "total_within"):
            rows.append((name, number(make(labelled).first())))
    if truth is not None:
        pairs = _label_pairs(labels, truth)
        rows += [(name, number(make(pairs).first())) for name, make in EXTERNAL.items() if wanted(name)]
    if not consensus and wanted("bootstrap_ari") and n_boot > 0 and fit.method in ("kmeans", "pam", "gmm"):
        extras["stability"] = bootstrap_ari(fit, n_boot)
        rows.append(("bootstrap_ari", extras["stability"][0]))
    if consensus and fit.stability_summary is not None and wanted("pairwise_partition_agreement"):
        rows.append(("pairwise_partition_agreement", fit.stability_summary.first().mean_ppa))
    # rows that are appended to the internal metrics have no scale and direction
    known = [(m, v, *(metrics.METRICS[m] if m == "silhouette" or m in INTERNAL else (None, None))) for m, v in rows]
    table = labels.sparkSession.createDataFrame(known, "metric string, value double, scale string, direction string")
    settings = {"method": fit.method, "n_boot": n_boot, "metrics": metrics_wanted, "silhouette": silhouette if wanted("silhouette") else None}
    return ClusterValidation(table, per, settings, "metacluster_fit" if consensus else "cluster_fit", extras)


def _draws(n: int, repeat) -> tuple:
    """(draw, place) of the ids of spark.range(n): n draws of places 0 to n - 1 with replacement, by an md5 of draw and repeat."""
    u = F.conv(F.substring(F.md5(F.concat_ws(":", F.col("id").cast("string"), repeat.cast("string"))), 1, 13), 16, 10).cast("long")
    return F.col("id").alias("draw"), F.least(F.floor(u / F.lit(16.0**13) * n), F.lit(n - 1)).cast("long").alias("place")


def draws_of(spark, n: int, repeat: int) -> DataFrame:
    return spark.range(n).select(*_draws(n, F.lit(repeat)))


def bootstrap_kmeans(fit: ClusterFit, placed: DataFrame, columns: list[str], n_boot: int, seed: int, nstart: int = 10, iter_max: int = 100, starts: list[list[list[float]]] | None = None) -> list[float]:
    """The agreement of each refit: rows carry how often each resample draws them, all resamples and their starts are one
    pass a round, and one aggregate counts the labels of all of them. ``starts`` are in the units of the fit's rows."""
    info, n, k, p = fit.info, fit.info.n_obs, fit.params["k"], len(columns)
    drawn = placed.sparkSession.range(n).select("id", F.explode(F.sequence(F.lit(0), F.lit(n_boot - 1))).alias("b"))
    drawn = drawn.select("b", _draws(n, F.col("b") + seed * 1000)[1]).groupBy("place", "b").agg(F.count("*").cast("double").alias("n"))
    often = drawn.groupBy("place").agg(F.map_from_entries(F.collect_list(F.struct("b", "n"))).alias("m"))
    weights = F.transform(F.sequence(F.lit(0), F.lit(n_boot - 1)), lambda b: F.coalesce(F.element_at("m", b), F.lit(0.0)))
    data = placed.join(often, "place").select("row_id", F.array(*(F.col(c).cast("double") for c in columns)).alias("x"), weights.alias("w")).persist()
    try:
        scales: list = [None] * n_boot
        if info.scaler is not None and info.scaler.sd:
            means = data.agg(*(F.avg(F.get("x", F.lit(f))).alias(f"m{f}") for f in range(p))).first()
            term = lambda b, f, e: F.sum(F.get("w", F.lit(b)) * F.pow(F.get("x", F.lit(f)) - F.lit(float(means[f])), e))
            sums = data.agg(*(term(b, f, e).alias(f"s{b}_{f}_{e}") for b in range(n_boot) for f in range(p) for e in (1, 2))).first()
            sd = lambda b, f: ((sums[f"s{b}_{f}_2"] - sums[f"s{b}_{f}_1"] ** 2 / n) / max(1, n - 1)) ** 0.5
            scales = [tuple(sd(b, f) or 1.0 for f in range(p)) for b in range(n_boot)]
        part = [] if starts else sampled(data, max(SAMPLE, 4 * k), seed, ("x", "w"))
        runs, of = [], []
        for b in range(n_boot):
            own = starts or starts_among(np.repeat(np.array([r.x for r in part], float), np.array([r.w[b] for r in part], int), axis=0) / (scales[b] or 1.0), k, seed, nstart)
            runs += runs_from(own, sample=b, scale=scales[b])
            of += [b] * len(own)
        means_of(data, runs, iter_max)
        costs = {s: found[2] for s, found in means_round(data, dict(enumerate(runs))).items()}
        best = [min((costs[s], s) for s in range(len(runs)) if of[s] == b)[1] for b in range(n_boot)]
        divided = lambda by: F.array(*(F.get("x", F.lit(f)) / F.lit(by[f]) for f in range(p))) if by else F.col("x")
        to = [nearest(divided(scales[b]), runs[s].centers) for b, s in enumerate(best)]
        both = data.join(fit.clusters.select("row_id", F.col("cluster").alias("a")), "row_id").select("a", F.posexplode(F.arrays_zip(F.array(*to).alias("c"), F.col("w").alias("w"))).alias("b", "z"))
        counts = both.where("z.w > 0").groupBy("b", "a", F.col("z")["c"].alias("c")).agg(F.sum(F.col("z")["w"]).alias("n")).collect()
    finally:
        data.unpersist()
    return [metrics.ari_of_counts([(r.a, r.c, r.n) for r in counts if r.b == b]) for b in range(n_boot)]


def bootstrap_ari(fit: ClusterFit, n_boot: int = 10, seed: int = 1, refit=None, **options) -> tuple[float, float]:
    """Mean and standard deviation of the ARI of refits on resamples of the same size. Places are those of the
    rows in the order of their ids, and every draw counts; a row drawn more than once has its last label.
    ``refit`` takes a resample (draw_id, features) to its labels (row_id, cluster); without it the fit's method
    and preprocessing do, k-means for all resamples at once (options as there)."""
    info, values = fit.info, []
    names = {f: f"f{i}" for i, f in enumerate(info.features)}
    numbered = info.data.select(F.col(f"`{info.id_col}`").alias("row_id"), *(F.col(f"`{f}`").alias(c) for f, c in names.items()))
    placed, n = ranked(numbered, ["row_id"]), info.n_obs
    again = refit or (lambda sample: cluster(sample, fit.method, fit.params["k"], id_col="draw_id", features=list(names.values()), scale=bool(info.scaler and info.scaler.sd), center=True, seed=seed).clusters)
    if refit is None and fit.method == "kmeans":
        values, n_serial = bootstrap_kmeans(fit, placed, list(names.values()), n_boot, seed, **options), 0
    else:
        n_serial = n_boot
    for b in range(n_serial):
        drawn = draws_of(placed.sparkSession, n, seed * 1000 + b).join(placed, "place").persist()
        found = again(drawn.select(F.col("draw").alias("draw_id"), *names.values())).select(F.col("row_id").alias("draw"), "cluster")
        last = found.join(drawn.select("draw", "row_id"), "draw").groupBy("row_id").agg(F.max_by("cluster", "draw").alias("b"))
        pairs = drawn.select("row_id").join(last, "row_id").join(fit.clusters.select("row_id", F.col("cluster").alias("a")), "row_id")
        values.append(float(metrics.adjusted_rand_index(pairs.select("a", "b")).first()[0]))
        drawn.unpersist()
    mean = sum(values) / n_boot
    return mean, (sum((v - mean) ** 2 for v in values) / max(1, n_boot - 1)) ** 0.5


# -- exploration ----------------------------------------------------------------------------------


@dataclass(frozen=True)
class ClusterExplore:
    size_table: DataFrame
    feature_summary: DataFrame | None
    separation_table: DataFrame | None
    prototype_table: list[dict] | None
    embedding: DataFrame
    embedding_method: str
    embedding_labels: tuple[str, str]
    embedding_fit: dict[str, Any]


def explore(fit, embedding: str = "auto", data: DataFrame | None = None) -> ClusterExplore:
    """Sizes, profiles, separation and an embedding; of ``data`` (the same rows by id, any columns) in place of the fit's own."""
    labels = clusters(fit)
    info = fit.info
    protos = (prototypes(fit) or centers(fit)) if isinstance(fit, ClusterFit) else None
    if data is None and info.input_type == "dist" or data is not None and is_distance(data):
        points, names, extra = embed.mds_of_pairs(info.data if data is None else data)
        return ClusterExplore(metrics.sizes(labels), None, None, protos, points.join(labels, "row_id"), "mds", names, extra)
    features = list(info.features) if data is None else [c for c in data.columns if c != info.id_col]
    data = info.data if data is None else data
    if set(feature_types(data, features).values()) != {"numeric"} and any(feature_type(data.schema[f].dataType) != "numeric" for f in features):
        encoder = fit_encoder(data, info.id_col, features)
        table, columns = encoder.apply(data, info.id_col), list(encoder.columns)
    else:
        table, columns = data.select(info.id_col, *features), features
    joined = table.withColumnRenamed(info.id_col, "row_id").join(labels.withColumnRenamed("cluster", "cluster of the row"), "row_id")
    points, method, names, extra = embed.embed(data, info.id_col, features, embedding)
    of = "cluster of the row"
    return ClusterExplore(metrics.sizes(labels), metrics.feature_summary(joined, columns, of), metrics.separation(joined, columns, of), protos, points.join(labels, "row_id"), method, names, extra)


# -- printing -------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Summary:
    """What summary tells of a fit, by name."""

    kind: str
    values: dict[str, Any]


def summary(obj):
    """Of a fit a Summary; other results are their own summary."""
    if isinstance(obj, ClusterFit):
        values = {"method": obj.method, "n_obs": obj.info.n_obs, "n_clusters": obj.n_clusters, "sizes": _size_list(obj), "has_centers": obj.centers is not None, "has_prototypes": obj.prototypes is not None}
        return Summary("Cluster fit summary", values)
    if hasattr(obj, "candidate_table"):
        values = {"methods": _methods(obj), "candidate_fits": obj.candidate_table.count(), "final_k": obj.final_k, "sizes": _size_list(obj), "selection_summary": obj.selection_summary}
        return Summary("Meta-cluster summary", values)
    return obj


def _size_list(fit) -> dict:
    return {r["cluster"]: r["size"] for r in sizes(fit).orderBy("cluster").collect()}


def _methods(fit) -> list[str]:
    return list(dict.fromkeys(r["method"] for r in fit.candidate_table.orderBy("candidate").collect()))


def describe(obj) -> str:
    """The text of a result, as print shows it."""
    lines: list[tuple[str, Any]] = []
    if isinstance(obj, Summary):
        v = obj.values
        counts = ", ".join(f"{k}={n}" for k, n in v["sizes"].items())
        lines = [("Method", v["method"]), ("Observations", v["n_obs"]), ("Clusters", v["n_clusters"])] if "method" in v else [("Methods", ", ".join(v["methods"])), ("Candidate fits", v["candidate_fits"]), ("Final clusters", v["final_k"])]
        return "\n".join([obj.kind, *(f"  {k}: {x}" for k, x in [*lines, ("Sizes", counts)])])
    name = {"ClusterFit": "cluster_fit", "MetaclusterFit": "metacluster_fit", "ClusterValidation": "cluster_validation", "ClusterExplore": "cluster_explore", "ClusterPrediction": "cluster_prediction"}.get(type(obj).__name__)
    name = name or re.sub(r"(?<=[a-z])(?=[A-Z])", "_", type(obj).__name__).lower()
    if isinstance(obj, ClusterFit):
        lines = [("Method", obj.method), ("Observations", obj.info.n_obs), ("Clusters", obj.n_clusters)]
    elif hasattr(obj, "candidate_table"):
        lines = [("Methods", ", ".join(_methods(obj))), ("Candidate fits", obj.candidate_table.count()), ("Final clusters", obj.final_k)]
    elif isinstance(obj, ClusterValidation):
        rows = obj.rounded().collect()
        columns = [c for c in ("metric", "value", "scale", "direction", "k") if c in obj.metrics_table.columns]
        cells = [columns, *([f"{r[c]:.15g}" if isinstance(r[c], float) else str(r[c]) for c in columns] for r in rows)]
        wide = [max(len(row[i]) for row in cells) for i in range(len(columns))]
        return "\n".join([f"<{name}>", f"  Object type: {obj.object_type}", f"  Metrics: {len(rows)}", *(" " + " ".join(c.rjust(w) for c, w in zip(row, wide, strict=True)) for row in cells)])
    elif isinstance(obj, ClusterExplore):
        lines = [("Feature summary", "unavailable")] if obj.feature_summary is None else [("Rows in feature summary", obj.feature_summary.count())]
    elif isinstance(obj, ClusterPrediction):
        lines = [("Method", obj.method), ("Predictions", obj.clusters.count())]
    elif hasattr(obj, "summary"):
        lines = [("Metric", obj.settings["metric"]), ("Features", obj.summary.count()), ("Repeats", obj.settings["n_repeats"])]
    elif hasattr(obj, "profiles"):
        lines = [("Target", obj.settings["target"]), ("Profiles", obj.profiles.count())]
    elif hasattr(obj, "explanations"):
        lines = [("Target", obj.settings["target"]), ("Observations", obj.explanations.select("observation").distinct().count()), ("Effects", obj.explanations.count())]
    return "\n".join([f"<{name}>", *(f"  {k}: {v}" for k, v in lines)])
