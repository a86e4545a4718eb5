"""Summaries and validation metrics of a labelled table.

Internal metrics take a (row_id, x, cluster) table; external ones a (row_id, a, b) table, of which
only the contingency table leaves the partial aggregates.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kindred.functions.expr import array_distance
from kindred.functions.quantile import medians
from kindred.operators.distance import MOST_TASKS
from kindred.operators.partition import squares, vectors_of


def sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("cluster").agg(F.count("*").alias("size"))


def long_form(labelled: DataFrame) -> DataFrame:
    """(row_id, cluster, feature, value): a row for each entry of x, features numbered from 0."""
    return labelled.select("row_id", "cluster", F.posexplode("x").alias("feature", "value"))


def centroids(labelled: DataFrame) -> DataFrame:
    """(cluster, n, center)."""
    means = long_form(labelled).groupBy("cluster", "feature").agg(F.avg("value").alias("m"), F.count("*").alias("n"))
    ordered = means.groupBy("cluster").agg(F.max("n").alias("n"), F.sort_array(F.collect_list(F.struct("feature", "m"))).alias("c"))
    return ordered.select("cluster", "n", F.col("c.m").alias("center"))


def feature_summary(df: DataFrame, features: list[str], cluster_col: str = "cluster") -> DataFrame:
    """(cluster, feature, mean, sd, median, min, max)."""
    tall = df.select(F.col(cluster_col).alias("cluster"), *(F.col(f"`{f}`").cast("double").alias(f) for f in features)).unpivot(["cluster"], [f"`{f}`" for f in features], "feature", "value")
    plain = tall.groupBy("cluster", "feature").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"), F.min("value").alias("min"), F.max("value").alias("max"))
    return plain.join(medians(tall, ["cluster", "feature"], "value"), ["cluster", "feature"], "left").select("cluster", "feature", "mean", "sd", "median", "min", "max")


def separation(df: DataFrame, features: list[str], cluster_col: str = "cluster") -> DataFrame:
    """(feature, separation): the share of a feature's variance that lies between clusters; NaN without variance."""
    tall = df.select(F.col(cluster_col).alias("cluster"), *(F.col(f"`{f}`").cast("double").alias(f) for f in features)).unpivot(["cluster"], [f"`{f}`" for f in features], "feature", "value")
    by = tall.groupBy("cluster", "feature").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    whole = by.groupBy("feature").agg(F.sum("n").alias("n"), (F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    parts = by.join(whole.select("feature", "mean"), "feature").groupBy("feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"))
    total = F.col("b") + F.col("w")
    return parts.select("feature", F.when(total > 0, F.col("b") / total).otherwise(F.lit(float("nan"))).alias("separation"))


def _spread(labelled: DataFrame) -> DataFrame:
    """(cluster, feature, n, m, v)."""
    return long_form(labelled).groupBy("cluster", "feature").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))


def total_within(labelled: DataFrame) -> DataFrame:
    return _spread(labelled).agg(F.sum(F.col("n") * F.col("v")).alias("total_within"))


def calinski_harabasz(labelled: DataFrame) -> DataFrame:
    by = _spread(labelled)
    grand = by.groupBy("feature").agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("mean"))
    row = by.join(grand, "feature").agg(F.sum(F.col("n") * F.pow(F.col("m") - F.col("mean"), 2)).alias("b"), F.sum(F.col("n") * F.col("v")).alias("w"), F.countDistinct("cluster").alias("k"), F.sum(F.when(F.col("feature") == 0, F.col("n"))).alias("n"))
    return row.select(F.when((F.col("k") > 1) & (F.col("w") > 0), (F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("n") - F.col("k")))).alias("calinski_harabasz"))


def davies_bouldin(labelled: DataFrame, most_values: int = 1 << 24) -> DataFrame:
    """Null with fewer than two clusters. The table of centers, most_values numbers at most, is sent to all tasks."""
    centers = centroids(labelled)
    scatter = labelled.join(centers.select("cluster", "center"), "cluster").groupBy("cluster").agg(F.avg(array_distance(F.col("x"), F.col("center"))).alias("s"), F.first("center").alias("center"))
    rows = scatter.collect()
    if sum(len(r.center) for r in rows) > most_values:
        raise ValueError("the centers of all clusters are more than most_values numbers")
    spark = labelled.sparkSession
    s, m = np.array([r.s for r in rows]), np.array([r.center for r in rows], float).reshape(len(rows), -1)
    shared = spark.sparkContext.broadcast((s, m))

    def run(batches):
        s, m = shared.value
        for batch in batches:
            own, out = batch.column(0).to_numpy(), []
            for i in own.tolist():
                d = np.zeros(len(m))
                for f in range(m.shape[1]):
                    d += (m[:, f] - m[i, f]) ** 2
                with np.errstate(divide="ignore", invalid="ignore"):
                    ratio = (s + s[i]) / np.sqrt(d)
                out.append(np.delete(ratio, i).max() if len(m) > 1 else None)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.float64())], ["r"])

    return spark.range(len(rows)).mapInArrow(run, "r double").agg(F.avg("r").alias("davies_bouldin"))


def silhouette_rows(labelled: DataFrame, block_rows: int | None = None) -> DataFrame:
    """(row_id, cluster, neighbour, width) by plain Euclidean distances; a cluster of one has width 0.

    Exact at any size, and quadratic in the rows: they are dealt by hash to blocks of about ``block_rows`` (a
    sixteenth of the rows, 1,024 at least and 16,384 at most, for each block is sent to all others),
    a task takes two blocks and gives back each row's sums of distances to the clusters of the other."""
    n = labelled.count()
    blocks = max(1, -(-n // (block_rows or min(16_384, max(1024, n // 16)))))
    own, every = F.pmod(F.xxhash64("row_id"), F.lit(blocks)).cast("int"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    left = labelled.select("row_id", "cluster", "x", own.alias("one"), every.alias("two"))
    right = labelled.select(*(F.col(c).alias(c) for c in ("row_id", "cluster", "x")), every.alias("one"), own.alias("two"))
    kinds = {c: labelled.schema[c].dataType.simpleString() for c in ("row_id", "cluster")}

    def sums(rows: pa.Table, others: pa.Table) -> pa.Table:
        groups, of = np.unique(others["cluster"].to_numpy(zero_copy_only=False), return_inverse=True)
        order = np.argsort(of, kind="stable")
        starts = np.searchsorted(of[order], np.arange(len(groups)))
        x, y = (vectors_of(t["x"]) for t in (rows, others))
        y, parts = y[order], []
        for at in range(0, len(x), 256):
            d = squares(x[at : at + 256], y)
            parts.append(np.add.reduceat(np.sqrt(d, out=d), starts, axis=1) if len(groups) else np.zeros((len(d), 0)))
        total = np.concatenate(parts) if parts else np.zeros((0, len(groups)))
        again = np.repeat(np.arange(len(x)), len(groups))
        return pa.table({"row_id": rows["row_id"].take(again), "cluster": rows["cluster"].take(again), "g": pa.array(np.tile(groups, len(x)), rows.schema.field("cluster").type), "s": pa.array(total.ravel()), "n": pa.array(np.tile(np.bincount(of, minlength=len(groups)), len(x)), pa.int64())})

    tasks = min(MOST_TASKS, blocks * blocks)
    left, right = (t.repartition(tasks, "one", "two") for t in (left, right))  # small tables too are dealt to all cores
    found = left.groupBy("one", "two").cogroup(right.groupBy("one", "two")).applyInArrow(sums, f"row_id {kinds['row_id']}, cluster {kinds['cluster']}, g {kinds['cluster']}, s double, n long")
    # a row's distance to itself is nought and not counted
    rest = F.sum("n") - F.when(F.col("g") == F.col("cluster"), 1).otherwise(0)
    means = found.groupBy("row_id", "cluster", "g").agg(F.sum("s").alias("s"), rest.alias("n")).where("n > 0")
    return widths(means.select("row_id", "cluster", "g", (F.col("s") / F.col("n")).alias("d")), labelled)


def silhouette_estimates(labelled: DataFrame, per_cluster: int = 512, seed: int = 1, sigmas: float = 3.0, most_values: int = 1 << 24) -> DataFrame:
    """(row_id, cluster, neighbour, width, error): silhouettes by distances to a seeded sample of each cluster, linear in the rows.

    Of a cluster at most ``per_cluster`` rows are taken, the first by a hash; so a cluster that is smaller counts whole.
    error bounds what a width may be off by: the mean distances of a and b stray by at most ``sigmas`` standard errors (of a
    sample without replacement), and a width changes by no more than both, over the greater of a and b. The
    mean width is off by at most the mean error. The sample is sent to all tasks: ``most_values`` numbers at most."""
    sizes = {r.cluster: r.n for r in labelled.groupBy("cluster").agg(F.count("*").alias("n")).collect()}
    p = (labelled.select(F.size("x")).first() or [0])[0]
    if len(sizes) * per_cluster * max(1, p) > most_values:
        raise ValueError(f"samples of {per_cluster} rows of {len(sizes)} clusters are more than most_values numbers")
    spark, kind = labelled.sparkSession, labelled.schema["cluster"].dataType.simpleString()
    groups = sorted(sizes, key=lambda c: (c is not None, c))
    place = F.pmod(F.xxhash64("row_id", F.lit(seed)), F.lit(1 << 30))
    rates = spark.createDataFrame([(g, min(1 << 30, int((1 << 30) * (2 * per_cluster + 64) / sizes[g]))) for g in groups], f"cluster {kind}, rate long")
    drawn: dict = {g: [] for g in groups}
    for r in labelled.select("row_id", "cluster", "x", place.alias("place")).join(F.broadcast(rates), "cluster").where("place < rate").collect():  # about 2 * per_cluster a cluster
        drawn[r.cluster].append((r.place, r.row_id, r.x))
    samples = [(np.array([x for *_, x in own], float).reshape(-1, p), {i for _, i, _ in own}) for own in (sorted(drawn[g], key=lambda r: r[:2])[:per_cluster] for g in groups)]
    shared = spark.sparkContext.broadcast(samples)
    number, totals = {g: i for i, g in enumerate(groups)}, np.array([sizes[g] for g in groups], float)
    names = labelled.columns

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, own = (batch.column(names.index(c)).to_pylist() for c in ("row_id", "cluster"))
            x, mine = np.array(batch.column(names.index("x")).to_pylist(), float).reshape(len(ids), -1), np.array([number[c] for c in own])
            mean, error = np.full((len(ids), len(groups)), np.inf), np.zeros((len(ids), len(groups)))
            for g, (y, inside) in enumerate(shared.value):
                for lo in range(0, len(x), 256):
                    part = slice(lo, lo + 256)
                    d = np.zeros((len(x[part]), len(y)))
                    for f in range(p):
                        d += (x[part, f, None] - y[None, :, f]) ** 2
                    d = np.sqrt(d)
                    self_ = np.array([i in inside for i in ids[part]]) & (mine[part] == g)
                    m, n = len(y) - self_, totals[g] - (mine[part] == g)
                    with np.errstate(invalid="ignore", divide="ignore"):
                        at = d.sum(axis=1) / m
                        spread = np.maximum((d * d).sum(axis=1) / m - at * at, 0) * m / np.maximum(m - 1, 1)
                        left = np.where(n > 1, np.maximum(n - m, 0) / np.maximum(n - 1, 1), 0)
                    mean[part, g], error[part, g] = np.where(m > 0, at, np.inf), np.where(m > 0, sigmas * np.sqrt(spread / np.maximum(m, 1) * left), 0)
            rows = np.arange(len(ids))
            a, ea = mean[rows, mine].copy(), error[rows, mine].copy()
            mean[rows, mine], error[rows, mine] = np.inf, 0
            near = mean.argmin(axis=1)
            b, eb = mean[rows, near], error.max(axis=1)
            alone, top = ~np.isfinite(a), np.maximum(np.where(np.isfinite(a), a, 0), b)
            width = np.where(alone | (top == 0), 0, (b - np.where(alone, 0, a)) / np.where(top > 0, top, 1))
            off = np.where(alone | (top == 0), 0, (ea + eb) / np.where(top > 0, top, 1))
            no = ~np.isfinite(b)
            yield pa.RecordBatch.from_arrays(
                [batch.column(names.index("row_id")), batch.column(names.index("cluster")), pa.array([groups[g] for g in near], batch.column(names.index("cluster")).type, mask=no), pa.array(width, mask=no), pa.array(np.minimum(off, 2.0), mask=no)],
                ["row_id", "cluster", "neighbour", "width", "error"],
            )

    return labelled.mapInArrow(run, f"row_id {labelled.schema['row_id'].dataType.simpleString()}, cluster {kind}, neighbour {kind}, width double, error double")


def widths(sums: DataFrame, labelled: DataFrame) -> DataFrame:
    """Silhouettes from mean distances (row_id, cluster, g, d) to each cluster, own row left out."""
    own = F.col("g") == F.col("cluster")
    both = sums.groupBy("row_id", "cluster").agg(F.min(F.when(own, F.col("d"))).alias("a"), F.min(F.when(~own, F.struct("d", "g"))).alias("o"))
    every = labelled.select("row_id", "cluster").join(both, ["row_id", "cluster"], "left")
    b = F.col("o.d")
    width = F.when(b.isNull(), None).when(F.col("a").isNull() | (F.greatest("a", b) == 0), 0.0).otherwise((b - F.col("a")) / F.greatest("a", b))
    return every.select("row_id", "cluster", F.col("o.g").alias("neighbour"), width.alias("width"))


def silhouette(labelled: DataFrame, **options) -> DataFrame:
    return silhouette_rows(labelled, **options).agg(F.avg("width").alias("silhouette"))


def silhouette_per_cluster(labelled: DataFrame, **options) -> DataFrame:
    return silhouette_rows(labelled, **options).groupBy("cluster").agg(F.avg("width").alias("silhouette"))


def contingency(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("a", "b").agg(F.count("*").alias("n"))


def _margins(pairs: DataFrame) -> DataFrame:
    """One row: n, and for cells and either margin the sums of squares, of pairs and of n log n."""
    cells = contingency(pairs)
    tables = (("ab", cells), ("a", cells.groupBy("a").agg(F.sum("n").alias("n"))), ("b", cells.groupBy("b").agg(F.sum("n").alias("n"))))
    out = None
    for name, t in tables:
        n = F.col("n").cast("double")
        row = t.agg(F.sum(n).alias(f"n_{name}"), F.sum(n * n).alias(f"sq_{name}"), F.sum(n * (n - 1) / 2).alias(f"ch_{name}"), F.sum(n * F.log(n)).alias(f"nl_{name}"))
        out = row if out is None else out.join(row)
    return out


def adjusted_rand_index(pairs: DataFrame) -> DataFrame:
    """NaN where both partitions are trivial."""
    expected = F.col("ch_a") * F.col("ch_b") / (F.col("n_ab") * (F.col("n_ab") - 1) / 2)
    top, bottom = F.col("ch_ab") - expected, (F.col("ch_a") + F.col("ch_b")) / 2 - expected
    return _margins(pairs).select(F.when(bottom == 0, F.lit(float("nan"))).otherwise(top / bottom).alias("ari"))


def ari_of_counts(cells: list[tuple]) -> float:
    """Of the cells (a, b, n) of a contingency table; NaN where both partitions are trivial."""
    pairs = lambda counts: sum(n * (n - 1) / 2 for n in counts)
    rows: dict = {}
    columns: dict = {}
    for a, b, n in cells:
        rows[a], columns[b] = rows.get(a, 0.0) + n, columns.get(b, 0.0) + n
    total, i, p, q = sum(rows.values()), pairs(n for *_, n in cells), pairs(rows.values()), pairs(columns.values())
    expected = p * q / (total * (total - 1) / 2)
    bottom = (p + q) / 2 - expected
    return (i - expected) / bottom if bottom else float("nan")


def normalized_mutual_information(pairs: DataFrame) -> DataFrame:
    """Natural logarithm, normalised by the geometric mean of the entropies; NaN where one is 0."""
    n = F.col("n_ab")
    ha, hb = F.log(n) - F.col("nl_a") / n, F.log(n) - F.col("nl_b") / n
    mutual = F.log(n) + (F.col("nl_ab") - F.col("nl_a") - F.col("nl_b")) / n
    return _margins(pairs).select(F.when((ha <= 0) | (hb <= 0), F.lit(float("nan"))).otherwise(mutual / F.sqrt(ha * hb)).alias("nmi"))


def partition_agreement(pairs: DataFrame) -> DataFrame:
    """Share of the n * n ordered pairs on which two partitions agree, from the contingency table."""
    n = F.col("n_ab")
    return _margins(pairs).select(((n * n - F.col("sq_a") - F.col("sq_b") + 2 * F.col("sq_ab")) / (n * n)).alias("ppa"))


def ensemble_stability(labels: DataFrame) -> DataFrame:
    """(mean_ppa, min_ppa, max_ppa) over the unordered pairs of candidates of (candidate, row_id, cluster)."""
    a = labels.select("row_id", F.col("candidate").alias("c1"), F.col("cluster").alias("u"))
    b = labels.select("row_id", F.col("candidate").alias("c2"), F.col("cluster").alias("v"))
    cells = a.join(b, "row_id").where("c1 < c2").groupBy("c1", "c2", "u", "v").agg(F.count("*").cast("double").alias("n"))
    square = lambda keys: cells.groupBy("c1", "c2", *keys).agg(F.sum("n").alias("n")).groupBy("c1", "c2").agg(F.sum(F.col("n") * F.col("n")).alias("q"), F.sum("n").alias("t"))
    ab, ua, vb = square(["u", "v"]), square(["u"]).select("c1", "c2", F.col("q").alias("qa")), square(["v"]).select("c1", "c2", F.col("q").alias("qb"))
    ppa = (F.col("t") * F.col("t") - F.col("qa") - F.col("qb") + 2 * F.col("q")) / (F.col("t") * F.col("t"))
    return ab.join(ua, ["c1", "c2"]).join(vb, ["c1", "c2"]).select(ppa.alias("p")).agg(F.avg("p").alias("mean_ppa"), F.min("p").alias("min_ppa"), F.max("p").alias("max_ppa"))


# Scale and direction of each metric.
METRICS = {
    "silhouette": ("-1 to 1", "higher is better"),
    "bootstrap_ari": ("0 to 1", "higher is better"),
    "davies_bouldin": ("positive, unbounded", "lower is better"),
    "total_within": ("positive, unbounded", "lower is better"),
    "calinski_harabasz": ("positive, unbounded", "higher is better"),
}


def rank_effects(effects: DataFrame, top_n: int | None = None) -> DataFrame:
    """Adds rank by absolute effect within each observation, of equal ones by ``at`` (the place of the feature,
    which goes) or by feature; with top_n, keeps as many."""
    tie = "at" if "at" in effects.columns else "feature"
    ranked = effects.withColumn("rank", F.row_number().over(Window.partitionBy("observation").orderBy(F.desc(F.abs("estimate")), tie))).drop("at")
    return ranked.where(F.col("rank") <= top_n) if top_n else ranked
