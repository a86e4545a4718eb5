"""Queries of the clustering operators, each with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kindred.functions.expr import signif
from kindred.functions.preprocess import feature_types, fit_encoder, fit_scaler
from kindred.operators import api, consensus, embed, explain, metrics, plotspec
from kindred.operators.distance import euclidean_pairs, mixed_distance, vectors
from kindred.operators.graph import connected, ensure_checkpoint_dir
from kindred.operators.methods import ClusterFit, DataInfo, cut_at, estimate_lambda, mixed_distances
from kindred.operators.methods import within_split as methods_within_split
from kindred.operators.partition import eps_counts
from kindred.sources.synthetic import synthetic_clusters
from kindred.sources.tables import read_table, write_results
from kindred.streaming import assign

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict:
    return dict(ORACLES)


table = read_table


def scratch(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder."""
    df = spark.range(0)
    ensure_checkpoint_dir(df)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def r6(c, name: str):
    return F.round(c, 6).alias(name)


def d6(c, name: str):
    """r6() of a number that is not negative, as SQL rounds: by the nearest whole number of millionths, without a decimal of each."""
    scaled = c * F.lit(1e6)
    whole = F.rint(scaled)
    return (F.when(scaled - whole == 0.5, whole + 1).otherwise(whole) / F.lit(1e6)).alias(name)


# -- preprocessing --------------------------------------------------------------------------------

PART = ["p_size", "p_retailprice"]


def part_z(spark, sf, keep=("p_partkey",)) -> DataFrame:
    part = table(spark, sf, "part")
    return fit_scaler(part, PART, True, True).apply(part, list(keep))


PART_Z = """z AS (SELECT p_partkey, p_type, p_brand, (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS a,
 (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS b FROM part)"""


@query(f"WITH {PART_Z} SELECT p_partkey, round(a, 6) AS z_size, round(b, 6) AS z_price FROM z")
def zscore_part(spark, sf):
    return part_z(spark, sf).select("p_partkey", r6(F.col("p_size"), "z_size"), r6(F.col("p_retailprice"), "z_price"))


GAPPED = "g AS (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL ELSE c_acctbal END AS bal, CASE WHEN c_custkey % 11 = 0 AND c_custkey % 7 <> 0 THEN NULL ELSE c_mktsegment END AS seg FROM customer)"


def gapped(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    return c.select("c_custkey", F.when(F.col("c_custkey") % 7 != 0, F.col("c_acctbal")).alias("bal"), F.when((F.col("c_custkey") % 11 != 0) | (F.col("c_custkey") % 7 == 0), F.col("c_mktsegment")).alias("seg"))


@query(f"WITH {GAPPED} SELECT c_custkey, round(coalesce(bal, (SELECT median(bal) FROM g)), 4) AS bal, coalesce(seg, 'missing') AS seg FROM g")
def impute_median(spark, sf):
    df = gapped(spark, sf)
    e = fit_encoder(df, "c_custkey", ["bal", "seg"], False, False)
    return df.select("c_custkey", F.round(F.coalesce("bal", F.lit(e.medians["bal"])), 4).alias("bal"), F.coalesce("seg", F.lit("missing")).alias("seg"))


LEVELS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY", "missing")


@query(f"WITH {GAPPED} SELECT c_custkey, " + ", ".join(f"CASE WHEN coalesce(seg, 'missing') = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS seg_{v}" for v in LEVELS) + " FROM g")
def onehot_segment(spark, sf):
    return fit_encoder(gapped(spark, sf), "c_custkey", ["seg"], False, False).apply(gapped(spark, sf), "c_custkey")


@query(
    f"WITH {GAPPED}, e AS (SELECT c_custkey, coalesce(bal, (SELECT median(bal) FROM g)) AS bal, "
    + ", ".join(f"CASE WHEN coalesce(seg, 'missing') = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS s{i}" for i, v in enumerate(LEVELS))
    + " FROM g) SELECT c_custkey, round((bal - avg(bal) OVER ()) / stddev_samp(bal) OVER (), 6) AS bal, "
    + ", ".join(f"round((s{i} - avg(s{i}) OVER ()) / stddev_samp(s{i}) OVER (), 6) AS seg_{v}" for i, v in enumerate(LEVELS))
    + " FROM e"
)
def mixed_encode(spark, sf):
    df = gapped(spark, sf)
    out = fit_encoder(df, "c_custkey", ["bal", "seg"]).apply(df, "c_custkey")
    return out.select("c_custkey", *(F.round(c, 6).alias(c) for c in out.columns[1:]))


@query(
    """WITH s AS (SELECT l_orderkey, l_linenumber, l_extendedprice * (1 - l_discount) AS v FROM lineitem)
    SELECT l_orderkey, l_linenumber, CASE WHEN v = 0 THEN v ELSE round(v * pow(10.0::DOUBLE, 3.0::DOUBLE - floor(log10(abs(v))))) / pow(10.0::DOUBLE, 3.0::DOUBLE - floor(log10(abs(v)))) END AS v4 FROM s"""
)
def signif4(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return df.select("l_orderkey", "l_linenumber", signif(F.col("v")).alias("v4"))


# -- distances ------------------------------------------------------------------------------------

@query(
    f"""WITH s AS (SELECT s_suppkey, CAST(s_nationkey AS VARCHAR) AS n, s_acctbal AS b FROM supplier), r AS (SELECT max(b) - min(b) AS w FROM s)
    SELECT x.s_suppkey AS i, y.s_suppkey AS j, round((abs(x.b - y.b) / w + CASE WHEN x.n <> y.n THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 2, 6) AS d FROM s x JOIN s y ON x.s_suppkey < y.s_suppkey, r"""
)
def gower_pairs(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", F.col("s_nationkey").cast("string").alias("n"), F.col("s_acctbal").alias("b"))
    return mixed_distance(s, "s_suppkey", ["n", "b"]).select("i", "j", d6(F.col("d"), "d"))


@query("SELECT x.s_suppkey AS i, y.s_suppkey AS j, round(sqrt((x.s_nationkey - y.s_nationkey) ** 2 + (x.s_acctbal / 1000 - y.s_acctbal / 1000) ** 2), 6) AS d FROM supplier x JOIN supplier y ON x.s_suppkey < y.s_suppkey")
def euclid_pairs(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") / 1000).alias("b"))
    return euclidean_pairs(vectors(s, "s_suppkey", ["s_nationkey", "b"])).select("i", "j", d6(F.col("d"), "d"))


EPS = 0.05


@query(f"WITH {PART_Z} SELECT x.p_partkey AS row_id, CAST(count(*) AS BIGINT) AS n FROM z x JOIN z y ON x.a BETWEEN y.a - {EPS} AND y.a + {EPS} AND sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) <= {EPS} GROUP BY 1")
def eps_neighbors(spark, sf):
    x = vectors(part_z(spark, sf), "p_partkey", PART)
    return eps_counts(x, x, EPS)


@query(
    f"""WITH RECURSIVE {PART_Z}, e AS (SELECT x.p_partkey AS i, y.p_partkey AS j FROM z x JOIN z y ON x.a BETWEEN y.a - {EPS} AND y.a + {EPS} AND sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) <= {EPS}),
    c AS (SELECT i FROM e GROUP BY i HAVING count(*) >= 4), l AS (SELECT e.i, e.j FROM e JOIN c p ON e.i = p.i JOIN c q ON e.j = q.i),
    w(i, r) AS (SELECT i, i FROM c UNION SELECT l.j, w.r FROM w JOIN l ON w.i = l.i WHERE w.r < l.j), m AS (SELECT i, min(r) AS root FROM w GROUP BY i),
    b AS (SELECT e.i, coalesce(max(o.root), min(m.root)) AS root FROM e JOIN m ON e.j = m.i LEFT JOIN m o ON e.i = o.i GROUP BY e.i),
    f AS (SELECT root, row_number() OVER (ORDER BY min(i)) AS id FROM b GROUP BY root)
    SELECT z.p_partkey AS row_id, CAST(coalesce(f.id, 0) AS INTEGER) AS cluster FROM z LEFT JOIN b ON z.p_partkey = b.i LEFT JOIN f ON b.root = f.root"""
)
def dbscan_part(spark, sf):
    return api.cluster(table(spark, sf, "part"), "dbscan", id_col="p_partkey", features=PART, scale=True, eps=EPS, minPts=4).clusters


@query("SELECT c.c_custkey AS row_id, min(d.c_custkey) AS root FROM customer c JOIN customer d ON c.c_nationkey = d.c_nationkey AND c.c_mktsegment = d.c_mktsegment GROUP BY 1")
def components_customer(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("row_id"), "c_nationkey", "c_mktsegment")
    before = F.lag("row_id").over(Window.partitionBy("c_nationkey", "c_mktsegment").orderBy("row_id"))
    links = c.select(F.col("row_id").alias("i"), before.alias("j")).where("j is not null")
    return connected(c.select("row_id"), links)


# -- assignment and k-means -----------------------------------------------------------------------

CENTERS = [[-1.0, -1.0], [0.0, 0.5], [1.2, 0.8]]
SQL_D = [f"(a - {p}) ** 2 + (b - {q}) ** 2" for p, q in (("(-1.0::DOUBLE)", "(-1.0::DOUBLE)"), ("0.0::DOUBLE", "0.5::DOUBLE"), ("1.2::DOUBLE", "0.8::DOUBLE"))]
NEAR = f"d AS (SELECT *, {SQL_D[0]} AS d1, {SQL_D[1]} AS d2, {SQL_D[2]} AS d3 FROM z), n AS (SELECT *, CASE WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS cluster FROM d)"


def fixed_fit(spark, sf, centers=CENTERS) -> ClusterFit:
    """A fit of the given centers: k-means that stops before its first round."""
    return api.cluster(table(spark, sf, "part"), "kmeans", len(centers), id_col="p_partkey", features=PART, scale=True, starts=[centers], iter_max=0)


@query(f"WITH {PART_Z}, {NEAR} SELECT p_partkey, cluster FROM n")
def assign_fixed_centers(spark, sf):
    return api.predict(fixed_fit(spark, sf), table(spark, sf, "part")).clusters.withColumnRenamed("row_id", "p_partkey")


@query(f"WITH {PART_Z}, {NEAR} SELECT p_partkey, cluster FROM n")
def stream_assign_part(spark, sf):
    """Rows read as a stream, assigned and written as files."""
    fit, out = fixed_fit(spark, sf), scratch(spark, "stream")
    rows = spark.readStream.schema(fit.info.data.schema).option("pathGlobFilter", "part.parquet").parquet(sf)
    assign.to_files(assign.assign_stream(fit, rows), f"{out}/rows", f"{out}/log").awaitTermination()
    return spark.read.schema("row_id long, cluster int").parquet(f"{out}/rows").withColumnRenamed("row_id", "p_partkey")


@query(f"WITH {PART_Z}, {NEAR} SELECT cluster, CAST(count(*) AS BIGINT) AS size FROM n GROUP BY cluster")
def sizes_fixed_centers(spark, sf):
    return plotspec.plot_cluster_sizes(fixed_fit(spark, sf)).data


@query(
    f"""WITH {PART_Z}, {NEAR} SELECT cluster, CAST(count(*) AS BIGINT) AS size, round(avg(a), 6) AS mean_size, round(avg(b), 6) AS mean_price, round(stddev_samp(a), 6) AS sd_size, round(stddev_samp(b), 6) AS sd_price,
    round(sum((a - ma) ** 2 + (b - mb) ** 2) / count(*), 6) AS within FROM (SELECT *, avg(a) OVER (PARTITION BY cluster) AS ma, avg(b) OVER (PARTITION BY cluster) AS mb FROM n) GROUP BY cluster"""
)
def part_profile(spark, sf):
    """The flagship: standardise, assign to literal centers, and profile the clusters in one aggregate."""
    fit = fixed_fit(spark, sf)
    placed = part_z(spark, sf).join(fit.clusters, F.col("p_partkey") == F.col("row_id"))
    a, b = (F.col(f) for f in PART)
    return placed.groupBy("cluster").agg(
        F.count("*").alias("size"), r6(F.avg(a), "mean_size"), r6(F.avg(b), "mean_price"), r6(F.stddev_samp(a), "sd_size"), r6(F.stddev_samp(b), "sd_price"), r6(F.var_pop(a) + F.var_pop(b), "within"),
    )


@query(
    f"""WITH {PART_Z}, {NEAR}, s AS (SELECT median(v) AS s FROM (SELECT unnest([sqrt(d1), sqrt(d2), sqrt(d3)]) AS v FROM n)),
    e AS (SELECT p_partkey, cluster, exp(-d1 / (2 * s * s)) AS e1, exp(-d2 / (2 * s * s)) AS e2, exp(-d3 / (2 * s * s)) AS e3 FROM n, s)
    SELECT p_partkey, cluster, round(e1 / (e1 + e2 + e3), 6) AS s1, round(e2 / (e1 + e2 + e3), 6) AS s2, round(e3 / (e1 + e2 + e3), 6) AS s3 FROM e"""
)
def scores_radial(spark, sf):
    fit = fixed_fit(spark, sf)
    scored = explain.score_rows(fit, table(spark, sf, "part"), api.feature_columns(fit))
    return scored.select("p_partkey", "cluster", *(r6(F.get("scores", F.lit(i)), f"s{i + 1}") for i in range(3)))


def _lloyd_sql(rounds: int) -> str:
    steps = ["c0 AS (SELECT 1 AS g, -1.0::DOUBLE AS p, -1.0::DOUBLE AS q UNION ALL SELECT 2, 0.0, 0.5 UNION ALL SELECT 3, 1.2, 0.8)"]
    for i in range(rounds):
        steps.append(f"a{i} AS (SELECT p_partkey, any_value(a) AS a, any_value(b) AS b, min_by(g, ((a - p) ** 2 + (b - q) ** 2, g)) AS g FROM z, c{i} GROUP BY p_partkey)")
        steps.append(f"c{i + 1} AS (SELECT g, avg(a) AS p, avg(b) AS q FROM a{i} GROUP BY g)")
    return f"WITH {PART_Z}, " + ", ".join(steps) + f" SELECT CAST(g AS INTEGER) AS cluster, round(p, 6) AS m_size, round(q, 6) AS m_price FROM c{rounds}"


def _lloyd(spark, sf, rounds):
    fit = api.cluster(table(spark, sf, "part"), "kmeans", 3, id_col="p_partkey", features=PART, scale=True, starts=[CENTERS], iter_max=rounds)
    rows = [(g, *(round(c[f], 6) for f in PART)) for g, c in enumerate(api.centers(fit, rounded=False), 1)]
    return spark.createDataFrame(rows, "cluster int, m_size double, m_price double")


@query(_lloyd_sql(1))
def lloyd_step(spark, sf):
    return _lloyd(spark, sf, 1)


@query(_lloyd_sql(4))
def lloyd_rounds(spark, sf):
    return _lloyd(spark, sf, 4)


@query(_lloyd_sql(3).rsplit(" SELECT", 1)[0] + ", l AS (SELECT p_partkey, min_by(g, ((a - p) ** 2 + (b - q) ** 2, g)) AS g FROM z, c3 GROUP BY p_partkey) SELECT p_partkey AS row_id, CAST(g AS INTEGER) AS cluster FROM l")
def kmeans_fixed_start(spark, sf):
    return api.cluster(table(spark, sf, "part"), "kmeans", 3, id_col="p_partkey", features=PART, scale=True, starts=[CENTERS], iter_max=3).clusters


def _gmm_sql() -> str:
    logs = ", ".join(f"ln(w{g}) - 0.5 * (({p} - a) ** 2 / va + ({q} - b) ** 2 / vb + ln(va) + ln(vb)) AS l{g}" for g, (p, q) in enumerate(CENTERS, 1))
    shares = ", ".join(f"exp(l{g} - m) / (exp(l1 - m) + exp(l2 - m) + exp(l3 - m)) AS r{g}" for g in (1, 2, 3))
    up = ", ".join(f"sum(r{g}) AS n{g}, sum(r{g} * a) / sum(r{g}) AS a{g}, sum(r{g} * b) / sum(r{g}) AS b{g}, sum(r{g} * a * a) / sum(r{g}) - pow(sum(r{g} * a) / sum(r{g}), 2) AS s{g}, sum(r{g} * b * b) / sum(r{g}) - pow(sum(r{g} * b) / sum(r{g}), 2) AS t{g}" for g in (1, 2, 3))
    last = ", ".join(f"ln(n{g} / (n1 + n2 + n3)) - 0.5 * ((a - a{g}) ** 2 / s{g} + (b - b{g}) ** 2 / t{g} + ln(s{g}) + ln(t{g})) AS k{g}" for g in (1, 2, 3))
    return f"""WITH {PART_Z}, {NEAR}, c AS (SELECT (count(*) FILTER (cluster = 1))::DOUBLE / count(*) AS w1, (count(*) FILTER (cluster = 2))::DOUBLE / count(*) AS w2, (count(*) FILTER (cluster = 3))::DOUBLE / count(*) AS w3, var_pop(a) / 3 AS va, var_pop(b) / 3 AS vb FROM n),
    l AS (SELECT p_partkey, a, b, {logs} FROM z, c), r AS (SELECT *, {shares} FROM (SELECT *, greatest(l1, l2, l3) AS m FROM l)), u AS (SELECT {up} FROM r),
    f AS (SELECT p_partkey, {last} FROM r, u) SELECT p_partkey AS row_id, CASE WHEN k1 >= k2 AND k1 >= k3 THEN 1 WHEN k2 >= k3 THEN 2 ELSE 3 END AS cluster, round(1 / (1 + exp(k2 - k1) + exp(k3 - k1)), 5) AS first FROM f"""


@query(_gmm_sql())
def gmm_fixed_start(spark, sf):
    """One round of the axis-parallel family from fixed centers."""
    fit = api.cluster(table(spark, sf, "part"), "gmm", 3, id_col="p_partkey", features=PART, scale=True, starts=[CENTERS], families=("VVI",), iter_max=1)
    return fit.clusters.join(fit.membership, "row_id").select("row_id", "cluster", F.round(F.get("membership", F.lit(0)), 5).alias("first"))


# -- mixed prototypes -----------------------------------------------------------------------------

PROTOS = [{"bal": 0.0, "seg": "BUILDING"}, {"bal": 5000.0, "seg": "MACHINERY"}, {"bal": 9000.0, "seg": None}]
TYPES = {"bal": "numeric", "seg": "categorical"}
LAM = 4.0e6


def _kmm_sql(p: dict) -> str:
    cat = f"CASE WHEN seg <> '{p['seg']}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" if p["seg"] else "NULL::DOUBLE"
    num, lam = f"pow(bal - {p['bal']}::DOUBLE, 2)", f"{LAM}::DOUBLE"
    seen = f"(CASE WHEN bal IS NULL THEN 0 ELSE 1 END + CASE WHEN seg IS NULL{'' if p['seg'] else ' OR TRUE'} THEN 0 ELSE {lam} END)"
    return f"CASE WHEN {seen} > 0 THEN (coalesce({num}, 0) + coalesce(CASE WHEN seg IS NULL THEN NULL ELSE {lam} * {cat} END, 0)) * (1 + {lam}) / {seen} ELSE 'inf'::DOUBLE END"


@query(f"WITH {GAPPED} SELECT c_custkey, " + ", ".join(f"CASE WHEN isinf({_kmm_sql(p)}) THEN -1.0::DOUBLE ELSE round({_kmm_sql(p)} / 1e8::DOUBLE, 6) END AS d{i}" for i, p in enumerate(PROTOS)) + " FROM g")
def kmm_distance_pairwise(spark, sf):
    d = mixed_distances(PROTOS, TYPES, LAM)({f: F.col(f) for f in TYPES})
    far = lambda i: F.get(d, F.lit(i))
    return gapped(spark, sf).select("c_custkey", *(F.when(far(i) == float("inf"), -1.0).otherwise(F.round(far(i) / 1e8, 6)).alias(f"d{i}") for i in range(3)))


@query(
    f"""WITH {GAPPED}, z AS (SELECT (bal - avg(bal) OVER ()) / stddev_samp(bal) OVER () AS b, seg FROM g), f AS (SELECT count(*)::DOUBLE AS n FROM z WHERE seg IS NOT NULL GROUP BY seg)
    SELECT round((SELECT var_samp(b) FROM z) / (1 - (SELECT sum(n * n) FROM f) / (SELECT sum(n) * sum(n) FROM f)), 6) AS lambda"""
)
def lambda_auto(spark, sf):
    df = gapped(spark, sf)
    s = fit_scaler(df, ["bal"], True, True)
    lam = estimate_lambda(df.select(s.column("bal").alias("bal"), "seg"), TYPES)
    return spark.createDataFrame([(round(lam, 6),)], "lambda double")


_ROUND = f"""d AS (SELECT *, {_kmm_sql(PROTOS[0])} AS d1, {_kmm_sql(PROTOS[1])} AS d2 FROM g), a AS (SELECT *, CASE WHEN d1 <= d2 THEN 1 ELSE 2 END AS g FROM d),
    m AS (SELECT g, seg, row_number() OVER (PARTITION BY g ORDER BY count(*) DESC, seg) AS r FROM a WHERE seg IS NOT NULL GROUP BY g, seg),
    p AS (SELECT a.g, avg(bal) AS bal, any_value(m.seg) AS seg FROM a JOIN m ON a.g = m.g AND m.r = 1 GROUP BY a.g)"""
_NEXT = f"""x AS (SELECT g.c_custkey, p.g, (coalesce(pow(g.bal - p.bal, 2), 0) + coalesce(CASE WHEN g.seg <> p.seg THEN {LAM}::DOUBLE WHEN g.seg = p.seg THEN 0 END, 0)) * (1 + {LAM}::DOUBLE) / (CASE WHEN g.bal IS NULL THEN 0 ELSE 1 END + CASE WHEN g.seg IS NULL THEN 0 ELSE {LAM}::DOUBLE END) AS d FROM g, p)
    SELECT c_custkey AS row_id, CAST(min_by(g, (d, g)) AS INTEGER) AS cluster FROM x GROUP BY c_custkey"""


@query(f"WITH {GAPPED}, {_ROUND} SELECT CAST(g AS INTEGER) AS cluster, round(bal / 1000, 6) AS bal, seg FROM p")
def kmm_prototypes(spark, sf):
    """One round from fixed prototypes, over what is observed."""
    fit = api.cluster(gapped(spark, sf), "kmm", 2, id_col="c_custkey", scale_numeric=False, center=False, starts=[PROTOS[:2]], iter_max=1, **{"lambda": LAM})
    return spark.createDataFrame([(g, round(p["bal"] / 1000, 6), p["seg"]) for g, p in enumerate(api.prototypes(fit, rounded=False), 1)], "cluster int, bal double, seg string")


@query(f"WITH {GAPPED}, {_ROUND}, {_NEXT}")
def kmm_fixed_start(spark, sf):
    return api.cluster(gapped(spark, sf), "kmm", 2, id_col="c_custkey", scale_numeric=False, center=False, starts=[PROTOS[:2]], iter_max=1, **{"lambda": LAM}).clusters


@query(f"WITH {GAPPED.replace('g AS', 'h AS')}, g AS (SELECT c_custkey, coalesce(bal, (SELECT median(bal) FROM h)) AS bal, coalesce(seg, 'missing') AS seg FROM h), {_ROUND}, {_NEXT}")
def kproto_fixed_start(spark, sf):
    """As kmm_fixed_start, with gaps filled first."""
    return api.cluster(gapped(spark, sf), "kproto", 2, id_col="c_custkey", center=False, starts=[PROTOS[:2]], iter_max=1, **{"lambda": LAM}).clusters


@query(f"WITH {GAPPED}, {_ROUND}, {_NEXT.rsplit(' SELECT', 1)[0]}, y AS (SELECT c_custkey, min_by(g, (d, g)) AS g FROM x GROUP BY 1) SELECT round(sum(pow(g.bal - p.bal, 2)) / 1e9::DOUBLE, 4) AS numeric_part, round(sum(CASE WHEN g.seg <> p.seg THEN {LAM}::DOUBLE ELSE 0 END) / 1e9::DOUBLE, 4) AS categorical_part FROM g JOIN y USING (c_custkey) JOIN p ON y.g = p.g")
def within_split(spark, sf):
    fit = api.cluster(gapped(spark, sf), "kmm", 2, id_col="c_custkey", scale_numeric=False, center=False, starts=[PROTOS[:2]], iter_max=1, **{"lambda": LAM})
    return spark.createDataFrame([tuple(round(v / 1e9, 4) for v in methods_within_split(fit))], "numeric_part double, categorical_part double")


@query(f"WITH {GAPPED}, d AS (SELECT least({_kmm_sql(PROTOS[0])}, {_kmm_sql(PROTOS[1])}) AS d FROM g) SELECT round(sum(d) / 1e9::DOUBLE, 4) AS objective FROM d")
def kmm_objective(spark, sf):
    fit = api.cluster(gapped(spark, sf), "kmm", 2, id_col="c_custkey", scale_numeric=False, center=False, starts=[PROTOS[:2]], iter_max=1, **{"lambda": LAM})
    return spark.createDataFrame([(round(fit.extras["objective"] / 1e9, 4),)], "objective double")


SCALED = [{"bal": -0.5, "seg": "BUILDING"}, {"bal": 0.5, "seg": "MACHINERY"}]


def _scaled_sql(p: dict) -> str:
    return f"(coalesce(pow(z - {p['bal']}, 2), 0) + coalesce(CASE WHEN seg <> '{p['seg']}' THEN 1.0::DOUBLE WHEN seg IS NOT NULL THEN 0 END, 0)) * 2 / ((CASE WHEN z IS NULL THEN 0 ELSE 1 END) + (CASE WHEN seg IS NULL THEN 0 ELSE 1 END))"


@query(
    f"""WITH {GAPPED}, c AS (SELECT *, (bal - avg(bal) OVER ()) / stddev_samp(bal) OVER () AS z FROM g), a AS (SELECT *, CASE WHEN {_scaled_sql(SCALED[0])} <= {_scaled_sql(SCALED[1])} THEN 1 ELSE 2 END AS p FROM c),
    m AS (SELECT p, seg, row_number() OVER (PARTITION BY p ORDER BY count(*) DESC, seg) AS r FROM a WHERE seg IS NOT NULL GROUP BY p, seg) SELECT CAST(a.p AS INTEGER) AS cluster, round(avg(bal), 4) AS bal, any_value(m.seg) AS seg FROM a JOIN m ON a.p = m.p AND m.r = 1 GROUP BY a.p"""
)
def kmm_restored_prototypes(spark, sf):
    """A round on standardised numbers; prototypes are shown in the columns' own units."""
    fit = api.cluster(gapped(spark, sf), "kmm", 2, id_col="c_custkey", starts=[SCALED], iter_max=1, **{"lambda": 1.0})
    return spark.createDataFrame([(g, round(p["bal"], 4), p["seg"]) for g, p in enumerate(api.prototypes(fit, rounded=False), 1)], "cluster int, bal double, seg string")


# -- metrics --------------------------------------------------------------------------------------

LINE = ["l_quantity", "l_discount", "l_tax"]


def line(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem")
    return li.select(F.col("l_orderkey").alias("row_id"), F.col("l_returnflag").alias("cluster"), *LINE, F.array(*(F.col(c) for c in LINE)).alias("x"))


def _tall(cols=LINE) -> str:
    return "t AS (" + " UNION ALL ".join(f"SELECT l_returnflag AS cluster, '{c}' AS feature, {c}::DOUBLE AS v FROM lineitem" for c in cols) + ")"


@query(f"WITH {_tall()} SELECT cluster, feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(median(v), 6) AS median, min(v) AS min, max(v) AS max FROM t GROUP BY 1, 2")
def feature_summary(spark, sf):
    s = metrics.feature_summary(line(spark, sf), LINE)
    return s.select("cluster", "feature", r6(F.col("mean"), "mean"), r6(F.col("sd"), "sd"), r6(F.col("median"), "median"), "min", "max")


@query(f"WITH {_tall()}, g AS (SELECT cluster, feature, count(*) AS n, avg(v) AS m FROM t GROUP BY 1, 2), a AS (SELECT feature, avg(v) AS m, count(*) AS n, var_samp(v) AS s FROM t GROUP BY 1) SELECT g.feature, round(1e4::DOUBLE * sum(g.n * (g.m - a.m) ** 2) / any_value((a.n - 1) * a.s), 6) AS separation FROM g JOIN a USING (feature) GROUP BY 1")
def separation_eta2(spark, sf):
    return metrics.separation(line(spark, sf), LINE).select("feature", F.round(F.col("separation") * 1e4, 6).alias("separation"))


@query("SELECT l_returnflag AS cluster, CAST(count(*) AS BIGINT) AS size FROM lineitem GROUP BY 1")
def cluster_sizes(spark, sf):
    return metrics.sizes(line(spark, sf))


@query("SELECT l_returnflag AS cluster, CAST(count(*) AS BIGINT) AS n, " + ", ".join(f"round(avg({c}), 6) AS c{i}" for i, c in enumerate(LINE)) + " FROM lineitem GROUP BY 1")
def centroids(spark, sf):
    return metrics.centroids(line(spark, sf)).select("cluster", "n", *(r6(F.get("center", F.lit(i)), f"c{i}") for i in range(3)))


@query(f"WITH {_tall()}, g AS (SELECT count(*) * var_pop(v) AS w FROM t GROUP BY cluster, feature) SELECT round(sum(w) / (SELECT count(*) FROM lineitem), 6) AS within_per_row FROM g")
def total_within(spark, sf):
    n = line(spark, sf).agg(F.count("*").alias("n"))
    return metrics.total_within(line(spark, sf)).join(n).select(r6(F.col("total_within") / F.col("n"), "within_per_row"))


EMB = "e AS (SELECT vec_id AS row_id, label AS cluster, unnest(range(64)) AS f, unnest(embedding)::DOUBLE AS v FROM embeddings)"


def emb(spark, sf) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("row_id"), F.col("label").alias("cluster"), F.col("embedding").cast("array<double>").alias("x"))


@query(
    f"WITH {EMB}, g AS (SELECT cluster, f, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM e GROUP BY 1, 2), a AS (SELECT f, avg(v) AS m FROM e GROUP BY 1), b AS (SELECT sum(g.n * (g.m - a.m) ** 2) AS b, sum(g.n * s) AS w, count(DISTINCT cluster) AS k FROM g JOIN a USING (f)) SELECT round((b / (k - 1)) / (w / ((SELECT count(*) FROM embeddings) - k)), 6) AS calinski_harabasz FROM b"
)
def calinski_harabasz(spark, sf):
    return metrics.calinski_harabasz(emb(spark, sf)).select(r6(F.col("calinski_harabasz"), "calinski_harabasz"))


@query(
    f"""WITH {EMB}, c AS (SELECT cluster, f, avg(v) AS m FROM e GROUP BY 1, 2), r AS (SELECT row_id, cluster, sqrt(sum((v - m) ** 2)) AS d FROM e JOIN c USING (cluster, f) GROUP BY 1, 2), s AS (SELECT cluster, avg(d) AS s FROM r GROUP BY 1),
    p AS (SELECT x.cluster AS i, y.cluster AS j, sqrt(sum((x.m - y.m) ** 2)) AS d FROM c x JOIN c y ON x.f = y.f AND x.cluster <> y.cluster GROUP BY 1, 2) SELECT round(avg(q), 6) AS davies_bouldin FROM (SELECT i, max((a.s + b.s) / d) AS q FROM p JOIN s a ON a.cluster = i JOIN s b ON b.cluster = j GROUP BY i)"""
)
def davies_bouldin(spark, sf):
    return metrics.davies_bouldin(emb(spark, sf)).select(r6(F.col("davies_bouldin"), "davies_bouldin"))


SIL = """e AS (SELECT vec_id AS i, label AS g, list_transform(embedding, lambda v: v::DOUBLE) AS x FROM embeddings),
 p AS (SELECT a.i, a.g, b.g AS h, avg(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) ** 2)))) AS d FROM e a JOIN e b ON a.i <> b.i GROUP BY 1, 2, 3),
 w AS (SELECT i, g, min(CASE WHEN h = g THEN d END) AS a, min(CASE WHEN h <> g THEN d END) AS b FROM p GROUP BY 1, 2), s AS (SELECT i, g, CASE WHEN a IS NULL THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM w)"""


@query(f"WITH {SIL} SELECT round(avg(s), 6) AS silhouette FROM s")
def silhouette(spark, sf):
    return metrics.silhouette(emb(spark, sf)).select(r6(F.col("silhouette"), "silhouette"))


@query(f"WITH {SIL} SELECT g AS cluster, round(avg(s), 6) AS silhouette FROM s GROUP BY 1")
def silhouette_per_cluster(spark, sf):
    return metrics.silhouette_per_cluster(emb(spark, sf)).select("cluster", r6(F.col("silhouette"), "silhouette"))


def pairs(spark, sf) -> DataFrame:
    return table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("a"), F.col("p_brand").alias("b"))


CELLS = "c AS (SELECT p_type AS a, p_brand AS b, count(*)::DOUBLE AS n FROM part GROUP BY 1, 2), x AS (SELECT sum(n) AS n FROM c GROUP BY a), y AS (SELECT sum(n) AS n FROM c GROUP BY b), t AS (SELECT sum(n) AS n FROM c)"


@query("SELECT p_type AS a, p_brand AS b, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY 1, 2")
def contingency(spark, sf):
    return metrics.contingency(pairs(spark, sf))


@query(f"WITH {CELLS}, q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(n * (n - 1) / 2) FROM x) AS p, (SELECT sum(n * (n - 1) / 2) FROM y) AS r, n * (n - 1) / 2 AS m FROM t) SELECT round((i - p * r / m) / ((p + r) / 2 - p * r / m), 6) AS ari FROM q")
def ari(spark, sf):
    return metrics.adjusted_rand_index(pairs(spark, sf)).select(r6(F.col("ari"), "ari"))


@query(f"WITH {CELLS}, h AS (SELECT (SELECT -sum(x.n / t.n * ln(x.n / t.n)) FROM x, t) AS p, (SELECT -sum(y.n / t.n * ln(y.n / t.n)) FROM y, t) AS q, (SELECT -sum(c.n / t.n * ln(c.n / t.n)) FROM c, t) AS r) SELECT round((p + q - r) / sqrt(p * q), 6) AS nmi FROM h")
def nmi(spark, sf):
    return metrics.normalized_mutual_information(pairs(spark, sf)).select(r6(F.col("nmi"), "nmi"))


@query(f"WITH {CELLS} SELECT round((n * n - (SELECT sum(n * n) FROM x) - (SELECT sum(n * n) FROM y) + 2 * (SELECT sum(n * n) FROM c)) / (n * n), 6) AS ppa FROM t")
def ppa(spark, sf):
    return metrics.partition_agreement(pairs(spark, sf)).select(r6(F.col("ppa"), "ppa"))


# -- validation -----------------------------------------------------------------------------------

_SIGNIF = "round(v * pow(10.0::DOUBLE, 3.0::DOUBLE - floor(log10(abs(v))))) / pow(10.0::DOUBLE, 3.0::DOUBLE - floor(log10(abs(v))))"


@query(
    f"""WITH {GAPPED}, q AS (SELECT c_custkey AS i, c_custkey % 3 + 1 AS g, [coalesce(bal, (SELECT median(bal) FROM g)), """
    + ", ".join(f"CASE WHEN coalesce(seg, 'missing') = '{v}' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END" for v in LEVELS)
    + f"""] AS x FROM g), p AS (SELECT a.i, a.g, b.g AS h, avg(sqrt(list_sum(list_transform(list_zip(a.x, b.x), lambda z: (z[1] - z[2]) ** 2)))) AS d FROM q a JOIN q b ON a.i <> b.i GROUP BY 1, 2, 3),
    w AS (SELECT i, min(CASE WHEN h = g THEN d END) AS a, min(CASE WHEN h <> g THEN d END) AS b FROM p GROUP BY 1),
    t AS (SELECT i, g, unnest(range(7)) AS f, unnest(x) AS v FROM q), c AS (SELECT g, f, count(*) AS n, avg(v) AS m, var_pop(v) AS s FROM t GROUP BY 1, 2), o AS (SELECT f, avg(v) AS m FROM t GROUP BY 1),
    b AS (SELECT sum(c.n * (c.m - o.m) ** 2) AS b, sum(c.n * s) AS w FROM c JOIN o USING (f)), r AS (SELECT g, avg(d) AS s FROM (SELECT i, g, sqrt(sum((v - m) ** 2)) AS d FROM t JOIN c USING (g, f) GROUP BY 1, 2) GROUP BY 1),
    e AS (SELECT x.g AS i, y.g AS j, sqrt(sum((x.m - y.m) ** 2)) AS d FROM c x JOIN c y ON x.f = y.f AND x.g <> y.g GROUP BY 1, 2),
    u AS (SELECT 'silhouette' AS metric, avg((b - a) / greatest(a, b)) AS v FROM w UNION ALL SELECT 'calinski_harabasz', (b / 2) / (w / ((SELECT count(*) FROM q) - 3)) FROM b
    UNION ALL SELECT 'davies_bouldin', avg(z) FROM (SELECT i, max((a.s + k.s) / d) AS z FROM e JOIN r a ON a.g = i JOIN r k ON k.g = j GROUP BY i) UNION ALL SELECT 'total_within', w FROM b) SELECT metric, {_SIGNIF} AS value, CASE WHEN metric = 'silhouette' THEN '-1 to 1' ELSE 'positive, unbounded' END AS scale, CASE WHEN metric IN ('silhouette', 'calinski_harabasz') THEN 'higher is better' ELSE 'lower is better' END AS direction FROM u"""
)
def validate_mixed(spark, sf):
    """Internal metrics of a mixed fit, on imputed and one-hot encoded data."""
    df = gapped(spark, sf)
    fit = api.cluster(df, "kproto", 3, id_col="c_custkey", starts=[PROTOS], iter_max=1)
    labels = df.select(F.col("c_custkey").alias("row_id"), (F.col("c_custkey") % 3 + 1).cast("int").alias("cluster"))
    return api.validate(replace(fit, clusters=labels)).rounded().select("metric", "value", "scale", "direction")


@query(f"WITH {PART_Z}, {NEAR}, {CELLS.replace('p_type AS a, p_brand AS b, count(*)::DOUBLE AS n FROM part', 'cluster AS a, p_brand AS b, count(*)::DOUBLE AS n FROM n')}, q AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS i, (SELECT sum(n * (n - 1) / 2) FROM x) AS p, (SELECT sum(n * (n - 1) / 2) FROM y) AS r, n * (n - 1) / 2 AS m FROM t), h AS (SELECT (SELECT -sum(x.n / t.n * ln(x.n / t.n)) FROM x, t) AS p, (SELECT -sum(y.n / t.n * ln(y.n / t.n)) FROM y, t) AS q, (SELECT -sum(c.n / t.n * ln(c.n / t.n)) FROM c, t) AS r) SELECT 'ari' AS metric, round((i - p * r / m) / ((p + r) / 2 - p * r / m), 6) AS value FROM q UNION ALL SELECT 'nmi', round((p + q - r) / sqrt(p * q), 6) FROM h")
def validate_truth(spark, sf):
    truth = table(spark, sf, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("cluster"))
    return api.validate(fixed_fit(spark, sf), truth=truth, metrics_wanted=["ari", "nmi"]).metrics_table.select("metric", r6(F.col("value"), "value"))


def _boot_sql(repeats=(1000, 1001)) -> str:
    u = "CAST('0x' || substr(md5(concat(d, ':', r)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
    return f"""WITH {PART_Z}, {NEAR}, k AS (SELECT cluster AS a, p_size AS v, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM n JOIN part USING (p_partkey)), s AS (SELECT count(*) AS n FROM k),
    w AS (SELECT unnest({list(repeats)}) AS r), i AS (SELECT r, unnest(range(s.n)) AS d FROM w, s), j AS (SELECT r, a, v FROM (SELECT r, least(floor({u} * s.n), s.n - 1) AS place FROM i, s) JOIN k USING (place)),
    c AS (SELECT r, a, v > avg(v) OVER (PARTITION BY r) AS b FROM j), e AS (SELECT r, a, b, count(*)::DOUBLE AS n FROM c GROUP BY 1, 2, 3), t AS (SELECT r, sum(n) AS n, sum(n * (n - 1) / 2) AS i FROM e GROUP BY 1),
    p AS (SELECT r, sum(n * (n - 1) / 2) AS p FROM (SELECT r, sum(n) AS n FROM e GROUP BY r, a) GROUP BY 1), q AS (SELECT r, sum(n * (n - 1) / 2) AS q FROM (SELECT r, sum(n) AS n FROM e GROUP BY r, b) GROUP BY 1)
    SELECT round(avg((i - p * q / (n * (n - 1) / 2)) / ((p + q) / 2 - p * q / (n * (n - 1) / 2))), 6) AS bootstrap_ari FROM t JOIN p USING (r) JOIN q USING (r)"""


@query(_boot_sql())
def bootstrap_ari_fixed(spark, sf):
    """Agreement over every draw of two resamples, with a refit that splits at the resample's mean size."""
    split = lambda sample: sample.join(F.broadcast(sample.agg(F.avg("f0").alias("m")))).select(F.col("draw_id").alias("row_id"), (F.col("f0") > F.col("m")).cast("int").alias("cluster"))
    mean, _ = api.bootstrap_ari(fixed_fit(spark, sf), 2, refit=split)
    return spark.createDataFrame([(round(mean, 6),)], "bootstrap_ari double")


def _refit_sql(starts=(10, 40), repeats=(1000, 1001)) -> str:
    u = "CAST('0x' || substr(md5(concat(d, ':', r)), 1, 13) AS BIGINT) / 4503599627370496.0::DOUBLE"
    first = f"abs(v - {starts[0]}) <= abs(v - {starts[1]})"
    means = f"avg(v) FILTER ({first}) AS m1, avg(v) FILTER (NOT {first}) AS m2"
    return f"""WITH k AS (SELECT p_size AS v, row_number() OVER (ORDER BY p_partkey) - 1 AS place FROM part), s AS (SELECT count(*) AS n FROM k), w AS (SELECT unnest({list(repeats)}) AS r), i AS (SELECT r, unnest(range(s.n)) AS d FROM w, s),
    j AS (SELECT r, v FROM (SELECT r, least(floor({u} * s.n), s.n - 1) AS place FROM i, s) JOIN k USING (place)), f AS (SELECT {means} FROM k), g AS (SELECT r, {means} FROM j GROUP BY r),
    c AS (SELECT r, abs(v - f.m1) <= abs(v - f.m2) AS a, abs(v - g.m1) <= abs(v - g.m2) AS b FROM j JOIN g USING (r), f), e AS (SELECT r, a, b, count(*)::DOUBLE AS n FROM c GROUP BY 1, 2, 3), t AS (SELECT r, sum(n) AS n, sum(n * (n - 1) / 2) AS i FROM e GROUP BY 1),
    p AS (SELECT r, sum(n * (n - 1) / 2) AS p FROM (SELECT r, sum(n) AS n FROM e GROUP BY r, a) GROUP BY 1), q AS (SELECT r, sum(n * (n - 1) / 2) AS q FROM (SELECT r, sum(n) AS n FROM e GROUP BY r, b) GROUP BY 1)
    SELECT round(avg((i - p * q / (n * (n - 1) / 2)) / ((p + q) / 2 - p * q / (n * (n - 1) / 2))), 6) AS bootstrap_ari FROM t JOIN p USING (r) JOIN q USING (r)"""


@query(_refit_sql())
def bootstrap_ari_refit(spark, sf):
    """The real refit: a round of k-means from fixed starts on each of two resamples, in one pass."""
    how = {"starts": [[[10.0], [40.0]]], "iter_max": 1}
    fit = api.cluster(table(spark, sf, "part"), "kmeans", 2, id_col="p_partkey", features=["p_size"], center=False, **how)
    return spark.createDataFrame([(round(api.bootstrap_ari(fit, 2, **how)[0], 6),)], "bootstrap_ari double")


@query(f"WITH {PART_Z}, {NEAR}, t AS (SELECT cluster, 'p_size' AS feature, p_size::DOUBLE AS v FROM n JOIN part USING (p_partkey) UNION ALL SELECT cluster, 'p_retailprice', p_retailprice FROM n JOIN part USING (p_partkey)) SELECT cluster, feature, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, round(median(v), 6) AS median, min(v) AS min, max(v) AS max FROM t GROUP BY 1, 2")
def explore_profiles(spark, sf):
    s = api.explore(fixed_fit(spark, sf), "pca").feature_summary
    return s.select("cluster", "feature", *(r6(F.col(c), c) for c in ("mean", "sd", "median")), "min", "max")


@query(
    "SELECT feature, CASE WHEN n IS NULL OR n <= 10 THEN 'categorical' ELSE 'numeric' END AS kind FROM (SELECT 'n_regionkey' AS feature, count(DISTINCT n_regionkey) AS n FROM nation UNION ALL SELECT 'n_nationkey', count(DISTINCT n_nationkey) FROM nation UNION ALL SELECT 'n_name', NULL)"
)
def feature_kinds(spark, sf):
    return spark.createDataFrame(list(feature_types(table(spark, sf, "nation"), ["n_regionkey", "n_nationkey", "n_name"]).items()), "feature string, kind string")


def _normal_sql(keys: str) -> str:
    u = lambda end: f"((CAST('0x' || substr(md5(concat_ws(':', {keys}, '{end}')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    return f"sqrt(-2 * ln({u('r')})) * cos(2 * pi() * {u('t')})"


@query(
    f"""WITH m AS (SELECT s_nationkey % 3 AS g, avg(s_acctbal) / 1000 AS x, avg(s_nationkey) AS y FROM supplier GROUP BY 1), n AS (SELECT count(*) AS n FROM supplier), i AS (SELECT unnest(range(3 * n)) AS id, n FROM n), c AS (SELECT id, CAST(id // n + 1 AS INTEGER) AS y FROM i)
    SELECT id AS row_id, round(m.x + 0.5 * {_normal_sql('1, id, 0')}, 6) AS x1, round(m.y + 0.5 * {_normal_sql('1, id, 1')}, 6) AS x2, c.y FROM c JOIN m ON m.g = c.y - 1"""
)
def synthetic_rows(spark, sf):
    """Groups about the means of three groups of suppliers, of as many rows as there are suppliers."""
    s = table(spark, sf, "supplier")
    means = s.groupBy((F.col("s_nationkey") % 3).alias("g")).agg((F.avg("s_acctbal") / 1000).alias("x"), F.avg("s_nationkey").alias("y")).orderBy("g").collect()
    return synthetic_clusters(spark, s.count(), [(r.x, r.y) for r in means]).select("row_id", r6(F.col("x1"), "x1"), r6(F.col("x2"), "x2"), "y")


@query("SELECT p_partkey, p_size, p_type FROM part")
def csv_round_trip(spark, sf):
    out = scratch(spark, "csv")
    write_results({"part": table(spark, sf, "part").select("p_partkey", "p_size", "p_type")}, out)
    source = table(spark, sf, "part").select("p_partkey", "p_size", "p_type").schema
    return spark.read.schema(source).option("header", True).csv(f"{out}/part")


# -- consensus ------------------------------------------------------------------------------------

LABELS = "l AS (SELECT 1 AS c, c_custkey AS r, c_nationkey % 4 AS g FROM customer UNION ALL SELECT 2, c_custkey, CAST(floor((c_acctbal + 1000) / 3000) AS INTEGER) + 1 FROM customer UNION ALL SELECT 3, c_custkey, CAST(length(c_mktsegment) AS INTEGER) FROM customer)"


def candidate_labels(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer")
    rule = [F.col("c_nationkey") % 4, F.floor((F.col("c_acctbal") + 1000) / 3000).cast("int") + 1, F.length("c_mktsegment")]
    out = None
    for i, r in enumerate(rule, 1):
        part = c.select(F.lit(i).alias("candidate"), F.col("c_custkey").alias("row_id"), r.cast("int").alias("cluster"))
        out = part if out is None else out.unionByName(part)
    return out


@query(
    """WITH l AS (SELECT 1 AS c, s_suppkey AS r, s_nationkey % 4 AS g FROM supplier UNION ALL SELECT 2, s_suppkey, CAST(floor((s_acctbal + 1000) / 3000) AS INTEGER) + 1 FROM supplier)
    SELECT a.r AS i, b.r AS j, round(count(*) / 2.0::DOUBLE, 6) AS agreement FROM l a JOIN l b ON a.c = b.c AND a.g = b.g AND a.r < b.r WHERE a.g <> 0 GROUP BY 1, 2"""
)
def coassoc(spark, sf):
    s = table(spark, sf, "supplier")
    rule = [F.col("s_nationkey") % 4, F.floor((F.col("s_acctbal") + 1000) / 3000).cast("int") + 1]
    parts = [s.select(F.lit(i).alias("candidate"), F.col("s_suppkey").alias("row_id"), r.cast("int").alias("cluster")) for i, r in enumerate(rule, 1)]
    return consensus.coassociation(parts[0].unionByName(parts[1])).select("i", "j", r6(F.col("agreement"), "agreement"))


@query(f"WITH {LABELS}, s AS (SELECT r, list(g ORDER BY c) AS s FROM l GROUP BY r) SELECT array_to_string(s, '-') AS signature, CAST(count(*) AS BIGINT) AS weight, min(r) AS first FROM s GROUP BY s, CASE WHEN list_contains(s, 0) THEN r END")
def consensus_signatures(spark, sf):
    s = consensus.signatures(candidate_labels(spark, sf))
    return s.select(F.array_join(F.col("signature").cast("array<string>"), "-").alias("signature"), "weight", "first")


@query(
    f"""WITH {LABELS}, p AS (SELECT a.c AS c1, b.c AS c2, a.g AS u, b.g AS v, count(*)::DOUBLE AS n FROM l a JOIN l b ON a.r = b.r AND a.c < b.c GROUP BY 1, 2, 3, 4),
    q AS (SELECT c1, c2, sum(n * n) AS s, sum(n) AS t FROM p GROUP BY 1, 2), x AS (SELECT c1, c2, sum(n * n) AS s FROM (SELECT c1, c2, u, sum(n) AS n FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2), y AS (SELECT c1, c2, sum(n * n) AS s FROM (SELECT c1, c2, v, sum(n) AS n FROM p GROUP BY 1, 2, 3) GROUP BY 1, 2)
    SELECT round(avg(z), 6) AS mean_ppa, round(min(z), 6) AS min_ppa, round(max(z), 6) AS max_ppa FROM (SELECT (t * t - x.s - y.s + 2 * q.s) / (t * t) AS z FROM q JOIN x USING (c1, c2) JOIN y USING (c1, c2))"""
)
def ensemble_stability(spark, sf):
    s = metrics.ensemble_stability(candidate_labels(spark, sf))
    return s.select(*(r6(F.col(c), c) for c in s.columns))


# -- explanations ---------------------------------------------------------------------------------


@query(
    f"""WITH {PART_Z}, {NEAR}, t AS (SELECT p_partkey, b, cluster, row_number() OVER (ORDER BY p_partkey) AS k FROM n), v AS (SELECT a, row_number() OVER (ORDER BY md5(concat(p_partkey, ':p_size:1:7')), p_partkey) AS k FROM n),
    m AS (SELECT t.p_partkey, v.a, t.b, t.cluster FROM t JOIN v USING (k)), d2 AS (SELECT *, {SQL_D[0]} AS d1, {SQL_D[1]} AS d2, {SQL_D[2]} AS d3 FROM m)
    SELECT round(avg(CASE WHEN cluster <> CASE WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS instability FROM d2"""
)
def importance_md5(spark, sf):
    found = explain.feature_importance(fixed_fit(spark, sf), table(spark, sf, "part"), ["p_size"], n_repeats=1, seed=7)
    return found.summary.select(r6(F.col("importance"), "instability"))


@query(
    f"""WITH {PART_Z}, {NEAR}, t AS (SELECT b, cluster, row_number() OVER (ORDER BY p_partkey) AS k FROM n), v AS (SELECT a, row_number() OVER (ORDER BY md5(concat(p_partkey, ':p_size:1:7')), p_partkey) AS k FROM n),
    m AS (SELECT v.a, t.b, t.cluster FROM t JOIN v USING (k)), d2 AS (SELECT *, {SQL_D[0]} AS d1, {SQL_D[1]} AS d2, {SQL_D[2]} AS d3 FROM m)
    SELECT 'p_size' AS feature, round((count(*) FILTER (d1 <= d2 AND d1 <= d3) - count(*) FILTER (cluster = 1)) / count(*)::DOUBLE, 6) AS importance FROM d2"""
)
def importance_loss(spark, sf):
    """By a caller's loss: the share of rows in the first cluster."""
    share = lambda data, labels, fit: labels.agg(F.avg((F.col("cluster") == 1).cast("double"))).first()[0]
    found = explain.feature_importance(fixed_fit(spark, sf), table(spark, sf, "part"), ["p_size"], loss=share, n_repeats=1, seed=7)
    return found.summary.select("feature", r6(F.col("importance"), "importance"))


@query(
    """WITH o AS (SELECT p_retailprice AS v, row_number() OVER (ORDER BY p_retailprice) AS k, count(*) OVER () AS n FROM part), g AS (SELECT unnest(range(6)) AS i), h AS (SELECT i, ((SELECT count(*) FROM part) + 1.0::DOUBLE / 3) * (i / 5.0::DOUBLE) + 1.0::DOUBLE / 3 AS h, (SELECT count(*) FROM part) AS n FROM g),
    q AS (SELECT i, h, n, CASE WHEN h < 1 THEN 1 WHEN h >= n THEN n ELSE floor(h) END AS lo, CASE WHEN h < 1 THEN 1 WHEN h >= n THEN n ELSE floor(h) + 1 END AS hi FROM h)
    SELECT CAST(i AS INTEGER) AS i, round(a.v + (CASE WHEN lo = hi THEN 0 ELSE h - floor(h) END) * (b.v - a.v), 6) AS value FROM q JOIN o a ON a.k = lo JOIN o b ON b.k = hi"""
)
def cp_grid_quantile8(spark, sf):
    values = explain.grid_values(table(spark, sf, "part"), "p_retailprice", True, None, 6)
    return spark.createDataFrame([(i, round(v, 6)) for i, v in enumerate(values)], "i int, value double")


GRID = [5.0, 15.0, 30.0, 45.0]
CP = f"""WITH {PART_Z}, g AS (SELECT avg(p_size) AS m, stddev_samp(p_size) AS s FROM part), t AS (SELECT p_partkey, v, (v - m) / s AS a, b FROM z, g, (SELECT unnest([5.0::DOUBLE, 15.0, 30.0, 45.0]) AS v)),
 d AS (SELECT *, {SQL_D[0]} AS d1, {SQL_D[1]} AS d2, {SQL_D[2]} AS d3 FROM t), n AS (SELECT *, CASE WHEN d1 <= d2 AND d1 <= d3 THEN 1 WHEN d2 <= d3 THEN 2 ELSE 3 END AS cluster FROM d)"""


def _profiles(spark, sf, **options) -> DataFrame:
    return explain.ceteris_paribus(fixed_fit(spark, sf), table(spark, sf, "part"), ["p_size"], grid={"p_size": GRID}, **options).profiles


@query(CP + " SELECT p_partkey AS observation, v AS feature_value, cluster FROM n")
def cp_profile_cluster(spark, sf):
    return _profiles(spark, sf).select("observation", F.col("feature_value_num").alias("feature_value"), "cluster")


@query(
    CP
    + """, s AS (SELECT p_partkey, median(x) AS s FROM (SELECT p_partkey, unnest([sqrt(d1), sqrt(d2), sqrt(d3)]) AS x FROM n) GROUP BY 1), e AS (SELECT n.*, exp(-d1 / (2 * s * s)) AS e1, exp(-d2 / (2 * s * s)) AS e2, exp(-d3 / (2 * s * s)) AS e3 FROM n JOIN s USING (p_partkey))
    SELECT p_partkey AS observation, v AS feature_value, round(e1 / (e1 + e2 + e3), 6) AS value FROM e"""
)
def cp_profile_score(spark, sf):
    return _profiles(spark, sf, target="score", cluster=1).select("observation", F.col("feature_value_num").alias("feature_value"), r6(F.col("value"), "value"))


def _lime_sql(permutations: int = 100) -> str:
    u = lambda end: f"((CAST('0x' || substr(md5(concat_ws(':', 1, s_suppkey, j, 's_acctbal', '{end}')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)"
    near = lambda v: f"CASE WHEN ({v} + 1) ** 2 <= {v} ** 2 AND ({v} + 1) ** 2 <= ({v} - 1) ** 2 THEN 1 WHEN {v} ** 2 <= ({v} - 1) ** 2 THEN 2 ELSE 3 END"
    return f"""WITH s AS (SELECT s_suppkey, (s_acctbal - avg(s_acctbal) OVER ()) / stddev_samp(s_acctbal) OVER () AS x FROM supplier), t AS (SELECT s_suppkey, x, unnest(range(1, {permutations + 1})) AS j FROM s),
    z AS (SELECT s_suppkey, x, CASE WHEN j = 1 THEN 0.0::DOUBLE ELSE sqrt(-2 * ln({u('r')})) * cos(2 * pi() * {u('t')}) END AS z FROM t),
    w AS (SELECT s_suppkey, z, exp(-z * z / 0.5625::DOUBLE) AS w, CASE WHEN {near('(x + z)')} = {near('x')} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS y FROM z),
    m AS (SELECT s_suppkey, sum(w * z) / sum(w) AS mz, sum(w * y) / sum(w) AS my FROM w GROUP BY 1)
    SELECT s_suppkey AS observation, 's_acctbal' AS feature, round(sum(w * (z - mz) * (y - my)) / sum(w * (z - mz) ** 2), 6) + 0.0 AS estimate, 1 AS rank FROM w JOIN m USING (s_suppkey) GROUP BY 1"""


@query(_lime_sql())
def lime_supplier(spark, sf):
    """Local slopes about each row of a fit of fixed centers on one feature, in closed form."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    fit = api.cluster(s, "kmeans", 3, id_col="s_suppkey", features=["s_acctbal"], scale=True, starts=[[[-1.0], [0.0], [1.0]]], iter_max=0)
    found = explain.lime_explain(fit, s, n_permutations=100).explanations
    return found.select("observation", "feature", (F.round("estimate", 6) + 0.0).alias("estimate"), "rank")


@query("WITH e AS (SELECT p_brand AS observation, p_type AS feature, avg(p_retailprice - 1400) / 1000 AS estimate FROM part GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY observation ORDER BY abs(estimate) DESC, feature) AS rank FROM e) SELECT observation, feature, round(estimate, 6) AS estimate, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3")
def rank_effects(spark, sf):
    e = table(spark, sf, "part").groupBy(F.col("p_brand").alias("observation"), F.col("p_type").alias("feature")).agg((F.avg(F.col("p_retailprice") - 1400) / 1000).alias("estimate"))
    return metrics.rank_effects(e, 3).select("observation", "feature", r6(F.col("estimate"), "estimate"), "rank")


# -- embeddings -----------------------------------------------------------------------------------


@query(f"WITH {PART_Z} SELECT round(var_samp(a), 6) AS v_size, round(covar_samp(a, b), 6) AS cov, round(var_samp(b), 6) AS v_price FROM z")
def pca_covariance(spark, sf):
    _, cov = embed.covariance(part_z(spark, sf), PART)
    return spark.createDataFrame([(round(float(cov[0, 0]), 6), round(float(cov[0, 1]), 6), round(float(cov[1, 1]), 6))], "v_size double, cov double, v_price double")


@query(
    """WITH l AS (SELECT o_orderkey, unnest(['o_orderstatus_' || o_orderstatus, 'o_orderpriority_' || regexp_replace(o_orderpriority, '[^A-Za-z0-9._]', '.', 'g')]) AS v FROM (SELECT o_orderkey, o_orderstatus, 'X' || o_orderpriority AS o_orderpriority FROM orders))
    SELECT a.v AS a, b.v AS b, CAST(count(*) AS BIGINT) AS n FROM l a JOIN l b ON a.o_orderkey = b.o_orderkey GROUP BY 1, 2"""
)
def mca_burt(spark, sf):
    o = table(spark, sf, "orders")
    names, counts, _ = embed.burt(o, "o_orderkey", ["o_orderstatus", "o_orderpriority"])
    rows = [(a, b, int(counts[i, j])) for i, a in enumerate(names) for j, b in enumerate(names) if counts[i, j] > 0]
    return spark.createDataFrame(rows, "a string, b string, n long")


def _signed(points: DataFrame) -> DataFrame:
    """Coordinates signed so that those of the least row_id are positive: axes have no direction of their own."""
    first = points.orderBy("row_id").first()
    return points.select("row_id", *((F.round(F.col(c) * (1.0 if first[c] >= 0 else -1.0), 6) + 0.0).alias(c) for c in ("x", "y")))


def _two_axes(z: str, scale: str) -> str:
    """SQL of the axes of two standardised columns a and b of z (i, a, b): their sum and difference."""
    return f"""{z}, r AS (SELECT CASE WHEN corr(a, b) >= 0 THEN 1 ELSE -1 END AS s FROM z), y AS (SELECT i, (a + s * b) / {scale} AS x, (a - s * b) / {scale} AS y FROM z, r),
    f AS (SELECT CASE WHEN x >= 0 THEN 1 ELSE -1 END AS fx, CASE WHEN y >= 0 THEN 1 ELSE -1 END AS fy FROM y ORDER BY i LIMIT 1) SELECT i AS row_id, round(x * fx, 6) + 0.0 AS x, round(y * fy, 6) + 0.0 AS y FROM y, f"""


@query(_two_axes("WITH z AS (SELECT p_partkey AS i, (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS a, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS b FROM part)", "sqrt(2.0::DOUBLE)"))
def pca_embedding(spark, sf):
    return _signed(embed.embed(table(spark, sf, "part"), "p_partkey", PART)[0])


_HALVES = "(t - avg(t) OVER ()) / stddev_pop(t) OVER ()"


@query(_two_axes(f"WITH h AS (SELECT c_custkey AS i, c_acctbal AS v, CASE WHEN c_nationkey < 9 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t FROM customer), z AS (SELECT i, (v - avg(v) OVER ()) / stddev_pop(v) OVER () AS a, {_HALVES} AS b FROM h)", "sqrt(2.0::DOUBLE)"))
def famd_embedding(spark, sf):
    """One number and one category of two levels: the axes are the sum and difference of their standard scores."""
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", F.when(F.col("c_nationkey") < 9, "low").otherwise("high").alias("part"))
    return _signed(embed.embed(c, "c_custkey", ["c_acctbal", "part"])[0])


_TURNED = """z AS (SELECT p_partkey AS i, p_size - avg(p_size) OVER () AS a, p_retailprice / 40 - avg(p_retailprice / 40) OVER () AS b FROM part), t AS (SELECT 0.5 * atan2(2 * covar_samp(a, b), var_samp(a) - var_samp(b)) AS t FROM z),
 y AS (SELECT i, cos(t) * a + sin(t) * b AS x, cos(t) * b - sin(t) * a AS y FROM z, t)"""


@query(f"WITH {_TURNED}, f AS (SELECT CASE WHEN x >= 0 THEN 1 ELSE -1 END AS fx, CASE WHEN y >= 0 THEN 1 ELSE -1 END AS fy FROM y ORDER BY i LIMIT 1) SELECT i AS row_id, round(x * fx, 6) + 0.0 AS x, round(y * fy, 6) + 0.0 AS y FROM y, f")
def mds_embedding(spark, sf):
    """Of two columns: they are turned to their main axes."""
    part = table(spark, sf, "part").select("p_partkey", "p_size", (F.col("p_retailprice") / 40).alias("price"))
    return _signed(embed.embed(part, "p_partkey", ["p_size", "price"], "mds")[0])


@query("WITH z AS (SELECT s_suppkey AS i, s_acctbal - avg(s_acctbal) OVER () AS x FROM supplier), f AS (SELECT CASE WHEN x >= 0 THEN 1 ELSE -1 END AS f FROM z ORDER BY i LIMIT 1) SELECT i AS row_id, round(x * f, 6) + 0.0 AS x, 0.0::DOUBLE AS y FROM z, f")
def mds_one_column(spark, sf):
    """A single column has a second axis of noughts."""
    return _signed(embed.embed(table(spark, sf, "supplier"), "s_suppkey", ["s_acctbal"], "mds")[0])


def _two_levels(spark, sf) -> DataFrame:
    return table(spark, sf, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "yes").otherwise("no").alias("filled"), F.when(F.col("o_totalprice") < 150000, "low").otherwise("high").alias("price"))


_LEVELS2 = "SELECT o_orderkey AS i, CASE WHEN o_orderstatus = 'F' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS t, CASE WHEN o_totalprice < 150000 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS u FROM orders"


@query(_two_axes(f"WITH h AS ({_LEVELS2}), z AS (SELECT i, {_HALVES} AS a, {_HALVES.replace('(t', '(u')} AS b FROM h)", "2.0::DOUBLE"))
def mca_embedding(spark, sf):
    return _signed(embed.embed(_two_levels(spark, sf), "o_orderkey", ["filled", "price"])[0])


@query(f"WITH h AS ({_LEVELS2}), p AS (SELECT avg(t) AS t, avg(u) AS u FROM h) SELECT variable, round(50 * (1 - share), 6) AS contribution FROM (SELECT 'filled_yes' AS variable, t AS share FROM p UNION ALL SELECT 'filled_no', 1 - t FROM p UNION ALL SELECT 'price_low', u FROM p UNION ALL SELECT 'price_high', 1 - u FROM p)")
def biplot_contributions(spark, sf):
    """Of the levels of two categories of two levels: half of what is not a level's own share."""
    _, _, extra = embed.mca(_two_levels(spark, sf), "o_orderkey", ["filled", "price"])
    return spark.createDataFrame([(v["variable"], round(v["contribution"], 6)) for v in embed.biplot(extra)], "variable string, contribution double")


# -- full fits ------------------------------------------------------------------------------------


@query()
def kmeans_part(spark, sf):
    return api.cluster(table(spark, sf, "part"), "kmeans", 3, id_col="p_partkey", features=PART, scale=True, seed=1).clusters


@query(
    """WITH s AS (SELECT s_suppkey AS i, s_acctbal AS v FROM supplier), t AS (SELECT a.i AS a, b.i AS b, (SELECT sum(least(abs(s.v - a.v), abs(s.v - b.v))) FROM s) AS cost FROM s a JOIN s b ON a.i < b.i), m AS (SELECT a, b FROM t ORDER BY cost, a, b LIMIT 1)
    SELECT s.i AS row_id, CASE WHEN abs(s.v - x.v) <= abs(s.v - y.v) THEN m.a ELSE m.b END AS medoid FROM s, m JOIN s x ON x.i = m.a JOIN s y ON y.i = m.b"""
)
def pam_supplier(spark, sf):
    """Rows with their medoids; SQL tries all pairs of rows as medoids."""
    fit = api.cluster(table(spark, sf, "supplier"), "pam", 2, id_col="s_suppkey", features=["s_acctbal"], scale=True, distributed=True)
    medoid = F.element_at(F.array(*(F.lit(p["row_id"]) for p in api.prototypes(fit, rounded=False))), F.col("cluster"))
    return fit.clusters.select("row_id", medoid.alias("medoid"))


def _gaps_sql(k: int) -> str:
    """Single linkage of one column: the rows in order, cut at the k - 1 widest gaps; ids by the least row."""
    return f"""WITH o AS (SELECT s_suppkey AS i, s_acctbal AS v, s_acctbal - lag(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) AS gap FROM supplier), w AS (SELECT i, row_number() OVER (ORDER BY gap DESC NULLS LAST) AS wide FROM o),
    p AS (SELECT o.i, sum(CASE WHEN wide < {k} THEN 1 ELSE 0 END) OVER (ORDER BY v, o.i) AS part FROM o JOIN w ON o.i = w.i), f AS (SELECT part, row_number() OVER (ORDER BY min(i)) AS id FROM p GROUP BY part)
    SELECT p.i AS row_id, CAST(id AS INTEGER) AS cluster FROM p JOIN f USING (part)"""


@query(_gaps_sql(4))
def hclust_supplier(spark, sf):
    return api.cluster(table(spark, sf, "supplier"), "hclust", 4, id_col="s_suppkey", features=["s_acctbal"], linkage="single", spanning=True).clusters


@query("WITH g AS (SELECT s_acctbal - lag(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) AS gap FROM supplier) SELECT CAST(row_number() OVER (ORDER BY gap) AS INTEGER) AS step, round(gap, 6) AS height FROM g WHERE gap IS NOT NULL")
def dendrogram_supplier(spark, sf):
    fit = api.cluster(table(spark, sf, "supplier"), "hclust", 4, id_col="s_suppkey", features=["s_acctbal"], linkage="single", spanning=True)
    return plotspec.plot_dendrogram(fit).data.select("step", r6(F.col("height"), "height"))


SIL_ROWS = """e AS (SELECT s_suppkey AS i, s_nationkey % 3 AS g, s_acctbal AS x FROM supplier), p AS (SELECT a.i, a.g, b.g AS h, avg(abs(a.x - b.x)) AS d FROM e a JOIN e b ON a.i <> b.i GROUP BY 1, 2, 3),
 w AS (SELECT i, g, min(CASE WHEN h = g THEN d END) AS a, min(CASE WHEN h <> g THEN d END) AS b, min_by(h, (d, h)) FILTER (h <> g) AS o FROM p GROUP BY 1, 2)"""


@query(f"WITH {SIL_ROWS} SELECT i AS row_id, CAST(g AS INTEGER) AS cluster, CAST(o AS INTEGER) AS neighbour, round((b - a) / greatest(a, b), 6) AS width FROM w")
def silhouette_plot_supplier(spark, sf):
    s = table(spark, sf, "supplier")
    fit = api.cluster(s, "kmeans", 3, id_col="s_suppkey", features=["s_acctbal"], starts=[[[-1.0], [0.0], [1.0]]], iter_max=0)
    labels = s.select(F.col("s_suppkey").alias("row_id"), (F.col("s_nationkey") % 3).cast("int").alias("cluster"))
    return plotspec.plot_silhouette(replace(fit, clusters=labels)).data.select("row_id", "cluster", "neighbour", r6(F.col("width"), "width"))


@query(
    _two_axes("WITH z AS (SELECT p_partkey AS i, (p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER () AS a, (p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER () AS b FROM part)", "sqrt(2.0::DOUBLE)").replace(
        " FROM y, f", f", CASE WHEN {SQL_D[0]} <= {SQL_D[1]} AND {SQL_D[0]} <= {SQL_D[2]} THEN 1 WHEN {SQL_D[1]} <= {SQL_D[2]} THEN 2 ELSE 3 END AS cluster FROM y JOIN z USING (i), f"
    ).replace("SELECT i AS row_id", "SELECT y.i AS row_id")
)
def plot_clusters_part(spark, sf):
    """The points of a cluster plot: two components and the cluster."""
    data = plotspec.plot_clusters(fixed_fit(spark, sf), "pca").data
    return _signed(data).join(data.select("row_id", "cluster"), "row_id")


@query(_gaps_sql(5))
def agnes_gower_supplier(spark, sf):
    """Of a distance table; Gower's dissimilarity of one number is its gap over the range."""
    pairs = mixed_distance(table(spark, sf, "supplier"), "s_suppkey", ["s_acctbal"])
    return api.cluster(pairs, "agnes", 5, linkage="single", spanning=True).clusters


@query(
    f"""WITH RECURSIVE {PART_Z}, e AS (SELECT x.p_partkey AS i, y.p_partkey AS j FROM z x JOIN z y ON x.a BETWEEN y.a - {EPS} AND y.a + {EPS} AND sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) <= {EPS}),
    r(i, root) AS (SELECT p_partkey, p_partkey FROM z UNION SELECT e.j, r.root FROM r JOIN e ON r.i = e.i WHERE r.root < e.j), f AS (SELECT i, min(root) AS root FROM r GROUP BY i)
    SELECT i AS row_id, CAST(dense_rank() OVER (ORDER BY root) AS INTEGER) AS cluster FROM f"""
)
def single_linkage_part(spark, sf):
    """The spanning tree of two columns, cut at a height."""
    fit = api.cluster(table(spark, sf, "part"), "hclust", 2, id_col="p_partkey", features=PART, scale=True, linkage="single", spanning=True)
    return cut_at(fit, EPS)


EMB_EPS = 1.2


@query(
    f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)
    SELECT a.vec_id AS row_id, CAST(count(*) AS BIGINT) AS n FROM v a JOIN v b ON list_distance(a.x, b.x) <= {EMB_EPS} GROUP BY 1"""
)
def eps_counts_embeddings(spark, sf):
    """Neighbours within a radius in all dimensions of a vector column."""
    e = emb(spark, sf)
    return eps_counts(e, e, EMB_EPS)


@query(
    """WITH s AS (SELECT s_suppkey AS i, s_nationkey AS n FROM supplier), p AS (SELECT k, a.i, a.n % k = b.n % k AS own, b.n % k AS h, avg((CAST(a.n % 2 <> b.n % 2 AS INT) + CAST(a.n % 4 <> b.n % 4 AS INT) + CAST(a.n % 8 <> b.n % 8 AS INT)) / 3) AS d FROM unnest([2, 4]) t(k), s a JOIN s b ON a.i <> b.i GROUP BY ALL),
    w AS (SELECT k, i, min(d) FILTER (own) AS a, min(d) FILTER (NOT own) AS b FROM p GROUP BY 1, 2), m AS (SELECT k, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS v FROM w GROUP BY 1), best AS (SELECT k FROM m ORDER BY round(v, 9) DESC, k LIMIT 1)
    SELECT i AS row_id, CAST(dense_rank() OVER (ORDER BY least) AS INTEGER) AS cluster FROM (SELECT i, min(i) OVER (PARTITION BY n % k) AS least FROM s, best)"""
)
def consensus_average(spark, sf):
    """Average linkage of nested partitions, whose consensus distances are an ultrametric: its cuts are the partitions."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("row_id"), "s_nationkey")
    labels = None
    for c, m in enumerate((2, 4, 8)):
        part = s.select(F.lit(c + 1).alias("candidate"), "row_id", (F.col("s_nationkey") % m + 1).cast("int").alias("cluster"))
        labels = part if labels is None else labels.unionByName(part)
    return consensus.consensus(labels, [2, 4])[0]


@query()
def gmm_part(spark, sf):
    return api.cluster(table(spark, sf, "part"), "gmm", 2, id_col="p_partkey", features=PART, scale=True, seed=1).clusters


@query()
def kproto_customer(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    return api.cluster(c, "kproto", 3, id_col="c_custkey", scale=True, seed=1).clusters


@query()
def kmm_customer(spark, sf):
    return api.cluster(gapped(spark, sf), "kmm", 3, id_col="c_custkey", seed=1).clusters


@query()
def metacluster_supplier(spark, sf):
    s = table(spark, sf, "supplier")
    return consensus.metacluster(s, ("kmeans", "pam", "hclust"), range(2, 7), id_col="s_suppkey", features=["s_acctbal"], scale=True, seed=1).final_clusters


# -- streams by micro-batch -----------------------------------------------------------------------


@query(
    f"""WITH {PART_Z}, t AS (SELECT p_partkey AS i, a, b, CASE WHEN a < 0 AND b < 0 THEN 1 WHEN a >= 0 AND b >= 0 THEN 2 ELSE 0 END AS g FROM z),
    n AS (SELECT x.i, min_by(y.g, (sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2), y.i)) AS g FROM t x JOIN t y ON y.g > 0 AND x.a BETWEEN y.a - {EPS} AND y.a + {EPS} AND sqrt((x.a - y.a) ** 2 + (x.b - y.b) ** 2) <= {EPS} GROUP BY 1)
    SELECT t.i AS row_id, CAST(coalesce(n.g, 0) AS INTEGER) AS cluster FROM t LEFT JOIN n USING (i)"""
)
def stream_dbscan_part(spark, sf):
    """A stream of rows joined with the training rows of a density fit of given labels, batch by batch."""
    z = part_z(spark, sf).withColumnsRenamed({"p_size": "a", "p_retailprice": "b"})
    low, high = (F.col("a") < 0) & (F.col("b") < 0), (F.col("a") >= 0) & (F.col("b") >= 0)
    labels = z.select(F.col("p_partkey").alias("row_id"), F.when(low, 1).when(high, 2).otherwise(0).alias("cluster"))
    info = DataInfo(z.count(), "p_partkey", ("a", "b"), "matrix", None, z, {"a": "numeric", "b": "numeric"})
    fit = ClusterFit("dbscan", {"eps": EPS}, labels, 2, info, training=vectors(z, "p_partkey", ["a", "b"]))
    source, out = scratch(spark, "arriving"), scratch(spark, "assigned")
    z.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(z.schema).option("maxFilesPerTrigger", 1).parquet(source)
    assign.by_batch(fit, stream, out).awaitTermination()
    return assign.assigned(spark, out).select("row_id", "cluster")


# -- consensus of fixed fits, and plots -----------------------------------------------------------

_GAPS = """o AS (SELECT s_suppkey AS i, s_acctbal AS v, s_acctbal - lag(s_acctbal) OVER (ORDER BY s_acctbal, s_suppkey) AS gap FROM supplier), w AS (SELECT i, v, row_number() OVER (ORDER BY gap DESC NULLS LAST) AS wide FROM o),
 g AS (SELECT i, v, count(*) FILTER (wide < 2) OVER (ORDER BY v, i) AS g2, count(*) FILTER (wide < 4) OVER (ORDER BY v, i) AS g4 FROM w)"""
_FINAL = f"""{_GAPS}, p AS (SELECT k, a.i, CASE k WHEN 2 THEN a.g2 = b.g2 ELSE a.g4 = b.g4 END AS own, CASE k WHEN 2 THEN b.g2 ELSE b.g4 END AS h, avg((CAST(a.g2 <> b.g2 AS INT) + CAST(a.g4 <> b.g4 AS INT)) / 2) AS d FROM unnest([2, 4]) t(k), g a JOIN g b ON a.i <> b.i GROUP BY ALL),
 u AS (SELECT k, i, min(d) FILTER (own) AS a, min(d) FILTER (NOT own) AS b FROM p GROUP BY 1, 2), m AS (SELECT k, avg(CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) AS v FROM u GROUP BY 1), best AS (SELECT k FROM m ORDER BY round(v, 9) DESC, k LIMIT 1),
 final AS (SELECT i, v, CAST(dense_rank() OVER (ORDER BY least) AS INTEGER) AS cluster FROM (SELECT i, v, min(i) OVER (PARTITION BY CASE k WHEN 2 THEN g2 ELSE g4 END) AS least FROM g, best))"""


def _single_consensus(spark, sf):
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    return consensus.metacluster(s, ("hclust", "agnes"), [2, 4], id_col="s_suppkey", features=["s_acctbal"], linkage="single", spanning=True)


@query(f"WITH {_FINAL} SELECT i AS row_id, cluster FROM final")
def metacluster_single(spark, sf):
    """Consensus of single-linkage fits, which are nested: k by the silhouettes of the consensus."""
    return _single_consensus(spark, sf).final_clusters


@query(f"WITH {_GAPS} SELECT a.i, b.i AS j, (CAST(a.g2 = b.g2 AS INT) + CAST(a.g4 = b.g4 AS INT)) / 2.0::DOUBLE AS agreement FROM g a JOIN g b ON a.g2 = b.g2")
def plot_coassoc_supplier(spark, sf):
    return plotspec.plot_coassoc(_single_consensus(spark, sf)).data


@query(f"WITH {_FINAL}, z AS (SELECT i, cluster, v - avg(v) OVER () AS x FROM final), f AS (SELECT CASE WHEN x >= 0 THEN 1 ELSE -1 END AS f FROM z ORDER BY i LIMIT 1) SELECT i AS row_id, round(x * f / (SELECT stddev_samp(v) FROM final), 6) + 0.0 AS x, 0.0::DOUBLE AS y, cluster FROM z, f")
def plot_consensus_supplier(spark, sf):
    data = plotspec.plot_consensus(_single_consensus(spark, sf), "pca").data
    return _signed(data).join(data.select("row_id", "cluster"), "row_id")


@query(ORACLES["plot_clusters_part"].replace(" AS cluster FROM y", " AS cluster, 1.0::DOUBLE AS cos2 FROM y"))
def plot_biplot_part(spark, sf):
    """Of two columns both axes are all there is: every row is wholly in the plane."""
    data = plotspec.plot_biplot(fixed_fit(spark, sf), "cos2").data
    return _signed(data).join(data.select("row_id", "cluster", r6(F.col("cos2"), "cos2")), "row_id")


@query(ORACLES["biplot_contributions"] + " ORDER BY contribution DESC, variable LIMIT 3")
def biplot_top(spark, sf):
    """The variables that contribute most."""
    _, _, extra = embed.mca(_two_levels(spark, sf), "o_orderkey", ["filled", "price"])
    return spark.createDataFrame([(v["variable"], round(v["contribution"], 6)) for v in embed.biplot(extra, 3)], "variable string, contribution double")


@query(ORACLES["mca_embedding"])
def mca_by_passes(spark, sf):
    """The embedding of mca_embedding by passes over the rows, as of many levels."""
    return _signed(embed.mca_wide(_two_levels(spark, sf), "o_orderkey", ["filled", "price"])[0])


@query(f"SELECT cluster, feature, mean FROM ({ORACLES['explore_profiles']}) WHERE feature = 'p_size'")
def plot_profiles_part(spark, sf):
    return plotspec.plot_feature_profiles(fixed_fit(spark, sf), ["p_size"]).data.select("cluster", "feature", r6(F.col("mean"), "mean"))


@query(f"SELECT 'p_size' AS feature, instability AS importance FROM ({ORACLES['importance_md5']})")
def plot_importance_part(spark, sf):
    found = explain.feature_importance(fixed_fit(spark, sf), table(spark, sf, "part"), ["p_size"], n_repeats=1, seed=7)
    return plotspec.plot(found).data.select("feature", r6(F.col("importance"), "importance"))


_TURNED_SUPPLIER = """z AS (SELECT s_suppkey AS i, s_nationkey - avg(s_nationkey) OVER () AS a, s_acctbal / 400 - avg(s_acctbal / 400) OVER () AS b FROM supplier), q AS (SELECT 0.5 * atan2(2 * covar_samp(a, b), var_samp(a) - var_samp(b)) AS t FROM z),
 y AS (SELECT i, cos(t) * a + sin(t) * b AS x, cos(t) * b - sin(t) * a AS y FROM z, q)"""


@query(f"WITH {_TURNED_SUPPLIER}, f AS (SELECT CASE WHEN x >= 0 THEN 1 ELSE -1 END AS fx, CASE WHEN y >= 0 THEN 1 ELSE -1 END AS fy FROM y ORDER BY i LIMIT 1) SELECT i AS row_id, round(x * fx, 6) + 0.0 AS x, round(y * fy, 6) + 0.0 AS y FROM y, f")
def mds_pairs_supplier(spark, sf):
    """Scaling of a table of distances by passes over it: of two columns these turn to their main axes."""
    s = table(spark, sf, "supplier").select("s_suppkey", "s_nationkey", (F.col("s_acctbal") / 400).alias("b"))
    return _signed(embed.mds_of_pairs(euclidean_pairs(vectors(s, "s_suppkey", ["s_nationkey", "b"])), iterated=True)[0])
