"""Mixing sources to target weights over a time-varying curriculum.

A source has a weight schedule, linear between knots of training time 0 to 1. Its integral is the
source's weight. Targets share the demand (``share`` times all words) by weight; a target stops at
``most`` times its source's size and the excess is shared again by weight.

In a source, documents are laid end to end in an order fixed by a hash of the id; their cumulative
size is a demand of tokens, and a copy is taken if its middle lies within the target. Each copy's
training position is the time at which the source's integrated schedule has met the demand before it:
the inverse of a piecewise quadratic, in closed form. The mix is range-sorted by position.

The cumulative sizes come from two levels, so that a source with a third of all rows is spread out:
hash ranges of about ``bucket_rows`` documents are summed, the sums accumulated, and documents are
accumulated within their range only. Ranks and targets of sources are running sums over the source table
in two levels too, so any number of sources will do.

Defined cases: a null text has no words and is never taken; a null source is a source, the last; a
null id has a place by its text; rows that repeat an id count each; an empty table gives no rows; columns
of docs that are named like those the mix adds (epoch, position) are replaced by these.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kindred.llm.common import Shelf

SPACES = " \t\n\x0b\x0c\r"
#: Weights of the sources in turn, each with the shape of its schedule: knots of (time, factor), integral 1.
TURNS = (
    (5.0, ((0.0, 1.5), (1.0, 0.5))),
    (2.0, ((0.0, 1.0), (1.0, 1.0))),
    (1.0, ((0.0, 0.5), (1.0, 1.5))),
)


@dataclass(frozen=True)
class Schedule:
    """Knots (time, weight) from time 0 to time 1."""

    knots: tuple[tuple[float, float], ...]

    def integrals(self) -> list[float]:
        out = [0.0]
        for (t0, w0), (t1, w1) in zip(self.knots, self.knots[1:], strict=False):
            out.append(out[-1] + (t1 - t0) * (w0 + w1) / 2)
        return out


def running(shelf: Shelf, name: str, df: DataFrame, order: list[Column], **values: Column) -> DataFrame:
    """df with the sums of ``values`` over the rows before each, in this order of all rows. The order is cut
    into ranges, their sums are accumulated, and rows are accumulated within their range."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_range", F.spark_partition_id())
    ranged = shelf.put(ranged, name)
    sums = ranged.groupBy("_range").agg(*(F.sum(v).alias(f"_{c}") for c, v in values.items()))
    # a row for each range
    whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    ahead = sums.select("_range", *(F.coalesce(F.sum(f"_{c}").over(whole), F.lit(0)).alias(f"_{c}") for c in values))
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = ranged.join(ahead, "_range")
    return out.select(*df.columns, *((F.coalesce(F.sum(v).over(within), F.lit(0)) + F.col(f"_{c}")).alias(c) for c, v in values.items()))


def goals(shelf: Shelf, sources: DataFrame, turns, named: dict[str | None, Schedule], share: float, most: float) -> DataFrame:
    """(source, s, n) with a number (rank), weight, schedule (t, w, cum) and target: demand by weight, none above ``most`` times
    its size; the excess is shared again by weight."""
    ranked = running(shelf, "ranked", sources, [F.col("source").asc_nulls_last()], rank=F.lit(1))
    plans = [Schedule(tuple((t, w * f) for t, f in shape)) for w, shape in turns]
    parts = lambda plan: F.struct(*(F.array(*(F.lit(float(x)) for x in xs)).alias(c) for c, xs in (("t", [t for t, _ in plan.knots]), ("w", [w for _, w in plan.knots]), ("cum", plan.integrals()))))
    plan = F.lit(None)
    for i, own in enumerate(plans):
        plan = F.when(F.col("rank") % len(plans) == i, parts(own)).otherwise(plan)
    for source, own in named.items():
        plan = F.when(F.col("source").eqNullSafe(F.lit(source)), parts(own)).otherwise(plan)
    weighed = ranked.withColumn("plan", plan).select("source", "s", "n", "rank", "plan.*").withColumn("weight", F.element_at("cum", -1))
    cap = F.lit(float(most)) * F.col("s")
    total = weighed.agg(F.sum("s"), F.sum("weight")).first()
    by = [F.when(F.col("weight") > 0, cap / F.nullif(F.col("weight"), F.lit(0.0))).asc_nulls_last(), F.col("source").asc_nulls_last()]
    left = running(shelf, "left", weighed.where("weight > 0"), by, capped=cap, weights=F.col("weight"))
    rest, others = F.lit(float(share)) * F.lit(total[0] or 0) - F.col("capped"), F.lit(total[1] or 0.0) - F.col("weights")
    # from the first source on whose part is within its cap, all get the same rate
    rate = left.where(F.col("weight") * rest / others <= cap).agg(F.min_by(F.struct(rest, others), F.struct(cap / F.col("weight"), F.col("source").isNull(), "source"))).first()[0]
    target = cap if rate is None else F.least(cap, F.col("weight") * F.lit(rate[0]) / F.lit(rate[1]))
    return weighed.withColumn("target", F.when(F.col("weight") > 0, target).otherwise(F.lit(0.0)))


def n_words(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(SPACES))
    return F.when(trimmed.isNull() | (trimmed == ""), F.lit(0)).otherwise(F.size(F.split(trimmed, r"[\x20\x09-\x0D]+"))).cast("long")


def inverse(x: Column, t: Column, w: Column, cum: Column) -> Column:
    """The time at which the schedule's integral reaches x times its whole."""
    at = F.greatest(F.lit(1), F.least(F.size(F.filter(cum, lambda c: c <= x * F.element_at(cum, -1))), F.size(cum) - 1))
    t0, w0, t1, w1 = F.element_at(t, at), F.element_at(w, at), F.element_at(t, at + 1), F.element_at(w, at + 1)
    rest = x * F.element_at(cum, -1) - F.element_at(cum, at)
    root = w0 + F.sqrt(F.greatest(F.lit(0.0), w0 * w0 + 2 * rest * (w1 - w0) / (t1 - t0)))
    return F.when(root > 0, F.least(t1, t0 + 2 * rest / root)).otherwise(t0)


def lay_out(
    docs: DataFrame, turns=TURNS, named: dict[str | None, Schedule] | None = None, share: float = 1.5, most: float = 2.0, seed: int = 0, keep: list[str] | None = None,
    id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", bucket_rows: int = 4096,
) -> DataFrame:
    """(row, key, size, source_size, target, copies, taken, positions) of each row of docs, in no order.

    ``row`` is a struct of the columns ``keep`` (default: all), ``key`` what orders the documents of a source.
    ``turns`` (weight, shape) are dealt to the sources by code point, null last; ``named`` sources have schedules of their own."""
    shelf = Shelf(docs.sparkSession, "mix")
    row = F.struct(*(F.col(f"`{c}`") for c in (keep or docs.columns))).alias("row")
    doc_id, text = F.col(f"`{id_col}`").cast("string"), F.col(f"`{text_col}`")
    key = F.md5(F.concat(F.coalesce(doc_id, F.lit("")), F.lit(f":{seed}"), F.when(doc_id.isNull(), F.concat(F.lit(":"), F.md5(F.coalesce(text, F.lit("")).cast("binary")))).otherwise(F.lit("")))).alias("key")
    sized = shelf.put(docs.select(row, F.col(f"`{source_col}`").alias("source"), n_words(text).alias("size"), key), "sized")
    found = sized.groupBy("source").agg(F.sum("size").alias("s"), F.count("*").alias("n"))
    sources = shelf.put(goals(shelf, found, turns, named or {}, share, most), "sources")
    shelf.drop("ranked", "left")
    own = sources.select(F.col("source").alias("own"), F.col("rank").alias("sid"), F.ceil(F.col("n") / bucket_rows).cast("long").alias("parts"))
    bucket = F.floor(F.conv(F.substring("key", 1, 8), 16, 10).cast("long") * F.col("parts") / F.lit(2**32)).cast("long")
    placed = sized.join(own, F.col("source").eqNullSafe(F.col("own"))).select("row", "size", "key", "sid", bucket.alias("bucket"))
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("b"))
    ahead = sums.select("sid", "bucket", (F.sum("b").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("b")).alias("offset"))
    # window and join are by the same keys, so rows are shuffled once
    within = Window.partitionBy("sid", "bucket").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)
    start = (F.col("offset") + F.sum("size").over(within) - F.col("size")).alias("start")
    laid = placed.join(ahead, ["sid", "bucket"]).select("row", "key", "size", "sid", start)
    plans = sources.select(F.col("rank").alias("sid"), F.col("s").alias("source_size"), "target", "t", "w", "cum")
    laid = laid.join(plans, "sid")
    copies = F.when((F.col("source_size") > 0) & (F.col("size") > 0), F.greatest(F.lit(0), F.ceil((F.col("target") - F.col("start") - F.col("size") / 2.0) / F.col("source_size")))).otherwise(F.lit(0))
    counted = laid.withColumn("copies", F.least(copies, F.lit(int(most))).cast("int"))
    met = lambda j: F.least(F.lit(1.0), (j * F.col("source_size") + F.col("start")) / F.col("target"))
    positions = F.when(F.col("copies") > 0, F.transform(F.sequence(F.lit(0), F.col("copies") - 1), lambda j: inverse(met(j), F.col("t"), F.col("w"), F.col("cum")))).otherwise(F.array().cast("array<double>"))
    return counted.select("row", "key", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"), positions.alias("positions"))


def mix(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of lay_out, range-sorted by first position; rows that are not taken come last, by key."""
    after = 1 + F.conv(F.substring("key", 1, 8), 16, 10).cast("double") / 2**32
    return lay_out(docs, **parameters).orderBy(F.coalesce(F.get("positions", F.lit(0)), after))


def training_order(docs: DataFrame, **parameters) -> DataFrame:
    """The mix: a row for each copy, range-sorted by training position; the columns of docs, then epoch and position."""
    mixed = lay_out(docs, **parameters).where(F.col("copies") > 0)
    columns = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() not in ("epoch", "position")]
    return mixed.select("row", F.posexplode("positions").alias("epoch", "position")).select(*columns, "epoch", "position").orderBy("position")


def oracle(table: str = "documents") -> str:
    """DuckDB: the rows of op5 for TURNS, share 1.5 and most 2."""
    return f"""
    WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
                      md5(concat(coalesce(CAST(doc_id AS VARCHAR), ''), ':0', CASE WHEN doc_id IS NULL THEN concat(':', md5(coalesce(text, ''))) ELSE '' END)) AS key FROM {table}),
    s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
    r AS (SELECT *, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS turn FROM s),
    w AS (SELECT *, CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM r),
    o AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER p, 0) AS rest,
                 sum(weight) OVER () - coalesce(sum(weight) OVER p, 0) AS others
          FROM w WINDOW p AS (ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    f AS (SELECT rest, others FROM o WHERE weight * rest / others <= 2.0::DOUBLE * source_size ORDER BY 2.0::DOUBLE * source_size / weight, source NULLS LAST LIMIT 1),
    t AS (SELECT w.source, w.turn, w.source_size, least(2.0::DOUBLE * source_size, weight * f.rest / f.others) AS target FROM w, f),
    c AS (SELECT doc_id, size, t.source_size, t.target, t.turn,
                 CAST(sum(size) OVER (PARTITION BY d.source ORDER BY key, size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS start
          FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
    k AS (SELECT *, CASE WHEN size = 0 THEN 0 ELSE CAST(least(2, greatest(0, ceil((target - start - size / 2.0::DOUBLE) / source_size))) AS BIGINT) END AS copies,
                 least(1.0::DOUBLE, start / target) AS x, least(1.0::DOUBLE, (source_size + start) / target) AS x2 FROM c),
    z AS (SELECT *, CASE turn WHEN 0 THEN 7.5::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 0.5::DOUBLE END AS w0,
                    CASE turn WHEN 0 THEN -5.0::DOUBLE WHEN 1 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS slope,
                    x * CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS met,
                    x2 * CASE turn WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS met2 FROM k)
    SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken,
           CASE WHEN copies > 0 THEN round(least(1.0::DOUBLE, 2 * met / (w0 + sqrt(greatest(0.0::DOUBLE, w0 * w0 + 2 * met * slope)))), 6) END AS position,
           CASE WHEN copies > 1 THEN round(least(1.0::DOUBLE, 2 * met2 / (w0 + sqrt(greatest(0.0::DOUBLE, w0 * w0 + 2 * met2 * slope)))), 6) END AS position_2
    FROM z"""
