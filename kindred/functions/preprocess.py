"""Feature typing, checks, imputation, encoding and scaling. Fitted steps are frozen and applied by name."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kindred.functions.expr import missing
from kindred.functions.quantile import medians as exact_medians

NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)
WHOLE = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


class UnsupportedFeatureType(ValueError):
    pass


def feature_type(kind: T.DataType) -> str:
    if isinstance(kind, NUMERIC):
        return "numeric"
    if isinstance(kind, (T.StringType, T.BooleanType)):
        return "categorical"
    return "unsupported"


def feature_types(df: DataFrame, features: list[str], ordinal: tuple[str, ...] = (), promote: bool = True, most_levels: int = 10) -> dict[str, str]:
    """numeric, categorical or ordinal by column; with ``promote``, whole-number columns of up to
    ``most_levels`` distinct values are categorical. One aggregate at most."""
    out = {}
    for f in features:
        out[f] = "ordinal" if f in ordinal else feature_type(df.schema[f].dataType)
        if out[f] == "unsupported":
            raise UnsupportedFeatureType(f"column `{f}` of type {df.schema[f].dataType.simpleString()} is not supported")
    whole = [f for f in features if out[f] == "numeric" and isinstance(df.schema[f].dataType, WHOLE)]
    if promote and whole:
        counts = df.agg(*(F.countDistinct(f).alias(f) for f in whole)).first()
        out.update({f: "categorical" for f in whole if counts[f] <= most_levels})
    return out


def check_input(df: DataFrame, id_col: str, features: list[str]) -> int:
    """Number of rows; raises on no columns, no rows, or a column without any value."""
    if id_col not in df.columns:
        raise ValueError(f"id column `{id_col}` is missing; row identity is by column")
    if not features:
        raise ValueError("at least one feature column is required")
    row = df.agg(F.count("*").alias("_n"), *(F.count(f).alias(f) for f in features)).first()
    if not row["_n"]:
        raise ValueError("at least one row is required")
    for f in features:
        if not row[f]:
            raise ValueError(f"column `{f}` has no values")
    return row["_n"]


def check_numeric(df: DataFrame, id_col: str, features: list[str]) -> int:
    for f in features:
        if feature_type(df.schema[f].dataType) != "numeric":
            raise ValueError(f"column `{f}` is not numeric; encode first with prepare_mixed_data() or measure with mixed_distance()")
    return check_input(df, id_col, features)


@dataclass(frozen=True)
class Scaler:
    """(x - mean) / sd by feature; where a standard deviation is 0 or missing the result is 0."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    sd: tuple[float, ...] | None

    def column(self, f: str, c: Column | None = None) -> Column:
        i = self.features.index(f)
        c = (F.col(f"`{f}`") if c is None else c).cast("double") - F.lit(self.mean[i])
        if self.sd is None:
            return c
        sd = self.sd[i]
        return c / F.lit(sd) if sd and sd == sd else F.when(c.isNull(), c).otherwise(F.lit(0.0))

    def apply(self, df: DataFrame, keep: list[str]) -> DataFrame:
        return df.select(*keep, *(self.column(f).alias(f) for f in self.features))

    def restore(self, f: str, value: float) -> float:
        i = self.features.index(f)
        return value * (self.sd[i] if self.sd else 1.0) + self.mean[i]


def fit_scaler(df: DataFrame, features: list[str], center: bool = True, scale: bool = False) -> Scaler:
    """scale without center centers too."""
    if not (center or scale):
        return Scaler(tuple(features), (0.0,) * len(features), None)
    row = df.agg(*(F.avg(F.col(f"`{f}`").cast("double")).alias(f"m_{i}") for i, f in enumerate(features)), *(F.stddev_samp(F.col(f"`{f}`").cast("double")).alias(f"s_{i}") for i, f in enumerate(features))).first()
    mean = tuple(float(row[f"m_{i}"] or 0.0) for i in range(len(features)))
    return Scaler(tuple(features), mean, tuple(float(row[f"s_{i}"] or 0.0) for i in range(len(features))) if scale else None)


def make_name(level: str) -> str:
    """A level as part of a column name."""
    name = re.sub(r"[^A-Za-z0-9._]", ".", level)
    return name if re.match(r"[A-Za-z]|\.(?![0-9])", name) else f"X{name}"


@dataclass(frozen=True)
class Encoder:
    """Frozen imputation, one-hot levels and scaling of a mixed table."""

    types: dict[str, str]
    medians: dict[str, float]
    levels: dict[str, list[str]]
    columns: tuple[str, ...]
    scaler: Scaler | None = field(default=None)

    def raw(self) -> list[Column]:
        out = []
        for f, kind in self.types.items():
            if kind == "numeric":
                c = F.col(f).cast("double")
                out.append(F.when(missing(c, True), F.lit(self.medians[f])).otherwise(c).alias(f))
            else:
                filled = F.coalesce(F.col(f).cast("string"), F.lit("missing"))
                out += [F.when(filled == level, 1.0).otherwise(0.0).alias(f"{f}_{make_name(level)}") for level in self.levels[f]]
        return out

    def apply(self, df: DataFrame, id_col: str) -> DataFrame:
        encoded = df.select(id_col, *self.raw())
        return self.scaler.apply(encoded, [id_col]) if self.scaler else encoded


def fit_encoder(df: DataFrame, id_col: str, features: list[str], center: bool = True, scale: bool = True, drop_first: bool = False, na_action: str = "keep", promote: bool = True, most_levels: int = 10_000) -> Encoder:
    """Medians (0 where there is none), sorted levels with "missing" where values are, and the scaler
    of all encoded columns. A categorical column of over ``most_levels`` levels is an error."""
    check_input(df, id_col, features)
    types = feature_types(df, features, promote=promote)
    numeric = [f for f in features if types[f] == "numeric"]
    other = [f for f in features if types[f] != "numeric"]
    if na_action not in ("keep", "fail"):
        raise ValueError("na_action must be keep or fail")
    clean = {f: F.when(missing(F.col(f).cast("double"), True), None).otherwise(F.col(f).cast("double")) for f in numeric}
    gaps = df.agg(F.count("*").alias("_n"), *(F.count(c).alias(f) for f, c in clean.items()), *(F.count(f).alias(f) for f in other)).first()
    if na_action == "fail" and any(gaps[f] < gaps["_n"] for f in features):
        raise ValueError("missing values found; na_action is fail")
    levels = {}
    for f in other:
        found = df.select(F.col(f).cast("string").alias("v")).where("v is not null").distinct().limit(most_levels + 1).collect()
        if len(found) > most_levels:
            raise ValueError(f"column `{f}` has more than {most_levels} levels")
        levels[f] = sorted({r.v for r in found} | ({"missing"} if gaps[f] < gaps["_n"] else set()))[int(drop_first) :]
    found = {}
    if numeric:
        tall = df.select(*(c.alias(f) for f, c in clean.items())).unpivot([], [f"`{f}`" for f in numeric], "feature", "value")
        found = {r["feature"]: r["median"] for r in exact_medians(tall, ["feature"], "value").collect()}
    medians = {f: float(found.get(f) or 0.0) for f in numeric}
    plain = Encoder(types, medians, levels, ())
    columns = tuple(plain.apply(df, id_col).columns[1:])
    scaler = fit_scaler(plain.apply(df, id_col), list(columns), center, scale) if center or scale else None
    return Encoder(types, medians, levels, columns, scaler)


def prepare_mixed_data(df: DataFrame, id_col: str, features: list[str], **options) -> DataFrame:
    return fit_encoder(df, id_col, features, **options).apply(df, id_col)
