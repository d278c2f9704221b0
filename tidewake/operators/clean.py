"""Cleaning: points, times, filters, duplicates, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import AIS, Spec
from ..functions.exprs import mercator_x, mercator_y


def with_points(df: DataFrame, s: Spec = AIS, mercator: bool = False) -> DataFrame:
    df = df.withColumn("geom", F.struct(F.col(s.lon).alias("x"), F.col(s.lat).alias("y")))
    return df.withColumn("merc_x", mercator_x(s.lon)).withColumn("merc_y", mercator_y(s.lat)) if mercator else df


def epoch_of(c: Column | str) -> Column:
    """Epoch seconds of a zoneless timestamp, whatever the session's zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_diff("SECOND", F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")), c)


def time_of(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.timestamp_add("SECOND", c, F.to_timestamp_ntz(F.lit("1970-01-01 00:00:00")))


def epoch_from_text(df: DataFrame, text: str = "datetime", out: str = "ts") -> DataFrame:
    return df.dropna(subset=[text]).withColumn(out, epoch_of(F.to_timestamp_ntz(F.col(text))))


def valid_ids(df: DataFrame, s: Spec = AIS) -> DataFrame:
    return df.filter(F.col(s.oid) != 0)


def calm(df: DataFrame, threshold: float, velocity: str = "velocity", s: Spec = AIS) -> DataFrame:
    """Drops rows at or above the velocity threshold; unknown velocities and objects stay."""
    return df.filter(~F.coalesce((F.col(velocity) >= threshold) & F.col(s.oid).isNotNull(), F.lit(False)))


def _ranked(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def dedup_first(df: DataFrame, s: Spec = AIS) -> DataFrame:
    return _ranked(df, [s.oid, s.ts], [F.col(t) for t in s.tie])


def dedup_last(df: DataFrame, s: Spec = AIS) -> DataFrame:
    return _ranked(df, [s.oid, s.ts], [F.desc(t) for t in s.tie])


def iqr_bounds(x: str, alpha: float, over) -> tuple[Column, Column]:
    """(low, high) fences of x over a window: quartiles with linear interpolation, alpha interquartile ranges away."""
    q = F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).over(over)
    return q[0] - F.lit(float(alpha)) * (q[1] - q[0]), q[1] + F.lit(float(alpha)) * (q[1] - q[0])


def iqr_outliers(df: DataFrame, x: str, alpha: float = 3.0, by: list[str] | None = None) -> DataFrame:
    """Adds low, high and is_outlier (strictly outside). One aggregate per group, joined back."""
    keys = by or []
    q = df.groupBy(*keys).agg(F.percentile(x, F.array(F.lit(0.25), F.lit(0.75))).alias("_q"))
    iqr = F.col("_q")[1] - F.col("_q")[0]
    fences = q.select(*keys, (F.col("_q")[0] - F.lit(float(alpha)) * iqr).alias("low"), (F.col("_q")[1] + F.lit(float(alpha)) * iqr).alias("high"))
    out = df.join(fences, keys) if keys else df.crossJoin(F.broadcast(fences))  # without groups: one row
    return out.withColumn("is_outlier", F.coalesce((F.col(x) > F.col("high")) | (F.col(x) < F.col("low")), F.lit(False)))


def clean(df: DataFrame, alpha: float = 3.0, s: Spec = AIS) -> DataFrame:
    """First row per object and time; then rows whose time is an outlier of their object go."""
    return iqr_outliers(dedup_first(df, s), s.ts, alpha, [s.oid]).filter("NOT is_outlier").drop("low", "high", "is_outlier")


def feature_outliers(df: DataFrame, features: list[str], row_id: list[str], alpha: float = 1.5) -> DataFrame:
    """(feature, row id) of every outlier: unpivoted, fences per feature."""
    long = df.unpivot(row_id, features, "feature", "x")
    return iqr_outliers(long, "x", alpha, ["feature"]).filter("is_outlier").select("feature", *row_id, "x")


def drop_outliers(df: DataFrame, features: list[str], alpha: float = 1.5) -> DataFrame:
    """Rows that are an outlier in no feature: all fences come from one aggregate of one row."""
    q = df.agg(*[F.percentile(c, F.array(F.lit(0.25), F.lit(0.75))).alias("_" + c) for c in features])
    out = df.crossJoin(F.broadcast(q))  # one row
    for c in features:
        lo, hi = F.col("_" + c)[0], F.col("_" + c)[1]
        out = out.filter(~F.coalesce((F.col(c) > hi + F.lit(float(alpha)) * (hi - lo)) | (F.col(c) < lo - F.lit(float(alpha)) * (hi - lo)), F.lit(False)))
    return out.drop(*["_" + c for c in features])


def drop_last(df: DataFrame, s: Spec = AIS) -> DataFrame:
    w = Window.partitionBy(s.oid).orderBy(s.ts, *s.tie)
    return df.withColumn("_next", F.lead(s.ts).over(w)).filter("_next IS NOT NULL").drop("_next")


def pick_groups(df: DataFrame, column: str, size: int, seed: int | None = None) -> DataFrame:
    """All rows of some values of a column: at random, or with no seed the values whose scrambled order comes first."""
    order = F.rand(seed) if seed is not None else F.pmod(F.col(column) * 7919, F.lit(1009))
    return df.join(df.select(column).distinct().orderBy(order, column).limit(size), column, "left_semi")
