"""Velocity, bearing, acceleration and distance along tracks: one window per object."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import AIS, NM_PER_KM, Spec
from ..functions.exprs import bearing_deg, haversine_km


def order_of(s: Spec, *more: str):
    return Window.partitionBy(s.oid, *more).orderBy(s.ts, *s.tie)


def _count(s: Spec):
    return F.count(F.lit(1)).over(Window.partitionBy(s.oid))


def velocity(df: DataFrame, s: Spec = AIS, compat: str = "v2", fallback: str | None = None) -> DataFrame:
    """Knots from each point to the next; the last point of an object goes. An object of one point keeps it with the fallback speed.
    compat v1: swapped axes, no id 0, the last kept point gets 0, nulls become 0."""
    w = order_of(s)
    legacy = compat == "v1"
    km = haversine_km(s.lon, s.lat, F.lead(s.lon).over(w), F.lead(s.lat).over(w), legacy)
    v = km * F.lit(NM_PER_KM) * F.lit(3600.0) / F.nullif(F.abs(F.lead(s.ts).over(w) - F.col(s.ts)).cast("double"), F.lit(0.0))
    alone = (F.col(fallback) if fallback else F.lit(None)).cast("double")
    out = df.filter(F.col(s.oid) != 0) if legacy else df
    out = out.withColumn("_n", _count(s)).withColumn("_i", F.row_number().over(w)).withColumn("velocity", F.when(F.col("_n") == 1, alone).otherwise(v))
    out = out.filter("_n = 1 OR _i < _n")
    if legacy:
        out = out.withColumn("velocity", F.when((F.col("_n") > 1) & (F.col("_i") == F.col("_n") - 1), 0.0).otherwise(F.coalesce("velocity", F.lit(0.0))))
    return out.drop("_n", "_i")


def bearing(df: DataFrame, s: Spec = AIS, compat: str = "v2") -> DataFrame:
    """Degrees from each point to the next; the last point goes; a single point keeps its course. compat v1 also fills nulls from the
    following, then the preceding bearing, and drops id 0."""
    w = order_of(s)
    b = bearing_deg(s.lon, s.lat, F.lead(s.lon).over(w), F.lead(s.lat).over(w))
    out = df.withColumn("_n", _count(s)).withColumn("_i", F.row_number().over(w)).withColumn("bearing", F.when(F.col("_n") == 1, F.col(s.course).cast("double")).otherwise(b)).filter("_n = 1 OR _i < _n")
    if compat == "v1":
        ahead, behind = w.rowsBetween(0, Window.unboundedFollowing), w.rowsBetween(Window.unboundedPreceding, 0)
        out = out.filter(F.col(s.oid) != 0).withColumn("bearing", F.coalesce(F.first("bearing", True).over(ahead), F.last("bearing", True).over(behind)))
    return out.drop("_n", "_i")


def acceleration(df: DataFrame, v: str = "velocity", s: Spec = AIS, compat: str = "v2") -> DataFrame:
    """v2: change to the next point over the seconds between, the last is null. v1: from the point before, the first is 0."""
    w = order_of(s)
    if compat == "v1":
        a = F.try_divide(F.col(v) - F.lag(v).over(w), (F.col(s.ts) - F.lag(s.ts).over(w)).cast("double"))
        return df.withColumn("acceleration", F.coalesce(a, F.lit(0.0)))
    return df.withColumn("acceleration", F.try_divide(F.col(v) - F.lead(v).over(w), F.abs(F.col(s.ts) - F.lead(s.ts).over(w)).cast("double")))


def distance_travelled(df: DataFrame, s: Spec = AIS, legacy_axes: bool = False) -> DataFrame:
    """Running sum of nautical miles, the leg to the next point included; the last point goes."""
    w = order_of(s)
    leg = haversine_km(s.lon, s.lat, F.lead(s.lon).over(w), F.lead(s.lat).over(w), legacy_axes) * F.lit(NM_PER_KM)
    out = df.withColumn("_leg", leg).withColumn("_next", F.lead(s.ts).over(w)).filter("_next IS NOT NULL")
    return out.withColumn("distance", F.sum("_leg").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_leg", "_next")
