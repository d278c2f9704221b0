"""Resampling on a common grid and the alignment operators in closed form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import AIS, Spec
from ..functions.exprs import bezier, control_point, linear
from .clean import dedup_first, iqr_outliers
from .kinematics import order_of, velocity
from .segments import offset_segments, poi_segments, points_of_interest, pre_segments, spatial_segments, temporal_segments


def _legs(df: DataFrame, keys: list[str], cols: list[str], s: Spec) -> DataFrame:
    """Each point (a_*) with the next of its keys (b_*)."""
    w = Window.partitionBy(*keys).orderBy(s.ts, *s.tie)
    both = df.select(*keys, *[F.col(c).alias("a_" + c) for c in (s.ts, *cols)], *[F.lead(c).over(w).alias("b_" + c) for c in (s.ts, *cols)])
    return both.filter(F.col("b_" + s.ts).isNotNull())


def grid_resample(df: DataFrame, features: list[str], rate_min: int = 1, keys: list[str] | None = None, s: Spec = AIS) -> DataFrame:
    """Linear values at grid instants after the first and up to the last record of each object. The grid starts at the object's first record, its
    seconds dropped and its minute floored within the hour."""
    keys = keys or [s.oid]
    step = 60 * rate_min
    if step <= 3600 and 3600 % step == 0:
        origin = F.lit(0).cast("long")
        d = df
    else:
        d = df.withColumn("_t0", F.min(s.ts).over(Window.partitionBy(*keys)))
        hour = F.col("_t0") - F.pmod(F.col("_t0"), F.lit(3600))
        minute = F.floor(F.pmod(F.col("_t0"), F.lit(3600)) / 60)
        d = d.withColumn("_o", hour + (minute - F.pmod(minute, F.lit(rate_min))) * 60)
        origin, keys = F.col("_o"), [*keys, "_o"]
    legs = _legs(d, keys, features, s)
    a, b = F.col("a_" + s.ts), F.col("b_" + s.ts)
    first = (F.floor((a - origin) / step) + 1) * step + origin
    last = F.floor((b - origin) / step) * step + origin
    out = legs.withColumn("_from", first.cast("long")).withColumn("_to", last.cast("long")).filter("_from <= _to").withColumn("grid_ts", F.explode(F.sequence(F.col("_from"), F.col("_to"), F.lit(step).cast("long"))))
    return out.select(*[k for k in keys if k != "_o"], F.col("grid_ts"), *[linear("a_" + f, "b_" + f, "a_" + s.ts, "b_" + s.ts, "grid_ts").alias(f) for f in features])


def resample_with_velocity(df: DataFrame, rate_min: int = 1, resample_first: bool = True, s: Spec = AIS) -> DataFrame:
    if resample_first:
        g = grid_resample(df, [s.lon, s.lat], rate_min, s=s).withColumnRenamed("grid_ts", s.ts)
        return velocity(g, Spec(s.oid, s.ts, s.lon, s.lat, tie=()))
    return grid_resample(velocity(df, s), [s.lon, s.lat, "velocity"], rate_min, s=s).withColumnRenamed("grid_ts", s.ts)


def prepare_tracks(df: DataFrame, rate_min: int = 1, alpha: float = 20.0, window: int = 100, resample_first: bool = True, drop_alpha: float | None = None, s: Spec = AIS) -> DataFrame:
    """The whole preparation per object: first row per time, grid and velocity, velocity outliers out (with drop_alpha), segments between points of interest."""
    v = resample_with_velocity(dedup_first(df, s).drop("id", "status"), rate_min, resample_first, s)
    if drop_alpha is not None:
        v = iqr_outliers(v, "velocity", drop_alpha, [s.oid]).filter("NOT is_outlier").drop("low", "high", "is_outlier")
    on_grid = Spec(s.oid, s.ts, s.lon, s.lat, tie=())
    return poi_segments(v, points_of_interest(v, "velocity", alpha, window, on_grid), on_grid)


def prepare_in_pieces(df: DataFrame, gap_s: int = 43_200, least_rows: int = 2, rate_min: int = 1, alpha: float = 20.0, window: int = 100, s: Spec = AIS) -> DataFrame:
    """prepare_tracks() on each piece between long gaps; later pieces number their segments on from earlier ones."""
    pieces = pre_segments(dedup_first(df, s), gap_s, least_rows, s).withColumn("_track", F.concat_ws(":", F.col(s.oid), F.col("piece")))
    done = prepare_tracks(pieces, rate_min, alpha, window, s=Spec("_track", s.ts, s.lon, s.lat, tie=s.tie))
    parts = F.split("_track", ":")
    done = done.withColumn(s.oid, parts[0].cast(df.schema[s.oid].dataType)).withColumn("piece", parts[1].cast("int")).drop("_track", "pois")
    return offset_segments(done, "piece", "traj_id", s)


def segment_and_resample(df: DataFrame, areas: DataFrame, radius_m: float = 2000.0, gap_s: int = 43_200, least_rows: int = 2, rate_min: int | None = None, s: Spec = AIS) -> DataFrame:
    """Trips: by area, then by time gap, then (with a rate) on the grid per trip."""
    trips = temporal_segments(spatial_segments(df, areas, radius_m, s), gap_s, least_rows, traj="traj_id", s=s)
    return grid_resample(trips, [s.lon, s.lat], rate_min, [s.oid, "traj_id", "trip_id"], s) if rate_min else trips


def _at_one_instant(df: DataFrame, s: Spec) -> DataFrame:
    """The first row per object and second; those at the very last second never arrive."""
    w = Window.partitionBy(s.oid, s.ts).orderBy(*s.tie)
    ends = df.agg(F.min(s.ts).alias("_s"), F.max(s.ts).alias("_e"))
    one = df.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")
    return one.crossJoin(F.broadcast(ends)).filter(F.col(s.ts) < F.col("_e"))  # ends has one row


def delayed_interpolation(df: DataFrame, features: list[str], rate_min: int = 5, s: Spec = AIS) -> DataFrame:
    """For each pair of consecutive points the value at the last grid instant before the second, if it is not before the first."""
    dt = 60 * rate_min
    legs = _legs(_at_one_instant(df, s), [s.oid], features, s)
    g = F.col("b_" + s.ts) - 1 - F.pmod(F.col("b_" + s.ts) - 1, F.lit(dt))
    return legs.withColumn("grid_ts", g).filter(F.col("a_" + s.ts) <= F.col("grid_ts")).select(s.oid, "grid_ts", *[linear("a_" + f, "b_" + f, "a_" + s.ts, "b_" + s.ts, "grid_ts").alias(f) for f in features])


def online_extrapolation(df: DataFrame, features: list[str], rate_min: int = 5, limit: int = 3, s: Spec = AIS) -> DataFrame:
    """The line through the last two points, at up to `limit` grid instants from the second on and before the next point."""
    dt = 60 * rate_min
    d, w = _at_one_instant(df, s), order_of(s)
    cols = [s.ts, *features]
    d = d.select(s.oid, "_e", *[F.col(c).alias("b_" + c) for c in cols], *[F.lag(c).over(w).alias("a_" + c) for c in cols], F.lead(s.ts).over(w).alias("_next")).filter(F.col("a_" + s.ts).isNotNull())
    b = F.col("b_" + s.ts)
    d = d.withColumn("_g", b + F.pmod(-b, F.lit(dt))).withColumn("_stop", F.coalesce("_next", "_e"))
    d = d.withColumn("grid_ts", F.explode(F.sequence(F.col("_g"), F.col("_g") + (limit - 1) * dt, F.lit(dt).cast("long")))).filter("grid_ts < _stop")
    return d.select(s.oid, "grid_ts", *[linear("a_" + f, "b_" + f, "a_" + s.ts, "b_" + s.ts, "grid_ts").alias(f) for f in features])


def online_interpolation(df: DataFrame, features: list[str], rate_min: int = 5, s: Spec = AIS) -> DataFrame:
    """A point is accepted if the last accepted one is older than the pending instant; accepted neighbours are interpolated one period late. The rule
    is a recurrence per object, so it runs over each object's first point per grid bucket (and points that hit the grid) in Arrow groups."""
    dt = 60 * rate_min
    d = _at_one_instant(df, s)
    start = F.col("_s") - F.pmod(F.col("_s"), F.lit(dt))
    k = F.when(F.col(s.ts) == F.col("_s"), start).otherwise(F.greatest(start, F.col(s.ts) - 1 - F.pmod(F.col(s.ts) - 1, F.lit(dt))))
    d = d.select(s.oid, F.col(s.ts).cast("long").alias("t"), *[F.col(f).cast("double").alias(f) for f in features], k.cast("long").alias("k"), F.col("_e").cast("long").alias("e"), start.cast("long").alias("s0"))
    schema = f"{s.oid} long, t long, e long, s0 long, " + ", ".join(f"{f} double" for f in features)

    def accept(frame):
        frame = frame.sort_values("t", kind="stable")
        last, keep = None, []
        for t, pending in zip(frame["t"], frame["k"]):
            ok = last is None or last < pending
            keep.append(ok)
            last = t if ok else last
        return frame.loc[keep, [s.oid, "t", "e", "s0", *features]]

    acc = d.groupBy(s.oid).applyInPandas(accept, schema)
    w = Window.partitionBy(s.oid).orderBy("t")
    legs = acc.select(s.oid, "e", "s0", F.col("t").alias("a_t"), *[F.col(f).alias("a_" + f) for f in features], F.lead("t").over(w).alias("b_t"), *[F.lead(f).over(w).alias("b_" + f) for f in features], F.lead("t", 2).over(w).alias("_next")).filter("b_t IS NOT NULL")
    first = F.greatest(F.col("a_t") + F.pmod(-F.col("a_t"), F.lit(dt)), F.col("s0"), F.col("b_t") - dt + F.pmod(-(F.col("b_t") - dt), F.lit(dt)))
    legs = legs.withColumn("_f", first.cast("long")).withColumn("_l", (F.col("b_t") - F.pmod(F.col("b_t"), F.lit(dt))).cast("long")).filter("_f <= _l")
    legs = legs.withColumn("grid_ts", F.explode(F.sequence("_f", "_l", F.lit(dt).cast("long")))).filter((F.col("grid_ts") + dt < F.coalesce("_next", "e")) & (F.col("grid_ts") + dt < F.col("e")))
    return legs.select(s.oid, "grid_ts", *[linear("a_" + f, "b_" + f, "a_t", "b_t", "grid_ts").alias(f) for f in features])


def bezier_interpolation(df: DataFrame, rate_min: int = 5, s: Spec = AIS) -> DataFrame:
    """Quadratic Bezier position at the last grid instant before each point; the control point is where the heading lines meet."""
    dt = 60 * rate_min
    legs = _legs(_at_one_instant(df, s), [s.oid], [s.lon, s.lat, s.heading], s)
    side = lambda p: {"lon": F.col(p + s.lon), "lat": F.col(p + s.lat), "heading": F.col(p + s.heading)}
    cx, cy = control_point(side("a_"), side("b_"))
    g = F.col("b_" + s.ts) - 1 - F.pmod(F.col("b_" + s.ts) - 1, F.lit(dt))
    legs = legs.withColumn("grid_ts", g).filter(F.col("a_" + s.ts) <= F.col("grid_ts")).withColumn("cx", cx).withColumn("cy", cy)
    t = F.try_divide((F.col("grid_ts") - F.col("a_" + s.ts)).cast("double"), (F.col("b_" + s.ts) - F.col("a_" + s.ts)).cast("double"))
    return legs.withColumn("t", t).select(s.oid, "grid_ts", bezier("a_" + s.lon, "cx", "b_" + s.lon, "t").alias(s.lon), bezier("a_" + s.lat, "cy", "b_" + s.lat, "t").alias(s.lat))


ALIGNERS = {
    "extrap1d": online_extrapolation, "interp1d": online_interpolation, "delayed": delayed_interpolation,
    "bezierInterp1d": lambda df, features, rate_min=5, s=AIS: bezier_interpolation(df, rate_min, s), "bezierIinterp1d": lambda df, features, rate_min=5, s=AIS: bezier_interpolation(df, rate_min, s),
}


def align(df: DataFrame, mode: str, features: list[str], rate_min: int = 5, s: Spec = AIS) -> DataFrame:
    if mode not in ALIGNERS:
        raise ValueError(f"unknown mode {mode}; known: {', '.join(ALIGNERS)}")
    return ALIGNERS[mode](df, features, rate_min=rate_min, s=s)
