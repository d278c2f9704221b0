"""Trajectory segmentation: by area, by time gap, by points of interest."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import AIS, Spec
from .areas import classify_areas, nearest_area
from .kinematics import order_of


def keep_borders(df: DataFrame, label: str = "label", s: Spec = AIS) -> DataFrame:
    """Rows outside areas, and inside rows next to an outside row."""
    w = order_of(s)
    return df.withColumn("_b", F.lag(label).over(w)).withColumn("_f", F.lead(label).over(w)).filter((F.col(label) == 0) | (F.coalesce("_b", F.lit(-1)) == 0) | (F.coalesce("_f", F.lit(-1)) == 0)).drop("_b", "_f")


def split_at_labels(df: DataFrame, label: str = "label", out: str = "traj_id", s: Spec = AIS) -> DataFrame:
    """A piece begins at every inside row; the first piece of an object is 0, a piece of one row takes its predecessor's number, any other the next one."""
    w = order_of(s)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    d = df.withColumn("_seg", F.sum((F.col(label) == -1).cast("int")).over(upto)).withColumn("_row", F.row_number().over(w))
    d = d.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(s.oid, "_seg")))
    start = (F.col(label) == -1) & (F.col("_row") > 1) & (F.col("_len") > 1)
    return d.withColumn(out, F.sum(start.cast("int")).over(upto).cast("int")).drop("_seg", "_row", "_len")


def spatial_segments(df: DataFrame, areas: DataFrame, radius_m: float = 2000.0, s: Spec = AIS) -> DataFrame:
    return split_at_labels(keep_borders(classify_areas(df, areas, radius_m, s), s=s), s=s)


def temporal_segments(df: DataFrame, gap_s: int = 43_200, least_rows: int = 2, traj: str | None = None, out: str = "trip_id", s: Spec = AIS) -> DataFrame:
    """Breaks where the gap is longer than gap_s, drops pieces of fewer than least_rows rows, numbers the rest from 0 per object."""
    keys = [s.oid, traj] if traj else [s.oid]
    w = Window.partitionBy(*keys).orderBy(s.ts, *s.tie)
    d = df.withColumn("_gap", F.col(s.ts) - F.lag(s.ts).over(w)).withColumn("_brk", F.sum(F.when(F.col("_gap") > gap_s, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    d = d.withColumn("_len", F.count(F.lit(1)).over(Window.partitionBy(*keys, "_brk"))).filter(F.col("_len") >= least_rows)
    rank = F.dense_rank().over(Window.partitionBy(s.oid).orderBy(*([traj] if traj else []), "_brk"))
    return d.withColumn(out, (rank - 1).cast("int")).drop("_gap", "_brk", "_len")


def smoothed_change(feature: str, window: int, s: Spec = AIS):
    """Column expressions (to be applied in turn) of rolling mean, difference and rolling mean; null until windows are full."""
    w = order_of(s)
    frame = w.rowsBetween(-(window - 1), 0)

    def apply(df: DataFrame) -> DataFrame:
        full = lambda c: F.when(F.count(c).over(frame) == window, F.avg(c).over(frame))
        return df.withColumn("_m", full(feature)).withColumn("_d", F.col("_m") - F.lag("_m").over(w)).withColumn("change", full("_d")).drop("_m", "_d")

    return apply


def points_of_interest(df: DataFrame, feature: str = "velocity", alpha: float = 20.0, window: int = 100, s: Spec = AIS) -> DataFrame:
    """(object, pois): row numbers from 0 where the smoothed change of the feature is an outlier, with 0 and the last row. Of the outliers the
    first and all others stay, except the last one if it does not follow its predecessor at once."""
    w, per = order_of(s), Window.partitionBy(s.oid)
    d = smoothed_change(feature, window, s)(df.withColumn("_i", (F.row_number().over(w) - 1).cast("int")))
    q = F.percentile("change", F.array(F.lit(0.25), F.lit(0.75))).over(per)
    d = d.select(s.oid, "_i", "change", q.alias("_q"))  # all on the object's partitioning: one exchange
    iqr = (F.col("_q")[1] - F.col("_q")[0]) * F.lit(float(alpha))
    out = (F.col("change") > F.col("_q")[1] + iqr) | (F.col("change") < F.col("_q")[0] - iqr)
    g = d.groupBy(s.oid).agg(F.max("_i").alias("_last"), F.array_sort(F.collect_list(F.when(out, F.col("_i")))).alias("_k"))
    n = F.size("_k")
    loose = (n >= 2) & (F.get("_k", n - 1) - F.get("_k", n - 2) != 1)
    kept = F.when(loose, F.slice("_k", F.lit(1), F.greatest(n - 1, F.lit(0)))).otherwise(F.col("_k"))
    return g.select(s.oid, F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), kept, F.array("_last")))).alias("pois"))


def adaptive_points_of_interest(df: DataFrame, feature: str = "velocity", window: int = 100, most: int = 100, s: Spec = AIS) -> DataFrame:
    """(object, pois): the most frequent answer for alpha = 1, 2, ... up to the first that finds no outlier; ties to the smallest alpha.
    Smoothing happens once; the alphas only compare with fences."""
    w = order_of(s)
    d = smoothed_change(feature, window, s)(df.withColumn("_i", (F.row_number().over(w) - 1).cast("int")))
    q = d.groupBy(s.oid).agg(F.percentile("change", F.array(F.lit(0.25), F.lit(0.75))).alias("_q"), (F.count(F.lit(1)) - 1).cast("int").alias("_last"))
    low, high = F.col("_q")[0], F.col("_q")[1]
    outside = lambda alpha: (F.col("change") > high + alpha * (high - low)) | (F.col("change") < low - alpha * (high - low))
    q = q.withColumn("_most", F.when(high == low, 1).otherwise(most))  # without a spread all alphas give one answer
    far = d.join(q, s.oid).filter(outside(F.lit(1.0)))
    reach = F.try_divide(F.greatest(F.col("change") - high, low - F.col("change")), high - low)
    top = F.when(reach < F.col("_most"), F.ceil(reach).cast("int")).otherwise(F.col("_most"))
    far = far.withColumn("alpha", F.explode(F.sequence(F.lit(1), top))).filter(outside(F.col("alpha").cast("double")))
    o = Window.partitionBy(s.oid, "alpha").orderBy("_i")
    far = far.withColumn("_before", F.lag("_i").over(o)).withColumn("_after", F.lead("_i").over(o)).filter("_before IS NULL OR _after IS NOT NULL OR _i - _before = 1")
    found = far.groupBy(s.oid, "alpha").agg(F.collect_set("_i").alias("_s"))
    none = F.array().cast("array<int>")
    every = q.select(s.oid, "_last", F.explode(F.sequence(F.lit(1), F.coalesce("_most", F.lit(most)))).alias("alpha")).join(found, [s.oid, "alpha"], "left")
    every = every.withColumn("pois", F.array_sort(F.array_distinct(F.concat(F.array(F.lit(0)), F.coalesce("_s", none), F.array("_last")))))
    every = every.withColumn("_stop", F.min(F.when(F.size("pois") <= 2, F.col("alpha"))).over(Window.partitionBy(s.oid))).filter("_stop IS NULL OR alpha <= _stop")
    votes = every.groupBy(s.oid, "pois").agg(F.count(F.lit(1)).alias("_n"), F.min("alpha").alias("_a"))
    return votes.withColumn("_r", F.row_number().over(Window.partitionBy(s.oid).orderBy(F.desc("_n"), "_a"))).filter("_r = 1").select(s.oid, "pois")


def poi_segments(df: DataFrame, pois: DataFrame, s: Spec = AIS) -> DataFrame:
    """traj_id: how many inner points of interest lie at or before the row."""
    d = df.withColumn("_i", (F.row_number().over(order_of(s)) - 1).cast("int")).join(pois, s.oid)
    inner = F.slice("pois", F.lit(2), F.greatest(F.size("pois") - 2, F.lit(0)))
    return d.withColumn("traj_id", F.size(F.filter(inner, lambda p: p <= F.col("_i"))).cast("int")).drop("_i")


def semantic_tags(df: DataFrame, areas: DataFrame, velocity: str = "velocity", near_deg: float = 0.1, s: Spec = AIS) -> DataFrame:
    """(object, traj_id, semantic_id): slow segments are 0 near an area, else 1; others 3 if they slow down, else 2."""
    d = nearest_area(df, areas, s)
    n = F.count(F.lit(1))
    known = F.when(F.col(velocity).isNotNull(), F.struct(s.ts, *s.tie))  # from the first known velocity to the last one
    rise = F.try_divide(F.max_by(velocity, known) - F.min_by(velocity, known), (n - 1).cast("double"))
    # Sums of doubles depend on their order, which would decide about means of just 1: here they are added exactly, in units of 2^-20 and 2^-62, and rounded once.
    scaled = F.col(velocity).cast("double") * F.lit(2.0**20)
    whole = scaled.try_cast("bigint")
    rest = ((scaled - whole) * F.lit(2.0**42)).try_cast("bigint")
    total = F.try_sum(whole.cast("decimal(19,0)")).cast("double") / F.lit(2.0**20) + F.try_sum(rest.cast("decimal(19,0)")).cast("double") / F.lit(2.0**62)
    mean = F.when(F.count(rest) == F.count(velocity), F.try_divide(total, F.count(rest)))
    g = d.groupBy(s.oid, "traj_id").agg(F.coalesce(mean, F.avg(velocity)).alias("_v"), F.avg("nearest").alias("_d"), rise.alias("_a"))
    tag = F.when(F.col("_v") < 1, F.when(F.col("_d") <= near_deg, 0).otherwise(1)).when(F.col("_a") < 0, 3).otherwise(2)
    return g.select(s.oid, "traj_id", tag.alias("semantic_id"))


def pre_segments(df: DataFrame, gap_s: int = 43_200, least_rows: int = 2, s: Spec = AIS) -> DataFrame:
    """piece: pieces between long gaps, those of one row left out."""
    return temporal_segments(df, gap_s, least_rows, out="piece", s=s)


def offset_segments(df: DataFrame, piece: str = "piece", traj: str = "traj_id", s: Spec = AIS) -> DataFrame:
    """Numbers the trajectories of later pieces on from those of earlier ones."""
    top = df.groupBy(s.oid, piece).agg((F.max(traj) + 1).alias("_n"))
    before = top.withColumn("_off", F.coalesce(F.sum("_n").over(Window.partitionBy(s.oid).orderBy(piece).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return df.join(before.drop("_n"), [s.oid, piece]).withColumn(traj, (F.col(traj) + F.col("_off")).cast("int")).drop("_off")
