"""One-dimensional series: runs, rolling statistics, entropy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def consecutive_runs(df: DataFrame, value: str, by: list[str], order: list[str], step: int = 1, out: str = "run") -> DataFrame:
    """run: numbers the runs in which each value is its predecessor plus step."""
    w = Window.partitionBy(*by).orderBy(*order)
    broken = F.coalesce((F.col(value) != F.lag(value).over(w) + step), F.lit(False))
    return df.withColumn("_b", broken.cast("int")).withColumn(out, F.sum("_b").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("_b")


def zero_runs(df: DataFrame, x: str = "x", idx: str = "idx", by: str = "series_id") -> DataFrame:
    """(series, first, last) of maximal runs of zeros."""
    z = df.filter(F.col(x) == 0)
    r = consecutive_runs(z, idx, [by], [idx])
    return r.groupBy(by, "run").agg(F.min(idx).alias("first"), F.max(idx).alias("last")).drop("run")


def linear_runs(df: DataFrame, x: str = "x", idx: str = "idx", by: str = "series_id", skip: int = 5, include_zeros: bool = False, eps: float = 4e-5) -> DataFrame:
    """(series, first, last): where the second difference vanishes; overlapping and touching runs are one; those shorter than skip + 2 go."""
    w = Window.partitionBy(by).orderBy(idx)
    d = df.withColumn("_d2", F.lead(x, 2).over(w) - 2 * F.lead(x).over(w) + F.col(x)).withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(by)))
    flat = d.filter(F.abs("_d2") < eps)
    if not include_zeros:
        flat = flat.filter(F.col(x) != 0)
    r = consecutive_runs(flat, idx, [by], [idx]).groupBy(by, "run").agg(F.min(idx).alias("first"), F.least(F.max(idx) + 2, F.max("_n")).alias("last"))
    o = Window.partitionBy(by).orderBy("first", "last")
    r = r.withColumn("_top", F.max("last").over(o.rowsBetween(Window.unboundedPreceding, -1)))
    r = r.withColumn("_g", F.sum(F.coalesce((F.col("first") > F.col("_top")).cast("int"), F.lit(0))).over(o.rowsBetween(Window.unboundedPreceding, 0)))
    return r.groupBy(by, "_g").agg(F.min("first").alias("first"), F.max("last").alias("last")).filter(F.col("last") - F.col("first") >= skip + 2).drop("_g")


def rolling(df: DataFrame, x: str, window: int, by: list[str], order: list[str], how: str = "mean") -> Column:
    """Rolling mean or median over full windows of rows; null before."""
    frame = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(window - 1), 0)
    value = F.avg(x).over(frame) if how == "mean" else F.percentile(x, 0.5).over(frame)
    return F.when(F.count(x).over(frame) == window, value)


def detrend(df: DataFrame, columns: list[str], by: list[str], order: list[str], window: int = 144) -> DataFrame:
    """Adds <c>_trend (rolling median) and <c>_detrended (0 where there is no trend yet)."""
    for c in columns:
        df = df.withColumn(f"{c}_trend", rolling(df, c, window, by, order, "median")).withColumn(f"{c}_detrended", F.coalesce(F.col(c) - F.col(f"{c}_trend"), F.lit(0.0)))
    return df


def shannon_entropy(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Bits of the value histogram per group."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    n = F.sum("_c")
    return c.groupBy(*by).agg((F.log2(n) - F.sum(F.col("_c") * F.log2("_c")) / n).alias("entropy"))


def mode_of(df: DataFrame, value: str, by: list[str], first: str) -> DataFrame:
    """The most frequent value per group; ties to the one seen first."""
    c = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(first).alias("_f"))
    return c.withColumn("_r", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("n"), "_f"))).filter("_r = 1").drop("_r", "_f")
