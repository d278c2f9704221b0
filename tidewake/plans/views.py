"""Views over the test tables that the queries start from, and the same as SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.clean import dedup_first, epoch_of

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
FRAME_S = 21_600
RADIUS_M = 600.0
PAIR_M = 1000.0


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLE_SQL[name] = re.sub(r"\bby\b", '"by"', sql)  # a column's name; the keyword is written BY
        return fn

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ais(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    i, u = F.col("event_id"), F.col("user_id")
    return e.select(
        i, u.alias("mmsi"), epoch_of("ts").alias("ts"),
        (F.lit(-5.0) + (u % 5) * F.lit(0.5) + ((i * 7919) % 1000) * F.lit(0.00002)).alias("lon"), (F.lit(47.0) + (u % 4) * F.lit(0.5) + ((i * 104729) % 1000) * F.lit(0.00002)).alias("lat"),
        F.col("value").alias("speed"), ((i * 31) % 360).cast("double").alias("course"), ((i * 17) % 360).cast("double").alias("heading"),
    )


def ais1(spark: SparkSession, d: str) -> DataFrame:
    return dedup_first(ais(spark, d))


def areas(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(0, -4.99, 47.01), (1, -4.49, 47.51), (2, -3.99, 48.01), (3, -3.49, 48.51)], "area_id int, lon double, lat double")


def frames_at(spark: SparkSession, d: str) -> DataFrame:
    """The first point per object and six hours: mmsi, frame, lon, lat."""
    a = ais(spark, d).withColumn("frame", F.col("ts") - F.col("ts") % FRAME_S)
    return a.groupBy("mmsi", "frame").agg(F.min(F.struct("ts", "event_id", "lon", "lat", "speed")).alias("p")).select("mmsi", "frame", "p.lon", "p.lat", "p.speed", "p.ts", "p.event_id")


AIS = """ais AS (SELECT event_id, user_id AS mmsi, CAST(floor(epoch(ts)) AS BIGINT) AS ts,
 CAST(-5.0 AS DOUBLE) + (user_id % 5) * CAST(0.5 AS DOUBLE) + ((event_id * 7919) % 1000) * CAST(0.00002 AS DOUBLE) AS lon,
 CAST(47.0 AS DOUBLE) + (user_id % 4) * CAST(0.5 AS DOUBLE) + ((event_id * 104729) % 1000) * CAST(0.00002 AS DOUBLE) AS lat,
 value AS speed, CAST((event_id * 31) % 360 AS DOUBLE) AS course, CAST((event_id * 17) % 360 AS DOUBLE) AS heading FROM events)"""
AIS1 = AIS + """, ais1 AS (SELECT * FROM ais QUALIFY row_number() OVER (PARTITION BY mmsi, ts ORDER BY event_id) = 1)"""
AREAS = "areas(area_id, lon, lat) AS (VALUES (0, CAST(-4.99 AS DOUBLE), CAST(47.01 AS DOUBLE)), (1, -4.49, 47.51), (2, -3.99, 48.01), (3, -3.49, 48.51))"
FRAMES = AIS + f""", frames AS (SELECT *, ts - ts % {FRAME_S} AS frame FROM ais QUALIFY row_number() OVER (PARTITION BY mmsi, ts - ts % {FRAME_S} ORDER BY ts, event_id) = 1)"""


def r6(x: str, scale: str = "1e6") -> str:
    return f"(floor(({x}) * CAST({scale} AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST({scale} AS DOUBLE))"


def hav(lon1: str, lat1: str, lon2: str, lat2: str) -> str:
    """Kilometres."""
    return f"(12742.0176::DOUBLE * asin(sqrt(least(1.0::DOUBLE, pow(sin((radians({lat2}) - radians({lat1})) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin((radians({lon2}) - radians({lon1})) / 2), 2)))))"


PAIRS = FRAMES + f""", pairs AS (SELECT a.frame, a.mmsi AS src, b.mmsi AS dst, {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} * 1000 AS metres
 FROM frames a JOIN frames b ON a.frame = b.frame AND a.mmsi < b.mmsi AND abs(a.lat - b.lat) < 0.02 WHERE {hav('a.lon', 'a.lat', 'b.lon', 'b.lat')} * 1000 < {PAIR_M})"""
# Groups of a frame by object number: overlapping from frame to frame, for the set operators.
GROUPS = FRAMES + """, groups AS (SELECT frame, CAST((frame // 21600) AS BIGINT) AS n, list_sort(list(mmsi)) AS clusters FROM frames GROUP BY frame, mmsi % 20 HAVING count(*) >= 2)"""


def groups_at(spark: SparkSession, d: str) -> DataFrame:
    """(frame, n, clusters): the objects of a frame by number modulo 20, two at least."""
    g = frames_at(spark, d).groupBy("frame", (F.col("mmsi") % 20).alias("site")).agg(F.array_sort(F.collect_list("mmsi")).alias("clusters"))
    return g.filter(F.size("clusters") >= 2).select("frame", F.floor(F.col("frame") / FRAME_S).cast("long").alias("n"), "clusters")
