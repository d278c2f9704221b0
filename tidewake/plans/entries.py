"""Queries of sources, sinks, streams and small operators, and SQL of queries that stand elsewhere."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import EARTH_KM, NM_PER_KM
from ..functions import exprs as X
from ..operators import patterns as G
from ..operators import resample as R
from ..sources import io
from ..sources.shared import fresh_path
from ..streaming import align as T
from ..streaming import driver as D
from .groups import FRAME_S, LINKS, SIDES, TEXT, convoys, sides, text
from .tracks import ENDS, NM, POI, TRIPS, W, grid_sql
from .video import PIX
from .views import AIS, AIS1, FRAMES, ORACLE_SQL, ais, ais1, frames_at, hav, query, r6, table

EVENT = "event_id long, user_id long, event_type string, value double"
EVENT_SQL = "SELECT event_id, user_id, event_type, value FROM events"


def events(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "events").select("event_id", "user_id", "event_type", "value")


# ---- sources and sinks: written, then read back ----
@query("s1_csv_scan", EVENT_SQL)
def s1_csv_scan(s, d):
    path = fresh_path(s, "csv")
    io.write_csv(events(s, d), path)
    return io.read_csv(s, path, EVENT)


@query("s6_csv_folder", "SELECT user_id, count(*) AS n, " + r6("sum(value)", "1e3") + " AS total FROM events GROUP BY user_id")
def s6_csv_folder(s, d):
    """A folder of CSV files, one per type of event, read as one table."""
    path = fresh_path(s, "csv")
    events(s, d).write.partitionBy("event_type").option("header", True).csv(path)
    read = io.read_csv(s, path, EVENT)
    return read.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), X.portable(F.sum("value"), 1e3).alias("total"))


@query("s7_table_round_trip", EVENT_SQL)
def s7_table_round_trip(s, d):
    path = fresh_path(s, "table")
    io.write_parquet(events(s, d), path)
    return io.read_parquet(s, path)


@query("s10_pattern_csv", f"WITH {LINKS} SELECT {TEXT}, st, et FROM links")
def s10_pattern_csv(s, d):
    """Patterns in a CSV folder whose name tells the parameters."""
    path = io.write_patterns_csv(G.intersection_links(*sides(s, d), 2, ["n"]).select("clusters", "st", "et"), fresh_path(s, "patterns"), io.Job())
    return io.read_patterns_csv(s, path).select(text(), "st", "et")


@query("s12_job_json", "SELECT 'flocks' AS gp_type, CAST(5 AS BIGINT) AS cardinality, CAST(10 AS BIGINT) AS dt_min, CAST(2778.0 AS DOUBLE) AS distance_m, CAST(60 AS BIGINT) AS step_s")
def s12_job_json(s, d):
    path = fresh_path(s, "job")
    io.write_job(s, io.Job("flocks", 5, 10, 2778.0, 60), path)
    job = io.read_job(s, path)
    return s.createDataFrame([tuple(job.as_dict().values())], "gp_type string, cardinality long, dt_min long, distance_m double, step_s long")


@query("s14_snapshot", f"WITH {LINKS} SELECT {TEXT}, st, et FROM links WHERE n = (SELECT max(n) FROM links)")
def s14_snapshot(s, d):
    """Active patterns of the last frame, written for a restart and found again by checksum and parameters."""
    links = G.intersection_links(*sides(s, d), 2, ["n"])
    last = links.join(links.agg(F.max("n").alias("n")), "n").select("clusters", "st", "et")
    path, job = fresh_path(s, "snapshot"), io.Job()
    io.write_snapshot(last, path, "links", job, 0)
    return io.read_snapshot(s, path, "links", job).select(text(), "st", "et")


@query("s15_map_points", f"""WITH {AIS} SELECT event_id, mmsi % 10 AS color, {r6('6378137.0::DOUBLE * radians(lon)', '1e3')} AS merc_x,
{r6('6378137.0::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians(lat) / 2))', '1e3')} AS merc_y FROM ais""")
def s15_map_points(s, d):
    """What a map plot draws: points on the Mercator plane with the colour of their object."""
    return ais(s, d).select("event_id", (F.col("mmsi") % 10).alias("color"), X.portable(X.mercator_x("lon"), 1e3).alias("merc_x"), X.portable(X.mercator_y("lat"), 1e3).alias("merc_y"))


@query("s15_cluster_colours", f"WITH {SIDES}, c AS (SELECT n, dense_rank() OVER (PARTITION BY n ORDER BY clusters) AS color, unnest(clusters) AS mmsi FROM present) SELECT f.frame, f.mmsi, coalesce(c.color, 0) AS color FROM frames f LEFT JOIN c ON c.n = f.frame // {FRAME_S} AND c.mmsi = f.mmsi")
def s15_cluster_colours(s, d):
    """What a cluster plot draws: the objects of every frame with the number of their cluster, 0 without one."""
    c = sides(s, d)[0].withColumn("color", F.dense_rank().over(Window.partitionBy("n").orderBy("clusters")).cast("long")).select("n", "color", F.explode("clusters").alias("mmsi"))
    f = frames_at(s, d).select("frame", "mmsi", F.floor(F.col("frame") / FRAME_S).alias("n"))
    return f.join(c, ["n", "mmsi"], "left").select("frame", "mmsi", F.coalesce("color", F.lit(0)).alias("color"))


# ---- ordering, joins and partitions ----
@query("o3_most_frequent", "SELECT user_id, event_type FROM (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, event_type) = 1")
def o3_most_frequent(s, d):
    n = events(s, d).groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("r", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("n"), "event_type"))).filter("r = 1").select("user_id", "event_type")


@query("o5_sorted_members", f"WITH {FRAMES} SELECT frame, array_to_string(list_sort(list(DISTINCT mmsi)), ',') AS members FROM frames GROUP BY frame")
def o5_sorted_members(s, d):
    return frames_at(s, d).groupBy("frame").agg(F.array_join(F.array_sort(F.collect_set("mmsi")), ",").alias("members"))


PARTS = "b AS (SELECT *, n // 30 AS part FROM links), e AS (SELECT part, min(st) AS st, max(et) AS et FROM b GROUP BY part)"


@query("j12_partition_chain", f"WITH {LINKS}, {PARTS} SELECT part, st, et, CAST(coalesce(st - lag(et) OVER (ORDER BY st), 0) = {FRAME_S} AS INTEGER) AS chained FROM e")
def j12_partition_chain(s, d):
    """Time partitions of patterns, and whether each begins exactly one step after the one before ends (a row per partition)."""
    links = G.intersection_links(*sides(s, d), 2, ["n"]).withColumn("part", F.floor(F.col("n") / 30))
    e = links.groupBy("part").agg(F.min("st").alias("st"), F.max("et").alias("et"))
    gap = F.coalesce(F.col("st") - F.lag("et").over(Window.orderBy("st")), F.lit(0))
    return e.select("part", "st", "et", (gap == FRAME_S).cast("int").alias("chained"))


# ---- functions ----
@query("f2_bearing", f"""WITH {AIS} SELECT event_id, {r6('CASE WHEN x >= 360 THEN x - 360 ELSE x END', '1e5')} AS bearing FROM (SELECT event_id,
degrees(atan2(sin(radians(CAST(-4.0 AS DOUBLE)) - radians(lon)) * cos(radians(CAST(48.5 AS DOUBLE))), cos(radians(lat)) * sin(radians(CAST(48.5 AS DOUBLE))) - sin(radians(lat)) * cos(radians(CAST(48.5 AS DOUBLE))) * cos(radians(CAST(-4.0 AS DOUBLE)) - radians(lon)))) + 360 AS x FROM ais)""")
def f2_bearing(s, d):
    return ais(s, d).select("event_id", X.portable(X.bearing_deg("lon", "lat", F.lit(-4.0), F.lit(48.5)), 1e5).alias("bearing"))


@query("f3_mercator", f"WITH {AIS} SELECT DISTINCT mmsi, {r6('6378137.0::DOUBLE * radians(CAST(mmsi % 180 AS DOUBLE))', '1e3')} AS x, {r6('6378137.0::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians(CAST(mmsi % 80 AS DOUBLE)) / 2))', '1e3')} AS y FROM ais")
def f3_mercator(s, d):
    lon, lat = (F.col("mmsi") % 180).cast("double"), (F.col("mmsi") % 80).cast("double")
    return ais(s, d).select("mmsi", X.portable(X.mercator_x(lon), 1e3).alias("x"), X.portable(X.mercator_y(lat), 1e3).alias("y")).distinct()


@query("f5_constants", "SELECT CAST(6371.0088 AS DOUBLE) AS earth_km, CAST(0.539956803 AS DOUBLE) AS nm_per_km")
def f5_constants(s, d):
    return s.range(1).select(F.lit(EARTH_KM).alias("earth_km"), F.lit(NM_PER_KM).alias("nm_per_km"))


@query("f17_grid_start", "SELECT event_id, epoch_us(date_trunc('hour', ts)) // 1000000 + date_part('minute', ts) // 7 * 7 * 60 AS start FROM events")
def f17_grid_start(s, d):
    """Seconds dropped, the minute floored to the rate within its hour."""
    t = F.col("ts").cast("timestamp")
    return table(s, d, "events").select("event_id", (F.unix_seconds(F.date_trunc("hour", t)) + F.floor(F.minute(t) / 7) * 7 * 60).alias("start"))


@query("f18_durations", "SELECT * FROM (VALUES ('30 min', CAST(1800 AS BIGINT)), ('1h', 3600), ('60s', 60), ('2 days', 172800), ('1 day 02:30:00', 95400), ('90', 90)) v(duration, seconds)")
def f18_durations(s, d):
    texts = ["30 min", "1h", "60s", "2 days", "1 day 02:30:00", "90"]
    return s.createDataFrame([(x, io.duration_seconds(x)) for x in texts], "duration string, seconds long")


# ---- user code over groups and rows ----
@query("x1_grouped_apply", f"WITH {AIS} SELECT mmsi, count(*) AS n, {r6('max(speed) - min(speed)')} AS spread FROM ais GROUP BY mmsi")
def x1_grouped_apply(s, d):
    """A function of a whole group, as pandas."""

    def spread(pdf):
        return pdf.groupby("mmsi", as_index=False).agg(n=("speed", "size"), hi=("speed", "max"), lo=("speed", "min"))

    got = ais(s, d).select("mmsi", "speed").groupBy("mmsi").applyInPandas(spread, "mmsi long, n long, hi double, lo double")
    return got.select("mmsi", "n", X.portable(F.col("hi") - F.col("lo")).alias("spread"))


@query("x2_row_function", f"WITH {AIS} SELECT event_id, CAST(CASE WHEN speed >= 50 THEN 1 ELSE 0 END AS INTEGER) AS fast FROM ais")
def x2_row_function(s, d):
    """A function of a row: a column expression, so it stays in generated code."""
    return ais(s, d).select("event_id", F.when(F.col("speed") >= 50, 1).otherwise(0).alias("fast"))


@query("x3_parallel_map", f"WITH {AIS} SELECT event_id, {r6('speed * 1.852::DOUBLE')} AS kmh FROM ais")
def x3_parallel_map(s, d):
    """A function of batches, run on all partitions side by side."""

    def convert(batches):
        for pdf in batches:
            yield pdf.assign(kmh=pdf["speed"] * 1.852)[["event_id", "kmh"]]

    return ais(s, d).select("event_id", "speed").mapInPandas(convert, "event_id long, kmh double").select("event_id", X.portable(F.col("kmh")).alias("kmh"))


@query("x6_pool_map", f"WITH {AIS} SELECT mmsi, min(ts) AS st, max(ts) AS et FROM ais GROUP BY mmsi")
def x6_pool_map(s, d):
    """One task per partition of objects, results joined by union: what a pool of processes does."""

    def ends(batches):
        import pandas as pd

        parts = [pdf.groupby("mmsi", as_index=False).agg(st=("ts", "min"), et=("ts", "max")) for pdf in batches]
        if parts:
            yield pd.concat(parts).groupby("mmsi", as_index=False).agg(st=("st", "min"), et=("et", "max"))

    return ais(s, d).select("mmsi", "ts").repartition("mmsi").mapInPandas(ends, "mmsi long, st long, et long")


@query("x8_set_aggregate", f"WITH {FRAMES} SELECT mmsi % 20 AS site, count(DISTINCT mmsi) AS n_members FROM frames GROUP BY 1")
def x8_set_aggregate(s, d):
    return frames_at(s, d).groupBy((F.col("mmsi") % 20).alias("site")).agg(F.size(F.collect_set("mmsi")).cast("long").alias("n_members"))


# ---- streams, run to the end of what is there ----
def arrivals(s: SparkSession, d: str) -> DataFrame:
    """The points as a stream of files: the first per object and second, without those of the very last second."""
    path, p = fresh_path(s, "arrivals"), ais1(s, d)
    p.join(F.broadcast(p.agg(F.max("ts").alias("e"))), F.col("ts") < F.col("e")).select("mmsi", "ts", "lon", "lat", "speed").write.parquet(path)
    return s.readStream.schema("mmsi long, ts long, lon double, lat double, speed double").parquet(path).withColumn("datetime", F.timestamp_seconds("ts"))


def drained(stream: DataFrame) -> DataFrame:
    """Runs a stream over all that is there, into a table."""
    s = stream.sparkSession
    out, state = fresh_path(s, "stream"), fresh_path(s, "stream-state")
    stream.writeStream.format("parquet").option("checkpointLocation", state).outputMode("append").trigger(availableNow=True).start(out).awaitTermination()
    return s.read.schema(stream.schema).parquet(out)


@query("st1_keyed_windows", ORACLE_SQL["r13_delayed_interpolation"])
def st1_keyed_windows(s, d):
    """Windows of two points per object, in event time; state expires with the watermark."""
    return drained(T.stream_delayed_interpolation(arrivals(s, d), 60)).select("mmsi", "grid_ts", X.portable(F.col("lon"), 1e9).alias("lon"))


@query("st3_pending_instants", f"""WITH {AIS1}, {ENDS}, l AS (SELECT mmsi, lag(ts) OVER w AS a, ts AS b, lag(lon) OVER w AS x, lon AS y, lead(ts) OVER w AS nx FROM arr {W}),
g AS (SELECT *, CASE WHEN b % 3600 = 0 THEN b ELSE (b // 3600 + 1) * 3600 END AS g0, unnest([0, 1, 2]) AS k FROM l WHERE a IS NOT NULL AND nx IS NOT NULL)
SELECT mmsi, CAST(g0 + k * 3600 AS BIGINT) AS grid_ts, {r6('x + (y - x) * (CAST(g0 + k * 3600 - a AS DOUBLE) / CAST(b - a AS DOUBLE))')} AS lon FROM g WHERE g0 + k * 3600 < nx""")
def st3_pending_instants(s, d):
    """Extrapolated instants that a later point has settled."""
    settled = ais1(s, d).join(F.broadcast(ais1(s, d).agg(F.max("ts").alias("e"))), F.col("ts") < F.col("e")).groupBy("mmsi").agg(F.max("ts").alias("last"))
    out = drained(T.stream_extrapolation(arrivals(s, d), 60)).join(settled, "mmsi").filter("grid_ts < last")
    return out.select("mmsi", "grid_ts", X.portable(F.col("lon")).alias("lon"))


@query("st5_incremental_mining", ORACLE_SQL["g2_mine_convoys"])
def st5_incremental_mining(s, d):
    """Clusters arrive as a stream; active patterns are carried from batch to batch."""
    path = fresh_path(s, "clusters")
    convoys(s, d).write.parquet(path)
    miner = T.IncrementalMiner(2, FRAME_S)
    s.readStream.schema(G.CLUSTER).parquet(path).writeStream.foreachBatch(miner).option("checkpointLocation", fresh_path(s, "stream-state")).trigger(availableNow=True).start().awaitTermination()
    return s.createDataFrame([(",".join(map(str, c)), st, et) for c, st, et in miner.patterns()], "clusters string, st long, et long")


@query("st7_session_windows", f"""WITH {AIS1}, b AS (SELECT mmsi, ts, sum(brk) OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS session FROM (SELECT *, CASE WHEN ts - lag(ts) OVER w > 43200 THEN 1 ELSE 0 END AS brk FROM ais1 {W}))
SELECT mmsi, min(ts) AS st, max(ts) AS et, count(*) AS n FROM b GROUP BY mmsi, session""")
def st7_session_windows(s, d):
    """Sessions that end after a gap of more than 12 hours (times are whole seconds; a length between two of them does not ask whether windows that touch are one)."""
    p = ais1(s, d).withColumn("t", F.timestamp_seconds("ts")).withWatermark("t", "1 hour")
    g = p.groupBy("mmsi", F.session_window("t", "43200500 milliseconds")).agg(F.min("ts").alias("st"), F.max("ts").alias("et"), F.count(F.lit(1)).alias("n"))
    return g.select("mmsi", "st", "et", "n")


@query("g7_driver_with_restart", ORACLE_SQL["g2_mine_convoys"])
def g7_driver_with_restart(s, d):
    """Mines in time partitions, stops after two, starts again from the snapshot, and writes the CSV."""
    clusters, folder, job = convoys(s, d), fresh_path(s, "driver"), io.Job("convoys", 2, FRAME_S // 60, 1000.0, FRAME_S)
    D.group_patterns(clusters, job, folder, parts=4, stop_after=2)
    return io.read_patterns_csv(s, D.group_patterns(clusters, job, folder, parts=4)).select(text(), "st", "et")


# ---- SQL of queries that stand elsewhere ----
ORACLE_SQL["x4_greedy_bins"] = f"""WITH RECURSIVE {AIS}, c AS (SELECT mmsi, count(*) AS n, row_number() OVER (ORDER BY mmsi) AS rn FROM ais GROUP BY mmsi), m AS (SELECT greatest(1, count(*) // 8) AS most FROM ais),
f AS (SELECT rn, mmsi, 0 AS bin, n AS held FROM c WHERE rn = 1 UNION ALL
 SELECT c.rn, c.mmsi, CASE WHEN f.held >= m.most THEN f.bin + 1 ELSE f.bin END, CASE WHEN f.held >= m.most THEN c.n ELSE f.held + c.n END FROM f JOIN c ON c.rn = f.rn + 1, m)
SELECT mmsi, CAST(bin AS INTEGER) AS bin FROM f"""
ORACLE_SQL["w20_adaptive_pois"] = f"""WITH {AIS1}, {POI.split(', q AS')[0]}, q AS (SELECT mmsi, max(last) AS last, quantile_cont(change, 0.25) AS a, quantile_cont(change, 0.75) AS b FROM chg GROUP BY mmsi),
al AS (SELECT unnest(range(1, 101)) AS alpha), o AS (SELECT c.mmsi, al.alpha, c.i FROM chg c JOIN q USING (mmsi), al WHERE c.change > q.b + al.alpha * (q.b - q.a) OR c.change < q.a - al.alpha * (q.b - q.a)),
k AS (SELECT * FROM o WINDOW z AS (PARTITION BY mmsi, alpha ORDER BY i) QUALIFY lag(i) OVER z IS NULL OR lead(i) OVER z IS NOT NULL OR i - lag(i) OVER z = 1),
u AS (SELECT mmsi, alpha, i FROM k UNION SELECT mmsi, alpha, 0 FROM q, al UNION SELECT mmsi, alpha, last FROM q, al),
p AS (SELECT mmsi, alpha, list_sort(list(i)) AS pois FROM u GROUP BY 1, 2), t AS (SELECT *, min(CASE WHEN len(pois) <= 2 THEN alpha END) OVER (PARTITION BY mmsi) AS stop FROM p),
v AS (SELECT mmsi, pois, count(*) AS n, min(alpha) AS a FROM t WHERE stop IS NULL OR alpha <= stop GROUP BY 1, 2)
SELECT mmsi, array_to_string(pois, ',') AS pois FROM v QUALIFY row_number() OVER (PARTITION BY mmsi ORDER BY n DESC, a) = 1"""
ORACLE_SQL["f9_video_codec"] = f"""WITH {PIX}, q AS (SELECT a.frame_id, a.row * 8 + a.col AS i, CASE WHEN b.v IS NULL THEN round_even(round_even(a.v / 10, 2) * 10, 2) ELSE -round_even(round_even((b.v - a.v) / 100, 2) * 100, 2) END AS v
 FROM px a LEFT JOIN px b ON b.frame_id = a.frame_id - 1 AND a.row = b.row AND a.col = b.col)
SELECT frame_id, i, {r6('sum(v) OVER (PARTITION BY i ORDER BY frame_id)')} AS v FROM q"""


def _even(x: str, digits: int = 2) -> str:
    """Half-even rounding of the shortest decimal that stands for a double, as Spark rounds."""
    d = f"(CAST(CAST(({x}) AS VARCHAR) AS DECIMAL(34, 18)) * {10**digits})"
    return f"(CAST(floor({d}) + CASE WHEN {d} - floor({d}) > 0.5 THEN 1 WHEN {d} - floor({d}) < 0.5 THEN 0 ELSE abs(floor({d}) % 2) END AS DOUBLE) / {10**digits})"


def _line(p: str) -> str:
    """m and b of the line along the heading of the point with this prefix."""
    s, c = f"round_even(sin(radians({p}heading)), 7)", f"round_even(cos(radians({p}heading)), 7)"
    return f"CASE WHEN {c} = 0 THEN CAST('inf' AS DOUBLE) ELSE {_even(f"{s} / {c}")} END AS {p}m, CASE WHEN {c} = 0 THEN CAST('inf' AS DOUBLE) ELSE {_even(f"({p}lat * {c} - {p}lon * {s}) / {c}")} END AS {p}b"


#: From rows with lon, lat, heading and the same with n_: cx, cy.
CROSSING = f"""CASE WHEN m = n_m THEN (lon + n_lon) / 2 WHEN isinf(m) THEN {_even('lon')} WHEN isinf(n_m) THEN {_even('n_lon')} ELSE {_even('(n_b - b) / (m - n_m)')} END AS cx,
CASE WHEN m = n_m THEN (lat + n_lat) / 2 WHEN isinf(m) THEN {_even('n_m * lon + n_b')} WHEN isinf(n_m) THEN {_even('m * n_lon + b')} ELSE {_even('m * ((n_b - b) / (m - n_m)) + b')} END AS cy"""
NEXT = f"nx AS (SELECT *, lead(ts) OVER w AS n_ts, lead(lon) OVER w AS n_lon, lead(lat) OVER w AS n_lat, lead(heading) OVER w AS n_heading FROM {{}} {W} QUALIFY lead(ts) OVER w IS NOT NULL), ln AS (SELECT *, {_line('')}, {_line('n_')} FROM nx), cr AS (SELECT *, {CROSSING} FROM ln)"
ORACLE_SQL["r9_control_points"] = f"WITH {AIS1}, {NEXT.format('ais1')} SELECT event_id, cx, cy FROM cr"
ORACLE_SQL["r11_bezier_alignment"] = f"""WITH {AIS1}, {ENDS}, {NEXT.format('arr')}, g AS (SELECT *, (n_ts - 1) // 3600 * 3600 AS g FROM cr), t AS (SELECT *, CAST(g - ts AS DOUBLE) / CAST(n_ts - ts AS DOUBLE) AS t FROM g WHERE ts <= g)
SELECT mmsi, g AS grid_ts, {r6('(1 - t) * (1 - t) * lon + 2 * t * (1 - t) * cx + t * t * n_lon')} AS lon, {r6('(1 - t) * (1 - t) * lat + 2 * t * (1 - t) * cy + t * t * n_lat')} AS lat FROM t"""


def _prepared(points: str) -> str:
    """Velocity on the grid and segments between points of interest (alpha 3, windows of 5), object by object."""
    leg = hav("lon", "lat", "lead(lon) OVER g", "lead(lat) OVER g")
    velocity = f"gv AS (SELECT mmsi, grid_ts AS ts, {leg} * {NM} * 3600 / abs(lead(grid_ts) OVER g - grid_ts) AS velocity FROM grid WINDOW g AS (PARTITION BY mmsi ORDER BY grid_ts) QUALIFY lead(grid_ts) OVER g IS NOT NULL OR count(*) OVER (PARTITION BY mmsi) = 1)"
    poi = POI.replace("FROM ais1", "FROM gv").replace("speed", "velocity").replace("ts, event_id", "ts").replace("1.5::DOUBLE", "3.0::DOUBLE")
    return f"{grid_sql(points, 'mmsi', 3600)}, {velocity}, {poi}, pt AS (SELECT c.mmsi, c.ts, velocity, (SELECT count(*) FROM k WHERE k.mmsi = c.mmsi AND k.i > 0 AND k.i < c.last AND k.i <= c.i) AS traj_id FROM chg c)"


ORACLE_SQL["r3_prepared_tracks"] = f"WITH {AIS1}, {_prepared('ais1')} SELECT mmsi, ts, {r6('velocity', '1e5')} AS velocity, CAST(traj_id AS INTEGER) AS traj_id FROM pt"
ORACLE_SQL["r4_prepared_in_pieces"] = f"""WITH {AIS1}, {TRIPS}, tracks AS (SELECT * REPLACE (mmsi || ':' || trip_id AS mmsi) FROM trip), {_prepared('tracks')},
pc AS (SELECT CAST(split_part(mmsi, ':', 1) AS BIGINT) AS mmsi, CAST(split_part(mmsi, ':', 2) AS INTEGER) AS piece, ts, velocity, traj_id FROM pt), top AS (SELECT mmsi, piece, max(traj_id) + 1 AS n FROM pc GROUP BY 1, 2),
off AS (SELECT mmsi, piece, coalesce(sum(n) OVER (PARTITION BY mmsi ORDER BY piece ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM top)
SELECT mmsi, ts, {r6('velocity', '1e5')} AS velocity, CAST(traj_id + off AS INTEGER) AS traj_id FROM pc JOIN off USING (mmsi, piece)"""
ORACLE_SQL["r14_interpolation"] = f"""WITH RECURSIVE {AIS1}, {ENDS}, d AS (SELECT mmsi, ts, lon, e.e, e.s // 3600 * 3600 AS s0, CASE WHEN ts = e.s THEN e.s // 3600 * 3600 ELSE greatest(e.s // 3600 * 3600, (ts - 1) // 3600 * 3600) END AS k, row_number() OVER (PARTITION BY mmsi ORDER BY ts) AS n FROM arr, e),
acc AS (SELECT mmsi, n, ts AS last, true AS ok FROM d WHERE n = 1 UNION ALL SELECT d.mmsi, d.n, CASE WHEN acc.last < d.k THEN d.ts ELSE acc.last END, acc.last < d.k FROM acc JOIN d ON d.mmsi = acc.mmsi AND d.n = acc.n + 1),
kept AS (SELECT d.*, lead(ts) OVER q AS b, lead(lon) OVER q AS y, lead(ts, 2) OVER q AS nx FROM d JOIN acc USING (mmsi, n) WHERE acc.ok WINDOW q AS (PARTITION BY mmsi ORDER BY ts)),
g AS (SELECT *, unnest(generate_series(greatest((ts + 3599) // 3600 * 3600, s0, (b - 1) // 3600 * 3600), b // 3600 * 3600, 3600)) AS g FROM kept WHERE b IS NOT NULL)
SELECT mmsi, g AS grid_ts, {r6('lon + (y - lon) * (CAST(g - ts AS DOUBLE) / CAST(b - ts AS DOUBLE))', '1e9')} AS lon FROM g WHERE g + 3600 < coalesce(nx, e) AND g + 3600 < e"""
ORACLE_SQL["r12_mode_dispatch"] = "SELECT * FROM (VALUES ('bezierInterp1d', 1), ('bezierIinterp1d', 1), ('delayed', 1), ('extrap1d', 1), ('interp1d', 1), ('spline', 0)) v(mode, known)"


@query("r12_mode_dispatch", ORACLE_SQL["r12_mode_dispatch"])
def r12_mode_dispatch(s, d):
    """Every known mode runs; an unknown one is refused."""
    rows = []
    for mode in (*R.ALIGNERS, "spline"):
        try:
            rows.append((mode, int(bool(R.align(ais(s, d), mode, ["lon"], 60).columns))))
        except ValueError:
            rows.append((mode, 0))
    return s.createDataFrame(rows, "mode string, known int")
