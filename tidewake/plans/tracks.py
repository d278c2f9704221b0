"""Queries over points and tracks."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..columns import Spec
from ..functions import exprs as X
from ..operators import areas as A
from ..operators import clean as C
from ..operators import kinematics as K
from ..operators import partitioning as P
from ..operators import resample as R
from ..operators import segments as S
from ..operators import series as N
from ..sources import io
from .views import AIS, AIS1, AREAS, ORACLE_SQL, RADIUS_M, ais, ais1, areas, hav, query, r6, table

r = X.portable
NM = "CAST(0.539956803 AS DOUBLE)"
W = "WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)"

# ---- scans ----
query("s3_column_scan", "SELECT count(DISTINCT user_id) AS n_objects FROM events")(lambda s, d: table(s, d, "events").select("user_id").agg(F.countDistinct("user_id").alias("n_objects")))
query("s4_range_scan", f"WITH {AIS} SELECT event_id, mmsi, ts FROM ais WHERE ts > 1704200000 AND ts <= 1705000000")(lambda s, d: io.scan_range(ais(s, d), "ts", 1704200000, 1705000000).select("event_id", "mmsi", "ts"))
query("s4_open_range_scan", f"WITH {AIS} SELECT event_id, mmsi, ts FROM ais WHERE ts > 1704200000 AND ts < 1704900000")(lambda s, d: io.scan_between(ais(s, d), "ts", 1704200000, 1704900000).select("event_id", "mmsi", "ts"))
query("s5_max_scan", f"WITH {AIS} SELECT max(ts) AS max_ts FROM ais")(lambda s, d: ais(s, d).agg(F.max("ts").alias("max_ts")))


@query("s13_checksum", """WITH h AS (SELECT sha256(concat_ws('|', event_id, user_id, event_type)) AS h FROM events), p AS (SELECT h[1:3] AS p, sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY 1)
SELECT sha256(string_agg(h, '' ORDER BY p)) AS checksum FROM p""")
def s13_checksum(s, d):
    return P.exact_fingerprint(table(s, d, "events"), ["event_id", "user_id", "event_type"])


query("s15_plot_thresholds", f"WITH {AIS}, q AS (SELECT quantile_cont(speed, 0.25) AS a, quantile_cont(speed, 0.75) AS b FROM ais) SELECT {r6('a - 3 * (b - a)')} AS low, {r6('b + 3 * (b - a)')} AS high FROM q")(
    lambda s, d: C.iqr_outliers(ais(s, d), "speed", 3.0).select(r(F.col("low")).alias("low"), r(F.col("high")).alias("high")).distinct())

# ---- projections, filters, duplicates ----
query("p1_points", f"WITH {AIS} SELECT event_id, lon AS x, lat AS y, {r6('6378137.0::DOUBLE * radians(lon)', '1e3')} AS merc_x, {r6('6378137.0::DOUBLE * ln(tan(0.7853981633974483::DOUBLE + radians(lat) / 2))', '1e3')} AS merc_y FROM ais")(
    lambda s, d: C.with_points(ais(s, d), mercator=True).select("event_id", "geom.x", "geom.y", r(F.col("merc_x"), 1e3).alias("merc_x"), r(F.col("merc_y"), 1e3).alias("merc_y")))
query("p2_epoch_from_text", "SELECT event_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts FROM events WHERE event_id % 10 <> 0")(
    lambda s, d: C.epoch_from_text(table(s, d, "events").select("event_id", F.when(F.col("event_id") % 10 != 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).alias("datetime"))).select("event_id", "ts"))
query("p3_time_from_epoch", f"WITH {AIS} SELECT event_id, strftime(make_timestamp(ts * 1000000), '%Y-%m-%d %H:%M:%S') AS datetime FROM ais")(
    lambda s, d: ais(s, d).select("event_id", F.date_format(C.time_of("ts"), "yyyy-MM-dd HH:mm:ss").alias("datetime")))
query("p4_valid_ids", f"WITH {AIS} SELECT event_id, mmsi % 7 AS mmsi FROM ais WHERE mmsi % 7 <> 0")(lambda s, d: C.valid_ids(ais(s, d).withColumn("mmsi", F.col("mmsi") % 7)).select("event_id", "mmsi"))
query("p5_drop_nulls", f"WITH {AIS} SELECT event_id, mmsi FROM ais WHERE event_id % 5 <> 0")(lambda s, d: ais(s, d).withColumn("lon", F.when(F.col("event_id") % 5 != 0, F.col("lon"))).dropna(subset=["mmsi", "lon"]).select("event_id", "mmsi"))
query("p6_drop_columns", "SELECT event_id, user_id, event_type FROM events")(lambda s, d: table(s, d, "events").drop("id", "status", "ts", "value", "props"))
query("p7_calm", f"WITH {AIS} SELECT event_id, mmsi FROM ais WHERE NOT coalesce(CASE WHEN event_id % 9 = 0 THEN NULL ELSE speed END >= 50, false)")(
    lambda s, d: C.calm(ais(s, d).withColumn("velocity", F.when(F.col("event_id") % 9 != 0, F.col("speed"))), 50.0).select("event_id", "mmsi"))
query("p8_dedup_first", f"WITH {AIS} SELECT mmsi, ts // 86400 AS ts, min(event_id) AS event_id FROM ais GROUP BY 1, 2")(lambda s, d: C.dedup_first(ais(s, d).withColumn("ts", F.floor(F.col("ts") / 86400))).select("mmsi", "ts", "event_id"))
query("p9_dedup_last", f"WITH {AIS} SELECT mmsi, ts // 86400 AS ts, max(event_id) AS event_id FROM ais GROUP BY 1, 2")(lambda s, d: C.dedup_last(ais(s, d).withColumn("ts", F.floor(F.col("ts") / 86400))).select("mmsi", "ts", "event_id"))
query("p10_clean", f"""WITH {AIS1}, q AS (SELECT mmsi, quantile_cont(ts, 0.25) AS a, quantile_cont(ts, 0.75) AS b FROM ais1 GROUP BY mmsi)
SELECT event_id, mmsi, ts FROM ais1 JOIN q USING (mmsi) WHERE NOT (ts > b + 0.3::DOUBLE * (b - a) OR ts < a - 0.3::DOUBLE * (b - a))""")(lambda s, d: C.clean(ais(s, d), 0.3).select("event_id", "mmsi", "ts"))
query("p11_pick_groups", f"WITH {AIS}, g AS (SELECT DISTINCT mmsi FROM ais ORDER BY (mmsi * 7919) % 1009, mmsi LIMIT 5) SELECT event_id, mmsi FROM ais WHERE mmsi IN (SELECT mmsi FROM g)")(lambda s, d: C.pick_groups(ais(s, d), "mmsi", 5).select("event_id", "mmsi"))
query("p15_drop_outliers", """WITH q AS (SELECT quantile_cont(l_quantity, [0.25, 0.75]) AS x, quantile_cont(l_extendedprice, [0.25, 0.75]) AS y FROM lineitem)
SELECT l_orderkey, l_linenumber FROM lineitem, q WHERE NOT (l_quantity > x[2] + 0.3::DOUBLE * (x[2] - x[1]) OR l_quantity < x[1] - 0.3::DOUBLE * (x[2] - x[1]) OR l_extendedprice > y[2] + 0.3::DOUBLE * (y[2] - y[1]) OR l_extendedprice < y[1] - 0.3::DOUBLE * (y[2] - y[1]))""")(
    lambda s, d: C.drop_outliers(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], 0.3).select("l_orderkey", "l_linenumber"))
query("p16_drop_last", f"WITH {AIS} SELECT event_id, mmsi FROM ais QUALIFY lead(ts) OVER (PARTITION BY mmsi ORDER BY ts, event_id) IS NOT NULL")(lambda s, d: C.drop_last(ais(s, d)).select("event_id", "mmsi"))
query("p17_empty_schema", f"WITH {AIS} SELECT event_id, mmsi, lon FROM ais WHERE false")(lambda s, d: ais(s, d).select("event_id", "mmsi", "lon").filter(F.lit(False)))

# ---- joins with areas ----
HITS = f"hits AS (SELECT p.mmsi, p.ts, p.event_id, max(a.area_id) AS area_id FROM ais1 p JOIN areas a ON {hav('p.lon', 'p.lat', 'a.lon', 'a.lat')} * 1000 <= {RADIUS_M} GROUP BY 1, 2, 3)"
LABELS = f"{HITS}, lab AS (SELECT p.*, h.area_id, CASE WHEN h.area_id IS NULL THEN 0 ELSE -1 END AS label FROM ais1 p LEFT JOIN hits h USING (mmsi, ts, event_id))"
query("j2_classify_areas", f"WITH {AIS1}, {AREAS}, {LABELS} SELECT event_id, area_id, label FROM lab")(lambda s, d: A.classify_areas(ais1(s, d), areas(s), RADIUS_M).select("event_id", "area_id", "label"))
query("j3_port_labels", f"WITH {AIS1}, {AREAS}, {LABELS} SELECT mmsi, count(*) AS n, count(*) FILTER (label = -1) AS inside FROM lab GROUP BY mmsi")(
    lambda s, d: A.classify_areas(ais1(s, d), areas(s), RADIUS_M).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("label") == -1).alias("inside")))
query("j4_area_bounds", f"WITH {AREAS}, b AS (SELECT area_id, lon, lat, 600.0::DOUBLE / 111194.9::DOUBLE AS dy, 600.0::DOUBLE / 111194.9::DOUBLE / greatest(0.01::DOUBLE, cos(radians(lat))) AS dx FROM areas) SELECT area_id, {r6('lon - dx', '1e9')} AS west, {r6('lon + dx', '1e9')} AS east, {r6('lat - dy', '1e9')} AS south, {r6('lat + dy', '1e9')} AS north FROM b")(
    lambda s, d: A.area_bounds(areas(s), RADIUS_M).select("area_id", *[r(F.col(c), 1e9).alias(c) for c in ("west", "east", "south", "north")]))
query("j5_nearest_area", f"WITH {AIS}, {AREAS} SELECT p.event_id, {r6('min(sqrt((a.lon - p.lon) * (a.lon - p.lon) + (a.lat - p.lat) * (a.lat - p.lat)))')} AS nearest FROM ais p, areas a GROUP BY p.event_id")(
    lambda s, d: A.nearest_area(ais(s, d), areas(s)).select("event_id", r(F.col("nearest")).alias("nearest")))
query("j6_semi_join", f"WITH {AIS1}, {AREAS}, {HITS} SELECT event_id, mmsi FROM ais1 WHERE mmsi IN (SELECT mmsi FROM hits)")(
    lambda s, d: ais1(s, d).join(A.classify_areas(ais1(s, d), areas(s), RADIUS_M).filter("label = -1").select("mmsi"), "mmsi", "left_semi").select("event_id", "mmsi"))
query("j7_anti_join", f"WITH {AIS1}, {AREAS}, {HITS} SELECT event_id, mmsi FROM ais1 WHERE mmsi NOT IN (SELECT mmsi FROM hits)")(
    lambda s, d: ais1(s, d).join(A.classify_areas(ais1(s, d), areas(s), RADIUS_M).filter("label = -1").select("mmsi"), "mmsi", "left_anti").select("event_id", "mmsi"))

# ---- aggregates ----
query("a1_quantiles", f"WITH {AIS} SELECT mmsi, {r6('quantile_cont(speed, 0.25)')} AS q25, {r6('quantile_cont(speed, 0.75)')} AS q75 FROM ais GROUP BY mmsi")(
    lambda s, d: ais(s, d).groupBy("mmsi").agg(F.percentile("speed", F.array(F.lit(0.25), F.lit(0.75))).alias("q")).select("mmsi", r(F.col("q")[0]).alias("q25"), r(F.col("q")[1]).alias("q75")))
query("a2_iqr_outliers", f"WITH {AIS}, q AS (SELECT mmsi, quantile_cont(speed, 0.25) AS a, quantile_cont(speed, 0.75) AS b FROM ais GROUP BY mmsi) SELECT event_id, mmsi FROM ais JOIN q USING (mmsi) WHERE speed > b + 1.5::DOUBLE * (b - a) OR speed < a - 1.5::DOUBLE * (b - a)")(
    lambda s, d: C.iqr_outliers(ais(s, d), "speed", 1.5, ["mmsi"]).filter("is_outlier").select("event_id", "mmsi"))
query("a3_feature_outliers", """WITH l AS (SELECT l_orderkey, l_linenumber, 'l_quantity' AS feature, l_quantity AS x FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'l_extendedprice', l_extendedprice FROM lineitem),
q AS (SELECT feature, quantile_cont(x, 0.25) AS a, quantile_cont(x, 0.75) AS b FROM l GROUP BY feature) SELECT feature, l_orderkey, l_linenumber, x FROM l JOIN q USING (feature) WHERE x > b + 0.4::DOUBLE * (b - a) OR x < a - 0.4::DOUBLE * (b - a)""")(
    lambda s, d: C.feature_outliers(table(s, d, "lineitem"), ["l_quantity", "l_extendedprice"], ["l_orderkey", "l_linenumber"], 0.4))
query("a9_count_distinct", f"WITH {AIS} SELECT ts // 86400 AS day, count(DISTINCT mmsi) AS n FROM ais GROUP BY 1")(lambda s, d: ais(s, d).groupBy(F.floor(F.col("ts") / 86400).alias("day")).agg(F.countDistinct("mmsi").alias("n")))
query("a10_basic", f"WITH {AIS} SELECT mmsi, min(speed) AS lo, max(speed) AS hi, {r6('avg(speed)')} AS mean, count(*) AS n FROM ais GROUP BY mmsi")(
    lambda s, d: ais(s, d).groupBy("mmsi").agg(F.min("speed").alias("lo"), F.max("speed").alias("hi"), r(F.avg("speed")).alias("mean"), F.count(F.lit(1)).alias("n")))
query("a11_mode", """WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2) SELECT user_id, event_type, n FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")(
    lambda s, d: N.mode_of(table(s, d, "events"), "event_type", ["user_id"], "event_id"))

# ---- kinematics ----
LEG = hav("lon", "lat", "lead(lon) OVER w", "lead(lat) OVER w")
VEL = f"vel AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY mmsi) = 1 THEN speed ELSE {LEG} * {NM} * 3600 / abs(lead(ts) OVER w - ts) END AS velocity FROM ais1 {W} QUALIFY count(*) OVER (PARTITION BY mmsi) = 1 OR lead(ts) OVER w IS NOT NULL)"
query("w1_next_location", f"WITH {AIS} SELECT event_id, lead(lon) OVER w AS next_lon, lead(lat) OVER w AS next_lat FROM ais {W}")(
    lambda s, d: ais(s, d).select("event_id", F.lead("lon").over(K.order_of(Spec())).alias("next_lon"), F.lead("lat").over(K.order_of(Spec())).alias("next_lat")))
query("w2_differences", f"WITH {AIS} SELECT event_id, ts - lag(ts) OVER w AS back, ts - lead(ts) OVER w AS ahead FROM ais {W}")(
    lambda s, d: ais(s, d).select("event_id", (F.col("ts") - F.lag("ts").over(K.order_of(Spec()))).alias("back"), (F.col("ts") - F.lead("ts").over(K.order_of(Spec()))).alias("ahead")))
query("w3_velocity", f"WITH {AIS1}, {VEL} SELECT event_id, {r6('velocity')} AS velocity FROM vel")(lambda s, d: K.velocity(ais1(s, d), fallback="speed").select("event_id", r(F.col("velocity")).alias("velocity")))
LEG1 = hav("lat", "lon", "lead(lat) OVER w", "lead(lon) OVER w")
query("w4_velocity_v1", f"""WITH {AIS1}, n AS (SELECT *, count(*) OVER (PARTITION BY mmsi) AS c, row_number() OVER w AS i, {LEG1} * {NM} * 3600 / abs(lead(ts) OVER w - ts) AS v FROM ais1 WHERE mmsi <> 0 {W})
SELECT event_id, {r6('CASE WHEN c = 1 THEN coalesce(speed, 0) WHEN i = c - 1 THEN 0 ELSE coalesce(v, 0) END')} AS velocity FROM n WHERE c = 1 OR i < c""")(lambda s, d: K.velocity(ais1(s, d), compat="v1", fallback="speed").select("event_id", r(F.col("velocity")).alias("velocity")))
BEAR = "degrees(atan2(sin(radians(lead(lon) OVER w) - radians(lon)) * cos(radians(lead(lat) OVER w)), cos(radians(lat)) * sin(radians(lead(lat) OVER w)) - sin(radians(lat)) * cos(radians(lead(lat) OVER w)) * cos(radians(lead(lon) OVER w) - radians(lon)))) + 360"
query("w5_bearing", f"WITH {AIS1}, b AS (SELECT event_id, count(*) OVER (PARTITION BY mmsi) AS c, course, lead(ts) OVER w AS nx, {BEAR} AS b FROM ais1 {W}) SELECT event_id, {r6('CASE WHEN c = 1 THEN course WHEN b >= 360 THEN b - 360 ELSE b END')} AS bearing FROM b WHERE c = 1 OR nx IS NOT NULL")(
    lambda s, d: K.bearing(ais1(s, d)).select("event_id", r(F.col("bearing")).alias("bearing")))
query("w6_acceleration_v1", f"WITH {AIS1} SELECT event_id, {r6('coalesce((speed - lag(speed) OVER w) / nullif(ts - lag(ts) OVER w, 0), 0)')} AS acceleration FROM ais1 {W}")(lambda s, d: K.acceleration(ais1(s, d), "speed", compat="v1").select("event_id", r(F.col("acceleration")).alias("acceleration")))
query("w7_acceleration_v2", f"WITH {AIS1} SELECT event_id, {r6('(speed - lead(speed) OVER w) / nullif(abs(ts - lead(ts) OVER w), 0)')} AS acceleration FROM ais1 {W}")(lambda s, d: K.acceleration(ais1(s, d), "speed").select("event_id", r(F.col("acceleration")).alias("acceleration")))
query("w8_distance", f"WITH {AIS1}, l AS (SELECT event_id, mmsi, ts, {LEG} * {NM} AS leg FROM ais1 {W} QUALIFY lead(ts) OVER w IS NOT NULL) SELECT event_id, {r6('sum(leg) OVER (PARTITION BY mmsi ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)')} AS distance FROM l")(
    lambda s, d: K.distance_travelled(ais1(s, d)).select("event_id", r(F.col("distance")).alias("distance")))
CHG = """m AS (SELECT *, CASE WHEN count(speed) OVER f = 5 THEN avg(speed) OVER f END AS m FROM ais1 WINDOW f AS (PARTITION BY mmsi ORDER BY ts, event_id ROWS 4 PRECEDING)),
dd AS (SELECT *, m - lag(m) OVER w AS dm FROM m WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)), chg AS (SELECT *, CASE WHEN count(dm) OVER f = 5 THEN avg(dm) OVER f END AS change, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) - 1 AS i, count(*) OVER (PARTITION BY mmsi) - 1 AS last FROM dd WINDOW f AS (PARTITION BY mmsi ORDER BY ts, event_id ROWS 4 PRECEDING))"""
query("w9_smoothed_change", f"WITH {AIS1}, {CHG} SELECT event_id, {r6('change')} AS change FROM chg")(lambda s, d: S.smoothed_change("speed", 5)(ais1(s, d)).select("event_id", r(F.col("change")).alias("change")))
query("w10_detrend", f"WITH {AIS1}, t AS (SELECT event_id, speed, CASE WHEN count(speed) OVER f = 25 THEN quantile_cont(speed, 0.5) OVER f END AS tr FROM ais1 WINDOW f AS (PARTITION BY mmsi ORDER BY ts, event_id ROWS 24 PRECEDING)) SELECT event_id, {r6('tr')} AS trend, {r6('coalesce(speed - tr, 0)')} AS detrended FROM t")(
    lambda s, d: N.detrend(ais1(s, d), ["speed"], ["mmsi"], ["ts", "event_id"], 25).select("event_id", r(F.col("speed_trend")).alias("trend"), r(F.col("speed_detrended")).alias("detrended")))
SERIES = f"ser AS (SELECT mmsi AS series_id, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) - 1 AS idx, CASE WHEN event_id % 7 < 2 THEN 0.0::DOUBLE ELSE speed END AS x FROM ais1)"


def series(s, d):
    return ais1(s, d).select(F.col("mmsi").alias("series_id"), (F.row_number().over(K.order_of(Spec())) - 1).cast("long").alias("idx"), F.when(F.col("event_id") % 7 < 2, 0.0).otherwise(F.col("speed")).alias("x"))


query("w11_consecutive_runs", f"WITH {AIS}, g AS (SELECT mmsi, event_id, event_id - 200 * row_number() OVER (PARTITION BY mmsi ORDER BY event_id) AS k FROM ais WHERE event_id % 2 = 0) SELECT mmsi, min(event_id) AS first, max(event_id) AS last, count(*) AS n FROM (SELECT mmsi, event_id, sum(b) OVER (PARTITION BY mmsi ORDER BY event_id) AS run FROM (SELECT mmsi, event_id, CASE WHEN event_id <> lag(event_id) OVER (PARTITION BY mmsi ORDER BY event_id) + 2 THEN 1 ELSE 0 END AS b FROM ais WHERE event_id % 2 = 0)) GROUP BY mmsi, run")(
    lambda s, d: N.consecutive_runs(ais(s, d).filter("event_id % 2 = 0"), "event_id", ["mmsi"], ["event_id"], 2).groupBy("mmsi", "run").agg(F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.count(F.lit(1)).alias("n")).drop("run"))
query("w12_zero_runs", f"WITH {AIS1}, {SERIES}, z AS (SELECT series_id, idx, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS k FROM ser WHERE x = 0) SELECT series_id, min(idx) AS first, max(idx) AS last FROM z GROUP BY series_id, k")(lambda s, d: N.zero_runs(series(s, d)))
LIN = "lin AS (SELECT mmsi AS series_id, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) - 1 AS idx, CAST(((row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) - 1) // 12 * 5) % 17 + (CASE WHEN ((row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) - 1) // 12) % 2 = 0 THEN ((row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) - 1) % 12) ELSE event_id % 5 END) AS DOUBLE) AS x FROM ais1)"


def steps(s, d):
    i = F.row_number().over(K.order_of(Spec())) - 1
    return ais1(s, d).withColumn("idx", i.cast("long")).select(F.col("mmsi").alias("series_id"), "idx", (F.floor(F.col("idx") / 12) * 5 % 17 + F.when(F.floor(F.col("idx") / 12) % 2 == 0, F.col("idx") % 12).otherwise(F.col("event_id") % 5)).cast("double").alias("x"))


query("w13_linear_runs", f"""WITH {AIS1}, {LIN}, d2 AS (SELECT *, lead(x, 2) OVER w - 2 * lead(x) OVER w + x AS d2, count(*) OVER (PARTITION BY series_id) AS n FROM lin WINDOW w AS (PARTITION BY series_id ORDER BY idx)),
f AS (SELECT *, idx - row_number() OVER (PARTITION BY series_id ORDER BY idx) AS k FROM d2 WHERE abs(d2) < 4e-5 AND x <> 0), rr AS (SELECT series_id, min(idx) AS first, least(max(idx) + 2, max(n)) AS last FROM f GROUP BY series_id, k),
g AS (SELECT *, max(last) OVER (PARTITION BY series_id ORDER BY first, last ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM rr), h AS (SELECT *, sum(CASE WHEN first > top THEN 1 ELSE 0 END) OVER (PARTITION BY series_id ORDER BY first, last) AS g FROM g)
SELECT series_id, min(first) AS first, max(last) AS last FROM h GROUP BY series_id, g HAVING max(last) - min(first) >= 7""")(lambda s, d: N.linear_runs(steps(s, d)))

# ---- segmentation ----
KEEP = "kp AS (SELECT * FROM lab QUALIFY label = 0 OR coalesce(lag(label) OVER w, -1) = 0 OR coalesce(lead(label) OVER w, -1) = 0 WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id))".replace(
    "QUALIFY label = 0 OR coalesce(lag(label) OVER w, -1) = 0 OR coalesce(lead(label) OVER w, -1) = 0 WINDOW w AS (PARTITION BY mmsi ORDER BY ts, event_id)",
    "QUALIFY label = 0 OR coalesce(lag(label) OVER (PARTITION BY mmsi ORDER BY ts, event_id), -1) = 0 OR coalesce(lead(label) OVER (PARTITION BY mmsi ORDER BY ts, event_id), -1) = 0")
SPLIT = """sg AS (SELECT *, sum(CASE WHEN label = -1 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS seg, row_number() OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS rn FROM kp),
sl AS (SELECT *, count(*) OVER (PARTITION BY mmsi, seg) AS len FROM sg), traj AS (SELECT *, CAST(sum(CASE WHEN label = -1 AND rn > 1 AND len > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY mmsi ORDER BY ts, event_id) AS INTEGER) AS traj_id FROM sl)"""
query("w14_keep_borders", f"WITH {AIS1}, {AREAS}, {LABELS}, {KEEP} SELECT event_id, label FROM kp")(lambda s, d: S.keep_borders(A.classify_areas(ais1(s, d), areas(s), RADIUS_M)).select("event_id", "label"))
query("w15_split_at_labels", f"WITH {AIS1}, {AREAS}, {LABELS}, {KEEP}, {SPLIT} SELECT mmsi, max(traj_id) AS top, count(*) AS n FROM traj GROUP BY mmsi")(
    lambda s, d: S.spatial_segments(ais1(s, d), areas(s), RADIUS_M).groupBy("mmsi").agg(F.max("traj_id").alias("top"), F.count(F.lit(1)).alias("n")))
query("w16_spatial_segments", f"WITH {AIS1}, {AREAS}, {LABELS}, {KEEP}, {SPLIT} SELECT event_id, traj_id FROM traj")(lambda s, d: S.spatial_segments(ais1(s, d), areas(s), RADIUS_M).select("event_id", "traj_id"))


def trip_sql(source: str, keys: str, order: str) -> str:
    p = f"PARTITION BY {keys} ORDER BY ts, event_id"
    return f"""tb AS (SELECT *, sum(CASE WHEN gap > 43200 THEN 1 ELSE 0 END) OVER ({p}) AS brk FROM (SELECT *, ts - lag(ts) OVER ({p}) AS gap FROM {source})),
tl AS (SELECT *, count(*) OVER (PARTITION BY {keys}, brk) AS plen FROM tb), trip AS (SELECT *, CAST(dense_rank() OVER (PARTITION BY mmsi ORDER BY {order}brk) - 1 AS INTEGER) AS trip_id FROM tl WHERE plen >= 2)"""


TRIPS = trip_sql("ais1", "mmsi", "")
query("w17_temporal_segments", f"WITH {AIS1}, {TRIPS} SELECT event_id, trip_id FROM trip")(lambda s, d: S.temporal_segments(ais1(s, d)).select("event_id", "trip_id"))
query("w18_pre_segments", f"WITH {AIS1}, {TRIPS}, x AS (SELECT mmsi, trip_id, max(event_id % 3) + 1 AS n FROM trip GROUP BY 1, 2), o AS (SELECT mmsi, trip_id, coalesce(sum(n) OVER (PARTITION BY mmsi ORDER BY trip_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM x) SELECT event_id, CAST(event_id % 3 + off AS INTEGER) AS traj_id FROM trip JOIN o USING (mmsi, trip_id)")(
    lambda s, d: S.offset_segments(S.pre_segments(ais1(s, d)).withColumn("traj_id", (F.col("event_id") % 3).cast("int"))).select("event_id", "traj_id"))
POI = f"""{CHG}, q AS (SELECT mmsi, quantile_cont(change, 0.25) AS a, quantile_cont(change, 0.75) AS b FROM chg GROUP BY mmsi),
o AS (SELECT c.mmsi, i FROM chg c JOIN q USING (mmsi) WHERE change > b + 1.5::DOUBLE * (b - a) OR change < a - 1.5::DOUBLE * (b - a)),
k AS (SELECT mmsi, i FROM o QUALIFY lag(i) OVER (PARTITION BY mmsi ORDER BY i) IS NULL OR lead(i) OVER (PARTITION BY mmsi ORDER BY i) IS NOT NULL OR i - lag(i) OVER (PARTITION BY mmsi ORDER BY i) = 1),
p AS (SELECT DISTINCT mmsi, i FROM (SELECT mmsi, i FROM k UNION ALL SELECT mmsi, 0 FROM chg UNION ALL SELECT mmsi, last FROM chg))"""
query("w19_points_of_interest", f"WITH {AIS1}, {POI} SELECT mmsi, string_agg(CAST(i AS VARCHAR), ',' ORDER BY i) AS pois FROM p GROUP BY mmsi")(
    lambda s, d: S.points_of_interest(ais1(s, d), "speed", 1.5, 5).select("mmsi", F.array_join("pois", ",").alias("pois")))
query("w20_adaptive_pois")(lambda s, d: S.adaptive_points_of_interest(ais1(s, d), "speed", 5).select("mmsi", F.array_join("pois", ",").alias("pois")))
query("w21_poi_segments", f"WITH {AIS1}, {POI} SELECT c.event_id, CAST((SELECT count(*) FROM k WHERE k.mmsi = c.mmsi AND k.i > 0 AND k.i < c.last AND k.i <= c.i) AS INTEGER) AS traj_id FROM chg c")(
    lambda s, d: S.poi_segments(ais1(s, d), S.points_of_interest(ais1(s, d), "speed", 1.5, 5)).select("event_id", "traj_id"))
query("w22_semantic_tags", f"""WITH {AIS1}, {AREAS}, {TRIPS}, nr AS (SELECT t.event_id, min(sqrt((a.lon - t.lon) * (a.lon - t.lon) + (a.lat - t.lat) * (a.lat - t.lat))) AS near FROM trip t, areas a GROUP BY 1),
g AS (SELECT mmsi, trip_id AS traj_id, avg(speed / 40) AS v, avg(near) AS dd, (arg_max(speed, ts) - arg_min(speed, ts)) / nullif(count(*) - 1, 0) AS a FROM trip JOIN nr USING (event_id) GROUP BY 1, 2)
SELECT mmsi, traj_id, CAST(CASE WHEN v < 1 THEN CASE WHEN dd <= 0.1 THEN 0 ELSE 1 END WHEN a < 0 THEN 3 ELSE 2 END AS INTEGER) AS semantic_id FROM g""")(
    lambda s, d: S.semantic_tags(S.temporal_segments(ais1(s, d), out="traj_id").withColumn("velocity", F.col("speed") / 40), areas(s)))

# ---- resampling and alignment ----
def grid_sql(source: str, keys: str, step: int, cols: str = "lon,lat") -> str:
    p = f"PARTITION BY {keys} ORDER BY ts, event_id"
    lead = ", ".join(f"{c}, lead({c}) OVER ({p}) AS n_{c}" for c in cols.split(","))
    out = ", ".join(f"{c} + (n_{c} - {c}) * (CAST(g - ts AS DOUBLE) / CAST(n_ts - ts AS DOUBLE)) AS {c}" for c in cols.split(","))
    return f"legs AS (SELECT {keys}, ts, lead(ts) OVER ({p}) AS n_ts, {lead} FROM {source}), grid AS (SELECT {keys}, g AS grid_ts, {out} FROM (SELECT *, unnest(generate_series((ts // {step} + 1) * {step}, n_ts // {step} * {step}, {step})) AS g FROM legs WHERE n_ts IS NOT NULL))"


query("r1_grid_resample", f"WITH {AIS1}, {grid_sql('ais1', 'mmsi', 3600, 'lon,lat,speed')} SELECT mmsi, grid_ts, {r6('lon', '1e9')} AS lon, {r6('lat', '1e9')} AS lat, {r6('speed')} AS speed FROM grid")(
    lambda s, d: R.grid_resample(ais1(s, d), ["lon", "lat", "speed"], 60).select("mmsi", "grid_ts", r(F.col("lon"), 1e9).alias("lon"), r(F.col("lat"), 1e9).alias("lat"), r(F.col("speed")).alias("speed")))
query("r2_resample_velocity", f"WITH {AIS1}, {grid_sql('ais1', 'mmsi', 3600)} SELECT mmsi, grid_ts AS ts, {r6(hav('lon', 'lat', 'lead(lon) OVER w', 'lead(lat) OVER w') + f' * {NM} * 3600 / abs(lead(grid_ts) OVER w - grid_ts)', '1e5')} AS velocity FROM grid WINDOW w AS (PARTITION BY mmsi ORDER BY grid_ts) QUALIFY lead(grid_ts) OVER w IS NOT NULL".replace(" WINDOW w AS (PARTITION BY mmsi ORDER BY grid_ts) QUALIFY lead(grid_ts) OVER w IS NOT NULL", " WINDOW w AS (PARTITION BY mmsi ORDER BY grid_ts) QUALIFY lead(grid_ts) OVER w IS NOT NULL OR count(*) OVER (PARTITION BY mmsi) = 1"))(
    lambda s, d: R.resample_with_velocity(ais1(s, d), 60).select("mmsi", "ts", r(F.col("velocity"), 1e5).alias("velocity")))
query("r3_prepared_tracks")(lambda s, d: R.prepare_tracks(ais(s, d), 60, 3.0, 5).select("mmsi", "ts", r(F.col("velocity"), 1e5).alias("velocity"), "traj_id"))
query("r4_prepared_in_pieces")(lambda s, d: R.prepare_in_pieces(ais(s, d), rate_min=60, alpha=3.0, window=5).select("mmsi", "ts", r(F.col("velocity"), 1e5).alias("velocity"), "traj_id"))
TRAJ_TRIPS = f"{SPLIT}, {trip_sql('traj', 'mmsi, traj_id', 'traj_id, ')}"
query("r5_trips", f"WITH {AIS1}, {AREAS}, {LABELS}, {KEEP}, {TRAJ_TRIPS} SELECT event_id, traj_id, trip_id FROM trip")(lambda s, d: R.segment_and_resample(ais1(s, d), areas(s), RADIUS_M).select("event_id", "traj_id", "trip_id"))
query("r5_trips_resampled", f"WITH {AIS1}, {AREAS}, {LABELS}, {KEEP}, {TRAJ_TRIPS}, {grid_sql('trip', 'mmsi, traj_id, trip_id', 1800)} SELECT mmsi, traj_id, trip_id, grid_ts, {r6('lon', '1e9')} AS lon, {r6('lat', '1e9')} AS lat FROM grid")(
    lambda s, d: R.segment_and_resample(ais1(s, d), areas(s), RADIUS_M, rate_min=30).select("mmsi", "traj_id", "trip_id", "grid_ts", r(F.col("lon"), 1e9).alias("lon"), r(F.col("lat"), 1e9).alias("lat")))
query("r6_extrapolated_hour", f"WITH {AIS1} SELECT event_id, {r6('lon + (lon - lag(lon) OVER w) * (3600.0::DOUBLE / (ts - lag(ts) OVER w))', '1e7')} AS lon FROM ais1 {W} QUALIFY lag(ts) OVER w IS NOT NULL")(
    lambda s, d: ais1(s, d).withColumn("_p", F.lag(F.struct("ts", "lon")).over(K.order_of(Spec()))).filter("_p IS NOT NULL").select("event_id", r(F.col("lon") + (F.col("lon") - F.col("_p.lon")) * F.try_divide(F.lit(3600.0), (F.col("ts") - F.col("_p.ts")).cast("double")), 1e7).alias("lon")))
query("r7_grid_floor", f"WITH {AIS} SELECT event_id, ts - ts % 300 AS slot FROM ais")(lambda s, d: ais(s, d).select("event_id", X.grid_floor("ts", 300).alias("slot")))
LINE = "CASE WHEN round_even(cos(radians(heading)), 7) = 0 THEN 1e9 ELSE round_even(round_even(sin(radians(heading)), 7) / round_even(cos(radians(heading)), 7), 2) END"
query("r8_heading_line", f"WITH {AIS} SELECT event_id, {LINE} + CAST(0 AS DOUBLE) AS slope FROM ais")(
    lambda s, d: ais(s, d).select("event_id", F.when(X.heading_line("lon", "lat", "heading")[0] == float("inf"), 1e9).otherwise(X.heading_line("lon", "lat", "heading")[0] + F.lit(0.0)).alias("slope")))
query("r9_control_points")(lambda s, d: _control_points(s, d))
query("r10_bezier", f"WITH {AIS1} SELECT event_id, {r6('0.25::DOUBLE * lon + 0.5::DOUBLE * (lon + 0.001::DOUBLE) + 0.25::DOUBLE * lead(lon) OVER w', '1e9')} AS lon FROM ais1 {W} QUALIFY lead(ts) OVER w IS NOT NULL")(
    lambda s, d: ais1(s, d).withColumn("n", F.lead("lon").over(K.order_of(Spec()))).filter("n IS NOT NULL").select("event_id", r(X.bezier("lon", F.col("lon") + F.lit(0.001), "n", F.lit(0.5)), 1e9).alias("lon")))
query("r11_bezier_alignment")(lambda s, d: R.align(ais(s, d), "bezierInterp1d", ["lon", "lat"], 60).select("mmsi", "grid_ts", r(F.col("lon")).alias("lon"), r(F.col("lat")).alias("lat")))
ENDS = "e AS (SELECT max(ts) AS e, min(ts) AS s FROM ais), arr AS (SELECT ais1.* FROM ais1, e WHERE ts < e)"
query("r13_delayed_interpolation", f"""WITH {AIS1}, {ENDS}, l AS (SELECT mmsi, lag(ts) OVER w AS a, ts AS b, lag(lon) OVER w AS x, lon AS y, (ts - 1) // 3600 * 3600 AS g FROM arr {W})
SELECT mmsi, g AS grid_ts, {r6('x + (y - x) * (CAST(g - a AS DOUBLE) / CAST(b - a AS DOUBLE))', '1e9')} AS lon FROM l WHERE a <= g""")(lambda s, d: R.align(ais(s, d), "delayed", ["lon"], 60).select("mmsi", "grid_ts", r(F.col("lon"), 1e9).alias("lon")))
query("r14_extrapolation", f"""WITH {AIS1}, {ENDS}, l AS (SELECT mmsi, lag(ts) OVER w AS a, ts AS b, lag(lon) OVER w AS x, lon AS y, coalesce(lead(ts) OVER w, (SELECT e FROM e)) AS nx, -((-ts) // 3600) * 3600 AS g0 FROM arr {W}),
g AS (SELECT *, unnest([0, 1, 2]) AS k FROM (SELECT mmsi, a, b, x, y, nx, CASE WHEN b % 3600 = 0 THEN b ELSE (b // 3600 + 1) * 3600 END AS g0 FROM l WHERE a IS NOT NULL))
SELECT mmsi, CAST(g0 + k * 3600 AS BIGINT) AS grid_ts, {r6('x + (y - x) * (CAST(g0 + k * 3600 - a AS DOUBLE) / CAST(b - a AS DOUBLE))', '1e6')} AS lon FROM g WHERE g0 + k * 3600 < nx""")(lambda s, d: R.align(ais(s, d), "extrap1d", ["lon"], 60).select("mmsi", "grid_ts", r(F.col("lon"), 1e6).alias("lon")))
query("r14_interpolation")(lambda s, d: R.align(ais(s, d), "interp1d", ["lon"], 60).select("mmsi", "grid_ts", r(F.col("lon"), 1e9).alias("lon")))


def _control_points(s, d):
    w = K.order_of(Spec())
    p = ais1(s, d).select("event_id", "lon", "lat", "heading", *[F.lead(c).over(w).alias("n_" + c) for c in ("lon", "lat", "heading")]).filter("n_lon IS NOT NULL")
    x, y = X.control_point({c: F.col(c) for c in ("lon", "lat", "heading")}, {c: F.col("n_" + c) for c in ("lon", "lat", "heading")})
    return p.select("event_id", x.alias("cx"), y.alias("cy"))


# ---- scalar functions ----
query("f1_haversine", f"WITH {AIS}, {AREAS} SELECT event_id, {r6(hav('p.lon', 'p.lat', 'a.lon', 'a.lat'))} AS km FROM ais p, areas a WHERE a.area_id = 0")(lambda s, d: ais(s, d).select("event_id", r(X.haversine_km("lon", "lat", F.lit(-4.99), F.lit(47.01))).alias("km")))
query("f1b_haversine_legacy", f"WITH {AIS} SELECT event_id, {r6(hav('lat', 'lon', 'CAST(47.01 AS DOUBLE)', 'CAST(-4.99 AS DOUBLE)'))} AS km FROM ais")(lambda s, d: ais(s, d).select("event_id", r(X.haversine_km("lon", "lat", F.lit(-4.99), F.lit(47.01), True)).alias("km")))
query("f4_hybrid_distance", f"WITH {AIS} SELECT event_id, {r6(hav('lon', 'lat', 'CAST(-4.99 AS DOUBLE)', 'CAST(47.01 AS DOUBLE)') + f' * {NM} + sqrt((speed - 10) * (speed - 10) + (course - 180) * (course - 180))')} AS dist FROM ais")(
    lambda s, d: ais(s, d).select("event_id", r(X.hybrid_distance("lon", "lat", F.lit(-4.99), F.lit(47.01), F.array("speed", "course"), F.array(F.lit(10.0), F.lit(180.0)))).alias("dist")))
query("x5_time_bins", f"WITH {AIS}, e AS (SELECT min(ts) AS lo, max(ts) AS hi FROM ais) SELECT event_id, CAST(greatest(0, ceil(CAST(ts - lo AS DOUBLE) * 5 / CAST(hi - lo AS DOUBLE)) - 1) AS INTEGER) AS bin FROM ais, e")(lambda s, d: P.time_bins(ais(s, d), "ts", 5).select("event_id", "bin"))
query("x4_greedy_bins")(lambda s, d: P.greedy_bins(ais(s, d), "mmsi", 8))
query("u1_union", f"WITH {AIS} SELECT mmsi, count(*) AS n FROM (SELECT mmsi FROM ais WHERE mmsi % 2 = 0 UNION ALL SELECT mmsi FROM ais WHERE mmsi % 3 = 0) GROUP BY mmsi")(
    lambda s, d: ais(s, d).filter("mmsi % 2 = 0").select("mmsi").unionByName(ais(s, d).filter("mmsi % 3 = 0").select("mmsi")).groupBy("mmsi").agg(F.count(F.lit(1)).alias("n")))
query("u3_distinct", f"WITH {AIS} SELECT DISTINCT mmsi % 11 AS k FROM ais")(lambda s, d: ais(s, d).select((F.col("mmsi") % 11).alias("k")).distinct())
query("u5_difference", f"WITH {AIS} SELECT mmsi FROM (SELECT DISTINCT mmsi FROM ais EXCEPT SELECT mmsi FROM ais WHERE speed > 60)")(lambda s, d: ais(s, d).select("mmsi").distinct().join(ais(s, d).filter("speed > 60").select("mmsi"), "mmsi", "left_anti"))
query("u6_union_distinct", f"WITH {AIS} SELECT mmsi FROM ais WHERE speed > 60 UNION SELECT mmsi FROM ais WHERE course > 350")(lambda s, d: ais(s, d).filter("speed > 60").select("mmsi").union(ais(s, d).filter("course > 350").select("mmsi")).distinct())
query("o1_sorted_points", f"WITH {AIS} SELECT event_id, ts FROM ais ORDER BY ts, event_id")(lambda s, d: ais(s, d).select("event_id", "ts").orderBy("ts", "event_id"))
query("o4_next_start", f"WITH {AIS}, b AS (SELECT mmsi, min(ts) AS st, max(ts) AS et FROM ais GROUP BY mmsi), e AS (SELECT min(et) AS x FROM b) SELECT arg_min(mmsi, st - x) AS mmsi, CAST(min(st - x) AS BIGINT) AS gap FROM b, e WHERE st - x >= 0 HAVING count(*) > 0")(
    lambda s, d: (lambda b: b.crossJoin(F.broadcast(b.agg(F.min("et").alias("x")))).filter("st - x >= 0").agg(F.min(F.struct((F.col("st") - F.col("x")).alias("gap"), "mmsi")).alias("m")).filter("m IS NOT NULL").select("m.mmsi", "m.gap"))(ais(s, d).groupBy("mmsi").agg(F.min("ts").alias("st"), F.max("ts").alias("et"))))
query("st8_sliding_means", f"WITH {AIS}, g AS (SELECT mmsi, speed, unnest([ts // 300 * 300, ts // 300 * 300 - 300]) AS w FROM ais) SELECT mmsi, w AS start, {r6('avg(speed)')} AS mean, count(*) AS n FROM g GROUP BY 1, 2")(
    lambda s, d: ais(s, d).withColumn("t", F.timestamp_seconds("ts")).groupBy("mmsi", F.window("t", "10 minutes", "5 minutes").alias("win")).agg(r(F.avg("speed")).alias("mean"), F.count(F.lit(1)).alias("n")).select("mmsi", F.unix_seconds("win.start").alias("start"), "mean", "n"))


FLAGSHIP = "trips_mean_speed"


@query(FLAGSHIP, f"WITH {AIS1}, {TRIPS}, v AS (SELECT *, {LEG} AS km, lead(ts) OVER w AS nx FROM trip WINDOW w AS (PARTITION BY mmsi, trip_id ORDER BY ts, event_id)) SELECT mmsi, trip_id, count(*) AS n_points, min(ts) AS st, max(ts) AS et, {r6(f'avg(km * {NM} * 3600 / (nx - ts))', '1e5')} AS mean_velocity, {r6(f'sum(km) * {NM}', '1e5')} AS distance FROM v GROUP BY mmsi, trip_id")
def trips_mean_speed(s, d):
    t = S.temporal_segments(ais1(s, d))
    w = Window.partitionBy("mmsi", "trip_id").orderBy("ts", "event_id")
    km = X.haversine_km("lon", "lat", F.lead("lon").over(w), F.lead("lat").over(w))
    v = t.withColumn("km", km).withColumn("nx", F.lead("ts").over(w))
    speed = F.col("km") * F.lit(0.539956803) * F.lit(3600.0) / (F.col("nx") - F.col("ts"))
    return v.groupBy("mmsi", "trip_id").agg(F.count(F.lit(1)).alias("n_points"), F.min("ts").alias("st"), F.max("ts").alias("et"), r(F.avg(speed), 1e5).alias("mean_velocity"), r(F.sum("km") * F.lit(0.539956803), 1e5).alias("distance"))
