"""Hand-made tracks with values worked out by hand, and loops as second implementations."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewake.columns import Spec
from tidewake.functions import exprs as X
from tidewake.operators import areas as A
from tidewake.operators import clean as C
from tidewake.operators import kinematics as K
from tidewake.operators import partitioning as P
from tidewake.operators import resample as R
from tidewake.operators import segments as S
from tidewake.operators import series as N

AIS = "event_id long, mmsi long, ts long, lon double, lat double, speed double, course double, heading double"


def ais(spark, rows):
    """rows: (mmsi, ts, lon, lat[, speed])"""
    return spark.createDataFrame([(i, r[0], r[1], float(r[2]), float(r[3]), float(r[4]) if len(r) > 4 else 1.0, 90.0, 45.0) for i, r in enumerate(rows)], AIS)


def hav(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    x = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(math.sqrt(x))


def test_velocity_rules(spark):
    d = ais(spark, [(1, 0, 0, 0), (1, 3600, 1, 0), (1, 3600 * 3, 1, 1), (2, 5, 0, 0, 7)])
    got = {(r["mmsi"], r["ts"]): r["velocity"] for r in K.velocity(d, fallback="speed").collect()}
    nm = hav((0, 0), (1, 0)) * 0.539956803
    assert got == {(1, 0): pytest.approx(nm), (1, 3600): pytest.approx(nm / 2), (2, 5): 7.0}
    v1 = {(r["mmsi"], r["ts"]): r["velocity"] for r in K.velocity(d, compat="v1", fallback="speed").collect()}
    assert v1[1, 3600] == 0.0 and v1[1, 0] > 0
    assert K.velocity(d).filter("mmsi = 2").first()["velocity"] is None


def test_equal_times_give_null_velocity(spark):
    d = ais(spark, [(1, 0, 0, 0), (1, 0, 1, 0), (1, 10, 1, 1)])
    assert K.velocity(d).orderBy("event_id").first()["velocity"] is None


def test_bearing_and_acceleration(spark):
    d = ais(spark, [(1, 0, 0, 0), (1, 60, 0, 1), (1, 120, 1, 1), (2, 0, 3, 3)])
    b = [r["bearing"] for r in K.bearing(d).orderBy("event_id").collect()]
    assert b[0] == pytest.approx(0) and 89 < b[1] < 91 and b[2] == 90.0
    a = ais(spark, [(1, 0, 0, 0, 5), (1, 10, 0, 0, 9), (1, 20, 0, 0, 3)])
    assert [r["acceleration"] for r in K.acceleration(a, "speed").orderBy("ts").collect()] == [pytest.approx(-0.4), pytest.approx(0.6), None]
    assert [r["acceleration"] for r in K.acceleration(a, "speed", compat="v1").orderBy("ts").collect()] == [0.0, pytest.approx(0.4), pytest.approx(-0.6)]


def test_gap_is_strict_and_short_pieces_go(spark):
    d = ais(spark, [(1, 0, 0, 0), (1, 43_200, 0, 0), (1, 86_401, 0, 0), (1, 86_402, 0, 0), (1, 200_000, 0, 0)])
    assert [(r["ts"], r["trip_id"]) for r in S.temporal_segments(d).orderBy("ts").collect()] == [(0, 0), (43_200, 0), (86_401, 1), (86_402, 1)]


def segments_by_loop(labels):
    keep = [i for i, x in enumerate(labels) if x == 0 or i and labels[i - 1] == 0 or i + 1 < len(labels) and labels[i + 1] == 0]
    pieces, piece = [], []
    for i in keep:
        if labels[i] == -1 and piece:
            pieces.append(piece)
            piece = []
        piece.append(i)
    pieces += [piece] if piece else []
    out, n = {}, 0
    for k, p in enumerate(pieces):
        n = n if k == 0 or len(p) == 1 else n + 1
        out |= dict.fromkeys(p, n)
    return out


def test_split_at_labels_equals_loop(spark):
    r, rows, want = random.Random(5), [], {}
    for m in range(150):
        labels = [r.choice((0, -1)) if r.random() < 0.8 else 0 for _ in range(r.randrange(1, 14))]
        rows += [(m, i, x, i) for i, x in enumerate(labels)]
        want |= {(m, i): n for i, n in segments_by_loop(labels).items()}
    d = spark.createDataFrame(rows, "mmsi long, ts long, label int, event_id long")
    assert {(x["mmsi"], x["ts"]): x["traj_id"] for x in S.split_at_labels(S.keep_borders(d)).collect()} == want


def test_areas_last_one_wins_and_border_counts(spark):
    areas = spark.createDataFrame([(0, 0.0, 0.0), (1, 0.001, 0.0)], "area_id int, lon double, lat double")
    d = ais(spark, [(1, 0, 0, 0), (1, 1, 0.5, 0), (1, 1, 0, 0)])
    got = [(r["area_id"], r["label"]) for r in A.classify_areas(d, areas, 200).orderBy("event_id").collect()]
    assert got == [(1, -1), (None, 0), (1, 0)]
    edge = hav((0, 0), (0.001, 0)) * 1000
    assert A.classify_areas(ais(spark, [(1, 0, 0, 0)]), areas.filter("area_id = 1"), edge).first()["label"] == -1


def test_polygons(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (2.0, 1.0), (0.0, 4.0)]
    p = spark.createDataFrame([(7, [{"x": x, "y": y} for x, y in ring])], "area_id int, ring array<struct<x:double,y:double>>")
    d = ais(spark, [(1, 0, 1, 1), (1, 1, 2, 3), (1, 2, 3, 1), (1, 3, 9, 9)])
    assert sorted(r["event_id"] for r in A.in_polygons(d, p).collect()) == [0, 2]


@pytest.mark.parametrize("lat", [0.0, 55.0, -58.0])
def test_pairs_equal_all_pairs(spark, lat):
    r = random.Random(int(lat))
    pts = [(i, 0, r.uniform(10, 10.1), lat + r.uniform(0, 0.05)) for i in range(120)]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if hav(pts[i][2:], pts[j][2:]) * 1000 < 900}
    got = A.pairs_within(ais(spark, pts), 900.0).collect()
    assert {(x["src"], x["dst"]) for x in got} == want and len(got) == len(want)


def test_resample_grid(spark):
    d = ais(spark, [(1, 60, 0, 0), (1, 180, 2, 4), (1, 210, 3, 4), (2, 30, 0, 0)])
    got = [(r["grid_ts"], r["lon"], r["lat"]) for r in R.grid_resample(d, ["lon", "lat"], 1).orderBy("grid_ts").collect()]
    assert got == [(120, 1.0, 2.0), (180, 2.0, 4.0)]
    odd = R.grid_resample(ais(spark, [(1, 3600 + 8 * 60, 0, 0), (1, 3600 + 30 * 60, 22, 0)]), ["lon"], 7).orderBy("grid_ts").collect()
    assert [r["grid_ts"] for r in odd] == [3600 + m * 60 for m in (14, 21, 28)]


def emulate(rows, dt, mode, limit=3):
    """The second-by-second clock. rows: (mmsi, ts, x)."""
    start, end = min(r[1] for r in rows), max(r[1] for r in rows)
    by = {}
    for m, t, x in rows:
        by.setdefault((t, m), x)
    pending, win, count, out = start - start % dt, {}, {}, {}
    line = lambda a, b, t: a[1] + (b[1] - a[1]) * ((t - a[0]) / (b[0] - a[0]))
    for i in range(start, end):
        for m in sorted({m for t, m in by if t == i}):
            w = win.setdefault(m, [])
            if mode == "delayed":
                w.append((i, by[i, m]))
                del w[:-2]
                if len(w) == 2 and w[0][0] <= pending <= w[1][0]:
                    out[m, pending] = line(*w, pending)
            elif mode == "extrap1d":
                w.append((i, by[i, m]))
                del w[:-2]
                count[m] = 0
            elif not w or not pending <= w[-1][0]:
                w.append((i, by[i, m]))
                del w[:-2]
        if mode == "delayed":
            if i % dt == 0 and i > pending:
                pending = i
        elif i % dt == 0:
            for m, w in win.items():
                if len(w) == 2:
                    if mode == "extrap1d" and count[m] < limit:
                        out[m, i] = line(*w, i)
                        count[m] += 1
                    elif mode == "interp1d" and i > pending and w[0][0] <= pending <= w[1][0]:
                        out[m, pending] = line(*w, pending)
            pending = i
    return out


@pytest.mark.parametrize("mode", ["delayed", "extrap1d", "interp1d"])
def test_alignment_equals_the_clock(spark, mode):
    r = random.Random(11)
    for _ in range(4):
        rows, seen = [], set()
        for _ in range(60):
            k = (r.randrange(4), r.randrange(1000, 2600) if r.random() < 0.8 else r.randrange(1000, 2600) // 60 * 60)
            if k not in seen:
                seen.add(k)
                rows.append((*k, float(r.randrange(100))))
        got = R.align(ais(spark, [(m, t, x, 0) for m, t, x in rows]), mode, ["lon"], 1).collect()
        want = emulate(rows, 60, mode)
        assert {(x["mmsi"], x["grid_ts"]): pytest.approx(x["lon"], abs=1e-6) for x in got} == want


def test_clean_and_outliers(spark):
    d = ais(spark, [(1, t, 0, 0) for t in range(20)] + [(1, 5, 9, 9), (1, 10_000, 0, 0)])
    got = C.clean(d).collect()
    assert len(got) == 20 and max(r["ts"] for r in got) == 19 and all(r["lon"] == 0 for r in got)
    flat = C.iqr_outliers(ais(spark, [(1, 0, 0, 0, 2)] * 4 + [(1, 0, 0, 0, 3)]), "speed", 3.0)
    assert flat.filter("is_outlier").count() == 1
    calm = C.calm(d.withColumn("velocity", F.when(F.col("ts") > 3, 5.0)), 5.0)
    assert calm.count() == 4


def test_series(spark):
    s = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([0, 0, 1, 0, 5, 6, 7, 8, 9, 10, 11, 0, 0, 0])], "series_id int, idx long, x double")
    assert sorted((r["first"], r["last"]) for r in N.zero_runs(s).collect()) == [(0, 1), (3, 3), (11, 13)]
    line = spark.createDataFrame([(1, i, float(x)) for i, x in enumerate([9, 1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 3, 7])], "series_id int, idx long, x double")
    assert [(r["first"], r["last"]) for r in N.linear_runs(line).collect()] == [(1, 10)]
    e = N.shannon_entropy(spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 2.0), (1, 3.0)], "g int, v double"), "v", ["g"]).first()["entropy"]
    assert e == pytest.approx(1.5)
    t = N.detrend(s, ["x"], ["series_id"], ["idx"], 3).orderBy("idx").collect()
    assert t[0]["x_detrended"] == 0 and t[0]["x_trend"] is None and t[5]["x_trend"] == 5.0


def test_adaptive_pois_agree_with_single_alphas(spark):
    import collections

    r = random.Random(3)
    d = ais(spark, [(m, i * 60, 0, 0, r.random() + (30 if r.random() < 0.04 else 0)) for m in range(3) for i in range(150)])
    got = {x["mmsi"]: tuple(x["pois"]) for x in S.adaptive_points_of_interest(d, "speed", 4, most=12).collect()}
    single = [{x["mmsi"]: tuple(x["pois"]) for x in S.points_of_interest(d, "speed", a, 4).collect()} for a in range(1, 13)]
    for m in got:
        tuples = []
        for s in single:
            tuples.append(s[m])
            if len(s[m]) == 2:
                break
        assert got[m] == collections.Counter(tuples).most_common(1)[0][0]


def test_bezier_and_control_point(spark):
    d = spark.createDataFrame([(0.0, 0.0, 45.0, 2.0, 0.0, 135.0)], "a double, b double, h double, c double, e double, g double")
    x, y = X.control_point({"lon": F.col("a"), "lat": F.col("b"), "heading": F.col("h")}, {"lon": F.col("c"), "lat": F.col("e"), "heading": F.col("g")})
    assert tuple(d.select(x, y).first()) == (1.0, 1.0)
    p = spark.range(1).select(X.control_point({"lon": F.lit(0.0), "lat": F.lit(0.0), "heading": F.lit(90.0)}, {"lon": F.lit(2.0), "lat": F.lit(4.0), "heading": F.lit(90.0)})[0].alias("x")).first()
    assert p["x"] == 1.0
    assert spark.range(1).select(X.bezier(F.lit(0.0), F.lit(1.0), F.lit(0.0), F.lit(0.5)).alias("v")).first()["v"] == 0.5


def test_bins_and_fingerprints(spark):
    d = spark.createDataFrame([(i,) for i in range(11)], "ts long")
    assert [r["bin"] for r in P.time_bins(d, "ts", 5).orderBy("ts").collect()] == [0, 0, 0, 1, 1, 2, 2, 3, 3, 4, 4]
    g = P.greedy_bins(spark.createDataFrame([(k,) for k in [1] * 5 + [2] * 2 + [3] * 3], "k long"), "k", 2)
    assert {r["k"]: r["bin"] for r in g.collect()} == {1: 0, 2: 1, 3: 1}
    assert P.fingerprint(d).first() == P.fingerprint(d.orderBy(F.desc("ts"))).first() != P.fingerprint(d.filter("ts > 0")).first()
    assert Spec().oid == "mmsi"
