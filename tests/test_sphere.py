"""Pairs and areas at any latitude and across the date line, against all pairs; entries of sources and the driver with restart."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidewake.operators import areas as A
from tidewake.operators import frames as V
from tidewake.operators import patterns as G
from tidewake.operators.components import connected
from tidewake.sources import io
from tidewake.streaming import driver as D


def metres(a, b):
    p, q = math.radians(a[1]), math.radians(b[1])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[0] - a[0]) / 2) ** 2
    return 2 * 6_371_008.8 * math.asin(min(1, math.sqrt(h)))


def scattered(lat, lon, n=250, seed=1):
    r = random.Random(seed)
    east = 0.06 / max(0.0008, math.cos(math.radians(lat)))
    wrap = lambda x: (x + 180) % 360 - 180
    return [(wrap(lon + r.uniform(-east, east)), max(-90.0, min(90.0, lat + r.uniform(-0.06, 0.06)))) for _ in range(n)]


@pytest.mark.parametrize("lat, lon", [(0, 0), (45, 180), (70, 20), (85, -180), (89.97, 10), (-78, 179.99)])
def test_pairs_and_areas_on_the_sphere(spark, lat, lon):
    p = scattered(lat, lon)
    df = spark.createDataFrame([(0, i, i, i, x, y) for i, (x, y) in enumerate(p)], "frame long, event_id long, mmsi long, ts long, lon double, lat double")
    want = {(i, j) for i in range(len(p)) for j in range(i + 1, len(p)) if metres(p[i], p[j]) < 1000}
    got = [(r["src"], r["dst"]) for r in A.pairs_within(df, 1000.0, "frame").collect()]
    assert len(got) == len(set(got)) and set(got) == want and want
    centres = scattered(lat, lon, 40, 2)
    areas = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(centres)], "area_id int, lon double, lat double")
    found = {r["mmsi"]: r["area_id"] for r in A.classify_areas(df, areas, 1500.0).collect()}
    assert found == {i: max((k for k, c in enumerate(centres) if metres(p[i], c) <= 1500), default=None) for i in range(len(p))}


def test_nearest_area_in_blocks(spark):
    r = random.Random(5)
    p, a = [(r.uniform(-5, 5), r.uniform(-5, 5)) for _ in range(50)], [(r.uniform(-5, 5), r.uniform(-5, 5)) for _ in range(70)]
    df = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(p)], "mmsi long, lon double, lat double")
    areas = spark.createDataFrame([(i, x, y) for i, (x, y) in enumerate(a)], "area_id int, lon double, lat double")
    got = {x["mmsi"]: x["nearest"] for x in A.nearest_area(df, areas, block=16).collect()}
    assert got == {i: pytest.approx(min(math.dist(p[i], c) for c in a)) for i in range(len(p))}
    assert {x["nearest"] for x in A.nearest_area(df, areas.limit(0)).collect()} == {None}


def test_components_of_long_paths(spark):
    r = random.Random(6)
    names = list(range(400))
    r.shuffle(names)
    edges = [(names[i], names[i + 1]) for i in range(299)] + [(names[i], names[i]) for i in range(300, 310)]
    got = {x["node"]: x["label"] for x in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = min(names[:300])
    assert got == {n: low for n in names[:300]} | {n: n for n in names[300:310]}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_driver_goes_on_where_it_was(spark, tmp_path):
    r = random.Random(9)
    rows = [(60 * t, sorted(r.sample(range(8), r.randint(2, 5)))) for t in range(24) for _ in range(2)]
    clusters = spark.createDataFrame(rows, G.CLUSTER).distinct()
    job = io.Job("convoys", 2, 3, 100.0, 60)
    assert D.group_patterns(clusters, job, f"{tmp_path}/run", stop_after=2) is None
    path = D.group_patterns(clusters, job, f"{tmp_path}/run")
    whole = D.group_patterns(clusters, job, f"{tmp_path}/once")
    read = lambda p: sorted((tuple(x["clusters"]), x["st"], x["et"]) for x in io.read_patterns_csv(spark, p).collect())
    assert job.file_name() in path and read(path) == read(whole)
    frames = clusters.select("frame").distinct()
    assert read(path) == sorted((tuple(x["clusters"]), x["st"], x["et"]) for x in G.mine(clusters, frames, 2, 180).collect())


def test_durations_and_jobs(spark, tmp_path):
    assert [io.duration_seconds(x) for x in ("5 min", "1h 30min", "1 day 00:00:01", 7)] == [300, 5400, 86_401, 7]
    for bad in ("", "soon", "5 parsecs"):
        with pytest.raises(ValueError):
            io.duration_seconds(bad)
    job = io.Job("flocks", 3, 5, 1852.0, 60)
    io.write_job(spark, job, f"{tmp_path}/job")
    assert io.read_job(spark, f"{tmp_path}/job") == job


def test_frame_differences_across_ranges(spark):
    rows = [(i, [float(i * i), 1.0]) for i in (0, 1, 2, 5, 6, 11, 12, 13)]
    df = spark.createDataFrame(rows, "frame_id long, pixels array<double>")
    got = {x["frame_id"]: x["pixels"][0] for x in V.frame_differences(df, span=3).collect()}
    assert got == {b[0]: a[1][0] - b[1][0] for a, b in zip(rows, rows[1:])}
    assert V.frame_differences(df.withColumn("v", F.lit(1)), ["v"], span=4).count() == 7


def test_jdbc_round_trip(spark):
    """A relational table, with the embedded database that comes with the engine; partitions by predicates."""
    try:
        spark._jvm.java.lang.Class.forName("org.apache.derby.iapi.jdbc.AutoloadedDriver")
    except Exception:
        pytest.skip("no embedded database")
    url, p = "jdbc:derby:memory:tracks;create=true", {"driver": "org.apache.derby.iapi.jdbc.AutoloadedDriver"}
    spark.range(100).withColumnRenamed("id", "mmsi").write.jdbc(url, "points", mode="overwrite", properties=p)
    got = io.read_jdbc(spark, url, "points", ['"mmsi" < 50', '"mmsi" >= 50'], p)
    assert got.rdd.getNumPartitions() == 2 and got.count() == 100
