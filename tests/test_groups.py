"""Patterns: cliques, links and folds against plain definitions; frames and codecs; streams against batches."""

import itertools
import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewake.functions import exprs as X
from tidewake.operators import frames as V
from tidewake.operators import patterns as G
from tidewake.operators import resample as R
from tidewake.sources import io
from tidewake.streaming import align as T


def test_cliques_and_components():
    r = random.Random(1)
    for _ in range(60):
        n = r.randrange(2, 9)
        edges = [(a, b) for a in range(n) for b in range(a + 1, n) if r.random() < 0.5]
        if not edges:
            continue
        near = G._adjacency(pd.DataFrame(edges, columns=["src", "dst"]))
        full = [set(c) for k in range(2, n + 1) for c in itertools.combinations(sorted(near), k) if all(b in near[a] for a, b in itertools.combinations(c, 2))]
        want = sorted(sorted(c) for c in full if not any(c < o for o in full))
        assert sorted(G.maximal_cliques(near)) == want
        assert sorted(x for c in G.component_lists(near) for x in c) == sorted(near)


def random_frames(r, frames=7, disjoint=False):
    out = []
    for t in range(frames):
        if disjoint:
            ids = list(range(10))
            r.shuffle(ids)
            cut = sorted(r.sample(range(1, 10), 2))
            groups = [ids[: cut[0]], ids[cut[0] : cut[1]], ids[cut[1] :]]
        else:
            groups = [r.sample(range(10), r.randrange(2, 7)) for _ in range(r.randrange(0, 4))]
        out.append((t + 1, t * 60, [sorted(set(g)) for g in groups if len(g) >= 2]))
    return out


def by_definition(frames, least):
    """Active patterns at the end: intersections of one cluster per frame from some start on."""
    out = {}
    for s in range(len(frames)):
        sets = {frozenset(c) for c in frames[s][2]}
        for f in frames[s + 1 :]:
            sets = {a & frozenset(c) for a in sets for c in f[2] if len(a & set(c)) >= least}
        for c in sets:
            out.setdefault(c, frames[s][1])
    return out


@pytest.mark.parametrize("disjoint", [False, True])
def test_fold_equals_definition(disjoint):
    r = random.Random(2)
    for _ in range(200):
        f = random_frames(r, r.randrange(1, 6), disjoint)
        end = f[-1][1]
        full = [x for x in f if x[2]]
        got = {frozenset(c): s for c, s, e in G.fold(full, 2, 0, len(f)) if e == end} if full else {}
        assert got == by_definition(f, 2)


def test_link_join_equals_fold_rule(spark):
    r = random.Random(4)
    now, past, want = [], [], {}
    for n in range(25):
        p = {frozenset(r.sample(range(9), r.randrange(2, 6))): (r.randrange(50), 60) for _ in range(3)}
        q = {frozenset(r.sample(range(9), r.randrange(2, 6))): (120, 120) for _ in range(3)}
        now += [(n, sorted(c), *t) for c, t in q.items()]
        past += [(n, sorted(c), *t) for c, t in p.items()]
        want |= {(n, tuple(sorted(c))): t for c, t in G._link(q, p, 2).items()}
    s = "n int, clusters array<bigint>, st long, et long"
    got = G.intersection_links(spark.createDataFrame(now, s), spark.createDataFrame(past, s), 2, ["n"]).collect()
    assert {(x["n"], tuple(x["clusters"])): (x["st"], x["et"]) for x in got} == want


def clusters_df(spark, frames):
    return spark.createDataFrame([(t, c) for _, t, cs in frames for c in cs], "frame long, clusters array<bigint>"), spark.createDataFrame([(t,) for _, t, _ in frames], "frame long")


def test_partitioned_mining_equals_single_run(spark):
    r = random.Random(6)
    for _ in range(3):
        f = [x if x[2] else (x[0], x[1], [[1, 2]]) for x in random_frames(r, 9)]
        c, frames = clusters_df(spark, f)
        one = {(tuple(x["clusters"]), x["st"], x["et"]) for x in G.mine(c, frames, 2, 120).collect()}
        bins = frames.withColumn("bin", F.floor(F.col("frame") / 180).cast("long"))
        parts = {(tuple(x["clusters"]), x["st"], x["et"]) for x in G.reduce_partitions(G.mine_partition(c, bins, 2, 120), 2, 60, 120).collect()}
        long_one = {p for p in one if p[2] - p[1] >= 120 or p[2] == 480}
        assert {p for p in parts if p[2] == 480} == {p for p in long_one if p[2] == 480}


def test_merge_by_containment():
    a = [([1, 2, 3], 0, 60), ([7, 8], 0, 60), ([4, 5], 0, 30)]
    b = [([1, 2], 120, 180), ([7, 8, 9], 120, 180), ([5, 6], 180, 240)]
    assert sorted(G.merge_by_containment(a, b, 60)) == sorted([([4, 5], 0, 30), ([5, 6], 180, 240), ([1, 2], 0, 180), ([7, 8, 9], 120, 180), ([1, 2, 3], 0, 60), ([7, 8], 0, 180)])


def test_incremental_miner_equals_single_run(spark):
    f = random_frames(random.Random(9), 8)
    c, frames = clusters_df(spark, f)
    m = T.IncrementalMiner(2, 60)
    for lo, hi in ((0, 150), (150, 300), (300, 999)):
        m(c.filter((F.col("frame") >= lo) & (F.col("frame") < hi)))
    if all(x[2] for x in f):
        assert sorted(m.patterns()) == sorted((x["clusters"], x["st"], x["et"]) for x in G.mine(c, frames, 2, 60).collect())


def test_frame_clusters_modes(spark):
    p = spark.createDataFrame([(1, 1, 2), (1, 2, 3), (1, 4, 5)], "frame long, src long, dst long")
    assert sorted(x["clusters"] for x in G.frame_clusters(p, "convoys").collect()) == [[1, 2, 3], [4, 5]]
    assert sorted(x["clusters"] for x in G.frame_clusters(p, "flocks").collect()) == [[1, 2], [2, 3], [4, 5]]
    with pytest.raises(NotImplementedError):
        G.frame_clusters(p, "swarms")


def test_codecs(spark):
    d = spark.createDataFrame([(0, [1.0, 1.0, 2.0, 2.0, 2.0, 2.0])], "frame_id int, pixels array<double>")
    assert d.select(X.rle_encode("pixels").alias("t")).first()["t"] == ["1.0!2", "2.0!4"]
    assert d.select(X.rle_decode(X.rle_encode("pixels")).alias("p")).first()["p"] == [1.0, 1.0, 2.0, 2.0, 2.0, 2.0]
    v = spark.createDataFrame([(i, [float(100 * i + 10 * k) for k in range(4)]) for i in range(4)], "frame_id int, pixels array<double>")
    back = {(r["frame_id"], r["i"]): r["v"] for r in V.video_decode(V.video_encode(v)).collect()}
    assert back == {(i, k): float(100 * i + 10 * k) for i in range(4) for k in range(4)}


def test_blocks_and_motion(spark):
    px = [(0, y, x, float(y * 12 + x)) for y in range(12) for x in range(12)]
    p = spark.createDataFrame(px, "frame_id long, row int, col int, v double")
    b = V.macroblocks(p, 5)
    assert b.count() == 9
    assert {(r["row"], r["col"]): r["v"] for r in V.unblock(b, 5).filter("row < 12 AND col < 12").collect()} == {(y, x): v for _, y, x, v in px}
    ref = spark.createDataFrame([(0, [v for *_, v in px])], "frame_id long, pixels array<double>")
    shifted = [float((y + 2) * 12 + x + 2) for y in range(4, 7) for x in range(4, 7)]
    t = spark.createDataFrame([(0, 4, 4, shifted)], "frame_id long, y int, x int, block array<double>")
    assert tuple(V.motion_search(ref, t, 2, 3, 12, 12).select("to_y", "to_x").first()) == (6, 6)


def test_streamed_interpolation_equals_batch(spark, tmp_path):
    r = random.Random(7)
    rows = sorted({(m, t): (m, t, r.random(), r.random()) for m in range(3) for t in (r.randrange(10_000, 13_000) for _ in range(25))}.values(), key=lambda x: x[1])
    schema = "mmsi long, ts long, lon double, lat double"
    for i in range(0, len(rows), 20):
        spark.createDataFrame(rows[i : i + 20], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    def stream():
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in").withColumn("datetime", F.timestamp_seconds("ts"))

    got = {}
    for name, f in (("delayed", T.stream_delayed_interpolation), ("extrap1d", T.stream_extrapolation)):
        q = f(stream(), 1).writeStream.format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        got[name] = {(x["mmsi"], x["grid_ts"]): x["lon"] for x in spark.table(name).collect()}
    batch = spark.createDataFrame([(i, *x, 0.0, 0.0, 0.0) for i, x in enumerate(rows)] + [(999, 99, 20_000, 0.0, 0.0, 0.0, 0.0, 0.0)], "event_id long, mmsi long, ts long, lon double, lat double, speed double, course double, heading double")
    want = {(x["mmsi"], x["grid_ts"]): x["lon"] for x in R.align(batch, "delayed", ["lon"], 1).collect()}
    assert got["delayed"].keys() == want.keys() and all(got["delayed"][k] == pytest.approx(want[k]) for k in want)
    want = {(x["mmsi"], x["grid_ts"]): x["lon"] for x in R.align(batch, "extrap1d", ["lon"], 1).collect()}
    last = {m: max(x[1] for x in rows if x[0] == m) for m in range(3)}
    settled = {k: v for k, v in want.items() if k[1] < last[k[0]]}
    assert all(got["extrap1d"][k] == pytest.approx(v) for k, v in settled.items()) and got["extrap1d"].keys() <= want.keys()


def test_sources(spark, tmp_path):
    p = spark.createDataFrame([([1, 2], 0, 60), ([3, 4], 0, 120)], G.PATTERN)
    io.write_csv(p, f"{tmp_path}/csv")
    assert sorted(io.read_patterns_csv(spark, f"{tmp_path}/csv").collect()) == sorted(p.collect())
    io.write_parquet(p, f"{tmp_path}/pq")
    assert io.read_parquet(spark, f"{tmp_path}/pq").count() == 2
    job = io.Job()
    assert io.read_snapshot(spark, f"{tmp_path}/snap", "a", job) is None
    io.write_snapshot(p, f"{tmp_path}/snap", "a", job, 60)
    assert io.read_snapshot(spark, f"{tmp_path}/snap", "a", job).count() == 2 and io.read_snapshot(spark, f"{tmp_path}/snap", "b", job) is None
    (tmp_path / "v.bin").write_bytes(b"\x01\x02\x03\x04")
    f = io.read_frames(spark, f"{tmp_path}/v.bin", lambda raw: [(1, 2, [float(x) for x in raw[i : i + 2]]) for i in (0, 2)])
    assert [r["pixels"] for r in f.orderBy("frame_id").collect()] == [[1.0, 2.0], [3.0, 4.0]]


def test_snapshot_without_patterns(spark, tmp_path):
    job = io.Job("convoys", 2, 30, 1000.0, 60)
    io.write_snapshot(spark.createDataFrame([], "clusters array<bigint>, st long, et long"), f"{tmp_path}/none", "a", job, 60)
    assert io.read_snapshot(spark, f"{tmp_path}/none", "a", job).count() == 0 and io.read_snapshot(spark, f"{tmp_path}/none", "b", job) is None
