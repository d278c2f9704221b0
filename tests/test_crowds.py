"""Crowds: what is shuffled grows with the members of groups, not with their square."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from tidewake.operators import patterns as G
from tidewake.plans.groups import pairs
from tidewake.plans.registry import QUERIES

MEMBERS, FRAMES = 2000, 3
LEAST_CUT = 20e6  # bytes; lists that travel with every member, and lists of all pairs, take several times as much here


@pytest.fixture(scope="module")
def crowd(tmp_path_factory):
    """One site where 2000 objects report in each of three frames; nine of ten come from frame to frame, and the last frame lies within the one before."""
    d, rng = tmp_path_factory.mktemp("crowd"), np.random.default_rng(5)
    met = [rng.choice(MEMBERS * 10 // 9, MEMBERS, replace=False) for _ in range(FRAMES - 1)]
    rows = [(20 * int(u), f) for f, m in enumerate([*met, met[-1][: MEMBERS * 9 // 10]]) for u in m]
    e = pd.DataFrame(rows, columns=["user_id", "frame"])
    e["ts"] = pd.Timestamp("2024-01-01") + pd.to_timedelta(e["frame"] * 21_600 + rng.integers(1, 20_000, len(e)), unit="s")
    e = e.assign(event_id=range(len(e)), event_type="view", value=rng.integers(0, 9900, len(e)) / 100, props="").drop(columns="frame")
    e["ts"] = e["ts"].astype("datetime64[us]")
    e.to_parquet(d / "events.parquet")
    return str(d)


def shuffled(spark):
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()


@pytest.mark.parametrize("name", [
    "a5_components", "a7_clusters_per_frame", "g1_link_step", "g2_mine_by_group", "g2_mine_convoys", "g3_mine_partitions",
    "g4_merge_two_partitions", "g5_reduce_partitions", "g6_mine_by_containment", "g7_driver_with_restart", "g8_reduce_by_containment", "j10_past_inside_present",
    "j11_intersection_links", "j12_partition_chain", "j13_pattern_velocity", "j9_subset_of_past", "p13_duration", "p14_open_closed",
    "s14_snapshot", "st5_incremental_mining", "u4_intersections", "u7_subsets",
])
def test_crowd_is_not_multiplied(spark, crowd, name):
    before = shuffled(spark)
    QUERIES[name](spark, crowd).collect()
    assert shuffled(spark) - before < LEAST_CUT


def test_components_of_points():
    """As from the list of all pairs: crowds, the date line, a pole, equal positions, objects at several places, unknown positions."""
    rng = np.random.default_rng(1)
    for trial in range(120):
        n, r = int(rng.integers(1, 100)), float(rng.choice([50.0, 900.0, 5000.0, 2e6, 2.1e7]))
        spread = r / 111_000 * rng.choice([1, 4, 12])
        lon, lat = rng.uniform(-1, 1, n) * spread, 47 + rng.uniform(-1, 1, n) * min(spread, 40)
        if trial % 4 == 1:
            lon = (lon + 360) % 360 - 180
        elif trial % 4 == 2:
            lon, lat = rng.uniform(-180, 180, n), 90 - np.abs(lat - 47)
        elif trial % 4 == 3:
            lon, lat = np.round(lon, 3), np.round(lat, 3)
        o = rng.integers(0, n * 2, n)
        lon[: n // 20] = np.nan
        near: dict = {}
        for i, j in zip(*np.nonzero(G._metres(lon[:, None], lat[:, None], lon[None], lat[None]) < r)):
            if o[i] != o[j]:
                near.setdefault(int(o[i]), set()).add(int(o[j]))
        assert sorted(G.point_components(o, lon, lat, r)) == sorted(G.component_lists(near)), trial


def test_cliques_of_points():
    """As from the list of all pairs: crowds, the date line, poles, equal positions, objects at several places, unknown positions."""
    rng = np.random.default_rng(2)
    for trial in range(120):
        n, r = int(rng.integers(1, 60)), float(rng.choice([50.0, 900.0, 5000.0, 2e6, 2.1e7]))
        spread = r / 111_000 * rng.choice([1, 4, 12])
        lon, lat = rng.uniform(-1, 1, n) * spread, 47 + rng.uniform(-1, 1, n) * min(spread, 40)
        if trial % 4 == 1:
            lon = (lon + 360) % 360 - 180
        elif trial % 4 == 2:
            lon, lat = rng.uniform(-180, 180, n), 90 - np.abs(lat - 47)
        elif trial % 4 == 3:
            lon, lat = np.round(lon, 3), np.round(lat, 3)
        o = rng.integers(0, n * 2, n)
        if trial % 3 == 0:
            lon, lat, o = np.repeat(lon, 3), np.repeat(lat, 3), np.repeat(o, 3) + 1000 * np.tile([0, 1, 2], n)
        lon[: n // 20] = np.nan
        near: dict = {}
        for i, j in zip(*np.nonzero(G._metres(lon[:, None], lat[:, None], lon[None], lat[None]) < r)):
            if o[i] != o[j]:
                near.setdefault(int(o[i]), set()).add(int(o[j]))
        assert sorted(c.tolist() for c in G.point_cliques(o, lon, lat, r) if len(c) > 1) == sorted(G.maximal_cliques(near)), trial


def test_cliques_are_not_held():
    """14 pairs of which all nodes but partners are linked have 16,384 maximal cliques: they pass one by one."""
    near = [{v for v in range(28) if v // 2 != u // 2} for u in range(28)]
    tracemalloc.start()
    found = sum(len(c) == 14 for c in G.clique_lists(near))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found == 1 << 14 and peak < 500_000


def test_flocks_of_copies(spark, tmp_path):
    """Fourteen objects in four frames, and 100 copies of each at the same places: the same cliques and patterns with all copies; nothing grows with pairs of copies."""
    rng, copies = np.random.default_rng(3), 100
    one = pd.DataFrame([(20 * u, f, 1000 * f + int(p)) for f in range(4) for u, p in enumerate(rng.choice(1000, 14, replace=False)) if rng.random() < 0.9], columns=["user_id", "frame", "event_id"])
    one.loc[len(one)] = (1, 3, 3999)  # alone at its site: only its copies meet it
    one["ts"] = (pd.Timestamp("2024-01-01") + pd.to_timedelta(one["frame"] * 21_600 + 60, unit="s")).astype("datetime64[us]")
    one = one.assign(event_type="view", value=1.0, props="").drop(columns="frame")
    for k in (1, copies):
        (tmp_path / str(k)).mkdir()
        pd.concat([one.assign(user_id=one["user_id"] + 10_000 * i, event_id=one["event_id"] + 10_000 * i) for i in range(k)]).to_parquet(tmp_path / str(k) / "events.parquet")
    members = lambda c: ",".join(map(str, sorted(m + 10_000 * i for m in c for i in range(copies))))
    p = pairs(spark, str(tmp_path / "1"))
    clusters = G.frame_clusters(p, "flocks").collect()
    last = max(x["frame"] for x in clusters)
    clusters = [(x["frame"], x["clusters"]) for x in clusters] + [(last, [1])]
    before = shuffled(spark)
    assert sorted(QUERIES["a6_cliques"](spark, str(tmp_path / str(copies))).collect()) == sorted((f, members(c)) for f, c in clusters)
    by = sorted({f for f, _ in clusters})
    want = G.fold([(i, f, [c for g, c in clusters if g == f]) for i, f in enumerate(by)], 1, 21_600, len(by) - 1)  # one object stands for 100
    assert sorted(QUERIES["g2_mine_flocks"](spark, str(tmp_path / str(copies))).collect()) == sorted((members(c), s, e) for c, s, e in want)
    assert shuffled(spark) - before < LEAST_CUT / 10


def test_fold_of_sets():
    """The patterns of fold() for overlapping cliques, in frames with gaps, with more members than bits of a word, in small blocks."""
    rng = np.random.default_rng(4)
    for trial in range(60):
        n, last, least, long = int(rng.choice([3, 8, 20, 40, 140])), 7, int(rng.choice([2, 3])), int(rng.choice([0, 100, 200]))
        frames = []
        for i in range(1, last + 1):
            here, at = np.flatnonzero(rng.random(n) < 0.8), rng.random((n, 2)) * (1 if n <= 20 else n / 20) ** 0.5
            near = [{b for b in range(len(here)) if b != a and np.hypot(*(at[here[a]] - at[here[b]])) < 0.5} for a in range(len(here))]
            if rng.random() < 0.85 and (c := [here[x] for x in G.clique_lists(near) if len(x) >= least]):
                frames.append((i, 100 * i, c))
        got = [(own[np.flatnonzero(x)].tolist(), int(s), e) for own, r, st, e in G.fold_sets(frames, np.ones(n, int), least, long, last, 64) for x, s in zip(G._unpacked(r, len(own)), st)]
        assert sorted(got) == sorted(G.fold([(i, t, [x.tolist() for x in c]) for i, t, c in frames], least, long, last)), trial


def test_crowd_of_flocks(spark, tmp_path):
    """70 objects at different places of a site: the patterns of the cliques found on pairs."""
    rng, copies = np.random.default_rng(6), 70
    e = pd.DataFrame([(20 * u, f, 1000 * f + int(p)) for f in range(4) for u, p in enumerate(rng.choice(1000, copies, replace=False)) if rng.random() < 0.8], columns=["user_id", "frame", "event_id"])
    e["ts"] = (pd.Timestamp("2024-01-01") + pd.to_timedelta(e["frame"] * 21_600 + 60, unit="s")).astype("datetime64[us]")
    e.assign(event_type="view", value=1.0, props="").drop(columns="frame").to_parquet(tmp_path / "events.parquet")
    clusters = G.frame_clusters(pairs(spark, str(tmp_path)), "flocks").collect()
    by = sorted({x["frame"] for x in clusters})
    want = G.fold([(i, f, [x["clusters"] for x in clusters if x["frame"] == f]) for i, f in enumerate(by)], 2, 21_600, len(by) - 1)
    assert sorted(QUERIES["g2_mine_flocks"](spark, str(tmp_path)).collect()) == sorted((",".join(map(str, c)), s, t) for c, s, t in want)
