"""Odd tracks: gaps at the limit of a session, unknown velocities; the same rows as the SQL."""

import duckdb
import pandas as pd
import pytest

from tidewake.operators import patterns as G
from tidewake.operators import segments as S
from tidewake.plans.registry import ORACLE_SQL, QUERIES


def same(spark, tmp_path, name, points):
    """points: (user, seconds, value)"""
    e = pd.DataFrame([(i, pd.Timestamp(1_704_067_200 + t, unit="s"), u, "view", v, "") for i, (u, t, v) in enumerate(points)], columns=["event_id", "ts", "user_id", "event_type", "value", "props"])
    e.assign(ts=e["ts"].astype("datetime64[us]"), value=e["value"].astype("Float64")).to_parquet(tmp_path / "events.parquet")
    con = duckdb.connect()
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    got = QUERIES[name](spark, str(tmp_path))
    return sorted(map(tuple, got.collect())) == sorted(con.execute(f"select {', '.join(got.columns)} from ({ORACLE_SQL[name]})").fetchall())


@pytest.mark.parametrize("gap", [43_199, 43_200, 43_201, 43_202])
def test_gap_of_sessions(spark, tmp_path, gap):
    assert same(spark, tmp_path, "st7_session_windows", [(1, 0, 1.0), (1, gap, 2.0), (2, 5, 3.0)])


@pytest.mark.parametrize("speeds", [[None, 50.0, 40.0, 60.0], [50.0, 40.0, 60.0, None], [60.0, None, 50.0]])
def test_tags_with_unknown_velocities(spark, tmp_path, speeds):
    assert same(spark, tmp_path, "w22_semantic_tags", [(1, 60 * i, v) for i, v in enumerate(speeds)])


def test_mean_of_just_one_is_not_slow(spark):
    speeds = [39.94, 40.54, 40.21, 40.6, 38.71]  # 40 in the mean; as doubles, divided by 40, they add up to less
    df = spark.createDataFrame([(1, i, i, 0.0, 0.0, v / 40, 0) for i, v in enumerate(speeds)], "mmsi long, ts long, event_id long, lon double, lat double, velocity double, traj_id int")
    areas = spark.createDataFrame([(0, 50.0, 50.0)], "area_id int, lon double, lat double")
    assert S.semantic_tags(df, areas).first()["semantic_id"] in (2, 3)


def test_means_of_just_one_of_two_points(spark, tmp_path):
    """Two doubles have one sum, in any order; for some pairs it is below 2, where the decimals give just 2."""
    assert same(spark, tmp_path, "w22_semantic_tags", [(a, 60 * i, v / 100) for a in range(1, 4000, 7) for i, v in enumerate((a, 8000 - a))])


def test_partitions_that_leave_nothing(spark):
    """A merge by the older rule may leave no pattern; the partitions after it are still there."""
    parts = spark.createDataFrame([([1, 2], 0, 0, 0), ([3, 4], 60, 60, 1), ([5, 6], 120, 300, 2)], "clusters array<bigint>, st long, et long, bin long")
    assert [tuple(r) for r in G.reduce_by_containment(parts, 60, 100).collect()] == [([5, 6], 120, 300)]


@pytest.mark.parametrize("speeds", [[3.0] * 20 + [7.0] * 3 + [3.0] * 20, [0.1] * 30 + [9.0] + [0.1] * 10, [5.0] * 30, [1.0, 2.0], [0.3 * i for i in range(40)]])
def test_adaptive_pois_of_steady_speeds(spark, tmp_path, speeds):
    """Quartiles that are equal: every change is an outlier for every alpha."""
    assert same(spark, tmp_path, "w20_adaptive_pois", [(1, 60 * i, v) for i, v in enumerate(speeds)])
