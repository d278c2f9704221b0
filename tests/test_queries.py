"""Every query with SQL gives the same rows on DuckDB; the rest imports without the training-data subpackage."""

import os
import subprocess
import sys

import duckdb
import pytest

import __spark_entry__ as entry
from tidewake.plans.registry import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings".split():
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def rows(frame):
    cols = sorted(frame.columns)
    return sorted(repr(tuple(None if v is None or v != v else float(v) if hasattr(v, "__float__") and not isinstance(v, str) else v for v in r)) for r in frame[cols].astype(object).where(frame[cols].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    got = QUERIES[name](spark, SF).toPandas()
    if name in ORACLE_SQL:
        want = con.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)


def test_video_codec_covers_all_frames(spark, con):
    rows_ = con.execute("select vec_id, embedding from embeddings order by vec_id").fetchall()
    quantized = lambda x, q: [round(round(v / q, 2) * q, 2) for v in x]
    want, last, now = {}, None, None
    for f, e in rows_:
        x = [float(int(abs(v) * 255.0)) for v in e]
        now = quantized(x, 10) if last is None else [a + b for a, b in zip(now, quantized([a - b for a, b in zip(x, last)], 100))]
        want.update({(f, i): v for i, v in enumerate(now)})
        last = x
    got = {(r["frame_id"], r["i"]): r["v"] for r in QUERIES["f9_video_codec"](spark, SF).collect()}
    assert len(rows_) > 40 and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-6 for k in want)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_works_without_the_subpackage():
    code = "import sys; sys.modules['tidewake.llm'] = None; sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert len(e.queries()) > 90 and not any(n.startswith('op1') for n in e.queries()); print('fine')"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    assert "fine" in subprocess.run([sys.executable, "-c", code], cwd=root, capture_output=True, text=True).stdout
