"""Registered queries against their SQL, at the smallest scale.

All of them run with PANELSPARK_ALL=1; by default one of each family does.
"""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
SAMPLE = (
    "bars", "training_table", "ic_by_timestamp_ranged", "global_avg_rank", "grouped_ic", "rolling_group_ic",
    "execution_features", "build_position_variants", "slot_book", "stream_band_state",
)
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-7)
    return a == b


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["date", "ic", "rank_ic", "timestamps"] and df.count() > 0


@pytest.mark.parametrize("name", sorted(ORACLES) if os.environ.get("PANELSPARK_ALL") else SAMPLE)
def test_query_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    cur = duck.execute(ORACLES[name])
    cols = sorted(df.columns)
    names = [d[0] for d in cur.description]
    assert cols == sorted(names)
    order = lambda r: tuple((v is None, v if v is not None else 0) for v in r)
    got = sorted((tuple(r[c] for c in cols) for r in df.collect()), key=order)
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=order)
    assert len(got) == len(want)
    for a, b in zip(got, want):
        assert all(same(x, y) for x, y in zip(a, b)), (a, b)
