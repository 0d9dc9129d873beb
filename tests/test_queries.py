"""Every registered query of the catalogue against its SQL in DuckDB, over the smallest tables."""

import math
import os
from datetime import date, datetime

import pytest

from scoreline.plans import ORACLE, QUERIES

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables here")


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    if isinstance(v, (datetime, date)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in os.listdir(DATA):
        con.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{name}'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    got = sorted((tuple(plain(r[c]) for c in sorted(df.columns)) for r in df.collect()), key=repr)
    if name not in ORACLE:
        assert df.columns
        return
    found = duck.execute(ORACLE[name])
    columns = [d[0] for d in found.description]
    order = sorted(range(len(columns)), key=columns.__getitem__)
    assert sorted(columns) == sorted(df.columns)
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in found.fetchall()), key=repr)


def test_fuzzy_pairs_cover_names_with_noise(spark):
    from scoreline.plans.adapters import frame

    seen = frame(spark, DATA, "samples").filter("success")
    later = seen.selectExpr("video_id", "t - 180 AS t", "player1 AS q1")
    pairs = seen.join(later, ["video_id", "t"])
    noisy = pairs.filter("endswith(player1, 'X') OR endswith(q1, 'X')").select("video_id", "t")
    got = QUERIES["fuzzy_pair_match"](spark, DATA)
    assert got.count() == pairs.count() and noisy.count() > 0
    assert got.join(noisy, ["video_id", "t"]).filter("same").count() > 0
