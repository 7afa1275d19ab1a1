import os

import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"


def test_registry():
    queries, oracles = entry.queries(), entry.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 50
    assert {f"p{n}_found" for n in (1, 2, 3, 4, 6)} <= set(queries)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_flagship(spark):
    rows = entry.entry(spark).collect()
    assert rows and set(rows[0].asDict()) == {"road_type", "n", "km"}


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
@pytest.mark.parametrize("name", ["km_by_road_type", "p6_found", "points_in_district", "nearest_node", "weak_components", "origin_centroids", "trajectory_entropy"])
def test_oracle(spark, name):
    import duckdb

    db = duckdb.connect()
    for f in os.listdir(DATA):
        db.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{DATA}/{f}'")
    df, want = entry.queries()[name](spark, DATA), db.sql(entry.oracle_sql()[name])
    order = sorted(df.columns)
    assert order == sorted(want.columns)
    text = lambda row: tuple(f"{v:.6f}" if isinstance(v, float) else str(v) for v in row)
    at = [want.columns.index(c) for c in order]
    assert sorted(text(r[c] for c in order) for r in df.collect()) == sorted(text(r[k] for k in at) for r in want.fetchall())
