import datetime as dt

from pyspark.sql import functions as F

from ruamesh.operators import mobility as M
from ruamesh.operators import network as N
from ruamesh.streaming.trajectories import windowed_usage


def test_entropy_and_usage(spark):
    rows = [(1, s) for s in "aabc"] + [(2, "a"), (2, None), (None, "a"), (1, None)]
    df = spark.createDataFrame(rows, "t bigint, s string")
    assert {r["t"]: (round(r["entropy"], 9), r["visits"]) for r in M.entropy(df, "t", "s").collect()} == {1: (1.5, 4), 2: (0.0, 1)}
    assert {r["s"]: (r["trajectories"], r["visits"]) for r in M.segment_usage(df, "t", "s").collect()} == {"a": (2, 3), "b": (1, 1), "c": (1, 1)}


def test_fragments_presence_periods(spark):
    at = dt.datetime(2023, 1, 1, 10)
    rows = [(1, s, at + dt.timedelta(minutes=k)) for k, s in enumerate("aabba")] + [(2, "a", at)]
    df = spark.createDataFrame(rows, "t bigint, s string, at timestamp")
    assert {r["t"]: (r["fragments"], r["steps"]) for r in M.fragments(df, "t", "s", ["at"]).collect()} == {1: (3, 5), 2: (1, 1)}
    assert {(r["s"], r["present"], r["pairs"]) for r in M.co_presence(df, "s", "t", "at").collect()} == {("a", 2, 1), ("b", 1, 0)}
    assert M.per_period(df, "at", "day", F.count(F.lit(1)).alias("n")).first()["n"] == 6
    one = spark.range(1)
    assert tuple(one.select(M.detour(F.lit(3.0), F.lit(2.0)), M.detour(F.lit(3.0), F.lit(0.0)), M.travel_seconds(F.lit(100.0), F.lit(36.0))).first()) == (1.5, None, 10.0)


def test_filled_edges_and_origins(spark):
    nodes = spark.createDataFrame([(1, 0.0, 0.0), (2, 3.0, 4.0), (2, 3.0, 4.0)], "osmid bigint, x double, y double")
    edges = spark.createDataFrame([(1, 1, 2, None, "primary"), (2, 1, 9, None, None), (3, 2, 1, [(3.0, 4.0), (3.0, 0.0), (0.0, 0.0)], "x")], "row_id bigint, u bigint, v bigint, geometry array<struct<x: double, y: double>>, highway string")
    got = {r["row_id"]: (r["length_mm"], r["road_type"]) for r in N.characterised(edges, nodes).collect()}
    assert got == {1: (5000, "Arterial Road"), 2: (None, "Other"), 3: (7000, "Other")}
    cell = [(0.0, 0.0), (50.0, 0.0), (50.0, 50.0), (0.0, 50.0), (0.0, 0.0)]
    grid = spark.createDataFrame([(1, 5, cell), (2, 0, cell), (3, None, cell)], "fid bigint, POP int, geometry array<struct<x: double, y: double>>")
    assert [tuple(r) for r in N.populated_origins(grid).collect()] == [(1, 5, 25.0, 25.0)]


def test_stream_equals_batch(spark, tmp_path):
    at = dt.datetime(2023, 1, 1)
    rows = [(k, at + dt.timedelta(minutes=17 * k), k % 3, "ab"[k % 2]) for k in range(60)]
    df = spark.createDataFrame(rows, "event_id bigint, ts timestamp, user_id bigint, event_type string")
    df.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed_usage(stream, "ts", "event_type", "user_id", late="30 days").writeStream.format("memory").queryName("usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    want = sorted(map(tuple, windowed_usage(df, "ts", "event_type", "user_id").collect()))
    assert sorted(map(tuple, spark.table("usage").collect())) == want
