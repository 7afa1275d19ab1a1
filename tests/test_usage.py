import datetime as dt

import pytest

import __spark_entry__ as entry
from ruamesh.streaming.trajectories import windowed_usage


@pytest.fixture
def events(spark):
    at = dt.datetime(2023, 1, 1, 10)
    # Windows of 1 to 400 users, each user twice; a row without user and one without segment.
    rows = [(at + dt.timedelta(hours=h), u, "a") for h, n in enumerate((1, 37, 51, 400, 5000)) for u in range(n) for _ in range(2)]
    rows += [(at, None, "a"), (at, 1, None), (at, None, "b"), (None, 7, "a")]
    return spark.createDataFrame(rows, "ts timestamp, user_id bigint, event_type string")


WANT = {(0, "a"): (3, 1), (1, "a"): (74, 37), (2, "a"): (102, 51), (3, "a"): (800, 400), (4, "a"): (10000, 5000), (0, "b"): (1, 0)}


def _by_window(rows):
    return {(r["window_start"].hour - 10, r["event_type"]): (r["visits"], r["users"]) for r in rows}


def test_users_are_counted_exactly(events):
    assert _by_window(windowed_usage(events, "ts", "event_type", "user_id").collect()) == WANT


def test_stream_counts_exactly(spark, events, tmp_path):
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = windowed_usage(stream, "ts", "event_type", "user_id", late="30 days").writeStream.format("memory").queryName("exact_usage").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    assert _by_window(spark.table("exact_usage").collect()) == WANT


def test_oracle(spark, events, tmp_path):
    import duckdb

    events.write.parquet(str(tmp_path / "events.parquet"))
    db = duckdb.connect()
    db.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = sorted((r[0].hour, *r[1:]) for r in db.sql(f"SET TimeZone = 'UTC'; {entry.oracle_sql()['usage_windows']}").fetchall())
    got = sorted((r[0].hour, *r[1:]) for r in entry.queries()["usage_windows"](spark, str(tmp_path)).collect())
    assert got == want
