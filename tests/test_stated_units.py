"""Statements alone give the units where they name one for a day; values are asked only where they leave a choice."""

import datetime as dt

import pytest

from ruamesh.operators import edges as E
from ruamesh.plans import problems

DATA = "/root/testdata/sf0.001"


def test_values_are_not_asked_where_statements_decide(spark, monkeypatch):
    e, fontes = spark.read.parquet(f"{DATA}/gdf_edges.parquet").select(problems.MEASURED), spark.read.parquet(f"{DATA}/fontes.parquet")
    counts = E.text_counts(e, ["maxspeed"])
    splits = E.learn_splits(e, ["maxspeed"], E.DECIMALS, texts=E.texts_of(counts))
    want = {kind: sorted(map(tuple, s.select("source", "day", "decoded").collect())) for kind, s in E.day_states(e, fontes, counts, splits).items()}
    got = {kind: sorted(map(tuple, s.select("source", "day", "decoded").collect())) for kind, s in E.decided_states(e, fontes, counts, splits).items()}
    assert got == want
    monkeypatch.setattr(E, "day_states", lambda *_: pytest.fail("the values were decoded"))
    assert problems.p2_found(spark, DATA).count() > 0


def test_values_decide_between_two_statements(spark):
    fontes = spark.createDataFrame([("dois", "Comprimentos em metros; extensões em quilômetros. Velocidade em km/h."), ("um", "Comprimentos em metros.")], "source string, descricao string")
    line = [{"x": 0.0, "y": 0.0}, {"x": 50.0, "y": 0.0}]
    rows = [(i, 1, "residential", v, "40", None, s, dt.datetime(2023, 5, 1 + i % 5), line) for i, (s, v) in enumerate([("dois", "0.05"), ("um", "0.05"), (None, "0.05")] * 10)]
    e = spark.createDataFrame(rows, "row_id bigint, load_id int, highway string, length string, maxspeed string, note string, source string, loaded_at timestamp, geometry array<struct<x:double,y:double>>")
    got = {(r["source"], r["unit"]) for r in E.measured(e, fontes).select("row_id", "length.unit").join(e.select("row_id", "source"), "row_id").collect()}
    assert got == {("dois", "km"), ("um", "m"), (None, "m")}
