import datetime as dt

import pytest

from ruamesh.plans import network as Q

POINTS = "array<struct<x: double, y: double>>"
AT = dt.datetime(2023, 5, 1)
#: maxspeed, note, source, km/h of its first value (None: no row)
SPEEDS = [
    ("50", None, "cad", 50.0), ("30", None, "imp", 30 * 1.609344), ("10", None, "gps", 36.0), ("37.5", None, "cad", 37.5), ("37,5", None, "cad", 37.5),
    (" 40 ", None, "cad", 40.0), ("30 mph", None, "cad", 30 * 1.609344), ("60", "limite em metros por segundo", "cad", 216.0), ("0", None, "cad", None), ("livre", None, "cad", None), (None, None, "cad", None),
    ("40;60", None, "cad", 40.0), ("60;40", None, "imp", 60 * 1.609344),
]


@pytest.fixture
def tables(spark, tmp_path):
    src = [("cad", "Velocidade em quilômetros por hora."), ("gps", "Velocidade convertida para metros por segundo."), ("imp", "Speed limits in miles per hour.")]
    rows = [(k, 1, 2, "primary", None, v, s, n, 1, AT, [(0.0, 0.0), (0.0, 100.0)]) for k, (v, n, s, _) in enumerate(SPEEDS)]
    # Other rows make the separator and the bare numbers common.
    rows += [(1000 + k, 1, 2, "primary", None, v, "cad", None, 1, AT, None) for k, v in enumerate(["40", "60", "30", "50", "40;60", "60;40"] * 20)]
    spark.createDataFrame(rows, f"row_id bigint, u bigint, v bigint, highway string, name string, maxspeed string, source string, note string, load_id int, loaded_at timestamp, geometry {POINTS}").write.parquet(str(tmp_path / "gdf_edges.parquet"))
    spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 50.0)], "osmid bigint, x double, y double").write.parquet(str(tmp_path / "gdf_nodes.parquet"))
    spark.createDataFrame(src, "source string, descricao string").write.parquet(str(tmp_path / "fontes.parquet"))
    return str(tmp_path)


def test_every_speed_counts_in_its_unit(spark, tables):
    got = {r["row_id"]: r["seconds"] for r in Q.travel_times(spark, tables).collect()}
    want = {k: 100 / (kmh / 3.6) for k, (*_, kmh) in enumerate(SPEEDS) if kmh}
    assert {k: v for k, v in got.items() if k < 1000} == pytest.approx(want, abs=1e-6)
    assert sum(k >= 1000 for k in got) == 120  # a straight line where there is no geometry
    assert got[1000] == pytest.approx(50 / (40 / 3.6), abs=1e-6)
