import math
import re

import pytest
from pyspark.sql import functions as F

from ruamesh.functions import classify as C
from ruamesh.functions import geo as G


def ring(*p):
    return [{"x": float(x), "y": float(y)} for x, y in p]


def polygons(spark, *rings):
    return spark.createDataFrame([(list(r),) for r in rings], "rings array<array<struct<x: double, y: double>>>")


def test_projection_round_trip(spark):
    pts = spark.createDataFrame([(-51.23, -30.03), (-51.0, -29.5), (-53.9, -31.2), (-48.1, -28.0)], "lon double, lat double")
    for grid in (G.UTM_22S, G.TM_POA):
        x, y = G.project("lon", "lat", grid)
        there = pts.select("lon", "lat", x.alias("x"), y.alias("y"))
        lon, lat = G.unproject("x", "y", grid)
        for r in there.select("lon", "lat", lon.alias("a"), lat.alias("b"), "x").collect():
            assert abs(r["lon"] - r["a"]) < 1e-8 and abs(r["lat"] - r["b"]) < 1e-8
    assert abs(there.select("x").collect()[1][0] - G.TM_POA.easting) < 1e-6  # on the central meridian


def test_great_circle(spark):
    q = F.lit(90.0)
    assert abs(spark.range(1).select(G.great_circle(F.lit(0.0), F.lit(0.0), q, F.lit(0.0))).first()[0] - G.EARTH_M * math.pi / 2) < 1e-6


def test_area_centroid_length(spark):
    square, hole = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0)), ring((2, 2), (4, 2), (4, 4), (2, 4))
    df = polygons(spark, [square, hole], [square[::-1]], [square[:2]])
    assert [r[0] for r in df.select(G.polygon_area("rings")).collect()] == [96.0, 100.0, 0.0]
    one = df.select(F.col("rings")[0].alias("r"))
    assert [r[0] and tuple(r[0]) for r in one.select(G.ring_centroid("r")).collect()] == [(5.0, 5.0), (5.0, 5.0), None]
    assert [r[0] for r in one.select(G.ring_area("r")).collect()] == [100.0, -100.0, 0.0]
    assert [r[0] for r in one.select(G.line_length("r")).collect()] == [40.0, 40.0, 10.0]
    assert tuple(G.total_bounds(one, "r").first()) == (0.0, 0.0, 10.0, 10.0)


def test_within_excludes_the_boundary_and_any_rotation(spark):
    square = ring((0, 0), (10, 0), (10, 10), (0, 10), (0, 0))
    pts = [(5, 5, True), (0, 5, False), (10, 5, False), (10, 10, False), (11, 5, False), (5, 0, False)]
    rows = [(float(x), float(y), want, [r]) for x, y, want in pts for r in (square, square[1:] + square[1:2], square[::-1])]
    df = spark.createDataFrame(rows, "x double, y double, want boolean, rings array<array<struct<x: double, y: double>>>")
    assert all(r[0] == r[1] for r in df.select("want", G.within("x", "y", "rings")).collect())


def test_srids_must_agree(spark):
    a = G.with_srid(spark.range(1), "id", 31982)
    G.same_srid(a, "id", a, "id")
    try:
        G.same_srid(a, "id", G.with_srid(spark.range(1), "id", 4674), "id")
    except ValueError:
        pass
    else:
        raise AssertionError("no error")


def test_classification(spark):
    df = spark.createDataFrame([("primary",), ("['busway', 'primary']",), ("secondary_link",), ("cycleway",), ("footway",), (None,)], "h string")
    got = df.select(C.road_type("h"), C.road_type("h", "pt"), C.road_type_ladder("h"), C.road_type_inline("h"), C.modal("h")).collect()
    assert [tuple(r) for r in got] == [
        ("Arterial Road", "Via Arterial", "Via Arterial", "Arterial Road", "car"),
        ("Bus Corridor", "Corredor de Ônibus", "Outro", "Bus Corridor", "other"),
        ("Other", "Other", "Link Coletor", "Collector Link", "other"),
        ("Other", "Other", "Outro", "Other", "bike"),
        ("Other", "Other", "Outro", "Other", "pedestrian"),
        ("Other", "Other", "Outro", "Other", "other"),
    ]
    named = spark.createDataFrame([("Avenida OSVALDO x",), (None,)], "name string")
    assert [r[0] for r in named.select(C.contains("name", "osvaldo")).collect()] == [True, False]


def test_tables_are_reprojected_and_back(spark):
    p, line = "struct<x: double, y: double>", [(478724.04, 6677099.57), (479920.73, 6677846.19)]
    df = spark.createDataFrame([(1, line[0], line, [line, line[::-1]]), (2, None, None, None)], f"id int, p {p}, l array<{p}>, g array<array<{p}>>")
    for column in ("p", "l", "g"):
        degrees = G.to_crs(df, column, 31982, 4674)
        back = G.to_crs(G.to_crs(degrees, column, 4674, 100_001), column, 100_001, 31982)
        assert degrees.schema[column].metadata["srid"] == 4674 and back.schema[column].metadata["srid"] == 31982
        flat = lambda v: [float(x) for x in re.findall(r"-?\d+\.\d+", str(v))]
        a, b = df.orderBy("id").collect(), back.orderBy("id").collect()
        assert flat(a[0][column]) == pytest.approx(flat(b[0][column]), abs=2e-3) and b[1][column] is None
        assert flat(degrees.orderBy("id").collect()[0][column])[:2] == pytest.approx([-51.2218, -30.0388], abs=2e-3)
        with pytest.raises(ValueError):
            G.to_crs(degrees, column, 31982, 4674)


def test_spatial_joins_want_one_system(spark):
    from ruamesh.operators.spatial import nearest

    a, b = spark.createDataFrame([(1, 0.0, 0.0)], "id bigint, x double, y double"), spark.createDataFrame([(2, 0.0, 1.0)], "target bigint, x double, y double")
    assert nearest(G.with_srid(a, "x", 31982), G.with_srid(b, "x", 31982)).count() == 1
    with pytest.raises(ValueError):
        nearest(G.with_srid(a, "x", 31982), G.with_srid(b, "x", 4674))
