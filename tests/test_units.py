import datetime as dt

from pyspark.sql import functions as F

from ruamesh.functions.units import number, own_unit, stated_unit
from ruamesh.operators.units import decode_units, statements

SOURCES = [
    ("cad", "Cadastro. Extensões publicadas em quilômetros até 30/06/2023; a partir de 01/07/2023 o órgão passou a publicar em metros. Velocidade em quilômetros por hora."),
    ("gps", "Distâncias em metros e velocidade convertida para metros por segundo."),
    ("imp", "Segment lengths are given in yards, speed limits in miles per hour."),
    ("mudo", "Sem indicação."),
]


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "val string")
    return [r[0] for r in df.select(column).collect()]


def test_numbers_and_own_units(spark):
    assert one(spark, number("val", "speed"), "40", "11,1 m/s", "30 kph (seg, ter)", "3O km/h", None, "", "50 @ (22:00-05:00)") == [40.0, 11.1, 30.0, None, None, None, 50.0]
    assert one(spark, own_unit("val", "speed"), "40", "11,1 m/s", "12 MPH", "20 milhas/h", "11 nós", "100 quilômetros por hora") == [None, "m/s", "mph", "mph", "kn", "km/h"]
    assert one(spark, own_unit("val", "length"), "40", "31.8M", "1,2 km", "34 pés", "3 jardas", "310 cm") == [None, "m", "km", "ft", "yd", "cm"]


def test_remarks_speak_only_of_their_field(spark):
    assert one(spark, stated_unit("val", "length"), "comprimento em jardas", "ext. anotada em quilômetros", "altura livre 4,5 m", "placa de 1 km antes", "faixa de 3 m", "vel. em mph", None) == ["yd", "km", None, None, None, None, None]
    assert one(spark, stated_unit("val", "speed"), "limite em metros por segundo", "vel. máx. em m/s", "velocidade em milhas por hora", "length in feet") == ["m/s", "m/s", "mph", None]


def test_statements_have_dates(spark):
    src = spark.createDataFrame(SOURCES, "source string, descricao string")
    got = {(r["source"], r["unit"]): (r["first"], r["last"]) for r in statements(src, "length").collect()}
    assert statements(src, "length").count() == 4  # no metre inside of "quilômetros" or "centímetro"
    assert got == {("cad", "km"): (None, dt.date(2023, 6, 30)), ("cad", "m"): (dt.date(2023, 7, 1), None), ("gps", "m"): (None, None), ("imp", "yd"): (None, None)}
    assert {(r["source"], r["unit"]) for r in statements(src, "speed").collect()} == {("cad", "km/h"), ("gps", "m/s"), ("imp", "mph")}


def _values(spark, rows):
    return spark.createDataFrame(rows, "id bigint, val string, note string, source string, at timestamp, level double")


def test_precedence_and_defaults(spark):
    at = dt.datetime(2023, 5, 1)
    rows = [(1, "0.05", None, "cad", at, 50.0), (2, "50", None, "cad", dt.datetime(2023, 8, 1), 50.0), (3, "50 ft", "comprimento em km", "cad", at, 15.0), (4, "1", "comprimento em km", "gps", at, None), (5, "7", None, None, at, None), (6, "x", None, "gps", at, None), (7, None, None, "gps", None, None), (8, "7", None, "mudo", None, None)]
    src = spark.createDataFrame(SOURCES, "source string, descricao string")
    got = {r["id"]: (r["unit"], round(r["si"], 6)) for r in decode_units(_values(spark, rows), src, "length").collect()}
    assert got == {1: ("km", 50.0), 2: ("m", 50.0), 3: ("ft", 15.24), 4: ("km", 1000.0), 5: ("m", 7.0), 8: ("m", 7.0)}


def test_switch_day_from_the_data_alone(spark):
    day0 = dt.datetime(2023, 6, 1)
    rows = []
    for d in range(60):
        for k in range(5):
            metres = 40.0 + 7 * k + d % 3
            rows.append((d * 10 + k, f"{metres / 1000 if d < 30 else metres:.5f}", None, "cad", day0 + dt.timedelta(days=d), metres))
    src = spark.createDataFrame([], "source string, descricao string")
    got = {r["id"]: r["unit"] for r in decode_units(_values(spark, rows), src, "length", statement_weight=0.0).collect()}
    assert all(unit == ("km" if i // 10 < 30 else "m") for i, unit in got.items())


def test_empty_and_extra_columns(spark):
    src = spark.createDataFrame(SOURCES, "source string, descricao string")
    assert decode_units(_values(spark, []), src, "speed").count() == 0
    odd = _values(spark, [(1, "40", None, "gps", None, 45.0)]).withColumn("descricao", F.lit("x"))
    assert [r["unit"] for r in decode_units(odd, src, "speed").collect()] == ["m/s"]
