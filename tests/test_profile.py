import random

from pyspark.sql import functions as F

from ruamesh.functions.units import number
from ruamesh.operators import profile as P


def test_masks(spark):
    df = spark.createDataFrame([("40 km/h",), ("3O",), ("ação 12;7",), (None,)], "v string")
    assert [r[0] for r in df.select(P.mask("v")).collect()] == ["9 a/a", "9a", "a 9;9", None]


def test_findings(spark):
    rows = [(i, 1 + i % 4, "3") for i in range(80)] + [(100, 1, "x"), (101, 1, ""), (102, 2, "99"), (103, 2, "1.5"), (104, 3, None), (105, 4, None)] + [(200 + i, 4, None) for i in range(9)] + [(300 + i, 3, "9") for i in range(40)]
    df = spark.createDataFrame(rows, "row_id bigint, load_id bigint, text string")
    texts = df.filter("text IS NOT NULL").groupBy("text").agg(F.count(F.lit(1)).alias("n")).select(F.lit("c").alias("field"), "text", "n", F.array("text").alias("vals"))
    marked = df.join(P.violations(texts, {"c": None}).select("text", "bad"), "text", "left")
    nums = F.transform(F.filter(F.array("text"), lambda v: v != ""), lambda v: number(v))
    got = {tuple(r) for r in P.number_findings(marked.select("row_id", "load_id", P.mark(F.col("text"), F.col("bad"), nums, 1, 10, whole=True).alias("mark"))).collect()}
    assert got == {(1, 100, "pattern"), (1, 101, "pattern"), (2, 102, "range"), (2, 103, "range"), (4, 0, "nulls"), (3, 0, "shift")}


def test_plain_and_profile(spark):
    rows = [(i, i % 3, float(i % 10)) for i in range(60)] + [(60, 0, -1.0), (61, 1, None), (61, 1, None)]
    df = spark.createDataFrame(rows, "row_id bigint, load_id bigint, num double")
    got = {tuple(r) for r in P.plain_findings(df, 0, 5000).collect()}
    assert (0, 60, "range") in got and (1, 0, "nulls") in got
    prof = {r["load"]: r for r in P.column_profile(df, "num").collect()}
    assert set(prof) == {0, 1, 2} and prof[0]["n"] == 21 and 0 <= prof[0]["js"] < 0.05 and prof[1]["null_share"] > 0.09


def test_empty(spark):
    none = spark.createDataFrame([], "row_id bigint, load_id bigint, num double")
    assert P.plain_findings(none, 0, 1).count() == 0 and P.column_profile(none, "num").count() == 0


def test_a_mask_decides_like_its_values(spark):
    rng = random.Random(2)
    parts = ["40", "3,5", "-7", " ", "  ", "km/h", "KM / H", "mph", "m/s", "xyz", "a", "placa", "(ida)", "@ 22:00", "nós", "quilômetros por hora", "milhas/h", ",", ";", "O", "\n"]
    vals = sorted({"".join(rng.choice(parts) for _ in range(rng.randrange(0, 5))) for _ in range(3000)})
    df = spark.createDataFrame([(v,) for v in vals], "v string")
    for kind in (None, "speed"):
        m = df.withColumn("m", P.value_mask("v", kind))
        assert m.filter(number("v", kind).isNotNull() != number("m", kind).isNotNull()).count() == 0
        assert m.select("m").distinct().count() < len(vals)


def test_the_grammar_is_asked_once_for_each_mask(spark):
    texts = spark.createDataFrame([("s", f"{k} km/h", 5, [f"{k} km/h"]) for k in range(200)] + [("s", "4O", 1, ["4O"]), ("s", "", 300, [""]), ("s", "x;30", 1, ["x", "30"])], "field string, text string, n bigint, vals array<string>")
    masks = {r["mask"]: (r["pattern"], r["passes"]) for r in P.value_masks(texts, {"s": "speed"}).collect()}
    assert masks == {"9 km/h": (True, True), "9a": (False, False), "": (False, False), "a": (False, False), "9": (False, True)}
    assert {r["text"] for r in P.violations(texts, {"s": "speed"}).filter("bad").collect()} == {"4O", ""}
