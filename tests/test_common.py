import pytest
from pyspark.sql import functions as F

from ruamesh import common


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("most", [0, 10_000])
def test_lookup_with_a_hot_key(spark, how, most):
    # One key holds a third of the rows; it is joined apart when the side may not be broadcast.
    facts = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.lit(7)).otherwise(F.col("id") % 500).alias("k"), "id")
    dim = common.cut(spark.range(0, 400).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")))
    got = common.lookup(facts, dim, ["k"], how, max_rows=most)
    want = facts.join(dim, ["k"], how)
    assert sorted(map(str, got.select("k", "id", "v").collect())) == sorted(map(str, want.select("k", "id", "v").collect()))


def test_lookup_without_hot_keys_and_empty(spark):
    facts, dim = spark.range(3000).select(F.col("id").alias("k")), common.cut(spark.range(2000).select(F.col("id").alias("k"), F.lit(1).alias("v")))
    assert common.lookup(facts, dim, ["k"], max_rows=0).count() == 2000
    assert common.lookup(facts.limit(0), dim, ["k"], max_rows=0).count() == 0
    assert common.lookup(facts, dim.limit(0), ["k"], "left").filter("v IS NULL").count() == 3000


def test_dense_index(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 5003).alias("a"), (F.col("id") % 5).alias("b"))
    rows = common.dense_index(df, [F.desc("b"), F.asc("a")], "place").orderBy("place").collect()
    assert [r["place"] for r in rows] == list(range(5000))
    assert [(-r["b"], r["a"]) for r in rows] == sorted((-r["b"], r["a"]) for r in rows)
    assert common.dense_index(df.limit(0), [F.asc("a")], "place").count() == 0


def test_cut_keeps_rows_and_partitions_of_work(spark):
    assert common.cut(spark.range(10)).agg(F.sum("id")).first()[0] == 45


def test_hot_key_on_both_sides_is_salted(spark):
    facts = spark.range(6000).select((F.col("id") % 3).alias("k"), "id")
    dim = common.cut(spark.range(300).select(F.lit(1).cast("bigint").alias("k"), F.col("id").alias("v")))
    got = common.lookup(facts, dim, ["k"], max_rows=10)
    assert got.count() == 2000 * 300 and got.distinct().count() == 2000 * 300


def test_null_keys_are_kept_on_the_left(spark):
    facts = spark.range(3000).select(F.when(F.col("id") > 900, F.col("id") % 2).alias("k"), "id")
    dim = common.cut(spark.range(1).select(F.col("id").alias("k"), F.lit("x").alias("v")))
    for how in ("inner", "left"):
        got = common.lookup(facts, dim, ["k"], how, max_rows=0)
        assert sorted(map(str, got.select("k", "id", "v").collect())) == sorted(map(str, facts.join(dim, ["k"], how).select("k", "id", "v").collect()))


def test_no_machine_local_checkpoints_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"
        applicationId = spark.sparkContext.applicationId

        class _jsc:
            @staticmethod
            def sc():
                return type("C", (), {"getCheckpointDir": staticmethod(lambda: type("O", (), {"isEmpty": staticmethod(lambda: True)}))})

    class Frame:
        sparkSession = type("S", (), {"sparkContext": Context, "conf": type("F", (), {"get": staticmethod(lambda *a: None)})})

    with pytest.raises(RuntimeError):
        common.cut(Frame)
