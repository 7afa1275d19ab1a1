"""The recorded quantities of the edge table, each value in common units.

The table is read three times, however many quantities are asked for: once for the counts of its distinct texts, once
for the days of its sources, once for its rows. Values decide a unit only for sources whose statements name several
units for one day; their rows are read once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruamesh.common import cut, lookup
from ruamesh.functions.units import FACTORS, factor, number, own_unit, stated_unit
from ruamesh.operators.multivalue import learn_splits
from ruamesh.operators.units import STATEMENT_WEIGHT, likelihoods, stated_states, unit_states

#: Packed fields whose values may have a decimal comma.
DECIMALS = ("maxspeed",)
KINDS = {"length": "length", "maxspeed": "speed"}


def _class() -> Column:
    return F.coalesce(F.regexp_extract("highway", "([a-z_]+)", 1), F.lit("")).alias("class")


def polyline_length(points: str) -> Column:
    """Length of an array of points; null without a segment."""
    n = F.size(points)
    seg = F.transform(F.sequence(F.lit(1), F.when(n > 1, n - 1)), lambda i: F.hypot(F.element_at(points, i + 1)["x"] - F.element_at(points, i)["x"], F.element_at(points, i + 1)["y"] - F.element_at(points, i)["y"]))
    return F.when(n > 1, F.aggregate(seg, F.lit(0.0), lambda a, b: a + b))


def text_counts(edges: DataFrame, fields: list[str]) -> DataFrame:
    """(field, class, text, n): how often each text stands in each field on each class of road; checkpointed."""
    parts = [F.struct(F.lit(f).alias("field"), (_class() if f == "maxspeed" else F.lit("").alias("class")), F.col(f).cast("string").alias("text")) for f in fields]
    return cut(edges.select(F.explode(F.array(*parts)).alias("p")).select("p.*").filter("text IS NOT NULL").groupBy("field", "class", "text").agg(F.count(F.lit(1)).alias("n")))


def texts_of(counts: DataFrame) -> DataFrame:
    """(field, text, n) of ``text_counts``."""
    return counts.groupBy("field", "text").agg(F.sum("n").alias("n"))


def speed_levels(counts: DataFrame, splits: DataFrame) -> DataFrame:
    """(class, level): median of the plain speeds of each class of road, the smooth level under its values."""
    vals = counts.filter("field = 'maxspeed'").join(splits.select("field", "text", "vals"), ["field", "text"], "left")
    nums = vals.select("class", "n", F.explode(F.coalesce("vals", F.array(F.trim("text")))).alias("val")).select("class", "n", number("val", "speed").alias("num")).filter("num > 0")
    return nums.groupBy("class").agg(F.percentile("num", F.lit(0.5), F.col("n")).alias("level"))


def _value_structs(vals: Column) -> Column:
    one = lambda v, i: F.struct((i + 1).cast("bigint").alias("pos"), v.alias("val"), number(v, "speed").alias("num"), own_unit(v, "speed").alias("own"))
    return F.filter(F.transform(vals, one), lambda s: s["val"] != "")


def _facts(edges: DataFrame, splits: DataFrame, keep: tuple[str, ...], levels: DataFrame | None = None) -> DataFrame:
    """One row an edge: its length and speeds as numbers with the units that their texts or its note say."""
    known = splits.filter("field = 'maxspeed'").select(F.col("text").alias("maxspeed"), "vals")
    length = F.col("length").cast("string") if "length" in edges.columns else F.lit(None).cast("string")
    base = edges.select(*keep, length.alias("length"), F.col("maxspeed").cast("string").alias("maxspeed"), "note", _source(), _day(), *([_class(), polyline_length("geometry").alias("level")] if levels is not None else []))
    base = lookup(base, known, ["maxspeed"], "left")
    vals = F.coalesce("vals", F.array(F.trim("maxspeed")))
    said = {k: stated_unit("note", k) for k in ("length", "speed")}
    out = base.withColumns({"num": number("length", "length"), "own": F.coalesce(own_unit("length", "length"), said["length"]), "speeds": F.when(F.col("maxspeed").isNotNull(), _value_structs(vals)), "said": said["speed"]})
    return out if levels is None else lookup(out, levels.withColumnRenamed("level", "slevel"), ["class"], "left")


def day_states(edges: DataFrame, sources: DataFrame, counts: DataFrame, splits: DataFrame, statement_weight: float = STATEMENT_WEIGHT) -> dict[str, DataFrame]:
    """(source, day, decoded) of the lengths and of the speeds."""
    facts = _facts(edges, splits, (), cut(speed_levels(counts, splits)))
    bare = F.when(F.col("said").isNull(), F.filter("speeds", lambda s: s["own"].isNull() & s["num"].isNotNull()))
    aggs = [F.avg(F.when(F.col("own").isNull(), ll)).alias(f"length{k}") for k, ll in enumerate(likelihoods(F.col("num"), F.col("level"), "length"))]

    def total(k: int) -> Column:
        each = F.transform(bare, lambda s: F.coalesce(likelihoods(s["num"], F.col("slevel"), "speed")[k], F.lit(0.0)))
        return F.sum(F.aggregate(each, F.lit(0.0), lambda a, x: a + x))

    seen = F.sum(F.when(F.col("slevel") > 0, F.size(bare)))
    aggs += [F.try_divide(total(k), seen).alias(f"speed{k}") for k in range(len(FACTORS["speed"]))]
    days = cut(facts.groupBy("source", "day").agg(*aggs))
    return {kind: unit_states(days.select("source", "day", *[F.col(f"{kind}{k}").alias(f"ll{k}") for k in range(len(FACTORS[kind]))]), sources, kind, statement_weight) for kind in ("length", "speed")}


def _day() -> Column:
    return F.coalesce(F.to_date("loaded_at"), F.lit("9999-12-31").cast("date")).alias("day")


def _source() -> Column:
    return F.coalesce("source", F.lit("")).alias("source")


def decided_states(edges: DataFrame, sources: DataFrame, counts: DataFrame, splits: DataFrame) -> dict[str, DataFrame]:
    """``day_states`` with statements that outweigh the values, which are read only where statements leave a choice."""
    days = cut(edges.select(_source(), _day()).distinct())
    stated = {kind: cut(stated_states(days, sources, kind)) for kind in ("length", "speed")}
    choice = cut(stated["length"].unionByName(stated["speed"]).filter("decoded IS NULL").select("source").distinct())
    if choice.isEmpty():
        return stated
    some = edges.withColumn("_rm_source", _source()).join(choice.withColumnRenamed("source", "_rm_source"), "_rm_source", "left_semi").drop("_rm_source")
    seen = day_states(some, sources, counts, splits)
    return {kind: stated[kind].join(choice, "source", "left_anti").unionByName(seen[kind]) for kind in stated}


def measured(edges: DataFrame, sources: DataFrame, keep: tuple[str, ...] = ("row_id",), counts: DataFrame | None = None, splits: DataFrame | None = None, statement_weight: float = STATEMENT_WEIGHT) -> DataFrame:
    """One row an edge: ``keep``, maxspeed, length (val, num, unit, si) and speeds, an array of (pos, val, num, unit, si).

    num is null where a value is no number; speeds is null where maxspeed is.
    """
    counts = text_counts(edges, ["maxspeed"]) if counts is None else counts
    splits = learn_splits(edges, ["maxspeed"], DECIMALS, texts=texts_of(counts)) if splits is None else splits
    states = decided_states(edges, sources, counts, splits) if statement_weight >= STATEMENT_WEIGHT else day_states(edges, sources, counts, splits, statement_weight)
    both = states["length"].withColumnRenamed("decoded", "ulength").join(states["speed"].withColumnRenamed("decoded", "uspeed"), ["source", "day"])
    rows = lookup(_facts(edges, splits, keep), cut(both), ["source", "day"])
    unit = F.coalesce("own", "ulength")
    length = F.struct(F.col("length").alias("val"), "num", unit.alias("unit"), (F.col("num") * factor(unit, "length")).alias("si"))

    def speed(s: Column) -> Column:
        u = F.coalesce(s["own"], F.col("said"), F.col("uspeed"))
        return F.struct(s["pos"].alias("pos"), s["val"].alias("val"), s["num"].alias("num"), u.alias("unit"), (s["num"] * factor(u, "speed")).alias("si"))

    return rows.select(*keep, "maxspeed", length.alias("length"), F.transform("speeds", speed).alias("speeds"))


def lengths(rows: DataFrame) -> DataFrame:
    """(row_id, pos, val, num, unit, si) of ``measured`` rows."""
    return rows.select("row_id", F.lit(1).cast("bigint").alias("pos"), "length.*").filter("num IS NOT NULL")


def speeds(rows: DataFrame) -> DataFrame:
    """(row_id, pos, val, num, unit, si) of ``measured`` rows."""
    return rows.select("row_id", F.explode("speeds").alias("s")).select("row_id", "s.*").filter("num IS NOT NULL")
