"""Column profile: character-class masks, null rates, ranges and changes between loads.

Every text is generalised to a mask (digit runs to 9, letter runs to a). Masks whose share of the non-null texts
reaches ``DOMINANT`` are the column's patterns; the rest are rare.

For violations the masks are a little finer: letter runs that stand in the writing of a unit are kept. Nothing else in
a value can decide whether it is a number, so a value is well-formed exactly if its mask, read as a value, is. Masks
are mined from each distinct value; the grammar is asked once for each mask, and a text violates when no mask of its
values passes. A dominant mask that passes is a pattern of the column; a dominant one that does not (such as that of
the empty text) is reported like the rare ones.
Loads are compared by null share, mean, and the Jensen-Shannon divergence of their mask distribution from that of
all loads.

Defined results: an empty table gives no row; null loads form a load of their own; a median over an even number of
loads is the mean of the middle two; repeated rows count each time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruamesh.common import cut, lookup
from ruamesh.functions.units import number

DOMINANT = 0.01
#: More than this times the median null share, and more than this share off the median mean, is a finding.
NULLS_TIMES, SHIFT_SHARE = 2.0, 0.25


def mask(value: str) -> Column:
    """Digit runs to 9, letter runs to a, runs of blanks to one blank."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(value, r"\d+", "9"), r"\p{L}+", "a"), r"\s+", " ")


#: Letter runs that the writing of a unit is made of, by kind.
UNIT_RUNS = {
    "speed": "km h hr kmh kph quilometros quilômetros por hora kilometers kilometres per hour m s mps metros segundo meters metres second mph mi milhas miles kn kt kts knot knots no nos nó nós",
    "length": "km quilometro quilômetro quilometros quilômetros kilometer kilometre kilometers kilometres kilómetro kilómetros cm centimetro centímetro centimetros centímetros centimeter centimetre centimeters centimetres ft feet foot pe pé pes pés yd yds yard yards jarda jardas mi mile miles milha milhas m mt mts metro metros meter meters metre metres",
}


def value_mask(value: str, kind: str | None = None) -> Column:
    """Digit runs to 9 and letter runs to a, but for those of the units of ``kind``; in lower case, blanks as they are."""
    lower = F.regexp_replace(F.lower(value), r"\d+", "9")
    if kind is None:
        return F.regexp_replace(lower, r"\p{L}+", "a")
    return F.regexp_replace(lower, rf"(?<!\p{{L}})(?!(?:{'|'.join(UNIT_RUNS[kind].split())})(?!\p{{L}}))\p{{L}}+", "a")


def mask_counts(df: DataFrame, column: str, load: str = "load_id") -> DataFrame:
    """(load, mask, n, rare): how often each mask occurs in each load; nulls left out."""
    texts = df.select(F.col(load).alias("load"), F.col(column).cast("string").alias("v")).filter("v IS NOT NULL").groupBy("load", "v").count()
    masks = texts.groupBy("load", mask("v").alias("mask")).agg(F.sum("count").alias("n"))
    overall = masks.groupBy("mask").agg(F.sum("n").alias("mn")).crossJoin(F.broadcast(masks.agg(F.sum("n").alias("total"))))  # one row
    return masks.join(overall, "mask").select("load", "mask", "n", (F.col("mn") / F.col("total") < DOMINANT).alias("rare"))


def divergence(masks: DataFrame) -> DataFrame:
    """(load, js): Jensen-Shannon divergence in bits of each load's masks from those of all loads."""
    loads = masks.groupBy("load").agg(F.sum("n").alias("ln"))
    allp = masks.groupBy("mask").agg(F.sum("n").alias("an")).crossJoin(F.broadcast(masks.agg(F.sum("n").alias("total"))))  # one row
    grid = masks.join(loads, masks.load.eqNullSafe(loads.load)).drop(loads.load).join(allp.select("mask", (F.col("an") / F.col("total")).alias("q")), "mask")
    p, q = F.col("n") / F.col("ln"), F.col("q")
    m = (p + q) / 2
    # Masks absent from a load add q/2 * log2(q / (q/2)) = q/2 each, hence the rest of q.
    return grid.groupBy("load").agg((F.sum(p / 2 * F.log2(p / m) + q / 2 * F.log2(q / m)) + (1 - F.sum(q)) / 2).alias("js"))


def load_findings(loads: DataFrame) -> DataFrame:
    """(load_id, finding) from (load_id, share, mean): nulls and shift against the medians of all loads."""
    loads = cut(loads)  # one row a load, read three times
    med = loads.agg(F.median("share").alias("ms"), F.median("mean").alias("mm"))
    both = loads.crossJoin(F.broadcast(med))  # one row
    nulls = both.filter(F.col("share") > NULLS_TIMES * F.col("ms")).select("load_id", F.lit("nulls").alias("finding"))
    shift = both.filter(F.abs(F.col("mean") - F.col("mm")) > SHIFT_SHARE * F.abs("mm")).select("load_id", F.lit("shift").alias("finding"))
    return nulls.unionByName(shift)


def value_masks(texts: DataFrame, kinds: dict[str, str | None]) -> DataFrame:
    """(field, mask, n, pattern, passes) of the values of (field, text, n, vals): the grammar's answer for each mask."""
    masked = _masked(texts, kinds).groupBy("field", "mask").agg(F.sum("n").alias("n"))
    total = masked.groupBy("field").agg(F.sum("n").alias("total"))  # one row a field
    passes = F.lit(False)
    for field, kind in kinds.items():
        passes = F.when(F.col("field") == field, number("mask", kind).isNotNull()).otherwise(passes)
    out = masked.join(F.broadcast(total), "field").withColumn("passes", passes)
    return out.select("field", "mask", "n", ((F.col("n") >= DOMINANT * F.col("total")) & F.col("passes")).alias("pattern"), "passes")


def _masked(texts: DataFrame, kinds: dict[str, str | None]) -> DataFrame:
    one = F.lit(None).cast("string")
    for field, kind in kinds.items():
        one = F.when(F.col("field") == field, value_mask("val", kind)).otherwise(one)
    return texts.withColumn("val", F.explode("vals")).withColumn("mask", one)


def violations(texts: DataFrame, kinds: dict[str, str | None]) -> DataFrame:
    """``texts`` (field, text, n, vals), one row each, with bad: no value of the text has a mask that passes.

    ``kinds``: the kind of unit that the numbers of each field may have, or None.
    """
    masks = cut(value_masks(texts, kinds))
    good = lookup(_masked(texts, kinds).select("field", "text", "mask"), masks.filter("passes").select("field", "mask"), ["field", "mask"]).select("field", "text").distinct()
    return texts.join(good.withColumn("good", F.lit(True)), ["field", "text"], "left").withColumn("bad", F.col("good").isNull()).drop("good")


def mark(text: Column, bad: Column, nums: Column, low: float, high: float, whole: bool = False) -> Column:
    """(gone, finding, first) of a row of a text column: null or not, pattern or range, and the first value.

    ``bad``: whether the text is a violation, null for no. ``nums``: the numbers of its values, null where one is none.
    """
    out = F.exists(nums, lambda x: (x < low) | (x > high) | ((x != F.floor(x)) if whole else F.lit(False)))
    finding = F.when(text.isNotNull() & F.coalesce(bad, F.lit(False)), F.lit("pattern")).when(out, F.lit("range"))
    return F.struct(text.isNull().alias("gone"), finding.alias("finding"), F.get(nums, F.lit(0)).alias("first"))


def number_findings(rows: DataFrame) -> DataFrame:
    """(load_id, row_id, finding) from (row_id, load_id, mark), all rows; checkpointed, as they are read twice."""
    share, mean = F.avg(F.col("mark.gone").cast("double")).alias("share"), F.avg(F.when(F.col("mark.finding").isNull() & ~F.col("mark.gone"), F.col("mark.first"))).alias("mean")
    by_load = load_findings(rows.groupBy("load_id").agg(share, mean)).select("load_id", F.lit(0).cast("bigint").alias("row_id"), "finding")
    return rows.filter("mark.finding IS NOT NULL").select("load_id", "row_id", F.col("mark.finding").alias("finding")).unionByName(by_load)


def plain_findings(rows: DataFrame, low: float, high: float) -> DataFrame:
    """(load_id, row_id, finding) of a numeric column: (row_id, load_id, num), all rows."""
    out = (F.col("num") < low) | (F.col("num") > high)
    loads = rows.groupBy("load_id").agg(F.avg(F.col("num").isNull().cast("double")).alias("share"), F.avg(F.when(~out, F.col("num"))).alias("mean"))
    return rows.filter(out).select("load_id", "row_id", F.lit("range").alias("finding")).unionByName(load_findings(loads).select("load_id", F.lit(0).cast("bigint").alias("row_id"), "finding"))


def column_profile(df: DataFrame, column: str, load: str = "load_id") -> DataFrame:
    """(load, n, null_share, n_distinct, low, high, rare_n, js) of a column, load by load.

    low and high are the least and greatest text; js compares the load's masks with those of all loads.
    """
    v = F.col(column).cast("string")
    base = df.select(F.col(load).alias("load"), v.alias("v")).groupBy("load").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("v").isNull().cast("double")).alias("null_share"), F.countDistinct("v").alias("n_distinct"), F.min("v").alias("low"), F.max("v").alias("high"))
    masks = cut(mask_counts(df, column, load))
    rare = masks.groupBy("load").agg(F.sum(F.when(F.col("rare"), F.col("n")).otherwise(0)).alias("rare_n"))
    # A null load must find itself.
    out = base.alias("b").join(rare.alias("r"), F.col("b.load").eqNullSafe(F.col("r.load")), "left").join(divergence(masks).alias("d"), F.col("b.load").eqNullSafe(F.col("d.load")), "left")
    return out.select("b.*", F.coalesce("rare_n", F.lit(0)).alias("rare_n"), "js")
