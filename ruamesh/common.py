"""Session helpers shared by the operators: table reading, lineage cuts, bounded broadcast and hot keys."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most rows that a lookup side may have to be broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Most bytes of such a side.
BROADCAST_BYTES = 24_000_000
#: A key is hot when it holds more than this share of the rows, so that there are at most 1 / share hot keys.
HOT_SHARE = 0.005


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables of a data directory."""
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that their Python finds it."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    _SHIPPED.add(app)
    root = Path(__file__).resolve().parent
    target = os.path.join(tempfile.mkdtemp(prefix="ruamesh-"), "ruamesh.zip")  # the driver serves it to all
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(target)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, written once to the checkpoint folder that all executors share.

    The folder is the one of ``spark.checkpoint.dir``; only a local session (as in tests) that names none gets a
    temporary one. On a cluster such a folder would be lost with its machine, so there it is an error.
    """
    spark = df.sparkSession
    ship(spark)
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="ruamesh-"))
    return df.checkpoint(eager=True)


def dense_index(df: DataFrame, order: list, name: str) -> DataFrame:
    """The rows with their place in an order, from 0, without a sort in one task.

    The rows are range-sorted and written once; a partition's offset is the number of rows before it, of which the
    driver sees one a partition.
    """
    placed = cut(df.orderBy(*order)).withColumns({"_rm_part": F.spark_partition_id(), "_rm_row": F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))})
    sizes = {r["_rm_part"]: r["count"] for r in placed.groupBy("_rm_part").count().collect()}
    offsets, before = [], 0
    for part in sorted(sizes):
        offsets.append((part, before))
        before += sizes[part]
    table_ = df.sparkSession.createDataFrame(offsets, "_rm_part int, _rm_before bigint")
    return placed.join(F.broadcast(table_), "_rm_part").withColumn(name, F.col("_rm_row") + F.col("_rm_before")).drop("_rm_part", "_rm_row", "_rm_before")


def weight(df: DataFrame) -> tuple[int, int]:
    """Rows of a frame and about how many bytes they take."""
    rows, size = df.agg(F.count(F.lit(1)), F.sum(F.length(F.to_json(F.struct(*df.columns))))).first()
    return rows, size or 0


def lookup(facts: DataFrame, dim: DataFrame, keys: list[str], how: str = "inner", max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Join ``facts`` to ``dim``, which has one row (or few) for each key, safely under skew; inner or left.

    ``dim`` should be cheap to read again (checkpointed). Its rows and bytes are counted: within the bounds it is
    broadcast. Otherwise the facts are written once, and the keys that hold more than ``HOT_SHARE`` of them (at most
    1 / HOT_SHARE keys) go apart: their rows of ``dim`` are broadcast when they are within the bounds too, else both
    sides are salted, so no task gets a hot key's rows. The rest is joined by shuffle; rows with a null key meet nothing.
    """
    rows, size = weight(dim)
    if rows <= max_rows and size <= max_bytes:
        return facts.join(F.broadcast(dim), keys, how)
    null = " OR ".join(f"`{k}` IS NULL" for k in keys)
    facts = cut(facts)
    whole = facts.filter(f"NOT ({null})")
    total = facts.count()
    counts = cut(whole.groupBy(*keys).count().filter(F.col("count") > max(1000, total * HOT_SHARE)))
    hot, most = counts.drop("count"), counts.agg(F.max("count")).first()[0]
    if most is None:
        out = whole.join(dim, keys, how)
    else:
        flagged = whole.join(F.broadcast(hot.withColumn("_rm_hot", F.lit(True))), keys, "left")
        some, few = flagged.filter("_rm_hot").drop("_rm_hot"), cut(dim.join(F.broadcast(hot), keys, "left_semi"))
        rows, size = weight(few)
        if rows <= max_rows and size <= max_bytes:
            some = some.join(F.broadcast(few), keys, how)
        else:
            salts = int(most // max(1000, int(total * HOT_SHARE))) + 1
            salted = few.withColumn("_rm_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
            some = some.withColumn("_rm_salt", F.pmod(F.monotonically_increasing_id(), F.lit(salts)).cast("int")).join(salted, [*keys, "_rm_salt"], how).drop("_rm_salt")
        out = some.unionByName(flagged.filter("_rm_hot IS NULL").drop("_rm_hot").join(dim, keys, how))
    return out.unionByName(facts.filter(null), allowMissingColumns=True) if how == "left" else out
