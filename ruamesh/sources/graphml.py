"""GraphML street graphs: nodes and edges as tables, and back to GraphML text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruamesh.functions.geo import with_srid
from ruamesh.sources.wkt import parse_line, to_wkt

_DATA = "array<struct<_VALUE: string, _key: string>>"


def _tagged(spark: SparkSession, path: str, tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)


def _keys(spark: SparkSession, path: str) -> dict[tuple[str, str], str]:
    """(for, name) to key id: the header's few declarations."""
    rows = _tagged(spark, path, "key", "_id string, _for string, `_attr.name` string").collect()
    return {(r["_for"], r["_attr.name"]): r["_id"] for r in rows}


def as_list(text: Column) -> Column:
    """A scalar, or a list written as ``['a', 'b']``, as an array; null for null. Commas inside quotes part nothing."""
    items = F.regexp_extract_all(text, F.lit(r"""'[^']*'|"[^"]*"|[^,\[\]\s'"][^,\[\]]*"""), F.lit(0))
    parts = F.transform(items, lambda p: F.regexp_replace(F.trim(p), r"""^(['"])(.*)\1$""", "$2"))
    return F.when(text.startswith("["), parts).otherwise(F.when(text.isNotNull(), F.array(text)))


def as_text(values: Column) -> Column:
    """The text that ``as_list`` reads: a single value as it is, several as a list in quotes."""
    quoted = F.transform(values, lambda v: F.when(F.contains(v, F.lit("'")), F.concat(F.lit('"'), v, F.lit('"'))).otherwise(F.concat(F.lit("'"), v, F.lit("'"))))
    return F.when(F.size(values) == 1, values[0]).when(F.size(values) != 1, F.concat(F.lit("["), F.array_join(quoted, ", "), F.lit("]")))


def read_graphml(spark: SparkSession, path: str, srid: int = 31982) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a street graph, typed; geometry columns carry the srid."""
    keys = _keys(spark, path)

    def value(kind: str, name: str) -> Column:
        k = keys.get((kind, name))
        return F.element_at("attrs", k) if k else F.lit(None).cast("string")

    attrs = F.map_from_entries(F.transform("data", lambda d: F.struct(d["_key"], d["_VALUE"]))).alias("attrs")
    n = _tagged(spark, path, "node", f"_id string, data {_DATA}").select("_id", attrs)
    nodes = n.select(F.col("_id").cast("bigint").alias("osmid"), value("node", "x").cast("double").alias("x"), value("node", "y").cast("double").alias("y"), value("node", "highway").alias("highway"), value("node", "street_count").cast("int").alias("street_count"))
    e = _tagged(spark, path, "edge", f"_source string, _target string, _id string, data {_DATA}").select("_source", "_target", "_id", attrs)
    lists = {c: as_list(value("edge", c)).alias(c) for c in ("osmid", "highway", "lanes", "maxspeed")}
    edges = e.select(
        F.col("_source").cast("bigint").alias("u"), F.col("_target").cast("bigint").alias("v"), F.col("_id").cast("int").alias("key"), *lists.values(),
        value("edge", "name").alias("name"), (value("edge", "oneway") == "True").alias("oneway"), (value("edge", "reversed") == "True").alias("reversed"),
        value("edge", "length").cast("double").alias("length"), parse_line(value("edge", "geometry")).alias("geometry"), value("edge", "bridge").alias("bridge"),
    )
    nodes = with_srid(nodes.withColumn("geometry", F.struct("x", "y")), "geometry", srid)
    return nodes, with_srid(edges, "geometry", srid)


NODE_FIELDS = ("x", "y", "highway", "street_count")
EDGE_FIELDS = ("osmid", "highway", "lanes", "maxspeed", "name", "oneway", "reversed", "length", "geometry", "bridge")


def to_graphml_lines(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, line): a GraphML document, every value as text: header, nodes, edges and footer are parts 0 to 3."""
    esc = lambda c: F.replace(F.replace(F.replace(c.cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))

    def text(df: DataFrame, name: str) -> Column:
        kind = dict(df.dtypes)[name]
        if name == "geometry":
            return to_wkt(name)
        if kind.startswith("array"):
            return as_text(F.col(name))
        return F.when(F.col(name), "True").when(~F.col(name), "False") if kind == "boolean" else F.col(name)

    def data(df: DataFrame, kind: str, names: tuple[str, ...]) -> Column:
        return F.concat_ws("", *[F.concat(F.lit(f'<data key="{kind}_{n}">'), esc(text(df, n)), F.lit("</data>")) for n in names if n in df.columns])

    n = nodes.select(F.lit(1).alias("part"), F.concat(F.lit('<node id="'), F.col("osmid").cast("string"), F.lit('">'), data(nodes, "node", NODE_FIELDS), F.lit("</node>")).alias("line"))
    e = edges.select(F.lit(2).alias("part"), F.concat(F.lit('<edge source="'), F.col("u").cast("string"), F.lit('" target="'), F.col("v").cast("string"), F.lit('" id="'), F.col("key").cast("string"), F.lit('">'), data(edges, "edge", EDGE_FIELDS), F.lit("</edge>")).alias("line"))
    keys = "".join(f'<key id="{kind}_{f}" for="{kind}" attr.name="{f}" attr.type="string"/>' for kind, df, names in (("node", nodes, NODE_FIELDS), ("edge", edges, EDGE_FIELDS)) for f in names if f in df.columns)
    ends = [(0, f'<?xml version="1.0" encoding="utf-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns">{keys}<graph edgedefault="directed">'), (3, "</graph></graphml>")]
    return nodes.sparkSession.createDataFrame(ends, "part int, line string").unionByName(n).unionByName(e)


def write_graphml(nodes: DataFrame, edges: DataFrame, path: str) -> None:
    """One GraphML file below ``path``; lines are written in order by a single task, as the format is one document."""
    to_graphml_lines(nodes, edges).repartition(1).sortWithinPartitions("part").select("line").write.mode("overwrite").text(path)
