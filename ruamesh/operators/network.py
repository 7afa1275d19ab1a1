"""Street network tables: edge geometries, characterised edges, origins from a grid, and od candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ruamesh.common import cut
from ruamesh.functions import classify as C
from ruamesh.functions import geo as G
from ruamesh.operators.graph import components


def places(nodes: DataFrame) -> DataFrame:
    """(node, x, y): one row for each node, however often it was loaded."""
    return nodes.filter("osmid IS NOT NULL AND x IS NOT NULL AND y IS NOT NULL").groupBy(F.col("osmid").alias("node")).agg(F.min("x").alias("x"), F.min("y").alias("y"))


def filled_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges with their geometry, a straight line from u to v where they have none."""
    at = places(nodes)
    a = at.select(F.col("node").alias("u"), F.struct("x", "y").alias("_rm_a"))
    b = at.select(F.col("node").alias("v"), F.struct("x", "y").alias("_rm_b"))
    line = F.when(F.col("_rm_a").isNotNull() & F.col("_rm_b").isNotNull(), F.array("_rm_a", "_rm_b"))
    return edges.join(a, "u", "left").join(b, "v", "left").withColumn("geometry", F.coalesce("geometry", line)).drop("_rm_a", "_rm_b")


def characterised(edges: DataFrame, nodes: DataFrame, language: str = "en") -> DataFrame:
    """Edges with road_type, modal and length_mm of the geometry (whole millimetres, so that sums are exact)."""
    full = filled_edges(edges, nodes)
    return full.withColumns({"road_type": C.road_type("highway", language), "modal": C.modal("highway"), "length_mm": F.floor(G.line_length("geometry") * 1000 + 0.5)})


def counts(df: DataFrame, column: str) -> DataFrame:
    """How often each value occurs; nulls left out."""
    return df.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def distinct_lists(df: DataFrame, group: str, item: str) -> DataFrame:
    """(group, items): the different items of each group, sorted, as one text; null groups left out."""
    pairs = df.filter(F.col(group).isNotNull() & F.col(item).isNotNull()).select(group, item).distinct()
    return pairs.groupBy(group).agg(F.array_join(F.array_sort(F.collect_list(item)), ";").alias("items"))


def top_longest(df: DataFrame, k: int = 5) -> DataFrame:
    """The k longest edges; ties by row id."""
    return df.filter("length_mm IS NOT NULL").orderBy(F.desc("length_mm"), "row_id").limit(k)


def populated_origins(grid: DataFrame) -> DataFrame:
    """(origin_id, POP, x, y): centroids of the populated cells."""
    c = G.ring_centroid("geometry")
    return grid.filter("POP > 0").select(F.col("fid").alias("origin_id"), "POP", c["x"].alias("x"), c["y"].alias("y"))


def contracted(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Nodes that only carry a street on: exactly two neighbours, counting both directions as one street."""
    both = edges.select(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).filter("a <> b").distinct()
    near = both.select("a", "b").unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return near.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("neighbours"), F.min("b").alias("low"), F.max("b").alias("high")).filter("neighbours = 2")


def chains(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(chain, end_a, end_b, edges, length_mm): streets through nodes of degree 2, contracted to one street each.

    ``edges``: (u, v, length_mm). Both directions are one street, of the least length. chain is the least node inside;
    the ends are the nodes beyond, or null for a ring; a chain that comes back to its beginning has equal ends.
    """
    e = edges.filter("u <> v").groupBy(F.least("u", "v").alias("a"), F.greatest("u", "v").alias("b")).agg(F.min("length_mm").alias("w"))
    e = cut(e)
    inner = contracted(edges, nodes).select("node")
    ends = e.select("w", F.explode(F.array(F.struct(F.col("a").alias("node"), F.col("b").alias("other")), F.struct(F.col("b").alias("node"), F.col("a").alias("other")))).alias("s"), "a", "b").select("w", "a", "b", "s.*")
    inner = cut(inner)
    inside = e.join(inner.toDF("a"), "a", "left_semi").join(inner.toDF("b"), "b", "left_semi")
    labels = cut(components(inner, inside.select(F.col("a").alias("u"), F.col("b").alias("v"))))
    touching = ends.join(labels, "node").join(inner.select(F.col("node").alias("other"), F.lit(True).alias("within")), "other", "left")
    per = touching.groupBy("label", "a", "b").agg(F.first("w").alias("w"), F.max(F.when(F.col("within").isNull(), F.col("other"))).alias("out"))
    got = per.groupBy("label").agg(F.min("out").alias("end_a"), F.max("out").alias("end_b"), F.count(F.lit(1)).alias("edges"), F.sum("w").alias("length_mm"))
    return got.withColumnRenamed("label", "chain")
