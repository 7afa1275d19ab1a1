"""Well-known text at the edges of the engine; inside, geometry is plain Spark values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def parse_line(text: Column) -> Column:
    """``LINESTRING (x y, x y)`` as array<struct<x, y>>; null for null and for anything else."""
    inner = F.regexp_extract(text, r"(?i)^\s*LINESTRING\s*Z?\s*\((.*)\)\s*$", 1)
    points = F.transform(F.split(inner, r"\s*,\s*"), lambda p: F.struct(F.split(F.trim(p), r"\s+")[0].cast("double").alias("x"), F.split(F.trim(p), r"\s+")[1].cast("double").alias("y")))
    return F.when(inner != "", points)


def to_wkt(points: str) -> Column:
    """``LINESTRING (...)`` of an array of points."""
    return F.expr(f"concat('LINESTRING (', array_join(transform({points}, p -> concat(cast(p.x AS string), ' ', cast(p.y AS string))), ', '), ')')")


def polygon_to_wkt(rings: str) -> Column:
    return F.expr(f"concat('POLYGON (', array_join(transform({rings}, r -> concat('(', array_join(transform(r, p -> concat(cast(p.x AS string), ' ', cast(p.y AS string))), ', '), ')')), ', '), ')')")
