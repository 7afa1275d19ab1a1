"""Geometry as plain Spark values: points are struct<x, y>, lines arrays of them, polygons arrays of rings.

All functions build Column expressions and stay in the JVM. Projections follow the series of Krueger for the
transverse Mercator on GRS80.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EARTH_M = 6_371_009.0
#: GRS80.
_A, _F = 6_378_137.0, 1 / 298.257222101


@dataclass(frozen=True)
class TransverseMercator:
    """Parameters of a transverse Mercator grid."""

    srid: int
    lon0: float
    k0: float
    easting: float
    northing: float


UTM_22S = TransverseMercator(31982, -51.0, 0.9996, 500_000.0, 10_000_000.0)
TM_POA = TransverseMercator(100_001, -51.0, 0.999995, 300_000.0, 5_000_000.0)

_N = _F / (2 - _F)
_RECT = _A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (_N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16, 13 * _N**2 / 48 - 3 * _N**3 / 5, 61 * _N**3 / 240)
_BETA = (_N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96, _N**2 / 48 + _N**3 / 15, 17 * _N**3 / 480)
_DELTA = (2 * _N - 2 * _N**2 / 3 - 2 * _N**3, 7 * _N**2 / 3 - 8 * _N**3 / 5, 56 * _N**3 / 15)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def project(lon: Column | str, lat: Column | str, grid: TransverseMercator = UTM_22S) -> tuple[Column, Column]:
    """(x, y) in metres of longitude and latitude in degrees."""
    lam, phi = F.radians(_col(lon) - grid.lon0), F.radians(_col(lat))
    t = F.sinh(F.atanh(F.sin(phi)) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return grid.easting + grid.k0 * _RECT * x, grid.northing + grid.k0 * _RECT * y


def unproject(x: Column | str, y: Column | str, grid: TransverseMercator = UTM_22S) -> tuple[Column, Column]:
    """(longitude, latitude) in degrees of grid metres."""
    xi, eta = (_col(y) - grid.northing) / (grid.k0 * _RECT), (_col(x) - grid.easting) / (grid.k0 * _RECT)
    a, b = xi, eta
    for j, beta in enumerate(_BETA, 1):
        a = a - beta * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        b = b - beta * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(a) / F.cosh(b))
    lat = chi
    for j, delta in enumerate(_DELTA, 1):
        lat = lat + delta * F.sin(2 * j * chi)
    return grid.lon0 + F.degrees(F.atan2(F.sinh(b), F.cos(a))), F.degrees(lat)


#: Reference systems by their number; None is longitude and latitude in degrees.
SYSTEMS: dict[int, TransverseMercator | None] = {31982: UTM_22S, 100_001: TM_POA, 4674: None, 4326: None}


def to_crs(df: DataFrame, column: str, source: int, target: int) -> DataFrame:
    """The frame with a geometry column (a point, an array of points or of arrays of points) in another system.

    A noted system of the column must be ``source``; the new one is noted.
    """
    noted = df.schema[column].metadata.get("srid", source)
    if noted != source:
        raise ValueError(f"reference systems differ: {noted} and {source}")
    a, b = SYSTEMS[source], SYSTEMS[target]

    def point(p: Column) -> Column:
        lon, lat = unproject(p["x"], p["y"], a) if a else (p["x"], p["y"])
        x, y = project(lon, lat, b) if b else (lon, lat)
        return F.when(p.isNotNull(), F.struct(x.alias("x"), y.alias("y")))

    def moved(c: Column, kind: T.DataType) -> Column:
        return F.transform(c, lambda x: moved(x, kind.elementType)) if isinstance(kind, T.ArrayType) else point(c)

    return df if a == b else with_srid(df.withColumn(column, moved(F.col(column), df.schema[column].dataType)), column, target)


def great_circle(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Great-circle metres between two points in degrees."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2 * EARTH_M * F.asin(F.sqrt(h))


def line_length(points: str) -> Column:
    """Length of a polyline; 0 for a single point, null for null."""
    seg = f"transform(sequence(1, size({points}) - 1), i -> sqrt(({points}[i].x - {points}[i - 1].x) * ({points}[i].x - {points}[i - 1].x) + ({points}[i].y - {points}[i - 1].y) * ({points}[i].y - {points}[i - 1].y)))"
    return F.expr(f"CASE WHEN {points} IS NULL THEN NULL WHEN size({points}) < 2 THEN 0D ELSE aggregate({seg}, 0D, (a, s) -> a + s) END")


def _ring_sum(ring: str, term: str) -> str:
    """Sum of a term over a ring's edges (p to q), closing it if it is open."""
    pair = f"transform(sequence(0, size({ring}) - 1), i -> named_struct('p', {ring}[i], 'q', {ring}[(i + 1) % size({ring})]))"
    return f"aggregate({pair}, 0D, (a, e) -> a + ({term}))"


def ring_area(ring: str) -> Column:
    """Signed area of a ring, relative to its first point so that large coordinates cost no precision."""
    o = f"{ring}[0]"
    return F.expr(f"CASE WHEN size({ring}) > 2 THEN " + _ring_sum(ring, f"(e.p.x - {o}.x) * (e.q.y - {o}.y) - (e.q.x - {o}.x) * (e.p.y - {o}.y)") + " / 2 ELSE 0D END")


def polygon_area(rings: str) -> Column:
    """Area of a polygon: its outline less its holes."""
    one = "abs(" + _ring_sum("r", "(e.p.x - r[0].x) * (e.q.y - r[0].y) - (e.q.x - r[0].x) * (e.p.y - r[0].y)") + ") / 2"
    return F.expr(f"aggregate(transform({rings}, (r, k) -> CASE WHEN size(r) < 3 THEN 0D WHEN k = 0 THEN {one} ELSE -({one}) END), 0D, (a, s) -> a + s)")


def ring_centroid(ring: str) -> Column:
    """Area-weighted centroid of a ring as struct<x, y>; null for a ring without area."""
    o = f"{ring}[0]"
    cross = f"((e.p.x - {o}.x) * (e.q.y - {o}.y) - (e.q.x - {o}.x) * (e.p.y - {o}.y))"
    area = _ring_sum(ring, cross)
    cx = _ring_sum(ring, f"(e.p.x + e.q.x - 2 * {o}.x) * {cross}")
    cy = _ring_sum(ring, f"(e.p.y + e.q.y - 2 * {o}.y) * {cross}")
    return F.expr(f"CASE WHEN size({ring}) > 2 AND {area} <> 0 THEN named_struct('x', {o}.x + {cx} / (3 * {area}), 'y', {o}.y + {cy} / (3 * {area})) END")


def within(x: str, y: str, rings: str) -> Column:
    """Whether a point lies strictly inside a polygon (even-odd over all rings; boundary points are not inside)."""
    edges = f"flatten(transform({rings}, r -> transform(sequence(0, size(r) - 1), i -> named_struct('p', r[i], 'q', r[(i + 1) % size(r)]))))"
    cross = f"(e.q.x - e.p.x) * ({y} - e.p.y) - (e.q.y - e.p.y) * ({x} - e.p.x)"
    crosses = f"(e.p.y > {y}) <> (e.q.y > {y}) AND {x} < (e.q.x - e.p.x) * ({y} - e.p.y) / (e.q.y - e.p.y) + e.p.x"
    on = f"{cross} = 0 AND {x} BETWEEN least(e.p.x, e.q.x) AND greatest(e.p.x, e.q.x) AND {y} BETWEEN least(e.p.y, e.q.y) AND greatest(e.p.y, e.q.y)"
    return F.expr(f"size(filter({edges}, e -> {crosses})) % 2 = 1 AND NOT exists({edges}, e -> {on})")


def total_bounds(df: DataFrame, points: str) -> DataFrame:
    """One row minx, miny, maxx, maxy over all points of an array column."""
    p = df.select(F.explode(points).alias("p"))
    return p.agg(F.min("p.x").alias("minx"), F.min("p.y").alias("miny"), F.max("p.x").alias("maxx"), F.max("p.y").alias("maxy"))


def with_srid(df: DataFrame, column: str, srid: int) -> DataFrame:
    """The frame with the reference system noted in the column's metadata."""
    return df.withColumn(column, F.col(column).alias(column, metadata={"srid": srid}))


def same_srid(a: DataFrame, ca: str, b: DataFrame, cb: str) -> None:
    """Raise where two columns name different reference systems."""
    left, right = a.schema[ca].metadata.get("srid"), b.schema[cb].metadata.get("srid")
    if left != right:
        raise ValueError(f"reference systems differ: {left} and {right}")
