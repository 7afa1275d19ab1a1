"""Readers of Shapefiles and GeoPackages without a geometry library: (file, layer, srid, geometry, attrs).

Files are parsed in the tasks, so that a folder of many files spreads over the cluster. A Shapefile, at most 2 GB by its
format, comes as bytes and is one unit of work; a GeoPackage is read in ranges of rows. Geometry is array<array<struct<x, y>>>: the parts of a line,
the rings of all polygons, or the single points. Attributes are texts by name; the caller casts them.
"""

from __future__ import annotations

import os
import sqlite3
import struct
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlparse

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruamesh.common import ship

_ROWS = "file string, layer string, srid int, geometry array<array<struct<x: double, y: double>>>, attrs map<string, string>"
_COLUMNS = ["file", "layer", "srid", "geometry", "attrs"]


def _points(data: bytes, at: int, n: int, order: str = "<", dims: int = 2) -> list[dict]:
    flat = struct.unpack_from(f"{order}{n * dims}d", data, at)
    return [{"x": flat[k], "y": flat[k + 1]} for k in range(0, len(flat), dims)]


def shapes(data: bytes) -> Iterator[list | None]:
    """Geometry of each record of a .shp file; null shapes are None."""
    at = 100
    while at + 8 <= len(data):
        (words,) = struct.unpack_from(">i", data, at + 4)
        body, at = at + 8, at + 8 + 2 * words
        (kind,) = struct.unpack_from("<i", data, body)
        base = kind % 10
        if kind == 0:
            yield None
        elif base == 1:
            yield [_points(data, body + 4, 1)]
        elif base == 8:
            (n,) = struct.unpack_from("<i", data, body + 36)
            yield [[p] for p in _points(data, body + 40, n)]
        elif base in (3, 5):
            parts, n = struct.unpack_from("<2i", data, body + 36)
            starts = [*struct.unpack_from(f"<{parts}i", data, body + 44), n]
            points = _points(data, body + 44 + 4 * parts, n)
            yield [points[a:b] for a, b in zip(starts, starts[1:])]
        else:
            raise ValueError(f"shape type {kind} is not read")


def records(data: bytes, encoding: str) -> Iterator[dict[str, str | None]]:
    """Attributes of each record of a .dbf file; blank values are None."""
    n, header, width = struct.unpack_from("<IHH", data, 4)
    fields, at = [], 32
    while at < header - 1 and data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode(encoding), data[at + 16]))
        at += 32
    for k in range(n):
        at, row = header + k * width + 1, {}
        for name, size in fields:
            row[name] = data[at : at + size].decode(encoding, "replace").strip(" \0") or None
            at += size
        yield row


def wkb(data: bytes, at: int = 0) -> tuple[list, int]:
    """Parts of a well-known binary geometry, and where it ends."""
    order = "<" if data[at] else ">"
    (code,) = struct.unpack_from(order + "I", data, at + 1)
    dims = 2 + (code // 1000 in (1, 2)) + 2 * (code // 1000 == 3) + bool(code & 0x80000000) + bool(code & 0x40000000)
    kind, at = (code & 0x0FFFFFFF) % 1000, at + 5
    if kind == 1:
        return [_points(data, at, 1, order, dims)], at + 8 * dims
    (n,) = struct.unpack_from(order + "I", data, at)
    at += 4
    if kind == 2:
        return [_points(data, at, n, order, dims)], at + 8 * dims * n
    out = []
    for _ in range(n):
        if kind == 3:
            (m,) = struct.unpack_from(order + "I", data, at)
            out.append(_points(data, at + 4, m, order, dims))
            at += 4 + 8 * dims * m
        else:
            part, at = wkb(data, at)
            out += part
    return out, at


def gpkg_geometry(blob: bytes | None) -> list | None:
    """Geometry of a GeoPackage blob: a header with an envelope, then well-known binary."""
    if not blob or blob[:2] != b"GP" or blob[3] & 0x10:
        return None
    return wkb(blob, 8 + (0, 32, 48, 48, 64)[blob[3] >> 1 & 7])[0]


def read_shapefile(spark: SparkSession, path: str, srid: int = 0, encoding: str = "utf-8") -> DataFrame:
    """Shapefiles at a path or glob ending in .shp, with the .dbf beside each."""
    ship(spark)
    stem = F.regexp_replace("path", r"\.[^.]*$", "")
    shp = spark.read.format("binaryFile").load(path).select(stem.alias("stem"), F.col("content").alias("shp"))
    dbf = spark.read.format("binaryFile").load(path[:-4] + ".dbf").select(stem.alias("stem"), F.col("content").alias("dbf"))

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, a, b in zip(pdf["stem"], pdf["shp"], pdf["dbf"]):
                rows = [(name, os.path.basename(name), srid, g, r) for g, r in zip(shapes(a), records(b, encoding))]
                yield pd.DataFrame(rows, columns=_COLUMNS)

    return shp.join(dbf, "stem").mapInPandas(parse, _ROWS)


#: Rows of a GeoPackage layer that are read as one piece of work.
GPKG_ROWS = 100_000
_RANGES = "path string, layer string, geom string, srid int, lo bigint, hi bigint"


def _open(path: str, content: bytes | None) -> sqlite3.Connection:
    if content is None:
        return sqlite3.connect(f"file:{quote(unquote(urlparse(path).path))}?mode=ro", uri=True)
    db = sqlite3.connect(":memory:")
    db.deserialize(content)
    return db


def read_geopackage(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    """Layers of the GeoPackages at a path or glob, all or the one named.

    Files of a mounted file system are opened in place, whatever their size, and read in ranges of ``GPKG_ROWS`` row
    ids by many tasks. Files of an object store come as bytes, and Spark takes at most 2 GB of them in one value.
    """
    ship(spark)
    files = spark.read.format("binaryFile").load(path)
    mounted = files.select("path").filter("path NOT LIKE 'file:%'").isEmpty()

    def ranges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for name, content in zip(pdf["path"], pdf["content"] if "content" in pdf else [None] * len(pdf)):
                db = _open(name, content)
                for table, column, srid in db.execute("SELECT table_name, column_name, srs_id FROM gpkg_geometry_columns").fetchall():
                    if layer is None or table == layer:
                        low, high = db.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(table)}").fetchone()
                        out += [(name, table, column, srid, k, k + GPKG_ROWS) for k in range(low, high + 1, GPKG_ROWS)] if low is not None else []
                db.close()
            yield pd.DataFrame(out, columns=["path", "layer", "geom", "srid", "lo", "hi"])

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, table, column, srid, lo, hi, content in zip(*(pdf[c] for c in ("path", "layer", "geom", "srid", "lo", "hi")), pdf["content"] if "content" in pdf else [None] * len(pdf)):
                db = _open(name, content)
                got = db.execute(f"SELECT * FROM {_quoted(table)} WHERE rowid >= ? AND rowid < ?", (int(lo), int(hi)))
                names = [d[0] for d in got.description]
                while some := got.fetchmany(10_000):
                    rows = [(name, table, srid, gpkg_geometry(r[names.index(column)]), {k: None if v is None else str(v) for k, v in zip(names, r) if k != column}) for r in some]
                    yield pd.DataFrame(rows, columns=_COLUMNS)
                db.close()

    work = files.select("path") if mounted else files.select("path", "content")
    pieces = work.mapInPandas(ranges, _RANGES)
    pieces = pieces.repartition(spark.sparkContext.defaultParallelism, "path", "layer", "lo") if mounted else pieces.join(files.select("path", "content"), "path")
    return pieces.mapInPandas(parse, _ROWS)


def _quoted(table: str) -> str:
    return '"' + table.replace('"', '""') + '"'
