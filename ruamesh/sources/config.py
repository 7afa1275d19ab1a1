"""Configuration and lookup files in JSON, and geocoder responses."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

_SCHEMA = "study_area struct<network_type: string, crs: string, place: string, districts: array<string>>, paths map<string, string>, analysis struct<entropy_base: double, buffer: double, max_trip_distance: double>"
_GEOCODER = "place_id bigint, osm_id bigint, name string, boundingbox array<string>, geojson struct<type: string, coordinates: array<array<array<double>>>>"


@dataclass(frozen=True)
class Config:
    """One study: what a pipeline needs to know, all of it read."""

    network_type: str = "drive"
    crs: str = "EPSG:31982"
    place: str = ""
    districts: tuple[str, ...] = ()
    paths: dict[str, str] = field(default_factory=dict)
    entropy_base: float = 2.0
    buffer: float = 500.0
    max_trip_distance: float = 30_000.0

    @property
    def srid(self) -> int:
        return int(self.crs.rpartition(":")[2])

    def district_place(self, k: int = 0) -> str:
        """District and place as one geocoder request."""
        return f"{self.districts[k]}, {self.place}"


def read_config(spark: SparkSession, path: str) -> Config:
    row = spark.read.schema(_SCHEMA).option("multiLine", True).json(path).first()
    area, analysis = row["study_area"], row["analysis"]
    return Config(area["network_type"], area["crs"], area["place"], tuple(area["districts"]), dict(row["paths"]), analysis["entropy_base"], analysis["buffer"], analysis["max_trip_distance"])


def read_labels(spark: SparkSession, path: str) -> dict[str, dict[str, str]]:
    """Language to (road class to label)."""
    row = spark.read.schema("pt map<string, string>, en map<string, string>").option("multiLine", True).json(path).first()
    return {k: dict(row[k]) for k in ("pt", "en")}


def read_geocoder(spark: SparkSession, path: str) -> DataFrame:
    """Geocoder responses: one row a place, rings as longitude and latitude."""
    df = spark.read.schema(_GEOCODER).option("multiLine", True).json(path)
    return df.selectExpr("place_id", "osm_id", "name", "transform(geojson.coordinates, r -> transform(r, p -> named_struct('x', p[0], 'y', p[1]))) AS rings")


def raster_cells(df: DataFrame, x0: float, y0: float, size: float) -> DataFrame:
    """Population rasters given as (row, col, pop): each cell as a closed ring, rows counted downwards from y0."""
    x, y = f"({x0}D + col * {size}D)", f"({y0}D - (row + 1) * {size}D)"
    corner = lambda dx, dy: f"named_struct('x', {x} + {dx * size}D, 'y', {y} + {dy * size}D)"
    return df.selectExpr("row", "col", "pop AS POP", f"array({corner(0, 0)}, {corner(1, 0)}, {corner(1, 1)}, {corner(0, 1)}, {corner(0, 0)}) AS geometry")
