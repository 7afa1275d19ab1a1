"""Layered tables: a dataset is a folder, a layer one Parquet directory in it; conversion between formats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def write_layer(df: DataFrame, path: str, layer: str | None = None, partition_by: list[str] | None = None) -> None:
    """Overwrite one layer; without a layer the dataset is the table itself."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(f"{path}/{layer}" if layer else path)


def read_layer(spark: SparkSession, path: str, layer: str | None = None) -> DataFrame:
    return spark.read.parquet(f"{path}/{layer}" if layer else path)


def convert(spark: SparkSession, source: str, source_format: str, target: str, layer: str, **options: str) -> DataFrame:
    """Read a table in any format that Spark reads and write it as a layer; returns the layer as read back."""
    write_layer(spark.read.format(source_format).options(**options).load(source), target, layer)
    return read_layer(spark, target, layer)
