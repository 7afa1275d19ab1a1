"""Readers and writers: GraphML, layered Parquet, WKT, JSON configuration."""
