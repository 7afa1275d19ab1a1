"""Odd versions of the test tables: empty, all nulls, and with extra columns of clashing names."""

import os

from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
NAMES = ("gdf_nodes", "gdf_edges", "grid", "origins", "od_pairs", "bairros", "fontes", "documents", "eval_items", "lang_samples")
CLASHES = ("pos", "val", "field", "n", "text2", "key", "sid", "cell", "home", "seg", "ids", "unit", "num", "count", "dist", "target", "region", "word", "form", "cost")


def write(spark, folder, kind):
    for name in NAMES:
        df = spark.read.parquet(f"{DATA}/{name}.parquet")
        if kind == "empty":
            df = df.limit(0)
        elif kind == "nulls":
            df = df.limit(40)
            gone = df.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema])
            parts = [df.withColumn(c, F.lit(None).cast(df.schema[c].dataType)) for c in df.columns]
            for p in [gone, df, *parts]:
                df = df.unionByName(p)
        elif kind == "clashes":
            df = df.withColumns({c: F.lit("x") for c in CLASHES if c not in df.columns})
        df.coalesce(1).write.mode("overwrite").parquet(os.path.join(folder, f"{name}.parquet"))
    return str(folder)
