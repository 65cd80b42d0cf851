"""Tables with nothing in them, and with rows that are null throughout and columns that clash."""

import os

from pyspark.sql import functions as F

#: Names that operators use themselves.
CLASHES = ("__block", "__n", "id", "n", "kind", "share", "form", "before", "prefix", "seq", "__wave", "lateness")


def empty_tables(spark, folder, out):
    for name in os.listdir(folder):
        spark.read.parquet(f"{folder}/{name}").limit(0).write.parquet(f"{out}/{name}")
    return out


def odd_tables(spark, folder, out):
    for name in os.listdir(folder):
        rows = spark.read.parquet(f"{folder}/{name}").limit(40)
        nothing = rows.limit(2).select(*[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in rows.columns])
        more = [F.lit("clash").alias(c) for c in CLASHES if c not in rows.columns]
        rows.union(rows.limit(3)).union(nothing).select("*", *more).write.parquet(f"{out}/{name}")
    return out
