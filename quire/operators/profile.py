"""Profiles of tables and files: sizes by bucket, the largest, the commonest values. Lengths and counts only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Upper bounds of size buckets, in bytes; the last bucket is open.
BUCKETS = (1 << 10, 10 << 10, 100 << 10, 1 << 20)


def size_buckets(rows: DataFrame, size: Column) -> DataFrame:
    """bucket (its place), n, bytes: all five buckets, empty ones too."""
    place = F.lit(len(BUCKETS))
    for i in reversed(range(len(BUCKETS))):
        place = F.when(size < BUCKETS[i], i).otherwise(place)
    got = rows.select(place.alias("bucket"), size.alias("s")).groupBy("bucket").agg(F.count("*").alias("n"), F.sum("s").alias("bytes"))
    every = rows.sparkSession.range(len(BUCKETS) + 1).select(F.col("id").cast("int").alias("bucket"))
    return every.join(got, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("bytes", F.lit(0)).alias("bytes"))


def largest(rows: DataFrame, key: str, size: Column, n: int = 10) -> DataFrame:
    return rows.select(key, size.cast("long").alias("bytes")).orderBy(F.desc("bytes"), key).limit(n)


def common_values(rows: DataFrame, column: str, n: int = 6) -> DataFrame:
    return rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "value").limit(n)


def row_checksums(rows: DataFrame, key: str) -> DataFrame:
    """key and a SHA-256 of the row's columns in order; nulls are told from empty strings."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("-")) for c in rows.columns]
    return rows.select(key, F.sha2(F.concat_ws("\x1f", *parts), 256).alias("checksum"))
