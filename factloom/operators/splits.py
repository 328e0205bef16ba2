"""Leak-free splits by a hash of the group key, and groups of duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bucket(key: Column, seed: int = 42) -> Column:
    """0 to 99, from the first 32 bits of SHA-256 over seed:key."""
    return F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), key).cast("binary"), 256), 1, 8), 16, 10).cast("bigint") % 100


def split(bucket: Column) -> Column:
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test")


def groups(df: DataFrame, key: str) -> DataFrame:
    """key, members, the smallest and the largest id of each group of more than one."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("members"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).filter("members > 1")
