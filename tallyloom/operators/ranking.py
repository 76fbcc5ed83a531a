"""Exact top-k per group for groups of any size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def top_per_group(df: DataFrame, group: str, order: Column, columns: list[str], k: int) -> DataFrame:
    """First ``k`` rows of each group by a unique descending ``order``.

    Groups are salted: each salt keeps its own first ``k`` rows, and only
    those few rows are ranked per group.
    """
    salt = F.pmod(F.xxhash64(*columns), F.lit(SALTS))
    df = df.withColumn("__o", order).withColumn("__salt", salt)
    first = Window.partitionBy(group, "__salt").orderBy(F.desc("__o"))
    part = df.withColumn("__r", F.row_number().over(first)).filter(F.col("__r") <= k)
    final = Window.partitionBy(group).orderBy(F.desc("__o"))
    return part.withColumn("rank_no", F.row_number().over(final)).filter(F.col("rank_no") <= k).select(
        group, *columns, "rank_no")
