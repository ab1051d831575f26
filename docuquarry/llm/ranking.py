"""Exact ranks of seeded-shuffled rows without a window over a whole (possibly hot) group."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def buckets_for(rows: int) -> int:
    """Ordered buckets for rows: as many buckets as a bucket of the largest group has rows."""
    return max(1, math.isqrt(max(rows, 1)))


def with_rank(df: DataFrame, group: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """df with its 0-based rank in each group by (bucket, order).

    bucket is an integer that rises with the order. Counts of (group, bucket) are summed before the
    shuffle and give each bucket its offset; only rows of one bucket are sorted together.
    """
    sizes = df.groupBy(*group, bucket).agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*group, bucket).orderBy(*order))
    return df.join(offsets, [*group, bucket]).withColumn(name, F.col("_before") + inside - 1).drop("_before")
