"""Idempotent sinks: replace by key, upsert, insert-ignore and superseded versions, as pure DataFrame results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def replace_keys(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Delete then insert: rows of the keys in fresh give way to fresh."""
    return existing.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh, allowMissingColumns=True)


def upsert(existing: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or update on a key; a null in fresh never clears a value."""
    values = [c for c in existing.columns if c not in keys]
    new = fresh.select(*keys, *[F.col(c).alias(f"_{c}") if c in fresh.columns else F.lit(None).alias(f"_{c}") for c in values])
    return existing.join(new, keys, "full").select(*keys, *[F.coalesce(f"_{c}", c).alias(c) for c in values])


def insert_ignore(existing: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The rows of fresh that would be inserted: new keys, the first of each."""
    return fresh.dropDuplicates([key]).join(existing.select(key), key, "left_anti")


def supersede(artifacts: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """Appends fresh as a new generation; exactly one row of each key is current."""
    last = artifacts.groupBy(*keys).agg(F.max("generation").alias("_last"))
    new = fresh.join(last, keys, "left").withColumn("generation", F.coalesce("_last", F.lit(0)) + 1).drop("_last")
    both = artifacts.drop("is_current").unionByName(new.drop("is_current"), allowMissingColumns=True)
    newest = F.max("generation").over(Window.partitionBy(*keys))
    return both.withColumn("is_current", F.col("generation") == newest)


def write(df: DataFrame, path: str, kind: str = "parquet", partition_by: list[str] | None = None) -> None:
    """Export in a known format; others are refused."""
    known = ("parquet", "json", "csv", "orc")
    if kind not in known:
        raise ValueError(f"unknown format {kind}; supported: {', '.join(known)}")
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).format(kind).option("header", True).save(path)
