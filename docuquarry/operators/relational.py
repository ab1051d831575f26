"""Joins, aggregates, windows, ordering and set operations over document facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Counts of a column with percentages to two places; null is unknown; the total comes from the grouped rows, not from a second scan."""
    counts = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("unknown")).alias("value")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())
    return counts.select("value", "n", F.round(100.0 * F.col("n") / F.greatest(total, F.lit(1)), 2).alias("pct"))


def listed(df: DataFrame, column: str, most: int = 10_000) -> Column:
    """The distinct values of a small dimension, in order, as an array literal; a dimension of more values is refused."""
    values = [r[0] for r in df.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{column} has more than {most} values")
    return F.array(*map(F.lit, values)) if values else F.array().cast(f"array<{dict(df.dtypes)[column]}>")


def latest_per_key(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in this order, which callers make total."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")


def page(df: DataFrame, sort_by: str | None, allowed: dict[str, str], descending: bool, tie: str, offset: int, limit: int) -> DataFrame:
    """An allow-listed sort with nulls last, ties by a key; unknown names fall back to the tie."""
    column = F.col(allowed.get(sort_by or "", tie))
    order = column.desc_nulls_last() if descending else column.asc_nulls_last()
    return df.orderBy(order, F.col(tie)).offset(offset).limit(limit)


def paged(df: DataFrame, number: int, size: int, sort_by: str | None, allowed: dict[str, str], descending: bool, tie: str) -> DataFrame:
    """A page, counted from 1, with the total of all rows beside each of its own."""
    return page(df, sort_by, allowed, descending, tie, (max(1, number) - 1) * size, size).withColumn("total", F.lit(df.count()).cast("long"))


def candidate_keys(df: DataFrame, key: str, order: list[Column], most: int = 200) -> DataFrame:
    """One row (keys, truncated): the keys in order, or none of them, and truncated, where there are more than most."""
    place = F.row_number().over(Window.orderBy(*order, key))
    first = df.orderBy(*order, key).limit(most + 1).select(F.struct(place.alias("_n"), key).alias("_k"))
    listed = first.agg(F.transform(F.array_sort(F.collect_list("_k")), lambda x: x[key]).alias("keys"))
    return listed.select(F.when(F.size("keys") <= most, F.col("keys")).otherwise(F.slice("keys", 1, 0)).alias("keys"), (F.size("keys") > most).alias("truncated"))


def missing_from(expected: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(seen.select(*keys).distinct(), keys, "left_anti")


def key_sets(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Each key with where it stands: baseline, candidate or both."""
    x = a.select(*keys).distinct().withColumn("_a", F.lit(True))
    y = b.select(*keys).distinct().withColumn("_b", F.lit(True))
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "baseline").otherwise("candidate")
    return x.join(y, keys, "full").select(*keys, side.alias("side"))


def neighbours(rows: DataFrame, seeds: DataFrame, group: list[str], order: str, window: int) -> DataFrame:
    """Rows at most window steps before or behind a seed of the same group, seeds left out.

    The seed's positions are exploded to at most 2 * window keys, so the join is an equality join.
    """
    offsets = F.array(*[F.lit(i) for i in range(-window, window + 1) if i])
    wanted = seeds.select(*group, F.explode(F.transform(offsets, lambda i: F.col(order) + i)).alias(order)).distinct()
    return rows.join(wanted, [*group, order], "left_semi").join(seeds.select(*group, order), [*group, order], "left_anti")


def running_budget(df: DataFrame, keys: list[str], order: list[Column], cost: str, budget: int) -> DataFrame:
    """Rows up to the first that doesn't fit the budget of its group."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("used", F.sum(cost).over(w)).where(F.col("used") <= budget)


def carry_forward(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """A missing value repeats the last known one; 0.0 before the first."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(value, F.coalesce(F.last(value, ignorenulls=True).over(w), F.lit(0.0)))


def ancestors(rows: DataFrame, start: DataFrame, depth: int = 12) -> DataFrame:
    """(id, ancestor, depth) along parent links, nearest first, cut at a depth and at the first repeat."""
    # many rows share their far ancestors: those stream past a table of links, where a sort would hold them all in one task
    links = rows.select(F.col("id").alias("_i"), F.col("parent_id").alias("_p")).hint("shuffle_hash")
    at = start.select("id", F.col("id").alias("ancestor"), F.array("id").alias("_path"))
    out = None
    for level in range(1, depth + 1):
        at = at.join(links, F.col("ancestor") == F.col("_i")).where("_p IS NOT NULL").where(~F.array_contains("_path", F.col("_p")))
        at = at.select("id", F.col("_p").alias("ancestor"), F.concat("_path", F.array("_p")).alias("_path"))
        step = at.select("id", "ancestor", F.lit(level).alias("depth"))
        out = step if out is None else out.unionByName(step)
    return out


def keep_best(df: DataFrame, keys: list[str], score: str, tie: str) -> DataFrame:
    return latest_per_key(df, keys, F.desc(score), F.asc(tie))
