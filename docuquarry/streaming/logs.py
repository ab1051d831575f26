"""Append-only logs: batches that are filed once, partitions by day, and retention that drops whole days."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What ends a run, and days that a log is kept.
ENDED, RETENTION_DAYS = ["succeeded", "failed", "skipped"], 180


def append(rows: DataFrame, path: str, batch: int, time: str) -> None:
    """Adds rows to the log at path as batch, by the day of their time; a batch that is filed again replaces itself and adds nothing.

    Rows without a time are filed under 1970-01-01, so none is lost.
    """
    day = F.coalesce(F.to_date(time), F.lit("1970-01-01").cast("date"))
    filed = rows.withColumns({"day": day, "batch": F.lit(int(batch)).cast("long")})
    filed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def each_batch(path: str, time: str):
    """A foreachBatch function that appends every trigger's rows under the trigger's number."""
    return lambda batch, number: append(batch, path, number, time)


def read(spark: SparkSession, path: str, since: date | None = None, until: date | None = None) -> DataFrame:
    """The log from a day on and up to another; only their partitions are read."""
    rows = spark.read.parquet(path)
    rows = rows if since is None else rows.where(F.col("day") >= F.lit(since))
    return rows if until is None else rows.where(F.col("day") <= F.lit(until))


def drop_before(spark: SparkSession, path: str, day: date) -> list[str]:
    """Deletes the log's days before this one, as folders, and names them; nothing is rewritten. Folders that aren't days stay."""
    context = spark.sparkContext
    root = context._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(context._jsc.hadoopConfiguration())
    gone = []
    for status in files.listStatus(root):
        name = status.getPath().getName()
        if name.startswith("day=") and name[4:] < day.isoformat() and len(name) == len("day=2024-01-01"):
            files.delete(status.getPath(), True)
            gone.append(name[4:])
    return sorted(gone)


def stage_runs(log: DataFrame, keys: list[str], at: str = "at", status: str = "status", error: Column | None = None) -> DataFrame:
    """(keys, started_at, ended_at, status, attempts, duration_ms, error): a run's state from its log of rows (at, status).

    The last start counts, and the last end at or after it; a run that started again is running. An end
    without a start keeps its time but has no duration.
    """
    started = F.max(F.when(F.col(status) == "started", F.col(at)))
    ends = F.max(F.when(F.col(status).isin(ENDED), F.struct(F.col(at).alias("at"), F.col(status).alias("status"), (F.lit(None).cast("string") if error is None else error).alias("error"))))
    rows = log.groupBy(*keys).agg(started.alias("started_at"), ends.alias("_e"), F.count_if(F.col(status) == "started").alias("attempts"))
    over = F.col("_e").isNotNull() & (F.col("started_at").isNull() | (F.col("_e.at") >= F.col("started_at")))
    spent = (F.unix_micros(F.col("_e.at").cast("timestamp")) - F.unix_micros(F.col("started_at").cast("timestamp"))) / 1000
    state = F.when(over, F.col("_e.status")).when(F.col("started_at").isNotNull(), "running").otherwise("pending")
    return rows.select(*keys, "started_at", F.when(over, F.col("_e.at")).alias("ended_at"), state.alias("status"), "attempts", F.when(over, spent.cast("long")).alias("duration_ms"), F.when(over, F.col("_e.error")).alias("error"))
