"""Streaming forms of the stage queue, and windows over events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _timed(stream: DataFrame, time: str, late: str) -> DataFrame:
    """Event time as a timestamp (sources may have it without a zone), with its watermark."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def dispatch_once(stream: DataFrame, key: str, time: str, late: str = "1 hour") -> DataFrame:
    """At-least-once input, each key once within the watermark, so state stays bounded."""
    return _timed(stream, time, late).dropDuplicatesWithinWatermark([key])


def windowed_counts(stream: DataFrame, time: str, by: list[str], width: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    w = F.window(time, width, slide) if slide else F.window(time, width)
    return _timed(stream, time, late).groupBy(w.alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), *by, "n")


def session_counts(stream: DataFrame, time: str, by: list[str], gap: str, late: str = "1 hour") -> DataFrame:
    return _timed(stream, time, late).groupBy(F.session_window(time, gap).alias("w"), *by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *by, "n")


def retry(failed: DataFrame, now: Column, base_ms: int = 1000) -> DataFrame:
    """Failed messages (attempt, max_attempts): delayed by base * 2^(attempt - 1) and tried again, or dead once attempts are spent."""
    spent = F.col("attempt") >= F.col("max_attempts")
    delay = F.make_interval(secs=(F.lit(base_ms) * F.pow(F.lit(2.0), F.col("attempt") - 1) / 1000).cast("decimal(18,6)"))
    state, at = F.when(spent, "DEAD").otherwise("PENDING"), F.when(spent, F.col("available_at")).otherwise(now + delay)
    return failed.withColumns({"state": state, "available_at": at, "attempt": F.when(spent, F.col("attempt")).otherwise(F.col("attempt") + 1)})


def expire_leases(claimed: DataFrame, now: Column, minutes: int = 45) -> DataFrame:
    """Messages claimed before the cutoff go back with one more attempt, or die."""
    late = (F.col("state") == "CLAIMED") & (F.col("claimed_at") < now - F.make_interval(mins=F.lit(minutes)))
    left = F.col("attempt") < F.col("max_attempts")
    state = F.when(late, F.when(left, "PENDING").otherwise("DEAD")).otherwise(F.col("state"))
    return claimed.withColumns({"state": state, "attempt": F.when(late & left, F.col("attempt") + 1).otherwise(F.col("attempt"))})
