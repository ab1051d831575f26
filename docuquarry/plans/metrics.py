"""Ranking quality, calibration and regression gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ranking_metrics(hits: DataFrame, case: str, rank: str, grade: str, relevant: str, k: int) -> DataFrame:
    """Per case: recall, precision, reciprocal rank and nDCG at k; gain 2^grade - 1 over log2(rank + 1).

    relevant: how many units the case expects (null or 0: unscoreable, all metrics null). The ideal
    puts the best grades first.
    """
    top = F.col(rank) <= k
    gain = (F.pow(F.lit(2.0), F.col(grade)) - 1) / F.log2(F.col(rank) + 1.0)
    agg = hits.groupBy(case).agg(
        F.max(relevant).alias("_want"),
        F.sum(F.when(top & (F.col(grade) > 0), 1).otherwise(0)).alias("_found"),
        F.sum(F.when(top, 1).otherwise(0)).alias("_shown"),
        F.min(F.when(F.col(grade) > 0, F.col(rank))).alias("_first"),
        F.sum(F.when(top, gain).otherwise(0.0)).alias("_dcg"),
        F.sort_array(F.collect_list(grade), asc=False).alias("_grades"),
    )
    ideal = F.aggregate(F.transform(F.slice("_grades", 1, k), lambda g, i: (F.pow(F.lit(2.0), g) - 1) / F.log2(i + 2.0)), F.lit(0.0), lambda s, x: s + x)
    ok = F.col("_want") > 0
    return agg.select(
        case,
        F.when(ok, F.round(F.col("_found") / F.col("_want"), 6)).alias("recall"),
        F.when(ok, F.when(F.col("_shown") > 0, F.round(F.col("_found") / F.col("_shown"), 6)).otherwise(0.0)).alias("precision"),
        F.when(ok, F.round(F.coalesce(1.0 / F.col("_first"), F.lit(0.0)), 6)).alias("mrr"),
        F.when(ok, F.when(ideal > 0, F.round(F.col("_dcg") / ideal, 6)).otherwise(0.0)).alias("ndcg"),
    )


def calibration(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """Equal-width bins: index min(int(c * n), n - 1), count, mean confidence and accuracy, gap."""
    b = F.least(F.floor(confidence * bins), F.lit(bins - 1)).cast("int")
    rows = df.select(b.alias("bin"), confidence.alias("_c"), correct.cast("double").alias("_y"))
    agg = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("_c").alias("_m"), F.avg("_y").alias("_a"))
    return agg.select("bin", "n", F.round("_m", 6).alias("confidence"), F.round("_a", 6).alias("accuracy"), F.round(F.abs(F.col("_m") - F.col("_a")), 6).alias("gap"))


def calibration_errors(df: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """ECE, MCE and Brier score in one row."""
    b = F.least(F.floor(confidence * bins), F.lit(bins - 1))
    rows = df.select(b.alias("bin"), confidence.alias("_c"), correct.cast("double").alias("_y"))
    per = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg("_c").alias("m"), F.avg("_y").alias("a"), F.sum(F.pow(F.col("_c") - F.col("_y"), 2)).alias("sq"))
    gap = F.abs(F.col("m") - F.col("a"))
    return per.agg(F.round(F.sum(F.col("n") * gap) / F.sum("n"), 6).alias("ece"), F.round(F.max(gap), 6).alias("mce"), F.round(F.sum("sq") / F.sum("n"), 6).alias("brier"))


def gate(metrics: DataFrame, baseline: str, candidate: str, absolute: float | Column, relative: float | Column, higher_is_better: str = "higher", limit: str | None = None) -> DataFrame:
    """Rows (metric, baseline, candidate) with a verdict.

    missing: no candidate value; regressed: beyond the limit column, whatever the baseline; new: no
    baseline; unchanged: moved by no more than the larger of both tolerances; else improved or regressed.
    """
    before, after, higher = F.col(baseline), F.col(candidate), F.col(higher_is_better)
    moved = after - before
    allowed = F.greatest(F.lit(absolute) if isinstance(absolute, float) else absolute, F.abs(before) * relative)
    beyond = F.coalesce(F.when(higher, after < F.col(limit)).otherwise(after > F.col(limit)), F.lit(False)) if limit else F.lit(False)
    verdict = (
        F.when(after.isNull(), "missing").when(beyond, "regressed").when(before.isNull(), "new").when(F.abs(moved) <= allowed, "unchanged")
        .when(F.when(higher, moved > 0).otherwise(moved < 0), "improved").otherwise("regressed")
    )
    return metrics.withColumn("verdict", verdict)
