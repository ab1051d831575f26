"""Calibration over tables: a logistic and a monotone recalibration fitted by Spark, and the report that compares them.

Samples are first counted by confidence, so both fits work on one row for each value. The monotone fit
pools violators inside ranges of confidence, which leaves few blocks, and pools those once more; a
calibrated value is looked up by an as-of join on the blocks' thresholds.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Steps and rate of the logistic fit, the gain in error that justifies a calibrator, and samples that any and the monotone one need.
STEPS, RATE, LEAST_GAIN, LEAST_SAMPLES, LEAST_MONOTONE = 800, 0.5, 0.02, 100, 1_000
#: Different values up to which the logistic fit's steps run on the driver; beyond, each step is a job of its own.
MOST_POINTS = 100_000
#: Ranges that confidences are cut into.
RANGES = 64


def counted(samples: DataFrame, confidence: Column, correct: Column) -> DataFrame:
    """(x, n, hits): judgeable samples (both known) by confidence, cut to 0..1."""
    rows = samples.select(confidence.cast("double").alias("x"), correct.cast("int").alias("y")).where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x)")
    return rows.groupBy(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "x")).alias("x")).agg(F.count("*").alias("n"), F.sum("y").alias("hits"))


def fit_platt(points: DataFrame, steps: int = STEPS, rate: float = RATE) -> tuple[float, float]:
    """Slope and offset of a logistic fit by gradient steps from (1, 0); without samples they stay."""
    a, b = 1.0, 0.0
    size, total = points.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    if not total:
        return a, b
    if size <= MOST_POINTS:
        got = points.orderBy("x").collect()
        x, n, hits = (np.array([r[c] for r in got], np.float64) for c in ("x", "n", "hits"))
        for _ in range(steps):
            g = n / (1 + np.exp(-(a * x + b))) - hits
            a, b = a - rate * float((g * x).sum()) / total, b - rate * float(g.sum()) / total
        return a, b
    held = points.persist()
    for _ in range(steps):
        g = F.col("n") / (1 + F.exp(-(F.lit(a) * F.col("x") + F.lit(b)))) - F.col("hits")
        by_x, plain = held.agg(F.sum(g * F.col("x")), F.sum(g)).first()
        a, b = a - rate * by_x / total, b - rate * plain / total
    held.unpersist()
    return a, b


def platt(confidence: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(F.lit(a) * confidence + F.lit(b))))


def _bounds(points: DataFrame) -> list[float]:
    """At most RANGES - 1 cuts between ranges of about as many different values."""
    got = points.agg(F.percentile_approx("x", [i / RANGES for i in range(1, RANGES)], 10_000)).first()[0]
    return sorted(set(got or []))


def _range_of(x: Column, bounds: list[float]) -> Column:
    return F.size(F.filter(F.array(*map(F.lit, bounds)), lambda b: b <= x)) if bounds else F.lit(0)


def _pool(frame: pd.DataFrame) -> pd.DataFrame:
    """Neighbours (x, n, hits) in order of x are pooled while the left mean isn't below the right one; whole numbers, so means compare exactly."""
    blocks: list[list] = []
    for x, n, hits in frame.sort_values("x")[["x", "n", "hits"]].itertuples(index=False):
        blocks.append([x, int(n), int(hits)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, more, found = blocks.pop()
            blocks[-1][1] += more
            blocks[-1][2] += found
    return pd.DataFrame(blocks, columns=["x", "n", "hits"])


def fit_isotonic(points: DataFrame) -> DataFrame:
    """(threshold, value, n): the steps of the non-decreasing fit, in samples by confidence from counted().

    Pooling is confluent, so what is pooled inside a range stays pooled: ranges run side by side, and only
    their blocks, whose means rise strictly inside each range, meet in one task. Equal confidences are one
    point whatever their order, and neighbouring steps of equal value are one step.
    """
    schema = "x double, n long, hits long"
    local = points.select(_range_of(F.col("x"), _bounds(points)).alias("_r"), "x", "n", "hits").groupBy("_r").applyInPandas(_pool, schema)
    whole = local.groupBy(F.lit(0).alias("_r")).applyInPandas(_pool, schema)
    return whole.select(F.col("x").alias("threshold"), (F.col("hits") / F.col("n")).alias("value"), "n")


def calibrated(rows: DataFrame, confidence: str, steps: DataFrame, name: str = "calibrated") -> DataFrame:
    """rows with the value of the last step at or below the confidence, that of the first step below all; without steps the confidence itself.

    An as-of join: steps and rows meet in ranges of confidence, and each range is told the last value of those
    before it, so no range has to see another's rows.
    """
    bounds = _bounds(steps.withColumnRenamed("threshold", "x"))
    at = steps.select(F.col("threshold").alias("_x"), F.col("value").alias("_v"), _range_of(F.col("threshold"), bounds).alias("_r"))
    last = at.groupBy("_r").agg(F.max_by("_v", "_x").alias("_last"), F.min_by("_v", "_x").alias("_first"))
    ahead = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    ranges = rows.sparkSession.range(len(bounds) + 1).select(F.col("id").cast("int").alias("_r")).join(last, "_r", "left")
    whole = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("_r", F.coalesce(F.last("_last", ignorenulls=True).over(ahead), F.first("_first", ignorenulls=True).over(whole)).alias("_carry"))
    asked = rows.withColumn("_x", F.col(confidence)).withColumn("_v", F.lit(None).cast("double")).withColumn("_r", F.coalesce(_range_of(F.col("_x"), bounds), F.lit(0))).withColumn("_step", F.lit(0))
    both = asked.unionByName(at.withColumn("_step", F.lit(1)), allowMissingColumns=True)
    upto = Window.partitionBy("_r").orderBy(F.col("_x").asc_nulls_first(), F.desc("_step")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_seen", F.last("_v", ignorenulls=True).over(upto)).where("_step = 0").join(F.broadcast(ranges), "_r", "left")
    value = F.when(F.col("_x").isNotNull(), F.coalesce("_seen", "_carry", "_x"))
    return found.withColumn(name, value).select(*rows.columns, name)


def measured(points: DataFrame, value: str, bins: int = 10) -> DataFrame:
    """One row (samples, ece, mce, brier, base_rate, mean_bias) of counted points under a value between 0 and 1."""
    rows = points.select(F.least(F.floor(F.col(value) * bins), F.lit(bins - 1)).alias("bin"), F.col(value).alias("v"), "n", "hits")
    spread = F.col("n") * F.col("v") * F.col("v") - 2 * F.col("v") * F.col("hits") + F.col("hits")
    per = rows.groupBy("bin").agg(F.sum("n").alias("n"), F.sum(F.col("v") * F.col("n")).alias("v"), F.sum("hits").alias("hits"), F.sum(spread).alias("sq"))
    gap = (F.col("v") - F.col("hits")) / F.col("n")
    total = F.sum("n")
    return per.agg(total.alias("samples"), (F.sum(F.col("n") * F.abs(gap)) / total).alias("ece"), F.max(F.abs(gap)).alias("mce"), (F.sum("sq") / total).alias("brier"), (F.sum("hits") / total).alias("base_rate"), (F.sum(F.col("n") * gap) / total).alias("mean_bias"))


def report(samples: DataFrame, confidence: Column, correct: Column, bins: int = 10) -> DataFrame:
    """(calibrator, samples, ece, mce, brier, base_rate, mean_bias, a, b, steps, recommended): raw, platt and isotonic, and which to consider.

    Nothing is recommended but raw below LEAST_SAMPLES samples, or without LEAST_GAIN in the error; the
    monotone one needs LEAST_MONOTONE samples. Without samples all measures are null.
    """
    points = counted(samples, confidence, correct).persist()
    a, b = fit_platt(points)
    steps = fit_isotonic(points).persist()
    n_steps = steps.count()
    scored = calibrated(points.withColumn("platt", platt(F.col("x"), a, b)), "x", steps, "isotonic").withColumnRenamed("x", "raw").persist()
    none = F.lit(None)
    rows = [
        measured(scored, name, bins).select(F.lit(name).alias("calibrator"), "*", (F.lit(a) if name == "platt" else none.cast("double")).alias("a"), (F.lit(b) if name == "platt" else none.cast("double")).alias("b"), (F.lit(n_steps) if name == "isotonic" else none.cast("int")).cast("int").alias("steps"))
        for name in ("raw", "platt", "isotonic")
    ]
    every = rows[0].unionByName(rows[1]).unionByName(rows[2])
    place = F.array_position(F.array(*map(F.lit, ("raw", "platt", "isotonic"))), F.col("calibrator"))
    judged = F.when((F.col("calibrator") == "isotonic") & (F.col("samples") < LEAST_MONOTONE), F.lit(1.0)).otherwise(F.col("ece"))
    all_three = Window.partitionBy()  # three rows
    best, raw = F.min(F.struct(judged.alias("ece"), place.alias("place"))).over(all_three), F.max(F.when(F.col("calibrator") == "raw", F.col("ece"))).over(all_three)
    worth = (F.col("samples") >= LEAST_SAMPLES) & (best["ece"] <= raw - LEAST_GAIN)
    return every.withColumn("_p", place).withColumn("recommended", F.coalesce(F.when(worth, best["place"] == F.col("_p")).otherwise(F.col("calibrator") == "raw"), F.lit(False))).drop("_p")
