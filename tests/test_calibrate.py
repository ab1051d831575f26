"""Recalibration over tables against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docuquarry.plans import calibrate as c


def pooled(x, y):
    """Violators pooled by hand; equal confidences are one point."""
    blocks = []
    for v in sorted(set(x)):
        hits = [b for a, b in zip(x, y, strict=True) if a == v]
        blocks.append([v, len(hits), sum(hits)])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][1] >= blocks[-1][2] * blocks[-2][1]:
            _, n, h = blocks.pop()
            blocks[-1][1] += n
            blocks[-1][2] += h
    return [(a, h / n) for a, n, h in blocks]


def sample(spark, n, seed):
    r = np.random.default_rng(seed)
    x = np.round(r.random(n), 3)
    y = (r.random(n) < x**2).astype(int)
    rows = [(float(a), bool(b)) for a, b in zip(x, y, strict=True)]
    return spark.createDataFrame([*rows, (None, True), (0.5, None), (float("nan"), True)], "x double, y boolean"), x.tolist(), y.tolist()


@pytest.mark.parametrize("ranges", [1, 7, 64])
def test_monotone_fit_and_lookup(spark, monkeypatch, ranges):
    monkeypatch.setattr(c, "RANGES", ranges)
    df, x, y = sample(spark, 3_000, ranges)
    steps = c.fit_isotonic(c.counted(df, F.col("x"), F.col("y")))
    want = pooled(x, y)
    assert [(r.threshold, pytest.approx(r.value)) for r in steps.orderBy("threshold").collect()] == want
    asked = spark.createDataFrame([(float(v), "t") for v in np.linspace(-0.1, 1.1, 241)] + [(None, "t")], "conf double, tag string")
    for r in c.calibrated(asked, "conf", steps).collect():
        below = [v for t, v in want if r.conf is not None and t <= r.conf]
        assert r.tag == "t" and r.calibrated == (None if r.conf is None else pytest.approx(below[-1] if below else want[0][1]))


def test_lookup_without_steps(spark):
    asked = spark.createDataFrame([(0.3,)], "conf double")
    none = spark.createDataFrame([], "threshold double, value double, n long")
    assert c.calibrated(asked, "conf", none).first().calibrated == 0.3


def test_logistic_fit_is_the_same_either_way(spark, monkeypatch):
    df, x, y = sample(spark, 400, 3)
    points = c.counted(df, F.col("x"), F.col("y"))
    a, b = 1.0, 0.0
    for _ in range(12):
        g = 1 / (1 + np.exp(-(a * np.array(x) + b))) - np.array(y)
        a, b = a - 0.5 * (g * np.array(x)).mean(), b - 0.5 * g.mean()
    assert c.fit_platt(points, steps=12) == pytest.approx((a, b))
    monkeypatch.setattr(c, "MOST_POINTS", 10)
    assert c.fit_platt(points, steps=12) == pytest.approx((a, b))


def test_recommendations(spark):
    few = spark.createDataFrame([(0.9, False)] * 50, "x double, y boolean")
    skewed = spark.createDataFrame([(0.9, i % 2 == 0) for i in range(600)] + [(0.1, False)] * 600, "x double, y boolean")
    said = lambda df: [r.calibrator for r in c.report(df, F.col("x"), F.col("y")).collect() if r.recommended]
    assert said(few) == ["raw"] and said(skewed) == ["isotonic"]
    assert c.report(few.limit(0), F.col("x"), F.col("y")).select("samples").distinct().collect()[0][0] is None
