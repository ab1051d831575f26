"""The detection driver: early stops, the invariant, skipped windows, answers that don't count."""

import pytest
from pyspark.sql import functions as F

from docuquarry.operators import layout
from docuquarry.plans import detection


@pytest.fixture(scope="module")
def pages(spark):
    rows = [("a", p, f"page {p} " + ("cap " if p == 2 else "term " if p in (7, 30) else "")) for p in range(1, 31)] + [("b", 1, "cap"), ("c", 1, None), ("c", 2, "nothing at all")]
    return spark.createDataFrame(rows, "doc string, page long, text string")


def run(spark, pages, wanted, asked, **more):
    headings = spark.createDataFrame([("a", 4, " Scope "), ("a", 9, "scope"), ("b", 1, "Other")], "doc string, page long, heading string")

    def search(windows):
        asked.append(windows.select("doc", "window", "page", F.array_join("pending", ",").alias("pending")).collect())
        found = windows.withColumn("clause", F.explode(F.split("text", " "))).where("clause IN ('cap', 'term', 'page')")
        return found.select("doc", "window", "page", "clause")

    wanted = spark.createDataFrame(wanted, "doc string, clause string")
    return detection.detect(pages, headings, wanted, search, lambda c: F.lower(F.trim(c)), size=3, overlap=1, wave=2, least_chars=4, **more)


def test_waves_stop_when_nothing_is_pending(spark, pages):
    asked = []
    got = run(spark, pages, [("a", "scope"), ("a", "cap"), ("a", "term"), ("b", "other")], asked)
    assert {(r.doc, r.clause, r.source, r.page, r.window) for r in got.claims.collect()} == {("a", "scope", "heading", 4, None), ("a", "cap", "window", 2, 0), ("a", "term", "window", 7, 2), ("b", "other", "heading", 1, None)}
    assert got.waves == 2 and got.missing.isEmpty() and got.broken().isEmpty()
    assert {r.pending for r in asked[0]} == {"cap,term"} and {r.pending for r in asked[1]} == {"term"} and all(r.doc == "a" for wave in asked for r in wave)
    assert sorted(r.page for r in got.read.where("doc = 'a'").collect()) == list(range(1, 10)) and {(r.doc, r.page) for r in got.unread.where("doc <> 'a'").collect()} == {("b", 1)}


def test_what_is_missing_has_every_page_read(spark, pages):
    got = run(spark, pages, [("a", "cap"), ("a", "absent"), ("b", "absent"), ("c", "cap"), ("c", "cap")], [])
    assert {(r.doc, r.clause) for r in got.missing.collect()} == {("a", "absent"), ("b", "absent"), ("c", "cap")}
    assert got.broken().isEmpty() and got.unread.isEmpty() and got.read.count() == 33
    assert {(r.doc, r.window) for r in got.skipped.collect()} == {("b", 0)}


def test_without_early_stop_everything_is_read(spark, pages):
    asked = []
    got = run(spark, pages, [("a", "scope")], asked, early_stop=False)
    assert got.waves == 8 and got.read.count() == 30 and {r.pending for wave in asked for r in wave} == {""}


def test_windows_reach_the_last_page_as_the_layout_has_them(spark):
    for n, size, overlap in [(1, 3, 1), (3, 3, 1), (4, 3, 1), (10, 4, 0), (10, 4, 3), (9, 2, 5)]:
        pages = spark.range(1, n + 1).select(F.lit("d").alias("doc"), F.col("id").alias("page"), F.lit("x").alias("text"))
        got = {(r.window, r.page) for r in detection.page_windows(pages, size, overlap).collect()}
        assert got == {(r.window, r.page) for r in layout.page_windows(pages.select("doc", "page"), "doc", size, min(overlap, size - 1)).collect()}


def test_no_documents(spark, pages):
    got = run(spark, pages.limit(0), [("a", "cap")], [])
    assert got.waves == 0 and got.missing.count() == 1 and got.unread.isEmpty()
