"""Context packages on small cases: history's share, what is skipped, and how evidence reads."""

from docuquarry.plans import context as c


def test_history_keeps_the_newest_within_its_share(spark):
    turns = [(1, i, "user", "x" * 36) for i in range(9)] + [(2, 0, "user", "y" * 36_000), (2, 1, "user", "z" * 36_000)] + [(3, 0, "user", None)]
    df = spark.createDataFrame(turns, "query_id int, turn int, role string, content string")
    kept = lambda budget: sorted((r.query_id, r.turn) for r in c.trimmed_history(df, budget).collect())
    assert kept(10_000) == [(1, 3), (1, 4), (1, 5), (1, 6), (1, 7), (1, 8), (2, 1), (3, 0)]
    assert kept(400) == [(1, 6), (1, 7), (1, 8), (2, 1), (3, 0)]


def test_order_of_evidence(spark):
    rows = [(1, 0, "chunk", "vector", "comparison"), (1, 1, "clause", "neighbour", "comparison"), (1, 2, "clause", "fused", "comparison"), (2, 0, "chunk", "vector", "financial"), (2, 1, "clause", "vector", "financial")]
    got = c.prioritised(spark.createDataFrame(rows, "query_id int, position int, level string, source string, intent string")).orderBy("query_id", "pos").collect()
    assert [(r.query_id, r.position) for r in got] == [(1, 2), (1, 0), (1, 1), (2, 0), (2, 1)]


def test_blank_items_take_no_label_and_large_ones_no_budget(spark):
    rows = [(1, 1, "a" * 36), (1, 2, "  \n"), (1, 3, None), (1, 4, "b" * 36), (1, 5, "c" * 36), (1, 6, "d" * 3_600), (1, 7, "e" * 36)]
    df = spark.createDataFrame(rows, "query_id int, pos int, text string")
    label = lambda **more: [r.label for r in c.packages(df, budget=1_000, **more).orderBy("pos").collect()]
    assert label() == [1, None, None, 2, 3, 0, 4]
    facts = spark.createDataFrame([(1, "f" * 3_500)], "query_id int, text string")
    assert label(facts=facts) == [1, None, None, 2, 3, 0, 0]


def test_rendering(spark):
    fields = "query_id int, label int, contract_id int, contract_title string, clause_type string, clause_number string, section_title string, page_start int, page_end int, text string"
    rows = [(1, 1, 7, None, None, "12.3", "Part", 4, 5, "later"), (1, 2, 8, "B", None, None, None, None, None, "only"), (1, 3, 7, None, "payment_terms", "2.1", None, 4, 4, "sooner"), (1, 4, 7, "T", None, "12(a)", "S", 4, None, "marked"), (1, 0, 9, "gone", None, None, None, None, None, "dropped")]
    asked = spark.createDataFrame([(1,), (2,)], "query_id int")
    got = {r.query_id: r.evidence for r in c.rendered(spark.createDataFrame(rows, fields), asked).collect()}
    assert got[1] == "=== Contract 7 ===\n\n[4] Clause 12(a) - S [p.4]\nmarked\n\n[3] Clause 2.1 (payment terms) [p.4]\nsooner\n\n[1] Clause 12.3 - Part [pp.4-5]\nlater\n\n=== B ===\n\n[2]\nonly"
    assert got[2] == c.NOTHING
