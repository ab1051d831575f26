"""Operators whose queries have no SQL, and cases that the driver tables don't hold."""

import hashlib

import numpy as np
from pyspark.sql import functions as F

from docuquarry.operators import layout, registers
from docuquarry.plans import embeddings, evaluation, fulltext, planner, retrieval, risks, validation
from docuquarry.streaming import jobs


def test_mock_vectors(spark):
    texts = ["", "abc", "größer"]
    got = spark.createDataFrame([(x,) for x in texts], "t string").select("t", embeddings.mock_vector(F.col("t"), 40).alias("v")).collect()
    for r in got:
        raw = b"".join(hashlib.sha256(r.t.encode() + i.to_bytes(4, "big")).digest() for i in range(2))[:40]
        x = np.array([(b - 127.5) / 127.5 for b in raw])
        assert np.allclose(r.v, x / np.linalg.norm(x))


def test_duplicate_rates(spark):
    rows = [("q", 1, ["a", "b"]), ("q", 2, ["a", "b", "c"]), ("q", 3, []), ("q", 4, ["x"]), ("r", 1, ["a"])]
    got = {r.q: (r["items"], r.duplicates, r.rate) for r in evaluation.duplicate_rates(spark.createDataFrame(rows, "q string, n int, g array<string>"), "q", "n", "g").collect()}
    assert got == {"q": (4, 1, 0.25), "r": (1, 0, 0.0)}


def test_absent_attributes_fire_nothing(spark):
    kinds = sorted({k for k, *_ in risks.clause_rules()})
    rows = [(k, j) for k in kinds for j in ("{}", None, '{"notice_days": "soon", "is_mutual": null, "carve_outs": "x"}')]
    got = {(r.clause_type, r.risk_type) for r in risks.clause_findings(spark.createDataFrame(rows, "clause_type string, attributes string")).collect()}
    assert got == {("governing_law", "unfavourable_governing_law")}


def test_rules_of_rare_clauses(spark):
    rows = [
        ("intellectual_property", '{"we_retain_pre_existing_ip": "neither", "work_product_owner_side": "counterparty"}'), ("exclusivity", '{"bound_side": "both"}'), ("assignment", '{"consent_required_on_change_of_control": true}'),
        ("audit_rights", '{"has_audit_rights": false, "notice_days": 0}'), ("termination_for_cause", '{"is_curable": false, "cure_period_days": 14}'), ("non_solicitation", '{"duration_months": 25, "bound_side": null}'), ("governing_law", '{"country": "IN"}'),
    ]
    got = sorted((r.clause_type, r.risk_type, r.severity) for r in risks.clause_findings(spark.createDataFrame(rows, "clause_type string, attributes string"), {"exclusivity": "low"}).collect())
    assert got == [
        ("assignment", "change_of_control", "medium"), ("audit_rights", "no_audit_rights", "low"), ("audit_rights", "other", "medium"), ("exclusivity", "exclusivity", "low"), ("intellectual_property", "ip_assignment_risk", "critical"),
        ("intellectual_property", "ip_assignment_risk", "high"), ("non_solicitation", "non_compete_breadth", "medium"), ("termination_for_cause", "broad_termination_rights", "high"), ("termination_for_cause", "broad_termination_rights", "medium"),
    ]


def test_registers_keep_null_rows_apart(spark):
    contracts = spark.createDataFrame([(1, 1, "a", "ready", None), (2, 1, "b", "archived", None), (3, 1, "c", "ready", "x")], "contract_id int, project_id int, title string, status string, deleted_at string")
    live = registers.live_contracts(contracts, [1])
    dates = spark.createDataFrame([(1, "expiry", None), (1, "expiry", "2024-01-01"), (2, "expiry", "2024-01-01")], "contract_id int, date_type string, date_value string")
    assert [r.date_value for r in registers.key_date_register(dates, live).collect()] == ["2024-01-01", None]
    assert [r.date_value for r in registers.key_date_register(dates, live, unresolved=True).collect()] == [None]
    assert registers.live_contracts(contracts, []).count() == 0


def test_clause_numbers_sort_as_numbers(spark):
    df = spark.createDataFrame([(1, "12.3", 1), (1, "2.1", 2), (1, "12(a)", 3), (None, "1", 4), (1, None, 5)], "page int, number string, label int")
    assert [r.label for r in df.orderBy(*registers.document_order("page", "number", "label")).collect()] == [3, 5, 2, 1, 4]


def test_windows_stop_at_the_end(spark):
    pages = spark.createDataFrame([("d", p) for p in range(1, 8)] + [("e", 1)], "doc string, page int")
    for size, overlap in ((3, 0), (3, 1), (4, 3), (10, 2), (1, 5)):
        got = sorted((r.doc, r.window, r.page) for r in layout.page_windows(pages, "doc", size, overlap).collect())
        want = []
        for doc, n in (("d", 7), ("e", 1)):
            for w, start in enumerate(range(0, n, max(1, size - overlap))):
                want += [(doc, w, p + 1) for p in range(start, min(start + size, n))]
                if start + size >= n:
                    break
        assert got == sorted(want)


def test_plans_of_odd_questions(spark):
    df = spark.createDataFrame([(None, True), ("What renews?", True), ("What renews?", False)], "query string, one boolean")
    got = [(r.intent, r.strategy) for r in planner.plan(df, one_contract="one").collect()]
    assert got == [("general_qa", "hybrid"), ("timeline", "hybrid"), ("timeline", "metadata_only")]


def test_checks_of_nulls_find_nothing(spark):
    df = spark.createDataFrame([(None, None, None)], "cap_amount double, cap_currency string, due_date string")
    found = validation.issues(*validation.attribute_checks({"cap_amount": "number", "cap_currency": "string", "due_date": "string"}, 1.0), *validation.cap_checks(F.lit(None), F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None)))
    assert df.select(found.alias("x")).first().x == []


def test_many_nearest(spark, monkeypatch):
    monkeypatch.setattr(retrieval, "BLOCK_ROWS", 16)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(100, 8))
    x[50] = x[10]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): r.id for r in retrieval.knn_of(df, df.where("id % 20 = 0").selectExpr("id AS query_id", "embedding"), 4, "id").collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 100, 20):
        best = sorted((j for j in range(100) if j != q), key=lambda j: (-round(float(u[q] @ u[j]), 9), j))[:4]
        assert [got[q, n + 1] for n in range(4)] == best


def test_jobs_resume_and_end(spark):
    df = spark.createDataFrame([("paused", "start"), ("paused", "resume"), ("ready", "fail"), ("ready", "reprocess"), ("queued", "start")], "s string, e string")
    assert [r[0] for r in df.select(jobs.transition(F.col("s"), F.col("e"))).collect()] == ["paused", "running", "ready", "queued", "running"]


def test_stems_meet(spark):
    words = ["parties", "party", "terminated", "terminating", "terminates", "boxes", "box", "running", "runs", "gas", "the"]
    got = {r.w: r.s for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", fulltext.stem(F.col("w")).alias("s")).collect()}
    assert got["parties"] == got["party"] and got["terminated"] == got["terminating"] and got["boxes"] == got["box"] and got["running"] == got["runs"] == "run" and got["gas"] == "gas"
