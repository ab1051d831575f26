"""Shapes of plans that keep a task's memory, the shuffle or the time in proportion to the input."""

import random
import tracemalloc
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from docuquarry import catalog, catalog_contracts  # noqa: F401  (registers its queries)
from docuquarry.operators import relational
from docuquarry.plans import detection, embeddings, evaluation, evidence, extraction, fulltext, positional, retrieval, risks


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_wave_reads_the_texts_of_its_own_pages(spark):
    pages = spark.createDataFrame([(d, p, "word " * 20) for d in (1, 2) for p in range(1, 31)], "doc long, page long, text string")
    wanted = spark.createDataFrame([(1, "here"), (2, "gone")], "doc long, clause string")
    seen = []

    def search(windows):
        seen.append((plan(windows), windows.agg(F.min("page"), F.max("page")).first()))
        return windows.where("doc = 1 AND page = 14").select("doc", "window", "page", F.lit("here").alias("clause"))

    got = detection.detect(pages, pages.select("doc", "page", F.lit("").alias("heading")).limit(0), wanted, search, F.lower, size=3, overlap=1, wave=5, least_chars=1)
    assert [(r.doc, r.page, r.window) for r in got.claims.collect()] == [(1, 14, 6)] and got.waves == 3
    assert [tuple(s[1]) for s in seen] == [(1, 11), (11, 21), (21, 30)]
    assert all(f"<= {last}" in text for (text, _), last in zip(seen, (11, 21, 31), strict=True))


def test_far_ancestors_stream_past_the_links(spark):
    rows = spark.createDataFrame([(i, i // 3 or None) for i in range(1, 60)], "id long, parent_id long")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = relational.ancestors(rows, rows.select("id"), depth=3)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString()
        assert {(r.ancestor, r.depth) for r in found.where("id = 30").collect()} == {(10, 1), (3, 2), (1, 3)}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_mock_vector_digests_its_text_once_a_counter(spark):
    rows = spark.createDataFrame([("some text",), ("",), (None,)], "text string").select(embeddings.mock_vector(F.col("text"), 40).alias("v"))
    assert plan(rows).count("sha2(") == 2
    got = rows.collect()
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-9 for r in got[:2]) and set(got[2].v) == {None}


def test_citation_outcomes_group_without_a_join(spark):
    cited = spark.createDataFrame([(1, 7, True), (1, 8, True), (1, 9, True), (1, None, True), (1, 7, False), (2, 7, None)], "case_id int, ref_id int, resolved boolean")
    hits = spark.createDataFrame([(1, 7, 3, True, True), (1, 7, 0, True, False), (1, 8, 0, True, True), (1, 5, 2, True, False), (3, 1, 2, False, False), (3, None, None, None, None)], "case_id int, ref_id int, grade int, in_context boolean, cited boolean")
    found = evaluation.citation_outcomes(cited, hits)
    assert "Join" not in plan(found)
    assert sorted(tuple(r)[:8] for r in found.collect()) == [(1, 5, 1, 1, 2, 1, 2, 1), (2, 1, 0, 0, 1, 0, 0, 0), (3, 0, 0, 0, 0, 0, 0, 0)]


def test_rules_are_read_once_and_join_behind_the_contracts(spark):
    from docuquarry import catalog_alerts
    from docuquarry.plans import alerts

    tables = catalog_alerts._tables(spark, "/root/testdata/sf0.001")
    drafts = alerts.collect(*tables, F.lit("2001-06-01").cast("date"))
    said = plan(drafts)
    assert "parse_json" not in said and "map_concat" not in said  # thresholds are columns of a few written rows
    swept = alerts.sweep(drafts.withColumns({"status": F.lit("open"), "escalated_at": F.lit(None).cast("timestamp"), "created_at": F.lit("2001-01-01").cast("timestamp")}), drafts, tables[-1], F.lit("2001-06-01 12:00:00").cast("timestamp"))
    assert "map_concat" not in plan(swept) and {r.action for r in swept.select("action").distinct().collect()} == {"keep"}


def test_a_payload_is_parsed_once_for_all_checks(spark):
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "array", "items": {"type": "object", "properties": {"n": {"type": ["number", "null"]}}}}}}
    rows = spark.createDataFrame([(1, '{"a": [{"n": 1}, {"n": "x"}, 2]}'), (2, "{"), (3, None), (4, "null"), (5, "{}")], "id long, payload string")
    got = rows.select("id", extraction.schema_issues(F.col("payload"), schema).alias("i"))
    assert plan(got).count("parseJson") == 1
    assert {r.id: [(i.code, i.field) for i in r.i] for r in got.collect()} == {
        1: [("schema_type_mismatch", "a[1].n"), ("schema_type_mismatch", "a[2]")], 2: [("schema_unreadable", "(root)")], 3: [("schema_unreadable", "(root)")], 4: [("schema_type_mismatch", "(root)")], 5: [("schema_missing_field", "a")],
    }


def test_rules_read_a_clause_once_and_meet_the_model_in_one_grouping(spark):
    clauses = spark.createDataFrame([(1, "assignment", '{"consent_required_on_change_of_control": [1]}'), (1, "assignment", '{"consent_required_on_change_of_control": []'), (2, "exclusivity", '{"bound_side": "both", "x": {"bound_side": null}}'), (2, "exclusivity", None), (None, "exclusivity", '{"bound_side": "both"}')], "contract_id long, clause_type string, attributes string")
    found = risks.clause_findings(clauses)
    assert found.columns == [*clauses.columns, "risk_type", "severity"] and "get_json_object" not in plan(found)
    model = spark.createDataFrame([(None, "exclusivity", "exclusivity", "low"), (2, "exclusivity", "assignment", "low"), (2, "exclusivity", "assignment", "high")], "contract_id long, risk_type string, clause_type string, severity string")
    merged = risks.merged_findings(found, model)
    assert plan(merged).count("json_tuple") == 1
    assert {tuple(r) for r in merged.collect()} == {(1, "change_of_control", "assignment", "medium", "rule"), (2, "exclusivity", "exclusivity", "high", "rule"), (None, "exclusivity", "exclusivity", "high", "rule"), (2, "exclusivity", "assignment", "high", "model")}


def test_an_index_stems_words_as_rows(spark):
    rows = spark.createDataFrame([(1, "The FLIES and \u00c9T\u00c9S running, running"), (2, None), (3, "")], "id long, body string")
    got = fulltext.index(rows, "id", None, "body")
    # the only lambda binds the text in lower case
    assert plan(got).count("lower(") == 1 and plan(got).count("transform(") == 1
    assert {(r.term, r.weight) for r in got.collect()} == {("fly", 0.4), ("\u00e9t\u00e9", 0.4), ("run", 0.8)}


def test_a_positional_index_stems_words_as_rows(spark):
    rows = spark.createDataFrame([(1, "The FLIES and \u00c9T\u00c9S running, running"), (2, None), (3, "")], "id long, body string")
    got = positional.index(rows, "id", {"body": 1.0})
    assert plan(got).count("lower(") == 1 and plan(got).count("transform(") == 1
    assert {(r.term, tuple(r.positions)) for r in got.collect()} == {("fly", (1,)), ("\u00e9t\u00e9", (3,)), ("run", (4, 5))}


def test_rows_of_a_sheet_are_sorted_for_their_places_alone(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        clauses = catalog.QUERIES["export_sheets"](spark, "/root/testdata/sf0.001").where("entity = 'clauses'")
        text = clauses._jdf.queryExecution().sparkPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert text.count("ShuffledHashJoin") >= 2 and clauses.count() > 0



@pytest.mark.parametrize("bounds", [{}, {"quote_words": None, "evidence_words": None}, {"quote_words": 9, "evidence_words": 31}])
def test_quotes_are_read_and_folded_once(spark, bounds):
    rnd, rows = random.Random(5), []
    for _ in range(60):
        text = rnd.choices("abcdefgh", k=rnd.choice([0, 1, 2, 9, 40, 41, 2500]))
        for _ in range(4):  # quotes of one text follow each other, as verbatim, altered and invented ones
            at = rnd.randrange(len(text) + 1)
            quote = text[at : at + rnd.choice([3, 10, 30])]
            for _ in range(rnd.randrange(3)):
                quote.insert(rnd.randrange(len(quote) + 1), rnd.choice(["x", "a", "b"]))
            rows.append((len(rows), " ".join(quote) if rnd.random() < 0.95 else None, " ".join(text) if text or rnd.random() < 0.5 else None))

    def verdict(quote, text):
        n, m = bounds.get("quote_words", evidence.QUOTE_WORDS), bounds.get("evidence_words", evidence.EVIDENCE_WORDS)
        if not quote or quote in (text or ""):
            return "ok" if quote else "empty"
        words, held = quote.split()[:n], (text or "").split()[:m]
        width = len(held) if m else max(4 * len(words), evidence.WINDOW_WORDS)
        best = max(sum(b.size for b in SequenceMatcher(None, words, held[i : i + width], autojunk=False).get_matching_blocks()) for i in range(0, max(1, len(held) - width // 2), max(1, width // 2)))
        return "ok" if best / len(words) >= evidence.QUOTE_CLEAN else "partial" if best / len(words) >= evidence.QUOTE_MATCH else "rejected"

    got = evidence.check_quotes(spark.createDataFrame(rows, "i int, quote string, text string"), "quote", "text", **bounds)
    assert got.columns == ["i", "quote", "text", "verdict"]
    assert plan(got).count("translate(") == 2 and "Union" not in plan(got)
    want = {i: verdict(q, t) for i, q, t in rows}
    assert {r.i: r.verdict for r in got.collect()} == want and {"empty", "ok", "partial", "rejected"} == set(want.values())


def test_a_block_holds_a_strip_of_its_scores(monkeypatch):
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(retrieval.BLOCK_ROWS, 8))
    tracemalloc.start()
    names, _, _ = retrieval.best_of_block(np.arange(retrieval.BLOCK_ROWS), x, np.arange(retrieval.BLOCK_ROWS), x, 5, 0.0)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(names) == 5 * retrieval.BLOCK_ROWS and peak < 32 << 20  # all scores at once take 128 MiB

    monkeypatch.setattr(retrieval, "STRIP_SCORES", 100)
    held = np.concatenate([x[:30], x[:10], x[:3] + 1e-12])  # equal scores, and scores that rounding makes equal
    ids, may = rnd.permutation(len(held)), rnd.random((20, len(held))) < 0.7
    for k, floor, scope in [(3, None, None), (4, 0.5, lambda at: may[at]), (50, None, lambda at: may[at]), (43, 0.0, None), (2, 99.0, None)]:
        names, found, scores = retrieval.best_of_block(np.arange(20), x[:20], ids, held, k, floor, scope)
        want = []
        for q in range(20):
            s = held @ x[q]
            seen = [i for i in range(len(held)) if ids[i] != q and (floor is None or s[i] >= floor) and (scope is None or may[q, i])]
            want += [(q, ids[i]) for i in sorted(seen, key=lambda i: (-np.round(s[i], 9), ids[i]))[:k]]
        assert list(zip(names, found, strict=True)) == want and len(scores) == len(want)
    assert [len(c) for c in retrieval.best_of_block(ids[:0], x[:0], ids, held, 3)] == [0, 0, 0]
