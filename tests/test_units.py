"""Null handling and folds on small fixtures."""

from pyspark.sql import functions as F

from docuquarry.functions import text as tx
from docuquarry.operators import predicates as p
from docuquarry.operators import relational as r
from docuquarry.plans import metrics, rules


def test_tri_state_flags_and_empty_arrays(spark):
    df = spark.createDataFrame([(1, True, ["a"]), (2, False, []), (3, None, None)], "id int, f boolean, xs array<string>")
    ids = lambda c: [x.id for x in df.where(c).orderBy("id").collect()]
    assert ids(p.flag("f", True)) == [1] and ids(p.flag("f", False)) == [2]
    assert ids(p.non_empty("xs", True)) == [1] and ids(p.non_empty("xs", False)) == [2]
    assert ids(p.all_of([None, None])) == [1, 2, 3]
    assert ids(p.is_missing("f", True)) == [3]


def test_like_wildcards_are_literal(spark):
    df = spark.createDataFrame([("50%",), ("505",), (None,)], "s string")
    assert [x.s for x in df.where(p.contains_text("0%", "s")).collect()] == ["50%"]


def test_live_scope(spark):
    df = spark.createDataFrame([(1, 1, None), (2, 1, "x"), (3, 2, None)], "id int, project_id int, deleted_at string")
    assert [x.id for x in p.scoped(df, [1]).collect()] == [1]
    assert p.scoped(df, []).count() == 0


def test_ancestors_stop_at_a_cycle(spark):
    rows = spark.createDataFrame([(1, None), (2, 1), (3, 2), (8, 9), (9, 8)], "id int, parent_id int")
    got = {(x.id, x.ancestor, x.depth) for x in r.ancestors(rows, rows.select("id")).collect()}
    assert got == {(2, 1, 1), (3, 2, 1), (3, 1, 2), (8, 9, 1), (9, 8, 1)}


def test_strict_dates_and_numbers(spark):
    df = spark.createDataFrame([("2024-02-30", "11.2 Cap"), ("2024-02-29", "Cap"), ("24-1-1", None)], "d string, t string")
    got = df.select(tx.strict_date(F.col("d")).alias("d"), tx.clause_number(F.col("t")).alias("n")).collect()
    assert [str(x.d) for x in got] == ["None", "2024-02-29", "None"] and [x.n for x in got] == ["11.2", None, None]


def test_saturating_score(spark):
    got = spark.range(1).select(tx.saturating_score(F.array(F.lit(40), F.lit(90))).alias("s")).first().s
    assert got == round(100 - 100 * 0.6 * 0.6)


def test_unscoreable_case_is_null(spark):
    hits = spark.createDataFrame([(1, 1, 0, 0), (2, 1, 4, 1)], "c int, r int, g int, w int")
    got = {x.c: x for x in metrics.ranking_metrics(hits, "c", "r", "g", "w", 5).collect()}
    assert got[1].recall is None and got[1].ndcg is None and got[2].mrr == 1.0 and got[2].ndcg == 1.0


def test_rule_resolution(spark):
    rows = [(None, "expiry", "high", True), (1, "expiry", "low", True), (2, "expiry", "low", False), (None, "risk", "high", False)]
    table = spark.createDataFrame(rows, "project_id int, alert_type string, severity string, enabled boolean")
    got = {tuple(x) for x in rules.resolve_rules(table, spark.createDataFrame([(1,), (2,), (3,)], "project_id int")).collect()}
    assert got == {(1, "expiry", "low"), (3, "expiry", "high")}


def test_risk_bands_and_scores(spark):
    bands = [(None, "low"), (33.5, "low"), (34.0, "medium"), (66.5, "medium"), (67.0, "high")]
    df = spark.createDataFrame(bands, "s double, want string")
    assert df.where(~tx.risk_band(F.col("s")).eqNullSafe(F.col("want"))).count() == 0
    assert [r.b for r in spark.createDataFrame([(0.8,), (0.55,), (0.54,), (None,)], "v double").select(tx.confidence_band(F.col("v")).alias("b")).collect()] == ["high", "medium", "low", "low"]
    cases = [([], 0), (["low"], 3), (["critical"], 67), (["high"], 34), (["medium"] * 3, round(100 - 100 * 0.9**3)), (["low", "critical", "high"], max(67, round(100 - 100 * 0.6 * 0.75 * 0.97))), (["critical"] * 9, 99)]
    got = spark.createDataFrame(cases, "s array<string>, want int").withColumn("got", tx.risk_score(F.col("s"))).collect()
    assert all(r.got == r.want for r in got), got


def test_halves_round_to_even(spark):
    assert spark.range(1).select(tx.saturating_score(F.array(F.lit(0.5))).alias("s")).first().s == 0.0
    assert spark.range(1).select(tx.saturating_score(F.array(F.lit(1.5))).alias("s")).first().s == 2.0


def test_wide_spaces_fold(spark):
    df = spark.createDataFrame([("a\u00a0\u2003b\x1f", "a b"), ("\u3000", ""), ("a\x0bb", "a b")], "x string, y string")
    got = df.select((tx.content_hash(F.col("x")) == tx.content_hash(F.col("y"))).alias("same"), tx.token_estimate(F.col("x")).alias("n")).collect()
    assert [r.same for r in got] == [True, True, True] and [r.n for r in got] == [1, 1, 1]


def test_names_and_headings_fold(spark):
    df = spark.createDataFrame([("IRIS-Tech Pvt. Ltd.", "12.3) Cap on  Liability!"), ("The Company", "iv. Term"), (None, "Annex 3")], "p string, h string")
    assert [tuple(r) for r in df.select(tx.party_name(F.col("p")), tx.clause_heading(F.col("h"))).collect()] == [("iris tech", "cap on liability"), ("the", "term"), ("", "annex 3")]


def test_verdicts_of_the_gate(spark):
    rows = [("gone", 1.0, None, True, None), ("limit", 1.0, 2.0, False, 1.5), ("new", None, 1.0, True, None), ("same", 1.0, 1.02, True, None), ("up", 1.0, 2.0, True, 0.5), ("down", 1.0, 0.5, True, None), ("slow", 100.0, 130.0, False, None), ("edge", 2.0, 1.5, True, None)]
    df = spark.createDataFrame(rows, "metric string, b double, c double, up boolean, cap double")
    got = {r.metric: r.verdict for r in metrics.gate(df, "b", "c", 0.02, 0.25, "up", "cap").collect()}
    assert got == {"gone": "missing", "limit": "regressed", "new": "new", "same": "unchanged", "up": "improved", "down": "regressed", "slow": "regressed", "edge": "unchanged"}


def test_rules_set_the_least_severity(spark):
    df = spark.createDataFrame([(-1, "low"), (5, "info"), (20, "low"), (20, "critical"), (80, "low"), (91, "low")], "d int, s string")
    got = df.select(rules.expiry_alert(F.col("d"), severity=F.col("s")).alias("e"), rules.obligation_alert(F.col("d"), severity=F.col("s"), status=F.lit("open")).alias("o")).collect()
    assert [r.e for r in got] == [None, "critical", "high", "critical", "low", None]
    assert [r.o for r in got] == ["high", "info", None, None, None, None]
    clauses = spark.createDataFrame([(["Cap", "term"],), ([],), (None,)], "m array<string>")
    assert [r[0] for r in clauses.select(rules.missing_clause_alert(F.col("m"), F.lit("low"), ["cap"])).collect()] == ["low", None, None]


def test_sweeps_keep_what_operators_did(spark):
    old = [("a", "expiry", "open", "high", "2024-01-01", None), ("b", "expiry", "acknowledged", "high", "2024-01-01", None), ("c", "expiry", "open", "high", "2024-01-01", "2024-01-09"), ("d", "risk", "open", "low", "2024-01-01", None), ("e", "expiry", "open", "low", "2024-01-19", None), ("f", "expiry", "open", "low", "2024-01-01", None)]
    alerts = spark.createDataFrame(old, "dedupe_key string, alert_type string, status string, severity string, created_at string, escalated_at string").withColumn("created_at", F.to_timestamp("created_at"))
    now = spark.createDataFrame([("a", "high"), ("b", "medium"), ("c", "high"), ("e", "low"), ("z", "low")], "dedupe_key string, severity string")
    on = spark.createDataFrame([("expiry", 7)], "alert_type string, escalate_after_days int")
    got = {r.dedupe_key: (r.action, r.severity, r.status) for r in rules.reconcile(alerts, now, on, F.lit("2024-01-20 00:00:00").cast("timestamp")).collect()}
    assert got == {
        "a": ("escalate", "critical", "open"), "b": ("update", "medium", "acknowledged"), "c": ("update", "critical", "open"), "d": ("hold", "low", "open"),
        "e": ("keep", "low", "open"), "f": ("resolve", "low", "open"), "z": ("create", "low", None),
    }


def test_rows_without_shingles_stay(spark):
    from docuquarry.plans import evidence, retrieval

    df = spark.createDataFrame([("q", 1, ["a"]), ("q", 2, []), ("q", 3, None), ("q", 4, ["a"])], "q string, pos int, grams array<string>")
    assert sorted(r.pos for r in retrieval.suppress_near_duplicates(df, "q", "pos", "grams").collect()) == [1, 2, 3]
    assert spark.range(1).select(tx.shingles(F.lit(" \u00a0 ")).alias("s")).first().s == []
    one = lambda x: F.lit(x)
    assert spark.range(1).select(evidence.answer_confidence(one(3), one(5), one(0.9), one(False), one(False), one(False), one(True)).alias("c")).first().c == 0.0


def test_a_number_is_the_whole_number(spark):
    from docuquarry.operators import structure

    rows = [("d", "a", 0, "11", None, 1), ("d", "b", 1, "11.2 Cap", "a", 3), ("d", "c", 2, "11.3.", None, 1)]
    got = {r.section_id: (r.parent_id, r.level) for r in structure.repair_sections(spark.createDataFrame(rows, "doc_id string, section_id string, ord int, number string, parent_id string, level int")).collect()}
    assert got == {"a": (None, 1), "b": ("a", 3), "c": ("a", 2)}
