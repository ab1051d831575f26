"""Registered queries of planning, risk rules, validation and embedding upkeep, beside SQL that says the same.

Lines of orders stand for clauses with attributes, orders for contracts, events for questions and results.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docuquarry.catalog import query, t
from docuquarry.functions import text as tx
from docuquarry.plans import embeddings as em
from docuquarry.plans import planner, risks
from docuquarry.plans import validation as v

#: Beginnings of questions; the rest is what the user said.
_OPENINGS = [
    "Compare the indemnity of both vendors", "Which contracts expire in the next 3 months?", "What does section 11.2 say?", "Any high-risk deals with uncapped liability", "Who is responsible within 60 days",
    "How much is the invoice", "GDPR please", "what is linked to this", "Summarise: overview", "How many are there", "hello", "upcoming: compare next quarter", "low risk and risk band medium",
]


def _plan_sql() -> str:
    """The rules over every question as SQL, from the same fixed tables; letters beyond ASCII count as letters of words."""
    text = lambda x: "'" + x.replace("'", "''") + "'"
    any_of = lambda patterns: " OR ".join(f"regexp_matches(s, {text(x)})" for x in patterns)
    intent = "CASE " + " ".join(f"WHEN {any_of(p)} THEN '{n}'" for n, p in planner.INTENTS.items()) + " ELSE 'general_qa' END"
    usual = "CASE intent " + " ".join(f"WHEN '{n}' THEN '{x}'" for n, x in planner.STRATEGIES.items()) + " ELSE 'hybrid' END"
    hints = ", ".join(f"CASE WHEN {' OR '.join(f'contains(l, {text(w)})' for w in words)} THEN '{n}' END" for n, words in planner.CLAUSE_HINTS.items())
    days = "CASE " + " ".join(f"WHEN {any_of([p])} THEN {f'CAST(regexp_extract(s, {text(p)}, 1) AS INTEGER) * {n}' if '(' in p else n}" for p, n in planner.PERIODS) + " END"
    bands = ", ".join(f"CASE WHEN {any_of([rf'\b{x}[- ]risk\b', rf'\brisk (?:is |band )?{x}\b'])} THEN '{x}' END" for x in ("high", "medium", "low"))
    levels = ", ".join(f"CASE WHEN strategy IN ({', '.join(map(text, of))}){' AND NOT one' if n == 'document_summary' else ''} THEN '{n}:{hits}' END" for n, hits, _, of in planner.LEVELS)
    openings = "[" + ", ".join(map(text, _OPENINGS)) + "]"
    listed = lambda x: f"array_to_string(list_filter([{x}], lambda v: v IS NOT NULL), ',')"
    return rf"""WITH q AS (SELECT conv_id, turn, {openings}[1 + (conv_id + turn) % {len(_OPENINGS)}] || ' ' || text AS q, conv_id % 5 = 0 AS one FROM conversations WHERE role = 'user'),
l AS (SELECT *, lower(q) AS l, regexp_replace(lower(q), '[^\x00-\x7F]', 'q', 'g') AS s FROM q), i AS (SELECT *, {intent} AS intent FROM l),
t AS (SELECT *, CASE WHEN regexp_matches(s, '\b(clause|section|article)\s+\d+') THEN 'clause_retrieval' WHEN {usual} = 'metadata_only' AND one THEN 'hybrid' ELSE {usual} END AS strategy FROM i)
SELECT conv_id, turn, intent, strategy, {listed(hints)} AS clause_types, {listed(bands)} AS risk_bands, {days} AS window_days, {listed(levels)} AS levels,
  CASE WHEN intent IN ('summarization', 'comparison') THEN 2 WHEN intent IN ('metadata_lookup', 'timeline') THEN 0 ELSE 1 END AS neighbour_window FROM t"""


@query(_plan_sql())
def query_plans(spark, d):
    """A plan for each thing that a user said; every fifth conversation wants an answer about one contract."""
    opening = F.element_at(F.array(*map(F.lit, _OPENINGS)), (1 + (F.col("conv_id") + F.col("turn")) % len(_OPENINGS)).cast("int"))
    asked = t(spark, d, "conversations").where("role = 'user'").select("conv_id", "turn", F.concat(opening, F.lit(" "), "text").alias("query"), (F.col("conv_id") % 5 == 0).alias("one"))
    planned = planner.plan(asked, one_contract="one", answering=F.col("one"))
    levels = F.array_join(F.transform("levels", lambda x: F.concat(x["level"], F.lit(":"), x["hits"].cast("string"))), ",")
    return planned.select("conv_id", "turn", "intent", "strategy", *[F.array_join(c, ",").alias(c) for c in ("clause_types", "risk_bands")], "window_days", levels.alias("levels"), "neighbour_window")


@query("""SELECT event_id, CASE WHEN value > 150 THEN 'msa' WHEN event_type IN ('view', 'click', 'purchase') AND value / 100 >= 0.75 THEN event_type ELSE '' END AS filter FROM events""")
def document_type_filters(spark, d):
    explicit = F.when(F.col("value") > 150, F.array(F.lit("msa"))).otherwise(F.array().cast("array<string>"))
    chosen = planner.document_types(explicit, F.col("event_type"), F.col("value") / 100, ["view", "click", "purchase", "error"], fallback="error")
    return t(spark, d, "events").select("event_id", F.array_join(chosen, ",").alias("filter"))


@query("""SELECT event_id, CASE event_type WHEN 'view' THEN 'vector' WHEN 'click' THEN 'keyword' ELSE 'vector,keyword' END AS legs FROM events""")
def search_modes(spark, d):
    mode = F.when(F.col("event_type") == "view", "semantic").when(F.col("event_type") == "click", "keyword").otherwise("hybrid")
    return t(spark, d, "events").select("event_id", F.array_join(planner.legs(mode), ",").alias("legs"))


@query("""WITH x AS (SELECT o_orderkey, list_distinct([o_orderkey % 7, o_custkey % 5, 9]) AS l FROM orders)
SELECT o_orderkey, array_to_string(list_sort(list_filter(l, lambda x: x BETWEEN 1 AND 4)), ',') AS valid, array_to_string(list_sort(list_filter(l, lambda x: x NOT BETWEEN 1 AND 4)), ',') AS fabricated FROM x""")
def parsed_citations(spark, d):
    answer = F.concat(F.lit("It says ["), (F.col("o_orderkey") % 7).cast("string"), F.lit(" , "), (F.col("o_custkey") % 5).cast("string"), F.lit("] and [9] but [x] and [ 3]"))
    c = planner.cited_labels(answer, F.array(*map(F.lit, [1, 2, 3, 4])))
    join = lambda x: F.array_join(F.transform(c[x], lambda n: n.cast("string")), ",")
    return t(spark, d, "orders").select("o_orderkey", join("valid").alias("valid"), join("fabricated").alias("fabricated"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type END AS label, CASE WHEN event_type = 'error' THEN 0.0 ELSE least(value / 100, 1.0) END AS confidence FROM events""")
def coerced_analyses(spark, d):
    said = F.when(F.col("event_type") == "error", "unsure").otherwise((F.col("value") / 100).cast("string"))
    got = planner.coerced_analysis(said, F.concat(F.lit(" "), F.upper("event_type")), ["view", "click"])
    return t(spark, d, "events").select("event_id", got["label"].alias("label"), got["confidence"].alias("confidence"))


_CLAUSE = """c AS (SELECT l_orderkey AS contract_id, l_linenumber AS line, CAST(l_quantity AS INTEGER) AS q, l_discount AS k, l_tax AS x, l_returnflag || l_linestatus AS f,
  CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'limitation_of_liability' WHEN 'AO' THEN 'indemnification' WHEN 'NF' THEN 'auto_renewal' WHEN 'NO' THEN 'payment_terms' WHEN 'RF' THEN 'termination_for_convenience' ELSE 'force_majeure' END AS clause_type FROM lineitem)"""


def clauses(spark, d):
    """Lines as clauses whose attributes, as JSON, follow from quantity, discount and tax."""
    f = F.concat("l_returnflag", "l_linestatus")
    kinds = {"AF": "limitation_of_liability", "AO": "indemnification", "NF": "auto_renewal", "NO": "payment_terms", "RF": "termination_for_convenience", "RO": "force_majeure"}
    kind = F.coalesce(*[F.when(f == k, name) for k, name in kinds.items()])
    q, k, x = F.col("l_quantity").cast("int"), F.col("l_discount"), F.col("l_tax")
    attributes = F.to_json(F.struct(
        F.when(k == 0, "uncapped").when(k < 0.03, "not_specified").when(k < 0.09, "fixed_amount").alias("cap_basis"), (q - 1).alias("cap_multiple"),
        F.when(q > 40, F.array(F.lit("ip_infringement"), F.lit("breach_of_law"), F.lit("gross_negligence"))).when(q > 30, F.array(F.lit("amounts_owed"), F.lit("breach_of_law"))).otherwise(F.array().cast("array<string>")).alias("carve_outs"),
        (q < 5).alias("has_carve_outs"), F.when(x > 0.05, x > 0.07).alias("is_mutual"), F.when(k > 0.05, k > 0.08).alias("is_capped"), F.when(q > 25, "one_sided_against_us").otherwise("mutual").alias("posture"),
        (q > 10).alias("auto_renews"), F.when(k > 0.02, q).alias("renewal_notice_days"), (q - 5).alias("payment_days"), F.when(x > 0.04, 2).otherwise(0).alias("late_fee_percent"),
        F.when(q > 45, "counterparty").when(q > 20, "both").otherwise("neither").alias("terminating_side"), F.when(k > 0.05, k > 0.07).alias("is_permitted"), F.when(x == 0, "neither").alias("can_we_terminate"), q.alias("notice_days"),
        F.when(q > 10, k > 0.05).alias("excuses_payment"), F.when(q > 20, x > 0.03).alias("covers_pandemic"),
    ))
    return t(spark, d, "lineitem").select(F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("line"), kind.alias("clause_type"), attributes.alias("attributes"), q.alias("q"))


_FOUND = f"""WITH {_CLAUSE}, r AS (
SELECT contract_id, line, clause_type, 'unlimited_liability' AS risk_type, 'critical' AS severity FROM c WHERE f = 'AF' AND k = 0
UNION ALL SELECT contract_id, line, clause_type, 'missing_liability_cap', 'high' FROM c WHERE f = 'AF' AND k > 0 AND k < 0.03
UNION ALL SELECT contract_id, line, clause_type, 'unlimited_liability', CASE WHEN q > 40 THEN 'critical' ELSE 'high' END FROM c WHERE f = 'AF' AND q > 30
UNION ALL SELECT contract_id, line, clause_type, 'unlimited_liability', 'medium' FROM c WHERE f = 'AF' AND q < 5
UNION ALL SELECT contract_id, line, clause_type, 'other', 'low' FROM c WHERE f = 'AF' AND q <= 2 AND k <> 0
UNION ALL SELECT contract_id, line, clause_type, 'other', 'medium' FROM c WHERE f = 'AF' AND x > 0.05 AND NOT x > 0.07
UNION ALL SELECT contract_id, line, clause_type, 'uncapped_indemnity', 'critical' FROM c WHERE f = 'AO' AND k > 0.05 AND NOT k > 0.08
UNION ALL SELECT contract_id, line, clause_type, 'other', 'high' FROM c WHERE f = 'AO' AND q > 25
UNION ALL SELECT contract_id, line, clause_type, 'auto_renewal', CASE WHEN k > 0.02 AND q < 30 THEN 'high' ELSE 'medium' END FROM c WHERE f = 'NF' AND q > 10
UNION ALL SELECT contract_id, line, clause_type, 'short_payment_terms', 'low' FROM c WHERE f = 'NO' AND q > 5 AND q <= 20
UNION ALL SELECT contract_id, line, clause_type, 'late_payment_penalty', 'low' FROM c WHERE f = 'NO' AND x > 0.04
UNION ALL SELECT contract_id, line, clause_type, 'unilateral_termination', 'high' FROM c WHERE f = 'RF' AND NOT (k > 0.05 AND NOT k > 0.07) AND (q > 45 OR x = 0)
UNION ALL SELECT contract_id, line, clause_type, 'broad_termination_rights', 'medium' FROM c WHERE f = 'RF' AND q <= 30 AND q > 20
UNION ALL SELECT contract_id, line, clause_type, 'other', 'high' FROM c WHERE f = 'RO' AND q > 10 AND k > 0.05
UNION ALL SELECT contract_id, line, clause_type, 'other', 'low' FROM c WHERE f = 'RO' AND q > 20 AND NOT x > 0.03)"""
_WEIGHTS = {"short_payment_terms": "low"}


def findings(spark, d):
    return risks.clause_findings(clauses(spark, d), _WEIGHTS).select("contract_id", "line", "clause_type", "risk_type", "severity")


@query(_FOUND + " SELECT * FROM r")
def clause_risks(spark, d):
    return findings(spark, d)


_SCORE = """CAST(greatest(round_even(100 - 100 * product(1 - w / 100.0), 0), CASE WHEN bool_or(severity = 'critical') THEN 67 WHEN bool_or(severity = 'high') THEN 34 ELSE 0 END) AS INTEGER)"""


@query(_FOUND + f""", s AS (SELECT contract_id, count(*) AS findings, {_SCORE} AS risk_score FROM (SELECT *, CASE severity WHEN 'critical' THEN 40 WHEN 'high' THEN 25 WHEN 'medium' THEN 10 ELSE 3 END AS w FROM r) GROUP BY 1)
SELECT *, CASE WHEN risk_score >= 67 THEN 'high' WHEN risk_score >= 34 THEN 'medium' ELSE 'low' END AS band FROM s""")
def risk_assessments(spark, d):
    return risks.assessments(findings(spark, d))


@query(f"WITH {_CLAUSE} SELECT contract_id, bool_or(f = 'AF' AND (k = 0 OR q > 30)) AS has_unlimited_liability FROM c GROUP BY 1")
def unlimited_liability(spark, d):
    return risks.unlimited_liability(clauses(spark, d))


@query(f"""WITH {_CLAUSE} SELECT o_orderkey AS contract_id, m AS clause_type, CASE m WHEN 'limitation_of_liability' THEN 'missing_liability_cap' ELSE 'missing_mandatory_clause' END AS risk_type, CASE m WHEN 'limitation_of_liability' THEN 'critical' ELSE 'high' END AS severity
FROM orders, (VALUES ('limitation_of_liability'), ('payment_terms'), ('warranty')) AS w(m) WHERE (o_orderkey, m) NOT IN (SELECT contract_id, clause_type FROM c)""")
def mandatory_omissions(spark, d):
    contracts = t(spark, d, "orders").select(F.col("o_orderkey").alias("contract_id"))
    return risks.omissions(contracts, clauses(spark, d), ["limitation_of_liability", "payment_terms", "warranty"], {"missing_liability_cap": "critical"})


@query(_FOUND + """, m AS (SELECT contract_id, 'other' AS risk_type, clause_type, CASE WHEN max(q) > 40 THEN 'high' ELSE 'low' END AS severity FROM c GROUP BY 1, 3)
SELECT contract_id, risk_type, clause_type, severity, 'rule' AS origin FROM r UNION ALL SELECT contract_id, risk_type, clause_type, severity, 'model' FROM m WHERE (contract_id, risk_type, clause_type) NOT IN (SELECT contract_id, risk_type, clause_type FROM r)""")
def merged_risks(spark, d):
    model = clauses(spark, d).select("contract_id", F.lit("other").alias("risk_type"), "clause_type", F.when(F.col("q") > 40, "high").otherwise("low").alias("severity"))
    return risks.merged_findings(findings(spark, d), model)


@query("""SELECT l_orderkey, array_to_string(list_filter([CASE WHEN count(*) FILTER (l_discount < 0.02) > 0 THEN 'low_confidence' END, CASE WHEN count(*) FILTER (l_returnflag = 'R') > 2 THEN 'missing_mandatory_clause' END,
  CASE WHEN count(*) FILTER (l_quantity > 45) > 0 THEN 'validation_failure' END, CASE WHEN count(*) FILTER (l_tax = 0.08) > 0 THEN 'auto_corrected' END], lambda x: x IS NOT NULL), ',') AS triggers FROM lineitem GROUP BY 1""")
def review_triggers(spark, d):
    n = lambda c: F.count_if(c)
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(n(F.col("l_discount") < 0.02).alias("a"), n(F.col("l_returnflag") == "R").alias("b"), n(F.col("l_quantity") > 40).alias("c"), n(F.col("l_quantity") > 45).alias("e"), n(F.col("l_tax") == 0.08).alias("f"))
    found = risks.review_triggers(F.col("a"), F.col("b") - 2, F.col("c"), F.col("e"), F.lit(0), F.col("f"), off=["high_risk_clause"])
    return rows.select("l_orderkey", F.array_join(found, ",").alias("triggers"))


@query("""SELECT o_orderkey, array_to_string(list_filter([CASE WHEN n < 0 THEN 'negative_duration' END, CASE WHEN n / 30 > 1200 THEN 'implausible_duration' END, CASE WHEN a < 0 THEN 'negative_amount' END, CASE WHEN a IS NOT NULL AND c IS NULL THEN 'amount_without_currency' END,
  CASE WHEN a > 400000 THEN 'implausible_amount' END, CASE WHEN length(c) <> 3 THEN 'invalid_currency_code' END, CASE WHEN d = '2001-02-30' THEN 'invalid_date' END], lambda x: x IS NOT NULL), ',') AS codes
FROM (SELECT o_orderkey, CASE WHEN o_totalprice > 450000 THEN 40000 ELSE 20 - o_custkey END AS n, CASE o_orderstatus WHEN 'F' THEN o_totalprice WHEN 'O' THEN -o_totalprice END AS a,
  CASE WHEN o_orderpriority > '4' THEN NULL WHEN o_orderpriority > '2' THEN 'usd' ELSE 'dollars' END AS c, CASE WHEN o_totalprice < 50000 THEN '2001-02-30' ELSE '2001-02-28' END AS d FROM orders)""")
def attribute_issues(spark, d):
    o = t(spark, d, "orders")
    rows = o.select(
        "o_orderkey", F.when(F.col("o_totalprice") > 450000, 40000).otherwise(20 - F.col("o_custkey")).alias("notice_days"), F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")).when(F.col("o_orderstatus") == "O", -F.col("o_totalprice")).alias("cap_amount"),
        F.when(F.col("o_orderpriority") > "4", None).when(F.col("o_orderpriority") > "2", "usd").otherwise("dollars").alias("cap_currency"), F.when(F.col("o_totalprice") < 50000, "2001-02-30").otherwise("2001-02-28").alias("effective_date"),
    )
    found = v.issues(*v.attribute_checks({"notice_days": "number", "cap_amount": "number", "cap_currency": "string", "effective_date": "string"}, max_value=400_000.0))
    return rows.select("o_orderkey", F.array_join(F.transform(found, lambda x: x["code"]), ",").alias("codes"))


@query("""SELECT l_orderkey, l_linenumber, CASE WHEN b = 'one_x_fees_paid' THEN coalesce(m, 1.0) ELSE m END AS multiple, array_to_string(list_filter([CASE WHEN b = 'one_x_fees_paid' AND m <> 1 THEN 'cap_multiple_conflicts_with_basis' END, CASE WHEN b = 'other_multiple_of_fees' AND m IS NULL THEN 'cap_multiple_required' END,
  CASE WHEN b = 'fixed_amount' AND a IS NULL THEN 'cap_amount_required' END, CASE WHEN b = 'uncapped' AND (m IS NOT NULL OR a IS NOT NULL) THEN 'uncapped_with_cap_value' END, CASE WHEN b IS NULL AND (m IS NOT NULL OR a IS NOT NULL) THEN 'cap_value_without_basis' END], lambda x: x IS NOT NULL), ',') AS codes
FROM (SELECT l_orderkey, l_linenumber, CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'one_x_fees_paid' WHEN 'AO' THEN 'other_multiple_of_fees' WHEN 'NF' THEN 'fixed_amount' WHEN 'NO' THEN 'uncapped' END AS b, CASE WHEN l_quantity < 20 THEN floor(l_quantity / 10) END AS m, CASE WHEN l_tax > 0.05 THEN l_extendedprice END AS a FROM lineitem)""")
def cap_issues(spark, d):
    f = F.concat("l_returnflag", "l_linestatus")
    basis = F.when(f == "AF", "one_x_fees_paid").when(f == "AO", "other_multiple_of_fees").when(f == "NF", "fixed_amount").when(f == "NO", "uncapped")
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", basis.alias("b"), F.when(F.col("l_quantity") < 20, F.floor(F.col("l_quantity") / 10).cast("double")).alias("m"), F.when(F.col("l_tax") > 0.05, F.col("l_extendedprice")).alias("a"))
    found = v.issues(*v.cap_checks(F.col("b"), F.col("m"), F.col("a"), F.lit(1)))
    return rows.select("l_orderkey", "l_linenumber", v.cap_multiple(F.col("b"), F.col("m")).alias("multiple"), F.array_join(F.transform(found, lambda x: x["code"]), ",").alias("codes"))


@query("""SELECT l_orderkey, l_linenumber, array_to_string(list_filter([CASE WHEN l_quantity > 25 AND l_discount > 0.05 THEN 'indemnity_posture_conflict' END, CASE WHEN NOT l_quantity > 25 AND NOT l_discount > 0.05 THEN 'indemnity_posture_conflict' END,
  CASE WHEN l_quantity > l_tax * 400 AND l_tax * 400 <> 0 THEN 'cure_exceeds_notice' END, CASE WHEN l_returnflag = 'A' AND l_quantity > 0 THEN 'cure_period_contradicts_incurable' END, CASE WHEN l_shipdate > TIMESTAMP '2000-01-01' THEN 'effective_after_expiration' END], lambda x: x IS NOT NULL), ',') AS codes FROM lineitem""")
def coherence_issues(spark, d):
    rows = t(spark, d, "lineitem").withColumns({"mutual": F.col("l_quantity") > 25, "posture": F.when(F.col("l_discount") > 0.05, "one_sided_against_us").otherwise("mutual"), "notice": F.col("l_tax") * 400})
    checks = [*v.indemnity_checks(F.col("posture"), F.col("mutual")), *v.termination_checks(F.col("notice"), F.col("l_quantity"), F.col("l_returnflag") != "A"), *v.date_order_checks(F.col("l_shipdate"), F.lit("2000-01-01").cast("timestamp"))]
    return rows.select("l_orderkey", "l_linenumber", F.array_join(F.transform(v.issues(*checks), lambda x: x["code"]), ",").alias("codes"))


@query("""SELECT c_custkey, 'customer ' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS party, CASE WHEN c_custkey < 10 THEN 'our_organisation' WHEN c_acctbal > 0 THEN 'counterparty' ELSE 'unknown' END AS side FROM customer""")
def party_sides(spark, d):
    name = F.concat("c_name", F.lit(", Pvt. Ltd."))
    return t(spark, d, "customer").select("c_custkey", tx.party_name(name).alias("party"), v.party_side(name, ["CUSTOMER-00000000 Inc", *[f"Customer#{i:09d}" for i in range(10)]], F.when(F.col("c_acctbal") > 0, False)).alias("side"))


@query("""SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS kind, round(value, 2) AS number, CASE WHEN user_id < 5 THEN 'EUR' END AS currency, CASE WHEN value > 200 THEN 0.0 WHEN value > 100 THEN 1.0 ELSE value / 100 END AS confidence,
  CASE WHEN value > 200 THEN 'invalid_confidence' WHEN value > 100 THEN 'confidence_out_of_range' END AS issue FROM events""")
def lenient_casts(spark, d):
    got = v.confidence(F.when(F.col("value") > 200, "high").otherwise((F.col("value") / 100).cast("string")))
    number = v.number_or_null(F.format_number("value", 2))
    currency = v.currency_or_null(F.when(F.col("user_id") < 5, " eur ").otherwise("euros"))
    return t(spark, d, "events").select("event_id", v.enum_or(F.concat(F.upper("event_type"), F.lit(" ")), ["view", "click"], "other").alias("kind"), number.alias("number"), currency.alias("currency"), got["confidence"].alias("confidence"), got["issue"].alias("issue"))


@query("""SELECT conv_id, turn, 'Conversation ' || conv_id || chr(10) || 'Agreement type: ' || replace(role, '_', ' ') || chr(10) || CASE WHEN turn > 1 THEN 'Parties: a, b' || chr(10) ELSE '' END || trim(text) AS summary_text,
  'Clause type: ' || role || ' | Clause ' || turn || CASE turn % 4 WHEN 1 THEN '' WHEN 2 THEN ' | cap multiple: 1.5; carve outs: ip infringement, breach of law; terminating side: our side'
    WHEN 3 THEN ' | cap basis: fixed amount; is mutual: no; governing law: Law ' || conv_id || '; duration months: ' || turn || '; is exclusive: yes; work product owner side: counterparty'
    ELSE ' | has carve outs: yes; carve outs: other, 12, True, None' END || chr(10) || trim(text) AS clause_text, CASE WHEN turn > 0 THEN 'Clause ' || turn || chr(10) ELSE '' END || trim(text) AS chunk_text
FROM conversations WHERE trim(text) <> ''""")
def embedding_texts(spark, d):
    c = t(spark, d, "conversations")
    parties = F.when(F.col("turn") > 1, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>"))
    law = F.concat(F.lit('{"is_exclusive": true, "work_product_owner_side": "counterparty", "is_mutual": false, "governing_law": "Law_'), "conv_id", F.lit('", "duration_months": '), "turn", F.lit(', "cap_basis": "fixed_amount"}'))
    said = (
        F.when(F.col("turn") % 4 == 1, '{"carve_outs": [], "cap_basis": "", "posture": null, "unknown": "x"}').when(F.col("turn") % 4 == 3, law)
        .when(F.col("turn") % 4 == 2, '{"terminating_side": "our_side", "carve_outs": ["ip_infringement", "breach_of_law"], "cap_multiple": 1.5}').otherwise('{"carve_outs": ["other", 12, true, null], "has_carve_outs": true}')
    )
    n = F.col("turn").cast("string")
    return c.where(F.trim("text") != "").select(
        "conv_id", "turn", em.summary_text(F.concat(F.lit("Conversation "), "conv_id"), F.col("role"), parties, F.col("text"), F.array().cast("array<string>")).alias("summary_text"),
        em.clause_text(F.col("role"), n, F.lit(None).cast("string"), F.col("text"), said).alias("clause_text"), em.chunk_text(F.lit(""), F.when(F.col("turn") > 0, n), F.col("text")).alias("chunk_text"),
    )


@query("""WITH h AS (SELECT sha256(o_orderpriority) AS content_hash, o_orderpriority AS text, o_orderstatus AS s FROM orders)
SELECT 'reused' AS how, content_hash, count(*) AS items FROM h WHERE text < '3' GROUP BY 1, 2 UNION ALL SELECT 'fresh', content_hash, count(*) FROM h WHERE text >= '3' GROUP BY 1, 2""")
def embedding_reuse(spark, d):
    items = t(spark, d, "orders").select(F.col("o_orderpriority").alias("text"))
    existing = items.where("text < '3'").select(tx.content_hash(F.col("text")).alias("content_hash"), F.array(F.lit(1.0)).alias("vector")).distinct()
    reused, fresh = em.to_embed(items, existing)
    return reused.groupBy(F.lit("reused").alias("how"), "content_hash").agg(F.count("*").alias("items")).unionByName(fresh.select(F.lit("fresh").alias("how"), "content_hash", "items"))


def _vectors(spark, d):
    e = t(spark, d, "events")
    return e.select(F.col("user_id").alias("contract_id"), (F.col("user_id") % 3).alias("project_id"), F.when(F.col("value") > 20, "m2").otherwise("m1").alias("model"), F.lit("p").alias("provider"), F.lit(64).alias("dim"), F.when(F.col("event_type") == "view", "v1").otherwise("v2").alias("embedding_version"), F.lit("s1").alias("strategy_version"))


@query("SELECT CASE WHEN value > 20 THEN 'm2' ELSE 'm1' END AS model, 'p' AS provider, 64 AS dim, CASE event_type WHEN 'view' THEN 'v1' ELSE 'v2' END AS embedding_version, 's1' AS strategy_version, count(*) AS vectors FROM events GROUP BY ALL")
def embedding_census(spark, d):
    return em.census(_vectors(spark, d))


@query("SELECT DISTINCT user_id AS contract_id FROM events WHERE user_id % 3 IN (0, 2) AND (value <= 20 OR event_type = 'view')")
def contracts_to_reindex(spark, d):
    return em.reindex_list(_vectors(spark, d), {"model": "m2", "provider": "p", "dim": 64, "embedding_version": "v2", "strategy_version": "s1"}, [0, 2])


@query()
def mock_embeddings(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", em.mock_vector(F.col("text"), 40).alias("vector")).select("conv_id", "turn", F.round(F.element_at("vector", 1), 9).alias("first"), F.round(F.element_at("vector", 40), 9).alias("last"))
