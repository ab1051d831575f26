"""Registered queries of alert sweeps, beside SQL that says the same: orders are contracts, their lines obligations and clauses."""

from __future__ import annotations

from pyspark.sql import functions as F

from docuquarry.catalog import query, t
from docuquarry.plans import alerts

#: (rule_id, project_id, alert_type, severity, config, escalate_after_days, is_enabled)
_RULES = [
    (1, None, "contract_expiring", "medium", '{"window_days": "60", "critical_days": 7}', 20, True), (2, 1, "contract_expiring", "low", '{"window_days": 400.9, "escalate_days": "x"}', None, True),
    (3, 2, "contract_expiring", "critical", "{}", 1, False), (4, None, "auto_renewal_notice", "low", '{"lead_days": 200, "critical_days": null}', 0, True), (5, None, "high_risk", "high", '{"risk_score_cutoff": 40}', 30, True),
    (6, 3, "high_risk", "low", '{"critical_score": "70"}', 10, True), (7, None, "missing_mandatory_clause", "medium", '{"clause_types": ["A_b", "C", "d"], "min_missing": 2}', None, True), (8, 4, "review_required", "info", '{"min_items": 3}', 5, True),
    (9, None, "obligation_due", "medium", None, 7, True), (10, 5, "obligation_due", "low", '{"overdue_days": 5, "window_days": true}', 7, True), (11, None, "processing_failed", "high", "{}", 1, True), (12, 4, "obligation_due", "high", "not json", None, False),
]
_RULE_COLUMNS = "rule_id int, project_id long, alert_type string, severity string, config string, escalate_after_days int, is_enabled boolean"
#: Which rule governs each kind in each project, with its thresholds, worked out by hand from _RULES: (kind, project or null for any other, severity, first, second, third threshold, days to escalation).
_GOVERNED = """g(kind, project, severity, a, b, c, after) AS (VALUES ('contract_expiring', NULL, 'medium', 60, 7, 30, 20), ('contract_expiring', 1, 'low', 400, 7, 30, NULL), ('auto_renewal_notice', NULL, 'low', 200, 14, 0, 0),
  ('high_risk', NULL, 'high', 40, 85, 0, 30), ('high_risk', 3, 'low', 67, 70, 0, 10), ('missing_mandatory_clause', NULL, 'medium', 2, 0, 0, NULL), ('review_required', 4, 'info', 3, 0, 0, 5),
  ('obligation_due', NULL, 'medium', 14, 30, 0, 7), ('obligation_due', 5, 'low', 1, 5, 0, 7)),
ru AS (SELECT p.project, k.kind, coalesce(o.severity, b.severity) AS severity, coalesce(o.a, b.a) AS a, coalesce(o.b, b.b) AS b, coalesce(o.c, b.c) AS c, CASE WHEN o.kind IS NOT NULL THEN o.after ELSE b.after END AS after
  FROM (SELECT DISTINCT o_custkey % 6 AS project FROM orders) AS p, (SELECT DISTINCT kind FROM g) AS k LEFT JOIN g AS o ON o.kind = k.kind AND o.project = p.project LEFT JOIN g AS b ON b.kind = k.kind AND b.project IS NULL
  WHERE coalesce(o.kind, b.kind) IS NOT NULL),
lad(s, i) AS (VALUES ('info', 1), ('low', 2), ('medium', 3), ('high', 4), ('critical', 5))"""


def _drafts_sql(name: str, today: str) -> str:
    """The six kinds on one day, as the tables name_c, name_o and name."""
    raised = lambda test, floor, other: f"CASE WHEN {test} AND severity NOT IN ({', '.join(repr(x) for x in ['critical', *(['high'] if floor == 'high' else [])])}) THEN '{floor}' ELSE {other} END"
    return f"""{name}_c AS (SELECT o_orderkey AS id, o_custkey % 6 AS project, CASE WHEN o_orderkey % 5 = 0 THEN 'Contract ' || o_orderkey WHEN o_orderkey % 5 = 1 THEN 'N-' || o_orderkey ELSE 'Order ' || o_orderkey END AS label,
  CASE WHEN o_orderkey % 17 = 0 THEN 'archived' WHEN o_orderkey % 19 = 0 THEN 'needs_review' ELSE 'active' END AS status, o_orderkey % 23 = 0 AS gone, o_orderkey % 7 <> 0 AS described, CAST(o_orderdate AS DATE) AS expiry,
  o_orderstatus = 'O' AS renews, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderdate AS DATE) - 20 END AS stated, CASE WHEN o_orderkey % 4 = 0 THEN CAST(o_custkey % 50 AS INTEGER) END AS notice,
  CASE WHEN o_orderstatus <> 'P' THEN CAST(floor(o_totalprice / 5000) AS INTEGER) END AS score, CASE WHEN o_orderpriority < '3' THEN ['c', 'a_B', 'zz'] WHEN o_orderpriority < '4' THEN ['D'] ELSE [] END AS missing, o_orderpriority = '5-LOW' AND o_orderkey % 2 = 0 AS flagged,
  coalesce(n, 0) AS pending FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1) ON l_orderkey = o_orderkey),
{name}_k AS (SELECT x.*, r.kind, r.severity, r.a, r.b, r.c, date_diff('day', DATE '{today}', expiry) AS n FROM {name}_c AS x JOIN ru AS r USING (project) WHERE NOT gone),
{name}_r AS (SELECT *, coalesce(stated, expiry - coalesce(notice, a)) AS due FROM {name}_k WHERE kind = 'auto_renewal_notice'),
{name}_o AS (SELECT l_orderkey * 10 + l_linenumber AS oid, k.id, k.project, k.label, k.severity, k.a, k.b, CAST(l_shipdate AS DATE) AS due, date_diff('day', DATE '{today}', CAST(l_shipdate AS DATE)) AS n,
  CASE WHEN l_linenumber = 1 THEN '' WHEN l_linenumber = 2 THEN repeat('pay ', 30) ELSE 'Deliver part ' || l_partkey END AS said, CASE WHEN l_suppkey % 2 = 0 THEN 'S' || l_suppkey END AS party
  FROM lineitem JOIN {name}_k AS k ON k.id = l_orderkey AND k.kind = 'obligation_due' WHERE l_linestatus = 'O' OR l_returnflag = 'A'),
{name}_d AS (SELECT *, CASE WHEN said = '' THEN 'An obligation' ELSE said END AS action FROM {name}_o WHERE n <= a AND n >= -b),
{name} AS (SELECT project, id, kind AS alert_type, {raised('n <= b', 'critical', raised('n > b AND n <= c', 'high', 'severity'))} AS severity, CASE WHEN n = 0 THEN label || ' expires today' ELSE label || ' expires in ' || n || ' days' END AS title,
  'The term ends on ' || expiry || '. Decide whether to renew, renegotiate or let it lapse before then.' AS message, 'expiring:' || id || ':' || expiry AS dedupe_key, expiry AS due_date FROM {name}_k WHERE kind = 'contract_expiring' AND status <> 'archived' AND described AND n BETWEEN 0 AND a
UNION ALL SELECT project, id, kind, {raised(f"date_diff('day', DATE '{today}', due) <= b", 'critical', 'severity')}, label || ' auto-renews unless notice is given by ' || due, 'This contract renews automatically. Notice must be served within ' || date_diff('day', DATE '{today}', due) || ' days (' || due || ') to stop it.'
  || CASE WHEN stated IS NULL THEN ' That date is calculated from the expiry date and the notice period, because no explicit notice deadline was extracted.' ELSE '' END, 'renewal:' || id || ':' || due, due FROM {name}_r WHERE status <> 'archived' AND described AND renews AND date_diff('day', DATE '{today}', due) BETWEEN 0 AND a
UNION ALL SELECT project, id, kind, {raised('score >= b', 'critical', 'severity')}, label || ' scored ' || score || ' for risk', 'The overall risk score is ' || score || ', at or above the ' || a || ' threshold for this project. ' || id % 4 || ' risk factors were identified.', 'high_risk:' || id, NULL
  FROM {name}_k WHERE kind = 'high_risk' AND status <> 'archived' AND described AND score >= a
UNION ALL SELECT project, id, kind, severity, label || ' is missing 2 mandatory clauses', 'These clause types are required by the document profile but were not found: a B, c.', 'missing_clause:' || id, NULL
  FROM {name}_k WHERE kind = 'missing_mandatory_clause' AND status <> 'archived' AND described AND len(missing) = 3
UNION ALL SELECT project, id, kind, severity, label || ' needs review', 'This contract was flagged for human review: ' || CASE WHEN pending > 0 THEN pending || ' clauses are waiting on a reviewer' ELSE 'extraction confidence fell below the profile''s threshold' END || '.', 'review_required:' || id, NULL
  FROM {name}_k WHERE kind = 'review_required' AND status <> 'archived' AND (flagged OR status = 'needs_review' OR pending >= a)
UNION ALL SELECT project, id, 'obligation_due', {raised('n < 0', 'high', 'severity')}, CASE WHEN n < 0 THEN 'Obligation ' || -n || ' days overdue: ' ELSE 'Obligation due in ' || n || ' days: ' END || CASE WHEN length(action) <= 90 THEN action ELSE left(action, 87) || '...' END,
  action || chr(10) || chr(10) || 'Due ' || due || coalesce(', owed by ' || party, '') || '. Contract: ' || label || '.', 'obligation:' || oid || ':' || due, due FROM {name}_d)"""


def _tables(spark, d):
    o, li = t(spark, d, "orders"), t(spark, d, "lineitem")
    key = F.col("o_orderkey")
    status = F.when(key % 17 == 0, "archived").when(key % 19 == 0, "needs_review").otherwise("active")
    contracts = o.select(
        key.alias("id"), (F.col("o_custkey") % 6).alias("project_id"), F.when(key % 5 > 1, F.concat(F.lit("Order "), key)).alias("title"), F.when(key % 5 == 1, F.concat(F.lit("N-"), key)).alias("contract_number"), F.lit("").alias("original_file_name"),
        status.alias("status"), ((F.col("o_orderpriority") == "5-LOW") & (key % 2 == 0)).alias("needs_review"), F.when(key % 23 == 0, F.col("o_orderdate")).alias("deleted_at"),
    )
    missing = F.when(F.col("o_orderpriority") < "3", F.array(*map(F.lit, ["c", "a_B", "zz"]))).when(F.col("o_orderpriority") < "4", F.array(F.lit("D"))).otherwise(F.array().cast("array<string>"))
    metadata = o.where(key % 7 != 0).select(
        key.alias("contract_id"), F.to_date("o_orderdate").alias("expiration_date"), (F.col("o_orderstatus") == "O").alias("auto_renewal"), F.when(key % 3 == 0, F.date_sub(F.to_date("o_orderdate"), 20)).alias("notice_deadline"),
        F.when(key % 4 == 0, (F.col("o_custkey") % 50).cast("int")).alias("auto_renewal_notice_days"), F.when(F.col("o_orderstatus") != "P", F.floor(F.col("o_totalprice") / 5000).cast("int")).alias("risk_score"), (key % 4).cast("int").alias("n_risk_factors"), missing.alias("missing_mandatory_clauses"),
    )
    action = F.when(F.col("l_linenumber") == 1, "").when(F.col("l_linenumber") == 2, "pay " * 30).otherwise(F.concat(F.lit("Deliver part "), "l_partkey"))
    owed = li.join(contracts.select(F.col("id").alias("l_orderkey"), "project_id"), "l_orderkey").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"), F.col("l_orderkey").alias("contract_id"), "project_id", F.to_date("l_shipdate").alias("due_date"), F.when((F.col("l_linestatus") == "O") | (F.col("l_returnflag") == "A"), F.when(F.col("l_linestatus") == "O", "open").otherwise("in_progress")).otherwise("met").alias("status"),
        action.alias("action"), F.when(F.col("l_suppkey") % 2 == 0, F.concat(F.lit("S"), "l_suppkey")).alias("responsible_party"),
    )
    pending = li.where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("contract_id")).agg(F.count("*").cast("int").alias("pending_clauses"))
    return contracts, metadata, owed, pending, spark.createDataFrame(_RULES, _RULE_COLUMNS)


@query(f"WITH {_GOVERNED}, {_drafts_sql('d', '2001-06-01')} SELECT project AS project_id, id AS contract_id, alert_type, severity, title, message, dedupe_key, due_date FROM d")
def collected_alerts(spark, d):
    """All six kinds over every contract and obligation."""
    return alerts.collect(*_tables(spark, d), F.lit("2001-06-01").cast("date")).drop("details")


@query(f"""WITH {_GOVERNED}, {_drafts_sql('d', '2001-06-01')}, {_drafts_sql('e', '2001-05-20')},
a AS (SELECT *, CASE id % 4 WHEN 0 THEN 'acknowledged' WHEN 3 THEN 'resolved' ELSE 'open' END AS status, CASE WHEN id % 9 = 0 THEN 1 END AS esc, CASE WHEN id % 2 = 0 THEN 12 ELSE 11 END AS age FROM e),
live AS (SELECT a.*, ru.after, ru.kind IS NOT NULL AS governed FROM a LEFT JOIN ru ON ru.project = a.project AND ru.kind = a.alert_type WHERE status <> 'resolved'),
j AS (SELECT coalesce(a.dedupe_key, d.dedupe_key) AS dedupe_key, a.status AS was, d.severity AS now, a.severity AS old, a.title AS old_title, left(d.title, 255) AS title, a.message <> d.message AS other, a.due_date AS old_due, d.due_date AS due, esc, age, after, governed, d.dedupe_key IS NOT NULL AS held
  FROM live AS a FULL JOIN d ON a.dedupe_key = d.dedupe_key),
s AS (SELECT j.*, CASE WHEN esc IS NULL THEN now ELSE (SELECT min_by(u.s, u.i) FROM lad AS u WHERE u.i = (SELECT least(l.i + 1, 5) FROM lad AS l WHERE l.s = now)) END AS kept FROM j),
p AS (SELECT *, coalesce(was = 'open' AND held AND esc IS NULL AND after > 0 AND age >= after, false) AS escalated FROM s)
SELECT dedupe_key, CASE WHEN was IS NULL THEN 'raise' WHEN NOT held THEN CASE WHEN governed THEN 'retire' ELSE 'hold' END WHEN kept <> old OR title <> old_title OR other OR due IS DISTINCT FROM old_due THEN 'refresh' ELSE 'keep' END AS action, escalated,
  CASE WHEN was IS NULL THEN now WHEN NOT held THEN old WHEN escalated THEN (SELECT min_by(u.s, u.i) FROM lad AS u WHERE u.i = (SELECT least(l.i + 1, 5) FROM lad AS l WHERE l.s = kept)) ELSE kept END AS severity,
  CASE WHEN was IS NULL THEN 'open' WHEN NOT held AND governed THEN 'resolved' ELSE was END AS status, coalesce(title, old_title) AS title, CASE WHEN held THEN due ELSE old_due END AS due_date FROM p""")
def alert_sweep(spark, d):
    """A sweep twelve days after the one whose alerts are stored: some acknowledged, escalated or resolved by hand."""
    tables = _tables(spark, d)
    key = F.col("contract_id")
    stored = alerts.collect(*tables, F.lit("2001-05-20").cast("date")).withColumns({
        "status": F.when(key % 4 == 0, "acknowledged").when(key % 4 == 3, "resolved").otherwise("open"), "escalated_at": F.when(key % 9 == 0, F.lit("2001-05-25").cast("timestamp")),
        "created_at": F.when(key % 2 == 0, F.lit("2001-05-20 06:00:00").cast("timestamp")).otherwise(F.lit("2001-05-20 18:00:00").cast("timestamp")),
    })
    return alerts.sweep(stored, alerts.collect(*tables, F.lit("2001-06-01").cast("date")), tables[-1], F.lit("2001-06-01 12:00:00").cast("timestamp"))
