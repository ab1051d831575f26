"""Registered queries of the registers, beside SQL that says the same.

Orders stand for contracts (priority: project, customer: user), their lines for obligations, key dates,
risks and clauses, events for jobs, runs and alerts, nations for projects.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docuquarry.catalog import query, t
from docuquarry.operators import listings
from docuquarry.operators import registers as g
from docuquarry.streaming import logs

_CONTRACT = """contract AS (SELECT o_orderkey AS contract_id, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS project_id, 'Order ' || o_orderkey AS title,
  CASE o_orderstatus WHEN 'F' THEN 'ready' WHEN 'O' THEN 'needs_review' ELSE 'archived' END AS status, CASE WHEN o_totalprice < 20000 THEN o_orderdate END AS deleted_at, o_orderdate AS created_at, o_totalprice, o_custkey FROM orders),
live AS (SELECT * FROM contract WHERE project_id IN (1, 2, 3) AND deleted_at IS NULL AND status NOT IN ('archived', 'failed'))"""
_LINE = """line AS (SELECT l_orderkey AS contract_id, l_linenumber AS line, 'party ' || l_suppkey AS responsible_party, CASE WHEN l_returnflag <> 'N' THEN CAST(l_shipdate AS DATE) END AS due_date,
  CASE l_linestatus WHEN 'O' THEN 'open' ELSE 'fulfilled' END AS status, l_returnflag || l_linestatus || ' part ' || l_partkey AS action, l_returnflag AS kind, l_shipdate AS created_at, l_quantity, l_discount, l_tax FROM lineitem)"""
_JOB = """job AS (SELECT event_id, user_id AS contract_id, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'queued' WHEN 'purchase' THEN 'ready' WHEN 'signup' THEN 'paused' ELSE 'failed' END AS state,
  CASE WHEN value > 60 THEN 'parser' ELSE 'extraction' END AS stage, ts, value FROM events)"""


def contracts(spark, d):
    o = t(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "ready").when(F.col("o_orderstatus") == "O", "needs_review").otherwise("archived")
    return o.select(
        F.col("o_orderkey").alias("contract_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("project_id"), F.concat(F.lit("Order "), "o_orderkey").alias("title"), status.alias("status"),
        F.when(F.col("o_totalprice") < 20000, F.col("o_orderdate")).alias("deleted_at"), F.col("o_orderdate").alias("created_at"), "o_totalprice", "o_custkey",
    )


def lines(spark, d):
    x = t(spark, d, "lineitem")
    return x.select(
        F.col("l_orderkey").alias("contract_id"), F.col("l_linenumber").alias("line"), F.concat(F.lit("party "), "l_suppkey").alias("responsible_party"),
        F.when(F.col("l_returnflag") != "N", F.to_date("l_shipdate")).alias("due_date"), F.when(F.col("l_linestatus") == "O", "open").otherwise("fulfilled").alias("status"),
        F.concat("l_returnflag", "l_linestatus", F.lit(" part "), "l_partkey").alias("action"), F.col("l_returnflag").alias("kind"), F.col("l_shipdate").alias("created_at"), "l_quantity", "l_discount", "l_tax",
    )


def jobs(spark, d):
    e = F.col("event_type")
    state = F.when(e == "view", "running").when(e == "click", "queued").when(e == "purchase", "ready").when(e == "signup", "paused").otherwise("failed")
    return t(spark, d, "events").select("event_id", F.col("user_id").alias("contract_id"), state.alias("state"), F.when(F.col("value") > 60, "parser").otherwise("extraction").alias("stage"), "ts", "value")


def live(spark, d):
    return g.live_contracts(contracts(spark, d), [1, 2, 3])


@query(f"WITH {_CONTRACT} SELECT contract_id, status FROM live")
def live_contract_scope(spark, d):
    return live(spark, d).select("contract_id", "status")


@query(f"""WITH {_CONTRACT}, {_LINE} SELECT contract_id, line.line, title, due_date, responsible_party FROM line JOIN live USING (contract_id)
WHERE line.status = 'open' AND responsible_party ILIKE '%party 1%' AND due_date BETWEEN DATE '1997-01-01' AND DATE '2000-12-31' AND action ILIKE '%PART 1%'""")
def obligation_register(spark, d):
    rows = lines(spark, d).withColumns({"due_description": F.lit(None).cast("string"), "trigger_event": F.lit(None).cast("string")})
    day = lambda x: F.lit(x).cast("date")
    out = g.obligation_register(rows, live(spark, d), ["open"], "Party 1", day("1997-01-01"), day("2000-12-31"), q="PART 1")
    return out.select("contract_id", "line", "title", "due_date", "responsible_party")


@query(f"WITH {_CONTRACT}, {_LINE} SELECT contract_id, line.line, title FROM line JOIN live USING (contract_id) WHERE due_date IS NULL")
def undated_obligations(spark, d):
    rows = lines(spark, d).withColumns({"due_description": F.lit(None).cast("string"), "trigger_event": F.lit(None).cast("string")})
    return g.obligation_register(rows, live(spark, d), undated=True).select("contract_id", "line", "title")


@query(f"""WITH {_CONTRACT}, {_LINE} SELECT contract_id, kind AS date_type, due_date AS date_value, title FROM line JOIN live USING (contract_id) WHERE kind IN ('A', 'N') AND (due_date >= DATE '1999-01-01')""")
def key_date_register(spark, d):
    rows = lines(spark, d).select("contract_id", F.col("kind").alias("date_type"), F.col("due_date").alias("date_value"))
    return g.key_date_register(rows, live(spark, d), ["A", "N"], F.lit("1999-01-01").cast("date"), unresolved=False)


_RISKS = f"""WITH {_CONTRACT}, {_LINE}, risk AS (SELECT contract_id, line.line, CASE WHEN l_discount > 0.08 THEN 'critical' WHEN l_discount > 0.05 THEN 'high' WHEN l_discount > 0.02 THEN 'medium' ELSE 'low' END AS severity,
  kind AS risk_type, l_tax > 0.06 AS is_omission, CASE WHEN l_tax > 0 THEN l_quantity END AS score_contribution, action AS description, created_at FROM line)"""


def risks(spark, d):
    x = F.col("l_discount")
    severity = F.when(x > 0.08, "critical").when(x > 0.05, "high").when(x > 0.02, "medium").otherwise("low")
    return lines(spark, d).select(
        "contract_id", "line", severity.alias("severity"), F.col("kind").alias("risk_type"), F.col("status").alias("category"), (F.col("l_tax") > 0.06).alias("is_omission"),
        F.when(F.col("l_tax") > 0, F.col("l_quantity")).alias("score_contribution"), F.col("action").alias("description"), F.lit(None).cast("string").alias("recommendation"), "created_at",
    )


@query(_RISKS + """ SELECT contract_id, line, severity, score_contribution, title, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS risk_score FROM risk JOIN live USING (contract_id)
LEFT JOIN (SELECT o_orderkey, c_acctbal FROM orders JOIN customer ON c_custkey = o_custkey WHERE c_acctbal > 0) ON o_orderkey = contract_id
WHERE severity IN ('critical', 'high') AND risk_type = 'R' AND NOT is_omission AND description ILIKE '%f part%'""")
def risk_register(spark, d):
    scores = t(spark, d, "orders").join(t(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("contract_id"), F.col("c_acctbal").alias("risk_score"))
    out = g.risk_register(risks(spark, d), live(spark, d), scores, ["critical", "high"], risk_type="R", omissions=False, q="F part")
    return out.select("contract_id", "line", "severity", "score_contribution", "title", "risk_score")


@query(_RISKS + """ SELECT contract_id, line, severity, score_contribution, description, count(*) OVER () AS total FROM risk
ORDER BY CASE severity WHEN 'critical' THEN 4 WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END DESC, score_contribution DESC NULLS LAST, contract_id, line, description LIMIT 50 OFFSET 100""")
def register_page(spark, d):
    rows = risks(spark, d).select("contract_id", "line", "severity", "score_contribution", "description")
    return g.numbered_page(rows, [g.severity_rank(F.col("severity")).desc(), F.desc_nulls_last("score_contribution"), F.col("contract_id"), F.col("line"), F.col("description")], 3, 50)


@query("""SELECT p_type || p_size AS key, max(p_type) AS name, max(p_size) AS priority, count(l_orderkey) AS clauses, count(l_orderkey) = 0 AS missing FROM (SELECT DISTINCT p_type, p_size FROM part WHERE p_size > 10)
LEFT JOIN (SELECT l_orderkey, q.p_type AS pt, q.p_size AS ps FROM lineitem JOIN part q ON q.p_partkey = l_partkey WHERE l_quantity > 48) ON pt = p_type AND ps = p_size GROUP BY 1""")
def clause_tabs(spark, d):
    part = t(spark, d, "part").withColumn("key", F.concat("p_type", "p_size"))
    categories = part.select("key", F.col("p_type").alias("name"), F.col("p_size").alias("priority"), (F.col("p_size") > 10).alias("is_active")).distinct()
    found = t(spark, d, "lineitem").where("l_quantity > 48").join(part, F.col("l_partkey") == F.col("p_partkey")).select(F.col("key").alias("clause_type"))
    return g.clause_tabs(categories, found)


@query("""SELECT n_nationkey AS project_id, n_name AS name FROM nation WHERE n_name ILIKE '%nation_1%' AND EXISTS (SELECT 1 FROM customer WHERE c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY' AND c_acctbal > 3000)""")
def accessible_projects(spark, d):
    projects = t(spark, d, "nation").select(F.col("n_nationkey").alias("project_id"), F.col("n_name").alias("name"), F.lit("active").alias("status"))
    members = t(spark, d, "customer").select(F.col("c_nationkey").alias("project_id"), F.col("c_mktsegment").alias("user_id"), (F.col("c_acctbal") > 3000).alias("is_favourite"))
    return g.accessible_projects(projects, members, "MACHINERY", q="nation_1", status="active", favourites=True).select("project_id", "name")


@query("""SELECT c_custkey AS user_id FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '3-MEDIUM'))""")
def members_with_permission(spark, d):
    users = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    members = t(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderstatus").alias("project_id"), F.col("o_orderpriority").alias("role"))
    roles = spark.createDataFrame([("1-URGENT", ["read", "sign"]), ("2-HIGH", ["read"]), ("3-MEDIUM", ["sign"]), ("5-LOW", [])], "role string, permissions array<string>")
    return g.members_with_permission(users, members, roles, "F", "sign")


@query("""SELECT c_custkey AS user_id, c_name AS name FROM customer WHERE (c_name ILIKE '%00001%' OR c_mktsegment ILIKE '%00001%') AND c_acctbal > 0 AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '2-HIGH')""")
def user_search(spark, d):
    users = t(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("name"), F.lit(None).cast("string").alias("email"), F.col("c_mktsegment").alias("title"), (F.col("c_acctbal") > 0).alias("is_active"))
    members = t(spark, d, "orders").select(F.col("o_custkey").alias("user_id"), F.col("o_orderpriority").alias("role"))
    return g.search_users(users, "00001", True, members, "2-HIGH").select("user_id", "name")


@query(f"WITH {_JOB} SELECT event_id, contract_id FROM job WHERE state = 'failed' AND stage = 'parser'")
def failed_jobs(spark, d):
    return g.filter_jobs(jobs(spark, d), ["queued"], "parser", failed_only=True).select("event_id", "contract_id")


@query(f"WITH {_JOB} SELECT count(*) FILTER (state NOT IN ('ready', 'failed', 'cancelled')) AS in_flight FROM job")
def jobs_in_flight(spark, d):
    return g.in_flight(jobs(spark, d))


@query(f"WITH {_JOB} SELECT contract_id, event_id, state FROM job WHERE state NOT IN ('ready', 'failed', 'cancelled') QUALIFY row_number() OVER (PARTITION BY contract_id ORDER BY ts DESC, event_id) = 1")
def active_jobs(spark, d):
    return g.active_job(jobs(spark, d), [F.desc("ts"), F.col("event_id")]).select("contract_id", "event_id", "state")


_RUN = """run AS (SELECT event_id, user_id, CASE WHEN value > 60 THEN 'parser' ELSE 'extraction' END AS stage, CASE event_type WHEN 'error' THEN 'failed' ELSE 'succeeded' END AS status, CASE WHEN value < 100 THEN ts END AS finished_at, event_id AS attempt FROM events)"""


def _runs(spark, d):
    e = t(spark, d, "events")
    return e.select("event_id", "user_id", F.when(F.col("value") > 60, "parser").otherwise("extraction").alias("stage"), F.when(F.col("event_type") == "error", "failed").otherwise("succeeded").alias("status"), F.when(F.col("value") < 100, F.col("ts")).alias("finished_at"), F.col("event_id").alias("attempt"))


@query(f"WITH {_RUN} SELECT user_id, stage, event_id FROM run WHERE status = 'succeeded' QUALIFY row_number() OVER (PARTITION BY user_id, stage ORDER BY finished_at DESC NULLS LAST, attempt DESC) = 1")
def latest_checkpoints(spark, d):
    return g.latest_checkpoint(_runs(spark, d), ["user_id", "stage"]).select("user_id", "stage", "event_id")


@query(f"WITH {_RUN} SELECT user_id, stage, attempt, status FROM run QUALIFY row_number() OVER (PARTITION BY user_id, stage ORDER BY attempt DESC) = 1")
def highest_attempts(spark, d):
    return g.highest_attempts(_runs(spark, d), ["user_id", "stage"])


@query("""WITH e AS (SELECT event_id, CASE WHEN value > 60 THEN 'chunk' ELSE 'clause' END AS level, user_id AS ref_id, CASE WHEN event_type = 'view' THEN 'seen' END AS title FROM events)
SELECT event_id, level, ref_id, coalesce(title, CASE level WHEN 'chunk' THEN c_mktsegment ELSE s_name END) AS title, CASE level WHEN 'chunk' THEN c_name ELSE s_name END AS text
FROM e LEFT JOIN customer ON c_custkey = ref_id AND level = 'chunk' LEFT JOIN supplier ON s_suppkey = ref_id AND level = 'clause'""")
def hydrated_hits(spark, d):
    hits = t(spark, d, "events").select("event_id", F.when(F.col("value") > 60, "chunk").otherwise("clause").alias("level"), F.col("user_id").alias("ref_id"), F.when(F.col("event_type") == "view", "seen").alias("title"))
    chunks = t(spark, d, "customer").select(F.col("c_custkey").alias("ref_id"), F.col("c_name").alias("text"), F.col("c_mktsegment").alias("title"))
    clauses = t(spark, d, "supplier").select(F.col("s_suppkey").alias("ref_id"), F.col("s_name").alias("text"), F.col("s_name").alias("title"))
    return g.hydrated(hits, chunks, clauses)


@query("""WITH m AS (SELECT p_type AS agreement_type, p_brand AS key, CAST(min(p_size) AS INTEGER) AS display_order FROM part WHERE p_size > 30 GROUP BY 1, 2)
SELECT *, true AS mapped FROM m UNION ALL SELECT a.agreement_type, b.key, NULL, false FROM (SELECT DISTINCT agreement_type FROM m) a, (SELECT DISTINCT p_brand AS key FROM part) b WHERE (a.agreement_type, b.key) NOT IN (SELECT agreement_type, key FROM m)""")
def clauses_by_type(spark, d):
    part = t(spark, d, "part")
    mapping = part.where("p_size > 30").groupBy(F.col("p_type").alias("agreement_type"), F.col("p_brand").alias("key")).agg(F.min("p_size").cast("int").alias("display_order"))
    return g.clauses_by_type(mapping, part.select(F.col("p_brand").alias("key")).distinct()).select("agreement_type", "key", "display_order", "mapped")


@query("""SELECT conv_id, turn, role AS clause_type, CASE WHEN role = 'assistant' THEN '[masked]' ELSE text END AS text, CASE WHEN role = 'assistant' THEN '[masked]' ELSE substr(text, 1, 20) END AS summary FROM conversations""")
def masked_clauses(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", F.col("role").alias("clause_type"), "text", F.substring("text", 1, 20).alias("summary"))
    return g.masked_clauses(rows, ["assistant"], permitted=False)


@query("""SELECT contract_id, count(*) FILTER (k = 'clauses') AS clauses, count(*) FILTER (k = 'risks') AS risks, count(*) FILTER (k = 'orders') AS orders FROM
(SELECT l_orderkey AS contract_id, 'clauses' AS k FROM lineitem UNION ALL SELECT l_orderkey, 'risks' FROM lineitem WHERE l_discount > 0.05 UNION ALL SELECT o_orderkey, 'orders' FROM orders) GROUP BY 1""")
def knowledge_counts(spark, d):
    x = lines(spark, d)
    return g.knowledge_counts({"clauses": x, "risks": x.where("l_discount > 0.05"), "orders": contracts(spark, d)})


@query("""SELECT l_orderkey AS contract_id, count(*) FILTER (l_linestatus = 'O') AS pending FROM lineitem GROUP BY 1""")
def pending_clauses(spark, d):
    return g.grouped_counts(lines(spark, d), ["contract_id"], pending=F.col("status") == "open")


@query("""SELECT c_nationkey AS project_id, count(*) AS members, count(*) FILTER (c_acctbal > 0) AS active FROM customer GROUP BY 1""")
def member_counts(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_nationkey").alias("project_id"), "c_acctbal")
    return g.grouped_counts(rows, ["project_id"], members=F.lit(True), active=F.col("c_acctbal") > 0)


@query("""SELECT (SELECT count(*) FROM orders) AS documents, count(*) AS clauses, CAST(sum(CASE WHEN l_quantity > 25 THEN 2 ELSE 1 END) AS BIGINT) AS boxes, round(count(*) / (SELECT count(*) FROM orders), 1) AS per_document FROM lineitem""")
def document_totals(spark, d):
    boxes = F.when(F.col("l_quantity") > 25, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return g.document_totals(lines(spark, d).withColumn("boxes", boxes), contracts(spark, d))


@query("""WITH x AS (SELECT DISTINCT p_type AS agreement_type, p_size // 10 AS profile, p_brand AS c FROM part)
SELECT agreement_type, documents, expected FROM (SELECT p_type AS agreement_type, count(*) AS documents FROM part GROUP BY 1) JOIN
(SELECT agreement_type, CAST(max(n) AS INTEGER) AS expected FROM (SELECT agreement_type, profile, count(DISTINCT c) AS n FROM x GROUP BY 1, 2) GROUP BY 1) USING (agreement_type)""")
def documents_by_type(spark, d):
    part = t(spark, d, "part").withColumn("profile", F.expr("p_size div 10"))
    big = F.col("p_retailprice") > 905
    profiles = part.groupBy(F.col("p_type").alias("agreement_type"), "profile").agg(F.collect_set(F.when(big, F.col("p_brand"))).alias("mandatory"), F.collect_set(F.when(~big, F.col("p_brand"))).alias("optional"))
    return g.documents_by_type(part.select(F.col("p_type").alias("agreement_type")), g.expected_clause_counts(profiles))


@query("""WITH r AS (SELECT l_orderkey, l_returnflag AS rule, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_orderkey, CAST(sum(n) AS BIGINT) AS rejected, (SELECT CAST(count(DISTINCT l_linestatus) AS INTEGER) FROM lineitem x WHERE x.l_orderkey = r.l_orderkey) AS reasons, first(rule ORDER BY n DESC, rule) AS dominant_rule FROM r GROUP BY 1""")
def rejection_diagnostics(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", F.col("l_linestatus").alias("reason"), F.col("l_returnflag").alias("rule"))
    return g.rejection_diagnostics(rows, ["l_orderkey"])


@query("""SELECT event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN value < 100 THEN floor(value / 10) END NULLS LAST, event_type = 'view' DESC, CASE event_type WHEN 'view' THEN 0 ELSE floor(value) END, event_id) AS INTEGER) AS place FROM events""")
def document_order(spark, d):
    number = F.when(F.col("event_type") != "view", F.concat_ws(".", "user_id", F.floor("value").cast("string")))
    rows = t(spark, d, "events").select("event_id", "user_id", F.when(F.col("value") < 100, F.floor(F.col("value") / 10)).alias("page"), number.alias("number"))
    w = Window.partitionBy("user_id").orderBy(*g.document_order("page", "number", "event_id"))
    return rows.select("event_id", F.row_number().over(w).alias("place"))


@query("SELECT event_id, value FROM events WHERE value IS NOT NULL ORDER BY value DESC, event_id LIMIT 20")
def worst_cases(spark, d):
    return g.top_cases(t(spark, d, "events").select("event_id", "value"), "value", "event_id")


@query(f"WITH {_CONTRACT} SELECT contract_id, created_at FROM contract WHERE project_id IN (2, 4) AND deleted_at IS NULL ORDER BY created_at DESC, contract_id LIMIT 20")
def recent_activity(spark, d):
    return g.newest(contracts(spark, d), [2, 4], tie="contract_id").select("contract_id", "created_at")


@query("""WITH a AS (SELECT o_orderkey, o_totalprice AS v, o_orderstatus AS s, CASE WHEN o_orderpriority > '3' THEN o_orderpriority END AS p FROM orders),
b AS (SELECT o_orderkey, CASE WHEN v > 250000 THEN v ELSE v + 1 END AS v2, CASE s WHEN 'P' THEN NULL ELSE s END AS s2, p AS p2, v, s, p FROM a)
SELECT o_orderkey, 'status' AS field_name, s AS old_value, s2 AS new_value FROM b WHERE s IS DISTINCT FROM s2 UNION ALL SELECT o_orderkey, 'priority', p, '9' FROM b WHERE p IS DISTINCT FROM '9'""")
def change_history(spark, d):
    old = t(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), F.when(F.col("o_orderpriority") > "3", F.col("o_orderpriority")).alias("priority"), F.lit(1).alias("same"))
    new = old.select("o_orderkey", F.when(F.col("status") != "P", F.col("status")).alias("status"), F.lit("9").alias("priority"), "same")
    return g.change_history(old, new, "o_orderkey", ["status", "priority", "same"])


@query("""SELECT l_orderkey, coalesce(a, 0) + coalesce(r, 0) AS pages, CASE WHEN r IS NULL THEN a END AS only_old FROM (SELECT l_orderkey, sum(l_quantity) FILTER (l_returnflag = 'A') AS a, sum(l_quantity) FILTER (l_returnflag = 'R') AS r FROM lineitem GROUP BY 1)""")
def merged_metrics(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(*[F.sum(F.when(F.col("l_returnflag") == f, F.col("l_quantity"))).alias(f) for f in "AR"])
    kept = lambda c: F.when(F.col(c).isNotNull(), F.create_map(F.lit("pages"), F.col(c)))
    both = g.merged_metrics(kept("A"), kept("R"))
    return rows.select("l_orderkey", F.coalesce(F.try_element_at(both, F.lit("pages")), F.lit(0.0)).alias("pages"), F.when(F.col("R").isNull(), F.try_element_at(both, F.lit("pages"))).alias("only_old"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN '9' ELSE o_orderpriority END AS priority, CASE WHEN o_orderstatus = 'P' THEN o_orderpriority END AS first_priority, CASE WHEN o_orderstatus = 'P' THEN 'corrected' ELSE 'pending' END AS review_status, o_orderstatus AS kept FROM orders""")
def reviewed_clauses(spark, d):
    o = t(spark, d, "orders")
    rows = o.select("o_orderkey", F.create_map(F.lit("priority"), "o_orderpriority", F.lit("status"), "o_orderstatus").alias("attributes"), F.lit(None).cast("map<string,string>").alias("original_attributes"), F.lit("pending").alias("review_status"))
    patch = F.when(F.col("attributes")["status"] == "P", F.create_map(F.lit("priority"), F.lit("9")))
    out = g.corrected(rows, patch)
    return out.select("o_orderkey", F.col("attributes")["priority"].alias("priority"), F.col("original_attributes")["priority"].alias("first_priority"), "review_status", F.col("attributes")["status"].alias("kept"))


@query("""SELECT user_id, event_id, '***redacted***' AS api_key, CASE WHEN length(k) > 2000 THEN substr(k, 1, 2000) || '... [' || length(k) || ' chars]' ELSE k END AS note FROM (SELECT user_id, event_id, repeat(event_type, CASE WHEN value > 90 THEN 400 ELSE 1 END) AS k FROM events)""")
def redacted_logs(spark, d):
    note = F.repeat("event_type", F.when(F.col("value") > 90, 400).otherwise(1))
    payload = g.redacted(F.create_map(F.lit("User_API_KEY"), F.col("props"), F.lit("note"), note))
    return t(spark, d, "events").select("user_id", "event_id", payload.alias("m")).select("user_id", "event_id", F.col("m")["User_API_KEY"].alias("api_key"), F.col("m")["note"].alias("note"))


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus <> 'F' THEN o_orderstatus END AS was, CASE WHEN o_orderstatus <> 'F' THEN 'F' END AS now, CAST(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END AS INTEGER) AS n FROM orders""")
def changed_fields(spark, d):
    before = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("priority"), F.col("o_orderpriority"), F.lit("updated_at"), F.lit("1"))
    after = F.create_map(F.lit("status"), F.lit("F"), F.lit("priority"), F.col("o_orderpriority"), F.lit("updated_at"), F.lit("2"))
    a, b = g.changed_only(before, after)
    rows = t(spark, d, "orders").select("o_orderkey", a.alias("a"), b.alias("b"))
    return rows.select("o_orderkey", F.try_element_at("a", F.lit("status")).alias("was"), F.try_element_at("b", F.lit("status")).alias("now"), F.size("a").alias("n"))


@query("SELECT * FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'MACHINERY')")
def rows_by_ids(spark, d):
    ids = t(spark, d, "customer").where("c_mktsegment = 'MACHINERY'").select(F.col("c_custkey").alias("o_custkey"))
    return g.by_ids(t(spark, d, "orders"), ids, "o_custkey").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")


@query("SELECT o_custkey AS contract_id, o_orderpriority AS project_id, o_orderkey, o_totalprice FROM orders WHERE o_custkey = 7 AND o_orderpriority = '2-HIGH' AND o_orderstatus IN ('F', 'O')")
def child_list(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("contract_id"), F.col("o_orderpriority").alias("project_id"), "o_orderkey", "o_totalprice", "o_orderstatus")
    return g.child_list(rows, 7, "2-HIGH", ("o_orderstatus", ["F", "O"]), [F.desc_nulls_last("o_totalprice"), F.col("o_orderkey")]).drop("o_orderstatus")


@query("""SELECT event_id, user_id FROM events WHERE user_id IN (1, 2, 3) AND event_type IN ('view', 'click') ORDER BY CASE WHEN value < 50 THEN CAST(ts AS DATE) END ASC NULLS LAST, ts DESC, event_id""")
def alert_list(spark, d):
    rows = t(spark, d, "events").select("event_id", "user_id", F.col("user_id").alias("project_id"), F.col("event_type").alias("status"), F.when(F.col("value") < 50, F.to_date("ts")).alias("due_date"), F.col("ts").alias("created_at"))
    return g.alert_list(rows, [1, 2, 3], ["view", "click"]).select("event_id", "user_id")


@query(_RISKS + " SELECT contract_id, count(*) FILTER (severity = 'critical') AS critical, count(*) FILTER (severity = 'high') AS high, count(*) FILTER (severity = 'medium') AS medium, count(*) FILTER (severity = 'low') AS low FROM risk GROUP BY 1")
def severity_counts(spark, d):
    return g.severity_counts(risks(spark, d), ["contract_id"])


@query("""WITH l AS (SELECT user_id, event_id % 40 AS run, ts, event_id, CASE event_type WHEN 'view' THEN 'started' WHEN 'purchase' THEN 'succeeded' WHEN 'error' THEN 'failed' ELSE 'heartbeat' END AS status FROM events),
g AS (SELECT user_id, run, max(ts) FILTER (status = 'started') AS started_at, max({'a': ts, 's': status}) FILTER (status IN ('succeeded', 'failed')) AS e, count(*) FILTER (status = 'started') AS attempts FROM l GROUP BY ALL),
o AS (SELECT *, e IS NOT NULL AND (started_at IS NULL OR e.a >= started_at) AS over FROM g)
SELECT user_id, run, started_at, CASE WHEN over THEN e.a END AS ended_at, CASE WHEN over THEN e.s WHEN started_at IS NOT NULL THEN 'running' ELSE 'pending' END AS status, attempts,
  CASE WHEN over THEN CAST(floor((epoch_us(e.a) - epoch_us(started_at)) / 1000) AS BIGINT) END AS duration_ms FROM o""")
def stage_run_states(spark, d):
    """Every run's state from the append-only log of its events."""
    status = F.when(F.col("event_type") == "view", "started").when(F.col("event_type") == "purchase", "succeeded").when(F.col("event_type") == "error", "failed").otherwise("heartbeat")
    log = t(spark, d, "events").select("user_id", (F.col("event_id") % 40).alias("run"), F.col("ts").alias("at"), status.alias("status"))
    return logs.stage_runs(log, ["user_id", "run"]).drop("error")


def _audit_rows(spark, d):
    e = t(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"), F.when(F.col("event_id") % 4 > 0, F.col("user_id") % 5).alias("project_id"), "user_id", F.col("event_type").alias("action"), (F.col("value") > 20).alias("succeeded"), F.when(F.col("event_id") % 13 == 0, F.col("ts")).alias("deleted_at"))


@query("""SELECT event_id AS id, event_type AS action, CASE WHEN event_id % 4 > 0 THEN user_id % 5 END AS project_id FROM events WHERE event_id % 13 <> 0 AND (event_id % 4 = 0 OR user_id % 5 IN (1, 3)) AND event_type IN ('click', 'error') AND value > 20
ORDER BY ts DESC, event_id DESC LIMIT 40 OFFSET 80""")
def audit_trail(spark, d):
    """The third page of an audit trail of two projects and the platform, with filters."""
    return listings.audit_trail(_audit_rows(spark, d), [1, 3], 3, 40, action=["click", "error"], succeeded=True, user_id=None).select("id", "action", "project_id")


@query("""SELECT user_id, count(*) FILTER (event_type = 'error') AS failures, count(*) FILTER (event_type IN ('click', 'view') AND value > 20) AS reads, bool_or(event_type = 'error') AS has_failures, bool_or(event_type IN ('click', 'view') AND value > 20) AS has_reads FROM events WHERE event_id % 13 <> 0 GROUP BY 1""")
def existence_counts(spark, d):
    return listings.counts(_audit_rows(spark, d), "user_id", failures={"action": "error"}, reads={"action": ["click", "view"], "succeeded": True, "project_id": None})


@query("""SELECT agreement_type, CAST(row_number() OVER (ORDER BY agreement_type = 'other', agreement_type) - 1 AS INTEGER) AS place FROM (SELECT DISTINCT p_type AS agreement_type FROM part WHERE p_size > 10 AND p_partkey % 9 <> 0 UNION ALL SELECT 'other')""")
def known_document_types(spark, d):
    profiles = t(spark, d, "part").select(F.col("p_type").alias("agreement_type"), (F.col("p_size") > 10).alias("is_active"), F.when(F.col("p_partkey") % 9 == 0, F.lit("x")).alias("deleted_at"))
    return listings.known_types(profiles)


@query("""SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS created_at, strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') AS due, round(o_totalprice, 2) AS value, upper(o_orderstatus) || '!' AS status FROM orders""")
def order_responses(spark, d):
    return listings.response(t(spark, d, "orders"), {"id": "o_orderkey", "created_at": "o_orderdate", "due": F.date_add(F.to_date("o_orderdate"), 30), "value": F.col("o_totalprice").cast("decimal(18,2)"), "status": F.concat(F.upper("o_orderstatus"), F.lit("!"))})
