"""The registered queries over the driver tables, each beside SQL that says the same.

There are no contracts in the tables: orders stand for contracts, their customers for parties, nations
for projects, lines for clauses, document lines for chunks and events for the stage log.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docuquarry.functions import text as tx
from docuquarry.functions import vectors as vx
from docuquarry.operators import aggregates as agg
from docuquarry.operators import predicates as p
from docuquarry.operators import relational as r
from docuquarry.plans import metrics, retrieval, rules

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
#: Queries never use the clock; this is their day.
TODAY = "2001-06-01"


def query(sql: str | None = None):
    """Registers a function under its name, with its SQL."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def contracts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "orders").join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))


def days_left(column: str):
    return F.datediff(F.to_date(F.col(column)), F.lit(TODAY).cast("date"))


EXPIRY = "CAST(date_diff('day', DATE '2001-06-01', CAST(o_orderdate AS DATE)) AS INTEGER)"


@query("""SELECT lower(trim(c_name)) AS party_key, max(c_name) AS name, count(DISTINCT o_orderkey) AS contracts, bool_or(c_acctbal > 9000) AS is_primary,
  string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS roles, max(CAST(o_orderdate AS DATE)) AS last_expiry, min(c_custkey) AS sample
FROM customer JOIN orders ON o_custkey = c_custkey WHERE trim(c_name) <> '' GROUP BY 1 ORDER BY contracts DESC, party_key LIMIT 200""")
def party_directory(spark, d):
    rows = agg.party_directory(contracts(spark, d), F.col("c_name"), "o_orderkey", F.col("c_acctbal") > 9000, F.col("c_mktsegment"), F.to_date("o_orderdate"), "c_custkey")
    return rows.orderBy(F.desc("contracts"), "party_key").limit(200)


@query("""SELECT o_orderkey, c_name, o_orderstatus, o_totalprice FROM orders LEFT JOIN customer ON o_custkey = c_custkey
WHERE coalesce(c_name, '') ILIKE '%00001%' AND o_orderstatus IN ('F', 'O') AND o_totalprice BETWEEN 1000 AND 200000
  AND o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '2000-01-01' AND (c_acctbal > 0) IS TRUE""")
def contract_filters(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer").withColumn("good", F.col("c_acctbal") > 0), F.col("o_custkey") == F.col("c_custkey"), "left")
    wanted = [
        p.contains_text("00001", "c_name"), p.one_of("o_orderstatus", ["F", "O"]), p.between("o_totalprice", 1000, 200000), p.flag("good", True), p.one_of("c_mktsegment", None),
        p.between("o_orderdate", F.lit("1996-01-01").cast("timestamp"), F.lit("2000-01-01").cast("timestamp")),
    ]
    return rows.where(p.all_of(wanted)).select("o_orderkey", "c_name", "o_orderstatus", "o_totalprice")


@query("SELECT * FROM customer WHERE c_nationkey IN (1, 3, 5)")
def project_scope(spark, d):
    return p.scoped(t(spark, d, "customer"), [1, 3, 5], "c_nationkey")


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(spark, d):
    return t(spark, d, "orders").where("o_orderkey = 7").limit(1)


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 20 OFFSET 40")
def paged_listing(spark, d):
    return r.page(t(spark, d, "orders").where("o_orderstatus = 'F'"), "value", {"value": "o_totalprice"}, True, "o_orderkey", 40, 20).select("o_orderkey", "o_totalprice")


@query("SELECT s_suppkey, s_name FROM supplier WHERE lower(coalesce(s_name, '')) = 'supplier#000000007'")
def folded_equality(spark, d):
    return t(spark, d, "supplier").where(p.same_folded("s_name", " Supplier#000000007 ")).select("s_suppkey", "s_name")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '2001-06-01' AND DATE '2001-06-01' + 30")
def expiring_within(spark, d):
    rows = t(spark, d, "orders").withColumn("day", F.to_date("o_orderdate"))
    return rows.where(p.within_days("day", F.lit(TODAY).cast("date"), 30)).select("o_orderkey")


@query("SELECT event_id FROM events WHERE json_extract_string(props, '$.k') = '3'")
def json_containment(spark, d):
    return t(spark, d, "events").where(p.holds_object("props", {"k": 3})).select("event_id")


def _tagged(spark, d):
    lines = t(spark, d, "lineitem").where("l_quantity > 25").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("tags"))
    return t(spark, d, "orders").select("o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")


@query("""SELECT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 25 GROUP BY 1 HAVING bool_or(l_returnflag = 'A') AND bool_or(l_returnflag = 'R')""")
def tags_contain_all(spark, d):
    return _tagged(spark, d).where(p.has_all("tags", ["A", "R"])).select("o_orderkey")


@query("""SELECT DISTINCT l_orderkey AS o_orderkey FROM lineitem WHERE l_quantity > 25 AND l_returnflag IN ('A', 'R')""")
def tags_contain_any(spark, d):
    return _tagged(spark, d).where(p.has_any("tags", ["A", "R"])).select("o_orderkey")


@query("""SELECT count(*) AS filled FROM (SELECT DISTINCT l_orderkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_quantity > 25)""")
def array_emptiness(spark, d):
    return _tagged(spark, d).where(p.non_empty("tags", True)).agg(F.count("*").alias("filled"))


@query("""SELECT event_id FROM events WHERE (CASE WHEN user_id % 3 = 0 THEN NULL ELSE user_id END) IN (1, 2, 4) OR user_id % 3 = 0""")
def scope_with_global(spark, d):
    rows = t(spark, d, "events").withColumn("owner", F.when(F.col("user_id") % 3 != 0, F.col("user_id")))
    return rows.where(p.scope_or_global("owner", [1, 2, 4])).select("event_id")


@query("""SELECT event_id FROM events WHERE event_type = 'view' AND ((CASE WHEN value > 50 THEN ts END) < TIMESTAMP '2024-01-15' - INTERVAL 45 MINUTE
  OR (NOT coalesce(value > 50, false) AND ts < TIMESTAMP '2024-01-15' - INTERVAL 45 MINUTE))""")
def stalled_jobs(spark, d):
    rows = t(spark, d, "events").select("event_id", F.when(F.col("event_type") == "view", "running").alias("state"), F.when(F.col("value") > 50, F.col("ts")).alias("heartbeat_at"), F.col("ts").alias("updated_at"))
    return rows.where(p.stalled("2024-01-15 00:00:00")).select("event_id")


@query("""SELECT value, n, round(100.0 * n / sum(n) OVER (), 2) AS pct FROM (SELECT coalesce(CASE WHEN o_orderpriority LIKE '5%' THEN NULL ELSE o_orderpriority END, 'unknown') AS value, count(*) AS n FROM orders GROUP BY 1)""")
def distribution(spark, d):
    return r.distribution(t(spark, d, "orders").withColumn("priority", F.when(~F.col("o_orderpriority").like("5%"), F.col("o_orderpriority"))), "priority")


@query(f"""SELECT count(*) AS total, count(*) FILTER ({EXPIRY} BETWEEN 0 AND 90) AS expiring, count(*) FILTER (o_totalprice >= 200000) AS high_risk,
  count(*) FILTER (o_orderstatus = 'P') AS needs_review, count(*) FILTER (o_orderpriority IS NULL) AS missing FROM orders""")
def dashboard_counts(spark, d):
    return agg.kpi_counts(t(spark, d, "orders"), expiring=days_left("o_orderdate").between(0, 90), high_risk=F.col("o_totalprice") >= 200000, needs_review=F.col("o_orderstatus") == "P", missing=F.col("o_orderpriority").isNull())


@query("""SELECT c_custkey, currency, CAST(sum(v) AS DOUBLE) AS value FROM (SELECT c_custkey, coalesce(CASE WHEN c_nationkey % 4 = 0 THEN NULL ELSE c_mktsegment END, 'unknown') AS currency, o_orderkey, max(CAST(o_totalprice AS DECIMAL(18, 2))) AS v
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3) GROUP BY 1, 2""")
def value_by_party_currency(spark, d):
    return agg.value_by_currency(contracts(spark, d), "c_custkey", "o_orderkey", F.col("o_totalprice").cast("decimal(18,2)"), F.when(F.col("c_nationkey") % 4 != 0, F.col("c_mktsegment")))


@query("""SELECT l_returnflag || l_linestatus AS clause_type, count(*) AS n_rows, count(DISTINCT l_orderkey) AS documents FROM lineitem GROUP BY 1 ORDER BY n_rows DESC, 1""")
def clause_frequency(spark, d):
    return agg.frequency(t(spark, d, "lineitem"), F.concat("l_returnflag", "l_linestatus"), "l_orderkey")


@query("""SELECT user_id, event_type, count(*) AS n, count(*) FILTER (value > 50) AS delayed, count(*) - count(*) FILTER (value > 50) AS waiting FROM events GROUP BY 1, 2""")
def queue_stats(spark, d):
    return agg.queue_counts(t(spark, d, "events"), ["user_id", "event_type"], F.col("value") > 50)


@query("""SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL AND event_type <> 'error' GROUP BY 1""")
def stage_durations(spark, d):
    return agg.mean_durations(t(spark, d, "events"), "event_type", "value", F.col("event_type") != "error")


@query("""SELECT CASE WHEN sum(CASE WHEN event_type IN ('purchase', 'error') THEN 1 ELSE 0 END) = 0 THEN 0.0 ELSE round(count(*) FILTER (event_type = 'purchase') * 1.0 / count(*) FILTER (event_type IN ('purchase', 'error')), 4) END AS success_rate FROM events""")
def success_rate(spark, d):
    return agg.success_rate(t(spark, d, "events"), F.col("event_type") == "purchase", F.col("event_type") == "error")


@query("""SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) > DATE '2024-01-10' GROUP BY 1""")
def uploads_per_day(spark, d):
    return agg.per_day(t(spark, d, "events"), "ts", after="2024-01-10")


@query("""SELECT o_orderkey, count(DISTINCT l_returnflag || l_linestatus) AS found, round(count(DISTINCT l_returnflag || l_linestatus) / 6.0, 3) AS coverage FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1""")
def coverage_per_document(spark, d):
    return agg.coverage(t(spark, d, "orders"), "o_orderkey", t(spark, d, "lineitem"), "l_orderkey", F.concat("l_returnflag", "l_linestatus"), 6)


@query("""SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1""")
def latest_job(spark, d):
    return r.latest_per_key(t(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate"), ["o_custkey"], F.desc("o_orderdate"), F.desc("o_orderkey")).select("o_custkey", "o_orderkey")


@query("""SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1""")
def representative_rows(spark, d):
    return agg.representative(t(spark, d, "documents"), F.sha2("text", 256), "doc_id", "content_hash")


@query("""SELECT n_nationkey, p_type FROM (SELECT DISTINCT n_nationkey, p_type FROM nation, (SELECT DISTINCT p_type FROM part))
WHERE (n_nationkey, p_type) NOT IN (SELECT s_nationkey, p_type FROM lineitem JOIN supplier ON s_suppkey = l_suppkey JOIN part ON p_partkey = l_partkey WHERE l_quantity > 49)""")
def missing_clauses(spark, d):
    expected = t(spark, d, "nation").select("n_nationkey", F.explode(r.listed(t(spark, d, "part"), "p_type")).alias("p_type"))
    seen = t(spark, d, "lineitem").where("l_quantity > 49").join(t(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey")).join(t(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return r.missing_from(expected, seen.select(F.col("s_nationkey").alias("n_nationkey"), "p_type"), ["n_nationkey", "p_type"])


@query("""SELECT coalesce(a.o_custkey, b.o_custkey) AS o_custkey, CASE WHEN a.o_custkey IS NOT NULL AND b.o_custkey IS NOT NULL THEN 'both' WHEN a.o_custkey IS NOT NULL THEN 'baseline' ELSE 'candidate' END AS side
FROM (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F') a FULL JOIN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'P') b USING (o_custkey)""")
def version_comparison(spark, d):
    o = t(spark, d, "orders")
    return r.key_sets(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus = 'P'"), ["o_custkey"])


@query("""SELECT DISTINCT b.l_orderkey, b.l_linenumber FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND abs(a.l_linenumber - b.l_linenumber) = 1
WHERE a.l_quantity > 45 AND (b.l_orderkey, b.l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_quantity > 45)""")
def neighbour_window(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return r.neighbours(rows, rows.where("l_quantity > 45"), ["l_orderkey"], "l_linenumber", 1).select("l_orderkey", "l_linenumber").distinct()


@query("""SELECT conv_id, turn, CAST(used AS BIGINT) AS used FROM (SELECT conv_id, turn, sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 400""")
def token_budget(spark, d):
    rows = t(spark, d, "conversations").withColumn("cost", F.length("text"))
    return r.running_budget(rows, ["conv_id"], [F.col("turn")], "cost", 400).select("conv_id", "turn", "used")


@query("""SELECT user_id, event_id, coalesce(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0.0) AS metric FROM events""")
def carry_forward_trend(spark, d):
    rows = t(spark, d, "events").select("user_id", "event_id", F.struct("ts", "event_id").alias("_o"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("metric"))
    return r.carry_forward(rows, ["user_id"], "_o", "metric").drop("_o")


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS id, p_partkey // 3 AS ancestor, 1 AS depth FROM part WHERE p_partkey // 3 > 0
UNION ALL SELECT id, ancestor // 3, depth + 1 FROM w WHERE ancestor // 3 > 0 AND depth < 12) SELECT id, ancestor, depth FROM w""")
def ancestor_walk(spark, d):
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("nullif(p_partkey div 3, 0)").alias("parent_id"))
    return r.ancestors(rows, rows.select("id"))


@query("""WITH RECURSIVE w AS (SELECT p_partkey AS id, p_partkey // 3 AS ancestor, 1 AS depth FROM part WHERE p_partkey // 3 > 0
UNION ALL SELECT id, ancestor // 3, depth + 1 FROM w WHERE ancestor // 3 > 0 AND depth < 12) SELECT id, ancestor, depth FROM w""")
def ancestor_walk_all(spark, d):
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.expr("nullif(p_partkey div 3, 0)").alias("parent_id"))
    return r.ancestors(rows, rows.select("id"))


@query("""SELECT o_orderkey, o_orderpriority, o_totalprice FROM orders WHERE o_orderstatus = 'P' ORDER BY CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 4 WHEN '2' THEN 3 WHEN '3' THEN 2 WHEN '4' THEN 1 ELSE 0 END DESC, o_totalprice DESC, o_orderkey LIMIT 25""")
def severity_ordering(spark, d):
    severity = F.element_at(F.array(*[F.lit(x) for x in ["critical", "high", "medium", "low", "none"]]), F.substring("o_orderpriority", 1, 1).cast("int"))
    return agg.top_by_severity(t(spark, d, "orders").where("o_orderstatus = 'P'"), severity, "o_totalprice", "o_orderkey").select("o_orderkey", "o_orderpriority", "o_totalprice")


WIDE = r"[\s\x{0B}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_HASHED = f"""sha256(trim(regexp_replace(text, '{WIDE}+', ' ', 'g'))) AS content_hash,
  CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / CASE WHEN length(text) - length(regexp_replace(text, '{WIDE}', '', 'g')) >= 0.25 * length(text) THEN 3.0 ELSE 3.6 END) AS INTEGER)) END AS tokens"""


@query(f"SELECT doc_id, {_HASHED} FROM documents")
def content_hashes(spark, d):
    return t(spark, d, "documents").select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), tx.token_estimate(F.col("text")).alias("tokens"))


@query(f"SELECT doc_id, {_HASHED} FROM (SELECT doc_id, translate(text, ' ,', chr(160) || chr(8195)) AS text FROM documents)")
def content_hashes_of_wide_space(spark, d):
    """Every space a no-break space and every comma an em space."""
    rows = t(spark, d, "documents").select("doc_id", F.translate("text", " ,", "\u00a0\u2003").alias("text"))
    return rows.select("doc_id", tx.content_hash(F.col("text")).alias("content_hash"), tx.token_estimate(F.col("text")).alias("tokens"))



@query("""SELECT o_orderkey, CASE WHEN s >= 67 THEN 'high' WHEN s >= 34 THEN 'medium' ELSE 'low' END AS band FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_totalprice / 5000 END AS s FROM orders)""")
def risk_bands(spark, d):
    score = F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice") / 5000)
    return t(spark, d, "orders").select("o_orderkey", tx.risk_band(score).alias("band"))


@query(f"""SELECT o_orderkey, 'expiry:' || o_orderkey || ':' || CAST(o_orderdate AS DATE) AS dedupe_key, CASE WHEN {EXPIRY} <= 7 THEN 'critical' WHEN {EXPIRY} <= 30 THEN 'high' ELSE 'medium' END AS severity FROM orders WHERE {EXPIRY} BETWEEN 0 AND 90""")
def expiry_alerts(spark, d):
    rows = t(spark, d, "orders").withColumn("severity", rules.expiry_alert(days_left("o_orderdate"))).where("severity IS NOT NULL")
    return rows.select("o_orderkey", F.concat(F.lit("expiry:"), "o_orderkey", F.lit(":"), F.to_date("o_orderdate")).alias("dedupe_key"), "severity")


@query("""WITH a AS (SELECT o_custkey AS k, max(CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'medium' END) AS was FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' GROUP BY 1),
b AS (SELECT o_custkey AS k, max(CASE WHEN o_totalprice > 150000 THEN 'high' ELSE 'medium' END) AS now FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' GROUP BY 1)
SELECT CAST(coalesce(a.k, b.k) AS VARCHAR) AS dedupe_key, CASE WHEN was IS NULL THEN 'create' WHEN now IS NULL THEN 'resolve' WHEN was <> now THEN 'update' ELSE 'keep' END AS action, coalesce(now, was) AS severity FROM a FULL JOIN b ON a.k = b.k""")
def alert_reconciliation(spark, d):
    rows = t(spark, d, "orders").withColumn("_s", F.when(F.col("o_totalprice") > 150000, "high").otherwise("medium"))
    side = lambda c: rows.where(c).groupBy(F.col("o_custkey").cast("string").alias("dedupe_key")).agg(F.max("_s").alias("severity"))
    cut = F.lit("1998-01-01").cast("timestamp")
    return rules.reconcile(side(F.col("o_orderdate") < cut), side(F.col("o_orderdate") >= cut))


@query("""SELECT l_orderkey, l_linenumber, risk_type, severity FROM (
SELECT l_orderkey, l_linenumber, 'uncapped' AS risk_type, 'critical' AS severity FROM lineitem WHERE l_discount = 0
UNION ALL SELECT l_orderkey, l_linenumber, 'short_payment', 'medium' FROM lineitem WHERE l_quantity > 0 AND l_quantity <= 15
UNION ALL SELECT l_orderkey, l_linenumber, 'late_fee', 'low' FROM lineitem WHERE l_tax > 0.05)""")
def risk_findings(spark, d):
    lines = t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_discount", "l_quantity", "l_tax")
    fired = [("uncapped", "critical", F.col("l_discount") == 0), ("short_payment", "medium", (F.col("l_quantity") > 0) & (F.col("l_quantity") <= 15)), ("late_fee", "low", F.col("l_tax") > 0.05)]
    return rules.findings(lines, fired).select("l_orderkey", "l_linenumber", "risk_type", "severity")


@query("""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0)
SELECT vec_id, round(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) / (sqrt(list_inner_product(CAST(v.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(q.e AS DOUBLE[])))), 6) AS similarity
FROM embeddings v, q WHERE label <> 3 ORDER BY similarity DESC, vec_id LIMIT 10""")
def filtered_knn(spark, d):
    rows = t(spark, d, "embeddings")
    probe = rows.where("vec_id = 0").first()["embedding"]
    return retrieval.knn(rows.where("label <> 3"), probe, 10, "vec_id").select("vec_id", F.round("similarity", 6).alias("similarity"))


@query("""WITH a AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[1] DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 50),
b AS (SELECT vec_id, row_number() OVER (ORDER BY embedding[2] DESC, vec_id) AS rank FROM embeddings QUALIFY rank <= 50)
SELECT vec_id, round(sum(1.0 / (60 + rank)), 6) AS score, CASE WHEN count(*) > 1 THEN 'fused' ELSE min(leg) END AS source FROM (SELECT vec_id, rank, 'vector' AS leg FROM a UNION ALL SELECT vec_id, rank, 'keyword' FROM b) GROUP BY 1 ORDER BY sum(1.0 / (60 + rank)) DESC, vec_id LIMIT 20""")
def rank_fusion(spark, d):
    rows = t(spark, d, "embeddings")
    leg = lambda i: retrieval.ranked(rows.orderBy(F.desc(F.col("embedding")[i]), "vec_id").limit(50), F.col("embedding")[i], "vec_id")
    return retrieval.fuse({"vector": leg(0), "keyword": leg(1)}, "vec_id", 20).withColumn("score", F.round("score", 6))


@query("""SELECT vec_id, round(list_inner_product(u, u), 6) AS length FROM (SELECT vec_id, list_transform(CAST(embedding[1:32] AS DOUBLE[]), lambda x: x / n) AS u FROM (SELECT *, sqrt(list_inner_product(CAST(embedding[1:32] AS DOUBLE[]), CAST(embedding[1:32] AS DOUBLE[]))) AS n FROM embeddings))""")
def truncated_vectors(spark, d):
    cut = vx.truncated(F.col("embedding"), 32)
    return t(spark, d, "embeddings").where(vx.is_sound(F.col("embedding"), 64)).select("vec_id", F.round(vx.dot(cut, cut), 6).alias("length"))


@query("""SELECT label, vec_id, round(embedding[1], 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY embedding[1] DESC, vec_id) AS n FROM embeddings) WHERE n = 1""")
def best_per_level(spark, d):
    rows = t(spark, d, "embeddings").withColumn("score", F.col("embedding")[0])
    return r.keep_best(rows, ["label"], "score", "vec_id").select("label", "vec_id", F.round("score", 6).alias("score"))


_HITS = """WITH h AS (SELECT o_custkey AS c, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank, CAST(4 - least(4, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) - 1) AS INTEGER) AS grade FROM orders)"""


def _hits(spark, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    grade = 4 - F.least(F.lit(4), F.substring("o_orderpriority", 1, 1).cast("int") - 1)
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("case_id"), F.row_number().over(w).alias("rank"), grade.alias("grade"))
    return rows.withColumn("wanted", F.sum((F.col("grade") > 0).cast("int")).over(Window.partitionBy("case_id")))


@query(_HITS + """, m AS (SELECT c, sum((grade > 0)::INT) AS want, count(*) FILTER (grade > 0 AND rank <= 5) AS found, count(*) FILTER (rank <= 5) AS shown, min(rank) FILTER (grade > 0) AS first,
  sum(CASE WHEN rank <= 5 THEN (pow(2, grade) - 1) / log2(rank + 1) ELSE 0 END) AS dcg FROM h GROUP BY 1),
i AS (SELECT c, sum((pow(2, grade) - 1) / log2(n + 1)) AS ideal FROM (SELECT c, grade, row_number() OVER (PARTITION BY c ORDER BY grade DESC) AS n FROM h) WHERE n <= 5 GROUP BY 1)
SELECT c AS case_id, CASE WHEN want > 0 THEN round(found / want, 6) END AS recall, CASE WHEN want > 0 THEN round(found / shown, 6) END AS precision, CASE WHEN want > 0 THEN round(coalesce(1.0 / first, 0), 6) END AS mrr,
  CASE WHEN want > 0 THEN round(dcg / ideal, 6) END AS ndcg FROM m JOIN i USING (c)""")
def ranking_metrics(spark, d):
    return metrics.ranking_metrics(_hits(spark, d), "case_id", "rank", "grade", "wanted", 5)


@query("""SELECT bin, n, round(m, 6) AS confidence, round(a, 6) AS accuracy, round(abs(m - a), 6) AS gap FROM (SELECT CAST(least(floor(c * 10), 9) AS INTEGER) AS bin, count(*) AS n, avg(c) AS m, avg(y) AS a
FROM (SELECT l_discount * 10 AS c, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem) GROUP BY 1)""")
def calibration_bins(spark, d):
    return metrics.calibration(t(spark, d, "lineitem"), F.col("l_discount") * 10, F.col("l_returnflag") == "R")


@query("""SELECT event_type, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1""")
def latency_percentiles(spark, d):
    return agg.percentiles(t(spark, d, "events"), "event_type", "value", p50=0.5, p95=0.95)


@query("""SELECT metric, b AS base, c AS cand, CASE WHEN c IS NULL THEN 'missing' WHEN b IS NULL THEN 'new' WHEN abs(c - b) <= greatest(0.5, abs(b) * 0.2) THEN 'unchanged' WHEN c > b THEN 'improved' ELSE 'regressed' END AS verdict FROM
(SELECT event_type AS metric, round(avg(value) FILTER (ts < TIMESTAMP '2024-01-15'), 6) AS b, round(avg(value) FILTER (ts >= TIMESTAMP '2024-01-15'), 6) AS c FROM events GROUP BY 1)""")
def regression_gate(spark, d):
    early = F.col("ts") < F.lit("2024-01-15").cast("timestamp")
    rows = t(spark, d, "events").groupBy(F.col("event_type").alias("metric")).agg(F.round(F.avg(F.when(early, F.col("value"))), 6).alias("base"), F.round(F.avg(F.when(~early, F.col("value"))), 6).alias("cand"))
    return metrics.gate(rows.withColumn("higher", F.lit(True)), "base", "cand", 0.5, 0.2).drop("higher")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS quantity, grouping(l_linestatus) AS total FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def register_rollup(spark, d):
    rows = t(spark, d, "lineitem").rollup("l_returnflag", "l_linestatus")
    return rows.agg(F.count("*").alias("n"), F.sum(F.col("l_quantity").cast("decimal(18,2)")).cast("double").alias("quantity"), F.grouping("l_linestatus").cast("long").alias("total"))


@query("""SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2""")
def event_windows(spark, d):
    return t(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")


#: Shingles of every turn, and for each turn the earlier ones that share 80 % of the smaller set; then a fold over the turns by recursion.
KEPT_TURNS = """WITH RECURSIVE x AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN line = '' THEN [] WHEN len(w) < 8 THEN [line]
    ELSE list_distinct(list_transform(range(1, len(w) - 6), lambda j: array_to_string(w[j:j + 7], ' '))) END AS g
  FROM (SELECT *, string_split(line, ' ') AS w FROM (SELECT conv_id, turn, trim(regexp_replace(lower(coalesce(text, '')), '\\s+', ' ', 'g')) AS line FROM conversations))),
y AS (SELECT a.conv_id, a.turn, a.i, len(a.g) > 0 AS said, coalesce(list(b.i) FILTER (len(a.g) > 0 AND len(b.g) > 0 AND len(list_intersect(a.g, b.g)) / least(len(a.g), len(b.g)) >= 0.8), []) AS like_it
  FROM x AS a LEFT JOIN x AS b ON a.conv_id = b.conv_id AND b.i < a.i GROUP BY ALL),
k AS (SELECT conv_id, i, true AS stays, CASE WHEN said THEN [i] ELSE [] END AS kept FROM y WHERE i = 1
  UNION ALL SELECT y.conv_id, y.i, NOT list_has_any(k.kept, like_it), CASE WHEN said AND NOT list_has_any(k.kept, like_it) THEN list_append(k.kept, y.i) ELSE k.kept END FROM k JOIN y ON y.conv_id = k.conv_id AND y.i = k.i + 1)"""


@query(KEPT_TURNS + " SELECT y.conv_id, turn FROM k JOIN y USING (conv_id, i) WHERE stays")
def near_duplicate_suppression(spark, d):
    lines = t(spark, d, "conversations").select("conv_id", "turn", tx.shingles(F.col("text")).alias("grams"))
    return retrieval.suppress_near_duplicates(lines, "conv_id", "turn", "grams").select("conv_id", "turn")


@query("""WITH w AS (SELECT doc_id, regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+') AS w FROM documents), c AS (SELECT doc_id, len(list_filter(w, lambda x: x = 'the')) AS a, len(list_filter(w, lambda x: x = 'and')) AS b, len(w) AS n FROM w)
SELECT doc_id, round(s, 6) AS score FROM (SELECT doc_id, (ln(1 + a) + ln(1 + b)) / ln(2 + n) AS s FROM c WHERE a > 0 AND b > 0) ORDER BY s DESC, doc_id LIMIT 25""")
def keyword_search(spark, d):
    return retrieval.keyword_rank(t(spark, d, "documents").select("doc_id", "text"), ["the", "and"], "doc_id", 25).select("doc_id", F.round("score", 6).alias("score"))


@query("""WITH b AS (SELECT least(floor(c * 10), 9) AS bin, count(*) AS n, avg(c) AS m, avg(y) AS a, sum(pow(c - y, 2)) AS sq FROM (SELECT l_discount * 10 AS c, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS y FROM lineitem) GROUP BY 1)
SELECT round(sum(n * abs(m - a)) / sum(n), 6) AS ece, round(max(abs(m - a)), 6) AS mce, round(sum(sq) / sum(n), 6) AS brier FROM b""")
def calibration_summary(spark, d):
    return metrics.calibration_errors(t(spark, d, "lineitem"), F.col("l_discount") * 10, F.col("l_returnflag") == "R")
