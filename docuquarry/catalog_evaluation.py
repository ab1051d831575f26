"""Registered queries of evaluation, layout, jobs and full-text search, beside SQL that says the same.

Orders stand for cases and their lines for hits, events for jobs and answers, conversations for documents.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docuquarry.catalog import KEPT_TURNS, query, t
from docuquarry.functions import text as tx
from docuquarry.operators import layout as lay
from docuquarry.plans import calibrate
from docuquarry.plans import evaluation as ev
from docuquarry.plans import fulltext as ft
from docuquarry.plans import retrieval
from docuquarry.sources import sinks
from docuquarry.streaming import jobs as jb

_HIT = """h AS (SELECT l_orderkey AS case_id, l_linenumber AS line, l_suppkey AS s, CAST(l_quantity AS INTEGER) AS q, l_returnflag AS f, l_linestatus AS t, l_discount AS k FROM lineitem)"""


def _cases(spark, d):
    """Lines as hits beside what their order expects: by its return flag a clause, headings, pages of a contract, or nothing."""
    x = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("line"), F.col("l_suppkey").alias("s"), F.col("l_quantity").cast("int").alias("q"), F.col("l_returnflag").alias("f"), F.col("l_linestatus").alias("t"), F.col("l_discount").alias("k"))
    none = F.array().cast("array<string>")
    text = lambda c: F.col(c).cast("string")
    return x.withColumns({
        "clauses": F.when(F.col("f") == "A", F.array(F.lit("1"), F.lit("2"))).otherwise(none), "headings": F.when((F.col("f") == "R") | (F.col("q") > 40), F.array(F.lit(" Line 3!"))).otherwise(none),
        "contracts": F.when(F.col("f") == "N", F.array(F.lit("O"))).otherwise(none), "pages": F.when(F.col("k") > 0.03, F.array(F.lit(10), F.lit(11))).otherwise(F.array().cast("array<int>")),
    }).withColumn("grade", ev.grade(text("s"), F.when(F.col("q") > 45, F.lit("2")), F.col("t"), F.concat(F.lit("line "), text("line")), F.lit(None).cast("string"), F.col("q"), F.when(F.col("q") > 8, F.col("q") + 1)))


_GRADE = """CASE WHEN f = 'A' AND (s IN (1, 2) OR q > 45) THEN 4 WHEN f = 'A' AND q <= 40 THEN 0 WHEN (f = 'R' OR q > 40) AND line = 3 THEN 3
  WHEN f = 'N' AND t = 'O' THEN CASE WHEN k > 0.03 AND (q IN (10, 11) OR q = 9) THEN 2 ELSE 1 END ELSE 0 END"""


@query(f"WITH {_HIT} SELECT case_id, line, s, q, {_GRADE} AS grade, CASE WHEN f = 'A' THEN 2 WHEN f = 'R' OR q > 40 THEN 1 WHEN f = 'N' THEN 1 ELSE 0 END AS units FROM h")
def relevance_grades(spark, d):
    return _cases(spark, d).select("case_id", "line", "s", "q", "grade", ev.total_relevant().alias("units"))


@query(f"""WITH {_HIT}, g AS (SELECT *, {_GRADE} AS grade FROM h), r AS (SELECT case_id, s, max(grade) AS g FROM g GROUP BY 1, 2),
c AS (SELECT case_id, CASE WHEN q > 40 THEN s + 100 ELSE s END AS ref, k > 0.01 AS resolved FROM h WHERE q > 20),
o AS (SELECT c.case_id, CASE WHEN NOT resolved THEN 'h' WHEN g IS NULL THEN 'b' WHEN g >= 1 THEN 'c' ELSE 'i' END AS kind FROM c LEFT JOIN r ON r.case_id = c.case_id AND r.s = c.ref),
n AS (SELECT case_id, count(*) AS total, count(*) FILTER (kind = 'c') AS correct, count(*) FILTER (kind = 'i') AS imprecise, count(*) FILTER (kind = 'b') AS broken, count(*) FILTER (kind = 'h') AS hallucinated FROM o GROUP BY 1),
v AS (SELECT case_id, count(*) FILTER (grade >= 1 AND q > 10) AS available, count(*) FILTER (grade >= 1 AND q > 10 AND NOT q > 20) AS missed FROM g GROUP BY 1)
SELECT case_id, coalesce(total, 0) AS total, coalesce(correct, 0) AS correct, coalesce(imprecise, 0) AS imprecise, coalesce(broken, 0) AS broken, coalesce(hallucinated, 0) AS hallucinated, available, missed,
  CASE WHEN coalesce(total - hallucinated - broken, 0) > 0 THEN round(correct / (total - hallucinated - broken), 6) END AS precision, CASE WHEN available > 0 THEN round((available - missed) / available, 6) END AS recall FROM v LEFT JOIN n USING (case_id)""")
def citation_outcomes(spark, d):
    x = _cases(spark, d)
    citations = x.where("q > 20").select("case_id", F.when(F.col("q") > 40, F.col("s") + 100).otherwise(F.col("s")).alias("ref_id"), (F.col("k") > 0.01).alias("resolved"))
    hits = x.select("case_id", F.col("s").alias("ref_id"), "grade", (F.col("q") > 10).alias("in_context"), (F.col("q") > 20).alias("cited"))
    return ev.citation_outcomes(citations, hits)


@query("""SELECT user_id, count(*) AS answers, count(*) FILTER (value > 80 AND event_type <> 'view') AS uncited, CAST(sum(CASE event_type WHEN 'error' THEN 1 ELSE 0 END) AS BIGINT) AS hallucinated,
  round((count(*) FILTER (value > 80 AND event_type <> 'view') + sum(CASE event_type WHEN 'error' THEN 1 ELSE 0 END)) / count(*), 4) AS hallucination_rate FROM events GROUP BY 1""")
def hallucination_rates(spark, d):
    e = t(spark, d, "events")
    rows = e.select("user_id", (F.col("value") * 2).alias("length"), F.lit(0).alias("citations"), (F.col("event_type") == "error").cast("int").alias("hallucinated"), (F.col("event_type") == "view").alias("honest"))
    return ev.hallucination_rate(rows, ["user_id"])


@query("""SELECT o_custkey, count(*) AS cases, round(count(*) FILTER (o_orderstatus IN ('F', 'O') AND o_totalprice > 100000) / nullif(count(*) FILTER (o_orderstatus IN ('F', 'O')), 0), 6) AS intent_accuracy,
  round(count(*) FILTER (o_orderpriority = '2-HIGH') / count(*), 6) AS document_type_accuracy, count(*) FILTER (o_totalprice > 200000 AND (CASE WHEN o_orderstatus = 'P' THEN o_orderpriority = '1-URGENT' ELSE o_totalprice > 300000 END)) AS correct_filtering,
  count(*) FILTER (o_totalprice > 200000 AND NOT (CASE WHEN o_orderstatus = 'P' THEN o_orderpriority = '1-URGENT' ELSE o_totalprice > 300000 END)) AS false_filtering, count(*) FILTER (o_totalprice <= 200000) AS filter_declined FROM orders GROUP BY 1""")
def planner_metrics(spark, d):
    o = t(spark, d, "orders")
    none, p = F.array().cast("array<string>"), F.col("o_orderpriority")
    rows = o.select(
        "o_custkey", F.when(F.col("o_totalprice") > 100000, "time-line").otherwise("x").alias("intent"), F.when(F.col("o_orderstatus") != "P", "Time Line").alias("expected_intent"), p.alias("document_type"), F.lit("2 high").alias("expected_type"),
        F.when(F.col("o_totalprice") > 200000, F.array(p)).otherwise(none).alias("applied_types"), F.when(F.col("o_orderstatus") == "P", F.array(F.lit("1 urgent"))).otherwise(none).alias("expected_types"), (F.col("o_totalprice") > 300000).alias("relevant"),
    )
    return ev.planner_metrics(rows, ["o_custkey"])


@query("""SELECT event_type, CASE WHEN value > 50 THEN 'a' ELSE 'b' END AS got, count(*) AS cases FROM events GROUP BY 1, 2""")
def intent_confusion(spark, d):
    return ev.confusion(t(spark, d, "events").withColumn("got", F.when(F.col("value") > 50, "a").otherwise("b")), "event_type", "got")


@query("""SELECT user_id, round(avg(CASE WHEN (event_type <> 'error') = (value > 45) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) FILTER (value > 45 AND event_type = 'error') AS false_accepts, count(*) FILTER (NOT value > 45 AND event_type <> 'error') AS false_rejects,
  count(*) FILTER (NOT value > 45 AND value + 10 >= 45) AS summary_would_pass FROM events GROUP BY 1""")
def guardrail_metrics(spark, d):
    rows = t(spark, d, "events").select("user_id", (F.col("event_type") != "error").alias("answerable"), (F.col("value") > 45).alias("answered"), (F.col("value") + 10).alias("summary_similarity"), F.lit(45.0).alias("floor"))
    return ev.guardrail_metrics(rows, ["user_id"])


_WIDE = "w AS (SELECT o_custkey, avg(o_totalprice) / 500009 AS mrr, avg(o_totalprice) FILTER (o_orderstatus = 'F') / 500009 AS recall, count(*) / 40.0 AS grounding FROM orders GROUP BY 1)"


def _wide(spark, d):
    return t(spark, d, "orders").groupBy("o_custkey").agg((F.avg("o_totalprice") / 500009).alias("mrr"), (F.avg(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice"))) / 500009).alias("recall"), (F.count("*") / 40.0).alias("grounding"))


@query(f"WITH {_WIDE} SELECT o_custkey, round((coalesce(recall * 0.3, 0) + mrr * 0.2 + grounding * 0.05) / (CASE WHEN recall IS NULL THEN 0.25 ELSE 0.55 END), 6) AS composite FROM w")
def scorecards(spark, d):
    return _wide(spark, d).select("o_custkey", ev.composite({"recall@10": F.col("recall"), "mrr": F.col("mrr"), "grounding_rate": F.col("grounding")}).alias("composite"))


@query(f"WITH {_WIDE} SELECT o_custkey, 'mrr' AS metric, round(mrr, 6) AS value FROM w UNION ALL SELECT o_custkey, 'recall', round(coalesce(recall, 0), 6) FROM w")
def flat_metrics(spark, d):
    return ev.flat_metrics(_wide(spark, d), ["mrr", "recall"], ["o_custkey"]).withColumn("value", F.round("value", 6))


@query(f"WITH {_WIDE} SELECT count(*) AS cases, round(avg(mrr), 6) AS mrr, round(avg(recall), 6) AS recall FROM w")
def run_means(spark, d):
    return ev.means(_wide(spark, d), ["mrr", "recall"])


@query("""SELECT o_custkey AS parameter, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS best_value, round((max(o_totalprice) - max(o_totalprice) FILTER (o_orderstatus = 'F')) / 500009, 6) AS gain,
  CASE WHEN max(o_totalprice) FILTER (o_orderstatus = 'F') IS NULL THEN 'unswept' WHEN round((max(o_totalprice) - max(o_totalprice) FILTER (o_orderstatus = 'F')) / 500009, 6) <= 0.005 THEN 'keep' ELSE 'consider' END AS advice FROM orders GROUP BY 1""")
def sweep_advice(spark, d):
    points = t(spark, d, "orders").select(F.col("o_custkey").alias("parameter"), F.col("o_orderkey").alias("value"), (F.col("o_totalprice") / 500009).alias("composite"), (F.col("o_orderstatus") == "F").alias("is_current"))
    return ev.sweep_advice(points)


@query("""SELECT event_id, CASE WHEN value / 1000 - 0.02 <= 0.005 THEN 'no_material_gain' ELSE 'gains' END AS verdict FROM events""")
def ablation_verdicts(spark, d):
    return t(spark, d, "events").select("event_id", ev.ablation_verdict(F.lit(0.02), F.col("value") / 1000).alias("verdict"))


@query(KEPT_TURNS + """ SELECT conv_id, count(*) AS items, count(*) FILTER (NOT stays) AS duplicates, CASE WHEN count(*) > 1 THEN round(count(*) FILTER (NOT stays) / count(*), 6) ELSE 0.0 END AS rate FROM k GROUP BY conv_id""")
def duplicate_rates(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", "turn", tx.shingles(F.col("text")).alias("grams"))
    return ev.duplicate_rates(rows, "conv_id", "turn", "grams").withColumn("rate", F.round("rate", 6))


@query("SELECT event_id FROM events WHERE event_type IN ('view', 'click') AND user_id = 3")
def golden_subset(spark, d):
    cases = t(spark, d, "events").select("event_id", F.array(F.initcap("event_type"), F.lit("x")).alias("tags"), F.col("user_id").alias("project_id"))
    return ev.golden_subset(cases, ["VIEW", "click"], ["none"], project_id=3).select("event_id")


@query("""WITH n AS (SELECT DISTINCT l_orderkey, l_returnflag, l_linenumber, l_partkey FROM lineitem), r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey) AS n FROM n)
SELECT l_orderkey, CAST(p AS INTEGER) AS pick, l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n > 1, l_linenumber, l_partkey, l_returnflag) AS p FROM r) WHERE p <= 3""")
def golden_skeleton(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("clause_type"), F.col("l_linenumber").alias("page_start"), F.col("l_partkey").alias("clause_number")).distinct()
    return ev.golden_skeleton(rows, "l_orderkey", 3).select("l_orderkey", "pick", F.col("page_start").alias("l_linenumber"), F.col("clause_number").alias("l_partkey"))


@query("""SELECT l_returnflag, CAST(sum(CASE WHEN l_quantity > 20 THEN l_linenumber ELSE 0 END) AS BIGINT) AS matched, CAST(sum(l_linenumber) AS BIGINT) AS total, CASE WHEN sum(l_linenumber) > 0 THEN round(sum(CASE WHEN l_quantity > 20 THEN l_linenumber ELSE 0 END) / sum(l_linenumber), 4) END AS share FROM lineitem GROUP BY 1""")
def diff_totals(spark, d):
    rows = t(spark, d, "lineitem").select("l_returnflag", F.when(F.col("l_quantity") > 20, F.col("l_linenumber")).otherwise(0).alias("matched"), F.col("l_linenumber").alias("total"))
    return ev.diff_totals(rows, by=["l_returnflag"])


@query("SELECT event_id, CASE WHEN user_id > 0 THEN round(least(user_id, floor(value / 20)) / user_id, 4) END AS coverage FROM events")
def audit_coverage(spark, d):
    rows = t(spark, d, "events").select("event_id", F.col("user_id").alias("offered"), F.least(F.col("user_id").cast("double"), F.floor(F.col("value") / 20)).alias("cited"))
    return ev.source_coverage(rows).select("event_id", "coverage")


_BOX = "b AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_quantity AS x, l_discount * 100 AS y, l_tax * 100 + 1 AS w FROM lineitem)"


@query(f"WITH {_BOX} SELECT doc, page, min(x) AS x, round(min(y), 6) AS y, round(max(x + w) - min(x), 6) AS width, round(max(y + 2) - min(y), 6) AS height FROM b GROUP BY 1, 2")
def merged_boxes(spark, d):
    boxes = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page"), F.col("l_quantity").alias("x"), (F.col("l_discount") * 100).alias("y"), (F.col("l_tax") * 100 + 1).alias("width"), F.lit(2.0).alias("height"))
    out = lay.merged_boxes(boxes, ["doc", "page"])
    return out.select("doc", "page", "x", *[F.round(c, 6).alias(c) for c in ("y", "width", "height")])


@query(f"WITH {_BOX} SELECT doc, min(x) AS l, round(min(y), 6) AS t, round(max(x + w), 6) AS r, round(max(y), 6) AS b FROM b WHERE page < 5 GROUP BY 1")
def polygon_unions(spark, d):
    x, y = F.col("l_quantity"), F.col("l_discount") * 100
    shape = F.when(F.col("l_linenumber") < 5, F.array(x, y, x + F.col("l_tax") * 100 + 1, y)).otherwise(F.array().cast("array<double>"))
    p = F.col("polygon")
    return lay.polygon_union(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), shape.alias("polygon")), ["doc"]).select("doc", p[0].alias("l"), F.round(p[1], 6).alias("t"), F.round(p[2], 6).alias("r"), F.round(p[5], 6).alias("b"))


@query("""WITH c AS (SELECT DISTINCT ON (l_orderkey, r, k) l_orderkey, l_linenumber // 3 AS r, l_linenumber % 3 AS k, l_returnflag || '\\|' || l_partkey AS v FROM lineitem ORDER BY l_orderkey, r, k, l_partkey, l_returnflag), w AS (SELECT l_orderkey, max(k) AS w FROM c GROUP BY 1),
a AS (SELECT r.l_orderkey, r.r, w.w, x.k FROM (SELECT DISTINCT l_orderkey, r FROM c) r JOIN w ON w.l_orderkey = r.l_orderkey JOIN (VALUES (0), (1), (2)) AS x(k) ON x.k <= w.w),
g AS (SELECT a.l_orderkey, a.r, a.w, string_agg(coalesce(c.v, ''), ' | ' ORDER BY a.k) AS line FROM a LEFT JOIN c ON c.l_orderkey = a.l_orderkey AND c.r = a.r AND c.k = a.k GROUP BY 1, 2, 3)
SELECT l_orderkey, string_agg('| ' || line || ' |' || CASE WHEN n = 1 THEN chr(10) || '|' || repeat(' --- |', CAST(w + 1 AS BIGINT)) ELSE '' END, chr(10) ORDER BY r) AS markdown FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY r) AS n FROM g) GROUP BY 1""")
def markdown_tables(spark, d):
    rows = t(spark, d, "lineitem").select("l_orderkey", F.expr("l_linenumber div 3").cast("int").alias("row"), (F.col("l_linenumber") % 3).alias("col"), F.struct("l_partkey", F.concat("l_returnflag", F.lit("|"), "l_partkey")).alias("v"))
    cells = rows.groupBy("l_orderkey", "row", "col").agg(F.min("v").alias("v")).select("l_orderkey", "row", "col", F.col("v.col2").alias("text"))
    return lay.tables_as_markdown(cells, "l_orderkey")


_ORDER = "row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'view' THEN CAST(ts AS DATE) END NULLS LAST, floor(value / 50), value, event_id) - 1"


def _elements(spark, d):
    e = t(spark, d, "events")
    rows = e.select("user_id", F.when(F.col("event_type") != "view", F.to_date("ts")).alias("page"), F.floor(F.col("value") / 50).alias("y"), F.col("value").alias("x"), F.col("event_id").alias("parser_order"), F.col("event_id").alias("element_id"))
    return lay.reading_order(rows, "user_id")


@query(f'SELECT event_id, CAST({_ORDER} AS INTEGER) AS "index" FROM events')
def reading_order(spark, d):
    return _elements(spark, d).select(F.col("element_id").alias("event_id"), "index")


@query(f"SELECT user_id, page, CAST(min(i) AS INTEGER) AS first_index FROM (SELECT user_id, CASE WHEN event_type <> 'view' THEN CAST(ts AS DATE) END AS page, {_ORDER} AS i FROM events) GROUP BY 1, 2")
def first_of_page(spark, d):
    return lay.first_of_page(_elements(spark, d), "user_id")


@query("""WITH p AS (SELECT conv_id, turn AS page, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)
SELECT conv_id, CAST(w AS BIGINT) AS "window", page FROM p, LATERAL (SELECT unnest(range(0, n)) AS w) WHERE i >= w * 2 AND i < w * 2 + 3 AND (w = 0 OR (w - 1) * 2 + 3 < n)""")
def page_windows(spark, d):
    return lay.page_windows(t(spark, d, "conversations").select("conv_id", F.col("turn").alias("page")), "conv_id", 3, overlap=1)


@query("""WITH p AS (SELECT DISTINCT l_orderkey AS doc, l_linenumber AS para, l_suppkey AS a, CAST(l_quantity AS INTEGER) AS b FROM lineitem), r AS (SELECT doc, para, a || '.' || b AS number FROM p UNION SELECT doc, para, '7' FROM p UNION SELECT doc, para, 'B' FROM p WHERE b > 25)
SELECT doc, para, number, CASE WHEN number = '7' THEN 's7' WHEN number = 'B' THEN NULL END AS section_id FROM r""")
def section_references(spark, d):
    p = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("para"), F.col("l_suppkey").alias("a"), F.col("l_quantity").cast("int").alias("b")).distinct()
    number = F.concat("a", F.lit("."), "b")
    said = F.concat(F.lit("Under Section "), number, F.lit(" and clauses 7(a), see section "), number, F.when(F.col("b") > 25, " or Schedule B.").otherwise(" of the sections."))
    paragraphs = p.groupBy("doc", "para").agg(F.array_join(F.collect_set(said), " ").alias("text"))
    sections = p.select("doc", F.lit("7").alias("number"), F.lit("s7").alias("section_id")).distinct()
    return lay.references(paragraphs, sections, "doc")


@query("""SELECT conv_id, count(*) AS paragraphs, CAST(sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> ''))) AS BIGINT) AS words, CAST(sum(length(text)) AS BIGINT) AS characters, round(count(*) FILTER (turn % 2 = 0) / count(*), 4) AS coordinate_coverage,
  sum(len(list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> ''))) < 20 AS is_sparse FROM conversations GROUP BY 1""")
def document_statistics(spark, d):
    rows = t(spark, d, "conversations").withColumn("polygon", F.when(F.col("turn") % 2 == 0, F.array(F.lit(0.5))).otherwise(F.array().cast("array<double>")))
    return lay.document_statistics(rows, "conv_id")


@query("""SELECT o_orderkey, 'order status: ' || o_orderstatus || chr(10) || 'is big: ' || CASE WHEN o_totalprice > 200000 THEN 'yes' ELSE 'no' END || chr(10) || 'note: not specified' || chr(10) || 'tags: ' || CASE WHEN o_orderstatus = 'F' THEN 'none' ELSE 'a, b' END AS lines FROM orders""")
def attribute_lines(spark, d):
    tags = F.when(F.col("o_orderstatus") == "F", "[]").otherwise('["a","b"]')
    m = F.create_map(F.lit("order_status"), F.col("o_orderstatus"), F.lit("is_big"), (F.col("o_totalprice") > 200000).cast("string"), F.lit("note"), F.lit(None).cast("string"), F.lit("tags"), tags)
    return t(spark, d, "orders").select("o_orderkey", lay.attribute_lines(m).alias("lines"))


_STAGE = "s AS (SELECT DISTINCT user_id AS job, CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'purchase' THEN 3 WHEN 'signup' THEN 4 ELSE 5 END AS place FROM events WHERE value > 100)"
_NAMES = "['validation', 'parser', 'docpipeline', 'extraction', 'embedding', 'indexing']"


def _stages(spark, d):
    e = F.col("event_type")
    at = F.when(e == "view", 0).when(e == "click", 1).when(e == "purchase", 2).when(e == "signup", 3).otherwise(4)
    done = t(spark, d, "events").where("value > 100").select(F.col("user_id").alias("job"), F.element_at(F.array(*map(F.lit, jb.STAGES)), at + 1).alias("stage")).distinct().withColumn("done", F.lit(True))
    every = t(spark, d, "events").select(F.col("user_id").alias("job")).distinct().select("job", F.explode(F.array(*map(F.lit, jb.STAGES))).alias("stage"))
    return every.join(done, ["job", "stage"], "left").withColumn("done", F.coalesce("done", F.lit(False)))


@query(f"WITH {_STAGE} SELECT j AS job, {_NAMES}[CAST(CASE WHEN coalesce(m, 0) + 1 = 3 THEN 4 ELSE coalesce(m, 0) + 1 END AS BIGINT)] AS next FROM (SELECT DISTINCT user_id AS j FROM events) LEFT JOIN (SELECT job, max(place) AS m FROM s GROUP BY 1) ON j = job")
def next_stages(spark, d):
    plan = _stages(spark, d).select("job", "stage", F.col("done").alias("completed"), (F.col("stage") != "docpipeline").alias("should_run"))
    return jb.next_stage(plan, "job")


@query(f"""WITH {_STAGE}, a AS (SELECT j AS job, k FROM (SELECT DISTINCT user_id AS j FROM events), (SELECT unnest(range(1, 7)) AS k))
SELECT job, {_NAMES}[k] AS stage, EXISTS (SELECT 1 FROM (SELECT unnest(range(1, 7)) AS i) WHERE i <= k AND (a.job, i) NOT IN (SELECT job, place FROM s)) AS runs, CASE WHEN (job, k) IN (SELECT job, place FROM s) THEN [3, 35, 50, 85, 95, 100][k] ELSE [0, 3, 35, 50, 85, 95][k] END AS progress FROM a""")
def stages_to_run(spark, d):
    rows = jb.to_run(_stages(spark, d).withColumn("reusable", F.col("done")), "job")
    return rows.select("job", "stage", "runs", jb.progress(F.col("stage"), F.col("done")).alias("progress"))


@query(f"""WITH {_STAGE}, a AS (SELECT j AS job, k FROM (SELECT DISTINCT user_id AS j FROM events), (SELECT unnest(range(1, 7)) AS k))
SELECT job, {_NAMES}[k] AS stage, CASE k WHEN 1 THEN true WHEN 4 THEN (job, 2) IN (SELECT job, place FROM s) AND (job, 3) IN (SELECT job, place FROM s) ELSE (job, k - 1) IN (SELECT job, place FROM s) END AS ready FROM a""")
def ready_stages(spark, d):
    needs = [(b, a) for a, b in zip(jb.STAGES, jb.STAGES[1:], strict=False)] + [("extraction", "parser")]
    rows = _stages(spark, d).withColumn("status", F.when(F.col("done"), "succeeded").otherwise("failed"))
    return jb.ready(rows, spark.createDataFrame(needs, "stage string, needs string"), "job")


@query("SELECT event_id, CASE WHEN event_type <> 'error' AND user_id < 6 THEN 'retry' ELSE 'failed' END AS outcome, NOT (event_type <> 'error' AND user_id < 6) AS alerts FROM events")
def failed_attempts(spark, d):
    rows = t(spark, d, "events").select("event_id", F.col("user_id").alias("attempt"), F.lit(6).alias("max_attempts"), (F.col("event_type") != "error").alias("retryable"))
    return jb.after_failure(rows).select("event_id", "outcome", "alerts")


@query("""SELECT event_id, CASE WHEN user_id < 3 THEN 'ready' WHEN user_id < 6 THEN CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'cancelled' ELSE 'paused' END ELSE CASE event_type WHEN 'view' THEN 'running' WHEN 'error' THEN 'cancelled' WHEN 'click' THEN 'failed' WHEN 'purchase' THEN 'ready' ELSE 'queued' END END AS state FROM events""")
def job_transitions(spark, d):
    e = F.col("event_type")
    event = F.when(e == "view", "resume").when(e == "error", "cancel").when(e == "click", "fail").when(e == "purchase", "finish").otherwise("unknown")
    state = F.when(F.col("user_id") < 3, "ready").when(F.col("user_id") < 6, "paused").otherwise("queued")
    return t(spark, d, "events").select("event_id", jb.transition(state, event).alias("state"))


@query("SELECT event_id AS message_id FROM events WHERE event_type IN ('view', 'click') AND ts <= TIMESTAMP '2024-01-15' ORDER BY user_id DESC, ts, event_id LIMIT 25")
def claimed_messages(spark, d):
    e = t(spark, d, "events")
    queue = e.select(F.col("event_id").alias("message_id"), F.when(F.col("event_type") == "error", "DEAD").otherwise("PENDING").alias("state"), F.col("event_type").alias("stage"), F.col("user_id").alias("priority"), F.col("ts").alias("available_at"))
    return jb.claim(queue, F.lit("2024-01-15").cast("timestamp_ntz"), 25, ["view", "click"]).select("message_id")


@query("""WITH c AS (SELECT o_orderkey AS contract_id, o_orderstatus AS p, o_orderpriority AS a FROM orders) SELECT contract_id, CASE WHEN a = '1-URGENT' AND p = 'F' THEN 1 WHEN a = '1-URGENT' THEN 3 WHEN a = '2-HIGH' AND p = 'O' THEN 4 ELSE 6 END AS profile_id FROM c""")
def resolved_profiles(spark, d):
    contracts = t(spark, d, "orders").select(F.col("o_orderkey").alias("contract_id"), F.col("o_orderstatus").alias("project_id"), F.col("o_orderpriority").alias("agreement_type"))
    rows = [("F", "1-URGENT", 1, 1, False, True), (None, "1-URGENT", 5, 2, False, False), (None, "1-URGENT", 4, 3, False, True), ("O", "2-HIGH", 0, 4, False, True), (None, "3-MEDIUM", 9, 5, True, False), (None, "none", 1, 6, True, True)]
    return jb.resolve_profiles(contracts, spark.createDataFrame(rows, "project_id string, agreement_type string, priority int, profile_id int, is_default boolean, is_active boolean"))


@query("""WITH k AS (SELECT DISTINCT p_brand AS key FROM part), m AS (SELECT DISTINCT p_type AS agreement_type, p_brand AS key, p_type <> 'PROMO' AND max(p_size) OVER (PARTITION BY p_type, p_brand) > 30 AS on_ FROM part WHERE p_type <> 'SMALL')
SELECT agreement_type, key FROM m WHERE on_ AND agreement_type <> 'LARGE' UNION SELECT t, key FROM k, (VALUES ('SMALL'), ('LARGE')) AS v(t)""")
def clause_targets(spark, d):
    part = t(spark, d, "part")
    types = part.select(F.col("p_type").alias("agreement_type")).distinct()
    mapping = part.where("p_type <> 'SMALL'").groupBy(F.col("p_type").alias("agreement_type"), F.col("p_brand").alias("key")).agg(((F.max("p_size") > 30) & (F.first("p_type") != "PROMO")).alias("is_active"))
    return jb.clause_targets(types, mapping, part.select(F.col("p_brand").alias("key")), fallback="LARGE")


@query("""SELECT event_id, CASE WHEN event_type = 'view' AND ts < TIMESTAMP '2024-01-14 23:30:00' THEN 'requeue' WHEN event_type = 'click' AND ts + INTERVAL 48 HOUR < TIMESTAMP '2024-01-15' THEN 'expire' ELSE 'keep' END AS action FROM events""")
def export_sweep(spark, d):
    e = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    rows = e.select("event_id", F.when(F.col("event_type") == "view", "running").when(F.col("event_type") == "click", "completed").otherwise("failed").alias("status"), F.col("ts").alias("started_at"), (F.col("ts") + F.make_interval(hours=F.lit(48))).alias("expires_at"))
    return jb.export_sweep(rows, F.lit("2024-01-15").cast("timestamp")).select("event_id", "action")


@query("SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10'")
def retained_logs(spark, d):
    rows = t(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return jb.within_retention(rows, "ts", F.lit("2024-07-08").cast("timestamp"), 180).select("event_id")


@query("""WITH s AS (SELECT DISTINCT user_id AS contract_id, event_type FROM events) SELECT contract_id, CASE event_type WHEN 'view' THEN 'parser' WHEN 'click' THEN 'extraction' ELSE 'indexing' END AS stage, event_type AS kind, NOT (contract_id < 5 AND event_type <> 'view') AS is_current FROM s""")
def invalidated_artifacts(spark, d):
    e = F.col("event_type")
    artifacts = t(spark, d, "events").select(F.col("user_id").alias("contract_id"), F.when(e == "view", "parser").when(e == "click", "extraction").otherwise("indexing").alias("stage"), e.alias("kind")).distinct().withColumn("is_current", F.lit(True))
    some = artifacts.where("contract_id < 5").select("contract_id")
    return jb.invalidated(artifacts, "docpipeline", some).select("contract_id", "stage", "kind", "is_current")


@query("""WITH o AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), n AS (SELECT o_custkey AS k, CASE WHEN max(o_totalprice) > 300000 THEN max(o_totalprice) END AS v FROM orders WHERE o_orderstatus = 'P' GROUP BY 1)
SELECT coalesce(o.k, n.k) AS k, coalesce(n.v, o.v) AS v FROM o FULL JOIN n ON o.k = n.k""")
def upserted_rows(spark, d):
    side = lambda s: t(spark, d, "orders").where(F.col("o_orderstatus") == s).groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return sinks.upsert(side("F"), side("P").withColumn("v", F.when(F.col("v") > 300000, F.col("v"))), ["k"])


@query("""SELECT o_custkey AS k, o_orderkey AS v, o_orderstatus AS s FROM orders WHERE o_orderstatus = 'P' OR o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')""")
def replaced_rows(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("v"), F.col("o_orderstatus").alias("s"))
    return sinks.replace_keys(rows.where("s <> 'P'"), rows.where("s = 'P'"), ["k"])


@query("""SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P' AND o_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')""")
def inserted_rows(spark, d):
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("k"), "o_orderstatus")
    return sinks.insert_ignore(rows.where("o_orderstatus = 'F'"), rows.where("o_orderstatus = 'P'"), "k").select("k")


@query("""WITH a AS (SELECT DISTINCT user_id AS k, CAST(dense_rank() OVER (PARTITION BY user_id ORDER BY event_type) AS INTEGER) AS generation FROM events), m AS (SELECT k, max(generation) AS m FROM a GROUP BY 1)
SELECT a.k, generation, generation = m AND a.k >= 5 AS is_current FROM a JOIN m USING (k) UNION ALL SELECT k, m + 1, true FROM m WHERE k < 5""")
def superseded_artifacts(spark, d):
    w = Window.partitionBy("user_id").orderBy("event_type")
    old = t(spark, d, "events").select(F.col("user_id").alias("k"), F.dense_rank().over(w).alias("generation")).distinct()
    old = old.withColumn("is_current", F.col("generation") == F.max("generation").over(Window.partitionBy("k")))
    return sinks.supersede(old, old.where("k < 5").select("k").distinct(), ["k"])


_STEM = """CASE WHEN length(w) > 3 AND regexp_matches(right(p, 1), '[b-df-hj-np-tv-z]') AND substr(p, length(p) - 1, 1) = right(p, 1) AND regexp_matches(p, '[a-z]{2}..$') THEN left(p, -1) WHEN length(w) > 3 THEN p ELSE w END"""
_TERMS = f"""tok AS (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+')) AS w FROM documents),
pl AS (SELECT doc_id, w, CASE WHEN regexp_matches(w, '[^aeious]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ss|x|z|ch|sh)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^aius]s$') THEN regexp_replace(w, 's$', '') ELSE w END AS s
  FROM tok WHERE w <> '' AND w NOT IN ({', '.join(f"'{x}'" for x in ft.STOP_WORDS)})),
st AS (SELECT doc_id, w, regexp_replace(s, '([a-z]{{3}})(ing|edly|ed|ly)$', '\\1') AS p FROM pl), post AS (SELECT {_STEM} AS term, doc_id, CAST(sum(0.4) AS DOUBLE) AS weight FROM st GROUP BY 1, 2)"""


@query(f"""WITH {_TERMS}, q(query_id, term) AS (VALUES (1, 'tion'), (2, 'tion'), (2, 'here'), (3, 'thing')), h AS (SELECT query_id, doc_id, count(*) AS n, round(sum(ln(1 + weight)), 6) AS score FROM post JOIN q USING (term) GROUP BY 1, 2)
SELECT query_id, doc_id, score, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS r FROM h WHERE n = CASE query_id WHEN 2 THEN 2 ELSE 1 END) WHERE r <= 25""")
def full_text_search(spark, d):
    """Every question over the inverted index of all documents."""
    asked = spark.createDataFrame([(1, "the tions"), (2, "a Tion is here"), (3, "things"), (4, "of the")], "query_id int, query string")
    return ft.search(ft.index(t(spark, d, "documents"), "doc_id", None, "text"), asked, "doc_id")


@query(f"WITH {_TERMS} SELECT term, count(*) AS documents, round(sum(weight), 4) AS weight FROM post GROUP BY 1")
def inverted_index(spark, d):
    return ft.index(t(spark, d, "documents"), "doc_id", None, "text").groupBy("term").agg(F.count("*").alias("documents"), F.round(F.sum("weight"), 4).alias("weight"))


_COS = "list_inner_product(CAST(embedding AS DOUBLE[]), CAST(q.e AS DOUBLE[])) / (sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) * sqrt(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(q.e AS DOUBLE[]))))"


@query(f"""WITH q AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0), v AS (SELECT vec_id, vec_id % 20 AS contract_id, CASE label WHEN 0 THEN 'document_summary' WHEN 1 THEN 'clause' WHEN 2 THEN 'clause' ELSE 'chunk' END AS level, {_COS} AS s FROM embeddings, q),
a AS (SELECT * FROM v WHERE level = 'document_summary' AND s >= 0.0 ORDER BY s DESC, vec_id LIMIT 5), n AS (SELECT DISTINCT contract_id FROM a)
SELECT level, vec_id AS ref_id, contract_id, round(s, 6) AS similarity FROM (SELECT * FROM a UNION ALL (SELECT * FROM v WHERE level = 'clause' AND s >= 0.05 AND contract_id IN (SELECT contract_id FROM n) ORDER BY s DESC, vec_id LIMIT 10)
UNION ALL (SELECT * FROM v WHERE level = 'chunk' AND s >= -1 AND contract_id IN (SELECT contract_id FROM n) ORDER BY s DESC, vec_id LIMIT 8))""")
def level_descent(spark, d):
    e = t(spark, d, "embeddings")
    level = F.when(F.col("label") == 0, "document_summary").when(F.col("label").isin(1, 2), "clause").otherwise("chunk")
    rows = e.select(F.col("vec_id").alias("ref_id"), (F.col("vec_id") % 20).alias("contract_id"), level.alias("level"), "embedding")
    probe = e.where("vec_id = 0").first()["embedding"]
    return ft.descend(rows, probe, [("document_summary", 5, 0.0), ("clause", 10, 0.05), ("chunk", 8, -1.0)]).withColumn("similarity", F.round("similarity", 6))


@query("""SELECT event_type AS level, user_id AS ref_id, round(value, 6) AS score, CASE WHEN has_real THEN 'vector' ELSE 'neighbour' END AS source FROM (SELECT *, bool_or(value < 60) OVER (PARTITION BY event_type, user_id) AS has_real, row_number() OVER (PARTITION BY event_type, user_id ORDER BY value DESC) AS n FROM events) WHERE n = 1""")
def deduplicated_hits(spark, d):
    hits = t(spark, d, "events").select(F.col("event_type").alias("level"), F.col("user_id").alias("ref_id"), F.col("value").alias("score"), F.when(F.col("value") < 60, "vector").otherwise("neighbour").alias("source"))
    return ft.deduplicated(hits).withColumn("score", F.round("score", 6))


@query("""WITH c AS (SELECT DISTINCT conv_id, turn FROM conversations), h AS (SELECT conv_id, turn, 1.0 / (conv_id + turn + 1) AS score, CAST(row_number() OVER (ORDER BY conv_id, turn) AS INTEGER) AS rank FROM conversations WHERE role = 'assistant'),
b AS (SELECT conv_id, turn + o AS turn, max(score) * 0.5 AS score FROM h, (VALUES (-1), (1)) AS w(o) WHERE rank <= 20 GROUP BY 1, 2) SELECT conv_id, b.turn, round(score, 6) AS score FROM b SEMI JOIN c USING (conv_id, turn) ANTI JOIN h USING (conv_id, turn)""")
def neighbour_hits(spark, d):
    c = t(spark, d, "conversations")
    hits = c.where("role = 'assistant'").orderBy("conv_id", "turn").limit(20)  # the seeds, the first of all hits
    ranked = hits.select(F.col("conv_id").alias("contract_id"), F.col("turn").alias("reading_order"), (1.0 / (F.col("conv_id") + F.col("turn") + 1)).alias("score"), F.lit(1).alias("rank"))
    every = c.where("role = 'assistant'").select(F.col("conv_id").alias("contract_id"), F.col("turn").alias("reading_order"), F.lit(0.0).alias("score"), F.lit(999).alias("rank"))
    out = ft.neighbours_of(ranked.unionByName(every), c.select(F.col("conv_id").alias("contract_id"), F.col("turn").alias("reading_order")), 1)
    return out.select(F.col("contract_id").alias("conv_id"), F.col("reading_order").alias("turn"), F.round("score", 6).alias("score"))


_UNIT = "u AS (SELECT vec_id, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / n) AS e FROM (SELECT *, sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings))"


@query(f"""WITH {_UNIT}, p AS (SELECT q.vec_id AS query_id, u.vec_id, list_inner_product(q.e, u.e) AS s FROM u AS q JOIN u ON u.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 6) AS similarity, CAST(r AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS r FROM p) WHERE r <= 10""")
def knn_of_many(spark, d):
    """The stated query set (ids divisible by 100) against all rows, in blocks."""
    rows = t(spark, d, "embeddings")
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieval.knn_of(rows, asked, 10, "vec_id").select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""WITH {_TERMS}, {_UNIT}, k AS (SELECT doc_id, row_number() OVER (ORDER BY round(ln(1 + weight), 6) DESC, doc_id) AS rank FROM post WHERE term = 'tion' QUALIFY rank <= 50),
v AS (SELECT u.vec_id AS doc_id, row_number() OVER (ORDER BY round(list_inner_product(q.e, u.e), 9) DESC, u.vec_id) AS rank FROM u AS q JOIN u ON u.vec_id <> q.vec_id WHERE q.vec_id = 0 QUALIFY rank <= 50)
SELECT doc_id, round(sum(1.0 / (60 + rank)), 6) AS score, CASE WHEN count(*) > 1 THEN 'fused' ELSE min(leg) END AS source FROM (SELECT doc_id, rank, 'keyword' AS leg FROM k UNION ALL SELECT doc_id, rank, 'vector' FROM v) GROUP BY 1 ORDER BY round(sum(1.0 / (60 + rank)), 12) DESC, doc_id LIMIT 30""")
def hybrid_search(spark, d):
    """One question by both legs, fused: the inverted index, and the vectors of the same ids."""
    vectors = t(spark, d, "embeddings")
    near = retrieval.knn_of(vectors, vectors.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 50, "vec_id").select(F.col("vec_id").alias("doc_id"), "rank")
    words = ft.search(ft.index(t(spark, d, "documents"), "doc_id", None, "text"), spark.createDataFrame([(1, "tion")], "query_id int, query string"), "doc_id", limit=50).select("doc_id", "rank")
    return retrieval.fuse({"keyword": words, "vector": near}, "doc_id", 30).withColumn("score", F.round("score", 6))


#: Confidence and outcome of every line: 99 different values, some outside of 0 to 1.
_SAMPLES = """h AS (SELECT greatest(0.0, least(1.0, x)) AS x, count(*) AS n, sum(y) AS hits FROM (SELECT l_discount * 8 + l_tax * 4 - 0.05 AS x, CASE WHEN l_quantity > 42 - 300 * l_discount THEN 1 ELSE 0 END AS y FROM lineitem WHERE l_returnflag <> 'N') GROUP BY 1)"""


@query(f"""WITH RECURSIVE {_SAMPLES}, t AS (SELECT sum(n) AS total FROM h),
g AS (SELECT 0 AS i, CAST(1 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b UNION ALL
  SELECT i + 1, a - 0.5 * sum((n / (1 + exp(-(a * x + b))) - hits) * x) / any_value(total), b - 0.5 * sum(n / (1 + exp(-(a * x + b))) - hits) / any_value(total) FROM g, h, t WHERE i < 800 GROUP BY i, a, b),
c AS (SELECT h.x, sum(k.hits) OVER (PARTITION BY h.x ORDER BY k.x) / sum(k.n) OVER (PARTITION BY h.x ORDER BY k.x) AS m, k.x AS upto FROM h JOIN h AS k ON k.x >= h.x),
iso AS (SELECT x, max(low) AS isotonic FROM (SELECT p.x, c.x AS j, min(c.m) AS low FROM h AS p JOIN c ON c.x <= p.x AND c.upto >= p.x GROUP BY ALL) GROUP BY x),
v AS (SELECT h.x, n, hits, 'raw' AS calibrator, h.x AS v FROM h UNION ALL SELECT h.x, n, hits, 'platt', 1 / (1 + exp(-(a * h.x + b))) FROM h, g WHERE i = 800 UNION ALL SELECT h.x, n, hits, 'isotonic', isotonic FROM h JOIN iso USING (x)),
b AS (SELECT calibrator, least(floor(v * 10), 9) AS bin, sum(n) AS n, sum(v * n) / sum(n) AS mv, sum(hits) / sum(n) AS mh, sum(n * v * v - 2 * v * hits + hits) AS sq, sum(hits) AS hits FROM v GROUP BY ALL),
m AS (SELECT calibrator, CAST(sum(n) AS BIGINT) AS samples, sum(n * abs(mv - mh)) / sum(n) AS ece, max(abs(mv - mh)) AS mce, sum(sq) / sum(n) AS brier, sum(hits) / sum(n) AS base_rate, sum(n * (mv - mh)) / sum(n) AS bias FROM b GROUP BY 1),
r AS (SELECT CASE WHEN min(ece) <= max(ece) FILTER (calibrator = 'raw') - 0.02 THEN arg_min(calibrator, ece) ELSE 'raw' END AS best FROM m)
SELECT calibrator, samples, round(ece, 5) AS ece, round(mce, 5) AS mce, round(brier, 5) AS brier, round(base_rate, 5) AS base_rate, round(bias, 5) + 0.0 AS mean_bias, CASE WHEN calibrator = 'platt' THEN round((SELECT a FROM g WHERE i = 800), 4) END AS a,
  CASE WHEN calibrator = 'platt' THEN round((SELECT b FROM g WHERE i = 800), 4) END AS b, CASE WHEN calibrator = 'isotonic' THEN CAST((SELECT count(DISTINCT round(isotonic, 12)) FROM iso) AS INTEGER) END AS steps, calibrator = best AS recommended FROM m, r""")
def calibration_report(spark, d):
    """Raw, logistic and monotone calibration of every judged line, and which is worth it."""
    rows = t(spark, d, "lineitem").where("l_returnflag <> 'N'")
    said, right = F.col("l_discount") * 8 + F.col("l_tax") * 4 - 0.05, F.col("l_quantity") > 42 - 300 * F.col("l_discount")
    got = calibrate.report(rows, said, right)
    return got.select("calibrator", "samples", *[(F.round(c, 5) + 0.0).alias(c) for c in ("ece", "mce", "brier", "base_rate", "mean_bias")], *[F.round(c, 4).alias(c) for c in ("a", "b")], "steps", "recommended")
