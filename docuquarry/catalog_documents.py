"""Registered queries of document structure, evidence and graph operators, beside SQL that says the same.

Orders stand for documents and their lines for sections; conversations and their turns for paragraphs.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docuquarry.catalog import query, t
from docuquarry.functions import text as tx
from docuquarry.operators import aggregates as agg
from docuquarry.operators import structure
from docuquarry.plans import evidence


@query("""WITH s AS (SELECT DISTINCT l_orderkey AS doc_id, l_linenumber AS n FROM lineitem),
p AS (SELECT *, last_value(CASE WHEN (n - 1) % 3 = 0 THEN n END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY n) AS top FROM s)
SELECT doc_id, CAST(n AS VARCHAR) AS section_id, CASE WHEN (n - 1) % 3 > 0 THEN CAST(top AS VARCHAR) END AS parent_id, CASE WHEN (n - 1) % 3 > 0 THEN 2 ELSE 1 END AS level FROM p""")
def section_hierarchy(spark, d):
    n, k = F.expr("(n - 1) div 3 + 1").cast("string"), F.expr("(n - 1) % 3")
    rows = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("n")).distinct()
    number = F.when(k == 0, n).otherwise(F.concat(n, F.lit("."), k.cast("string")))
    sections = rows.select("doc_id", F.col("n").alias("section_id"), F.col("n").alias("ord"), number.alias("number"), F.when(k == 0, F.lit("99")).alias("parent_id"), F.lit(1).alias("level"))
    return structure.repair_sections(sections).select("doc_id", "section_id", "parent_id", "level")


@query("""WITH s AS (SELECT user_id, CAST(ts AS DATE) AS page, max(event_id) AS section_id FROM events WHERE event_type = 'purchase' GROUP BY 1, 2)
SELECT e.event_id, s.section_id FROM (SELECT *, CAST(ts AS DATE) AS page FROM events WHERE event_type <> 'purchase') e ASOF LEFT JOIN s ON e.user_id = s.user_id AND e.page >= s.page""")
def owning_sections(spark, d):
    rows = t(spark, d, "events").select(F.col("user_id").alias("doc_id"), F.to_date("ts").alias("page"), F.col("event_id").alias("pos"), "event_type")
    sections = rows.where("event_type = 'purchase'").select("doc_id", F.col("page").alias("start_page"), F.col("pos").alias("ord"), F.col("pos").alias("section_id"))
    paragraphs = rows.where("event_type <> 'purchase'").select("doc_id", "page", "pos", F.lit(None).cast("long").alias("section_id"))
    return structure.assign_sections(paragraphs, sections).select(F.col("pos").alias("event_id"), "section_id")


@query("""WITH c AS (SELECT *, role = 'user' AS head, turn % 5 = 4 AS edge FROM conversations),
g AS (SELECT *, max(CASE WHEN head OR edge THEN turn END) OVER (PARTITION BY conv_id ORDER BY turn) AS at FROM c)
SELECT g.conv_id AS doc_id, g.turn AS pos, g.at AS heading_pos FROM g JOIN c ON c.conv_id = g.conv_id AND c.turn = g.at WHERE c.head""")
def clause_extents(spark, d):
    rows = t(spark, d, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("pos"), "role")
    return structure.extents(rows, F.col("role") == "user", F.col("pos") % 5 == 4).select("doc_id", "pos", "heading_pos")


@query("""SELECT o_custkey AS doc_id, CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'urgent' ELSE 'routine' END AS clause, min(o_orderkey) AS pos FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH', '5-LOW') GROUP BY 1, 2""")
def heading_clauses(spark, d):
    names = spark.createDataFrame([("urgent", "1 urgent"), ("urgent", " 2-high:"), ("routine", "5 LOW")], "clause string, name string")
    rows = t(spark, d, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("pos"), F.col("o_orderpriority").alias("text"))
    return structure.first_headings(rows, names)


def _paragraphs(spark, d):
    lines = t(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    return lines.where(F.trim("text") != "").withColumn("page", F.expr("pos div 10 + 1"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
c AS (SELECT doc_id, pos, CASE WHEN length(text) <= 40 THEN pos END AS head, greatest(1, CAST(floor(length(text) / CASE WHEN length(text) - length(regexp_replace(text, '\\s', '', 'g')) >= 0.25 * length(text) THEN 3.0 ELSE 3.6 END) AS BIGINT)) AS cost FROM l WHERE trim(text) <> ''),
o AS (SELECT *, coalesce(last_value(head IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos), -1) AS sec, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM c),
w AS (SELECT doc_id, i, sec, pos, pos AS first, CASE WHEN pos = sec THEN 0 ELSE cost END AS tok FROM o WHERE i = 1
  UNION ALL SELECT o.doc_id, o.i, o.sec, o.pos, CASE WHEN o.sec = w.sec AND (tok = 0 OR tok + cost <= 700) THEN first ELSE o.pos END, CASE WHEN o.sec = w.sec AND (tok = 0 OR tok + cost <= 700) THEN tok + cost WHEN o.pos = o.sec THEN 0 ELSE cost END FROM w JOIN o ON o.doc_id = w.doc_id AND o.i = w.i + 1)
SELECT doc_id, max(sec) AS heading_pos, first AS first_pos, max(pos) AS last_pos, count(*) AS paragraphs, max(tok) AS tokens FROM w GROUP BY doc_id, first""")
def chunked_sections(spark, d):
    rows = _paragraphs(spark, d).withColumn("tokens", tx.token_estimate(F.col("text")))
    return structure.section_chunks(rows, F.length("text") <= 40)


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents),
p AS (SELECT doc_id, pos // 10 + 1 AS page, pos, CASE WHEN pos % 10 = 9 AND doc_id % 3 = 0 THEN rtrim(line, '.') WHEN pos % 10 = 9 AND doc_id % 3 = 1 THEN line || ' Inc.' WHEN pos % 10 = 0 AND doc_id % 5 = 0 THEN 'section 4 ' || line WHEN pos % 10 < 2 AND doc_id % 2 = 0 THEN lower(line) ELSE line END AS text FROM l WHERE trim(line) <> ''),
o AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page, pos) AS i FROM p),
c AS (SELECT b.*, coalesce(NOT (regexp_matches(rtrim(a.text), '[.!?:;][''")\]]?\s*$') AND NOT regexp_matches(lower(rtrim(a.text)), '(inc|ltd|llc|co|corp|no|nos|art|sec|cf|e\.g|i\.e|etc|vs|v)\.$')) AND regexp_matches(trim(b.text), '^[a-z]')
  AND NOT regexp_matches(trim(b.text), '^(?i)(section|clause|article|paragraph|schedule|exhibit|annex|appendix|attachment)s?\s+(\d+(\.\d+)*(\([a-z0-9]+\))?|[A-Z](\.\d+)*|[IVXLC]+)\b'), false) AS runs FROM o AS b LEFT JOIN o AS a ON a.doc_id = b.doc_id AND a.i = b.i - 1),
w AS (SELECT doc_id, i, page AS first, i AS head FROM c WHERE i = 1 UNION ALL SELECT c.doc_id, c.i, CASE WHEN runs AND page = first + 1 THEN first ELSE page END, CASE WHEN runs AND page = first + 1 THEN head ELSE c.i END FROM w JOIN c ON c.doc_id = w.doc_id AND c.i = w.i + 1)
SELECT doc_id, min(page) AS page, CAST(min(pos) AS BIGINT) AS pos, CAST(count(*) AS INTEGER) AS fragments, sha256(CASE WHEN count(*) = 1 THEN any_value(text) ELSE string_agg(trim(text), ' ' ORDER BY i) END) AS text_sha256 FROM w JOIN c USING (doc_id, i) GROUP BY doc_id, head""")
def joined_continuations(spark, d):
    """Lines as paragraphs of ten to a page; some pages end open or with an abbreviation, some begin in small letters or with a reference."""
    line, at, doc = F.col("text"), F.col("pos") % 10, F.col("doc_id")
    text = F.when((at == 9) & (doc % 3 == 0), F.rtrim(line, F.lit("."))).when((at == 9) & (doc % 3 == 1), F.concat(line, F.lit(" Inc."))).when((at == 0) & (doc % 5 == 0), F.concat(F.lit("section 4 "), line)).when((at < 2) & (doc % 2 == 0), F.lower(line)).otherwise(line)
    rows = _paragraphs(spark, d).withColumn("section_id", F.lit(None).cast("string")).withColumn("text", text)
    return structure.merge_continuations(rows).select("doc_id", "page", "pos", "fragments", F.sha2("text", 256).alias("text_sha256"))


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'rejected' WHEN trim(substr(text, 1, 40)) = '' THEN 'empty' ELSE 'ok' END AS verdict FROM conversations""")
def quote_checks(spark, d):
    quote = F.when(F.col("turn") % 3 == 2, "qqzx zzqx xqzz").otherwise(F.substring("text", 1, 40))
    return evidence.check_quotes(t(spark, d, "conversations").withColumn("quote", quote), "quote", "text").select("conv_id", "turn", "verdict")


@query("""WITH c AS (SELECT conv_id, turn, trim(substr(text, 1, 40)) AS head, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\x0b\x0c]+'), lambda x: x <> '')) AS n FROM conversations),
s AS (SELECT conv_id, turn, k.kind, least(n, k.most) / (least(n, k.most) + 1.0) AS share FROM c, (VALUES ('short', 9), ('long', 60), ('invented', 0)) k(kind, most))
SELECT conv_id, turn, kind, CASE WHEN share >= 0.98 THEN 'ok' WHEN share >= 0.85 THEN 'partial' ELSE 'rejected' END AS verdict FROM s
UNION ALL SELECT conv_id, turn, 'typographic', CASE WHEN coalesce(head, '') = '' THEN 'empty' ELSE 'ok' END FROM c""")
def altered_quote_checks(spark, d):
    """Every turn quoted in typographic marks, by its first 9 and 60 words with an invented one behind them, and by the invented one alone."""
    opening = lambda n: F.concat_ws(" ", F.slice(F.split(tx.squeeze(F.col("text")), " "), 1, n), F.lit("qqzxq"))
    set_out = F.translate(F.substring("text", 1, 40), "'\"- ", "\u2019\u201d\u2013\u00a0")
    for ligature, letters in evidence.LIGATURES:
        set_out = F.replace(set_out, F.lit(letters), F.lit(ligature))
    quotes = {"typographic": set_out, "short": opening(9), "long": opening(60), "invented": F.lit("qqzxq")}
    kinds = F.array(*[F.struct(F.lit(k).alias("kind"), q.alias("quote")) for k, q in quotes.items()])
    rows = t(spark, d, "conversations").select("conv_id", "turn", "text", F.inline(kinds))
    return evidence.check_quotes(rows, "quote", "text").select("conv_id", "turn", "kind", "verdict")


@query("""SELECT l_orderkey, CASE WHEN count(*) FILTER (l_quantity > 30) = 0 THEN 'missing' WHEN bool_or(l_quantity > 30 AND l_returnflag = 'A') THEN 'fabricated' ELSE 'ok' END AS verdict
FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity, l_returnflag) GROUP BY 1""")
def citation_checks(spark, d):
    rows = t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_quantity", "l_returnflag")).alias("s")).select("*", "s.*")
    sets = rows.groupBy("l_orderkey").agg(F.collect_set(F.when(F.col("l_quantity") > 30, F.col("l_linenumber"))).alias("cited"), F.collect_set(F.when(F.col("l_returnflag") != "A", F.col("l_linenumber"))).alias("offered"))
    return sets.select("l_orderkey", evidence.citation_verdict(F.col("cited"), F.col("offered")).alias("verdict"))


@query("""WITH a AS (SELECT l_orderkey, count(*) FILTER (l_quantity > 30) AS cited, count(*) AS offered, avg(l_extendedprice) FILTER (l_quantity > 30) / 119993 AS s, bool_or(l_returnflag = 'A') AS fake, count(*) > 5 AS dropped, l_orderkey % 2 = 0 AS shy FROM lineitem GROUP BY l_orderkey)
SELECT l_orderkey, CASE WHEN cited = 0 AND shy THEN 0.75 WHEN cited = 0 THEN 0.15 ELSE round((0.55 * least(cited / least(offered, 5), 1.0) + 0.45 * least(s, 1.0)) * CASE WHEN fake THEN 0.5 ELSE 1.0 END * CASE WHEN dropped THEN 0.9 ELSE 1.0 END, 4) END AS confidence FROM a""")
def answer_scores(spark, d):
    big = F.col("l_quantity") > 30
    rows = t(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count_if(big).alias("cited"), F.count("*").alias("offered"), (F.avg(F.when(big, F.col("l_extendedprice"))) / 119993).alias("s"), F.bool_or(F.col("l_returnflag") == "A").alias("fake"))
    score = evidence.answer_confidence(F.col("cited"), F.col("offered"), F.col("s"), F.col("fake"), F.col("offered") > 5, F.col("l_orderkey") % 2 == 0)
    return rows.select("l_orderkey", score.alias("confidence"))


@query("""SELECT user_id, round(max(value) FILTER (event_type IN ('click', 'view')) / 100, 6) AS similarity, coalesce(max(value) FILTER (event_type IN ('click', 'view')) / 100 >= 0.45, false) AS answered FROM events GROUP BY 1""")
def answer_guardrail(spark, d):
    level = F.when(F.col("event_type") == "click", "clause").when(F.col("event_type") == "view", "chunk").otherwise("document_summary")
    rows = t(spark, d, "events").select("user_id", level.alias("level"), (F.col("value") / 100).alias("similarity"))
    return evidence.guardrail(rows, "user_id").withColumn("similarity", F.round("similarity", 6))


@query("""WITH h AS (SELECT o_custkey AS q, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
e AS (SELECT o_orderkey AS source, o_orderkey + 1 AS target FROM orders), w AS (SELECT source AS n, target AS node FROM e UNION SELECT target, source FROM e)
SELECT q, w.node, round(max(1.0 / rank) * 0.4, 6) AS score FROM h JOIN w ON w.n = h.node WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM h x WHERE x.q = h.q AND x.node = w.node) GROUP BY 1, 2""")
def graph_expansion(spark, d):
    w = Window.partitionBy("q").orderBy(F.desc("o_totalprice"), "node")
    hits = t(spark, d, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("node"), "o_totalprice").withColumn("rank", F.row_number().over(w)).withColumn("score", 1.0 / F.col("rank"))
    edges = t(spark, d, "orders").select(F.col("o_orderkey").alias("source"), (F.col("o_orderkey") + 1).alias("target"))
    return evidence.expand_graph(hits, edges, "q").withColumn("score", F.round("score", 6))


@query("""WITH h AS (SELECT o_custkey AS q, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders),
e AS (SELECT o_orderkey AS source, o_orderkey + 1 AS target FROM orders), w AS (SELECT source AS n, target AS node FROM e UNION SELECT target, source FROM e)
SELECT q, w.node, round(max(1.0 / rank) * 0.4, 6) AS score FROM h JOIN w ON w.n = h.node WHERE rank <= 10 AND NOT EXISTS (SELECT 1 FROM h x WHERE x.q = h.q AND x.node = w.node) GROUP BY 1, 2""")
def graph_expansion_all(spark, d):
    w = Window.partitionBy("q").orderBy(F.desc("o_totalprice"), "node")
    hits = t(spark, d, "orders").select(F.col("o_custkey").alias("q"), F.col("o_orderkey").alias("node"), "o_totalprice").withColumn("rank", F.row_number().over(w)).withColumn("score", 1.0 / F.col("rank"))
    edges = t(spark, d, "orders").select(F.col("o_orderkey").alias("source"), (F.col("o_orderkey") + 1).alias("target"))
    return evidence.expand_graph(hits, edges, "q").withColumn("score", F.round("score", 6))


@query("""SELECT l_suppkey AS source, l_partkey AS target, l_linestatus AS kind, bool_or(l_quantity > 25) AS resolved, CASE WHEN count(DISTINCT l_returnflag) > 1 THEN 'corroborated' ELSE min(l_returnflag) END AS origin FROM lineitem GROUP BY 1, 2, 3""")
def merged_edges(spark, d):
    rows = t(spark, d, "lineitem").select(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"), F.col("l_linestatus").alias("kind"), (F.col("l_quantity") > 25).alias("resolved"), F.col("l_returnflag").alias("origin"))
    return evidence.merge_edges(rows)


@query("""SELECT event_id AS ord, event_type || ':' || user_id AS ref FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) = 1""")
def graph_nodes(spark, d):
    return evidence.first_nodes(t(spark, d, "events").select(F.col("event_id").alias("ord"), F.concat_ws(":", "event_type", "user_id").alias("ref")))


@query("""SELECT user_id, event_id AS pos, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_type <> 'error' THEN value END DESC NULLS LAST, event_id) AS rank FROM events""")
def reranked_evidence(spark, d):
    rows = t(spark, d, "events").select("user_id", F.col("event_id").alias("pos"), F.when(F.col("event_type") != "error", F.col("value")).alias("rerank_score"))
    return evidence.rerank(rows, "user_id").drop("rerank_score")


@query("""WITH RECURSIVE c AS (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(floor(length(text) / CASE WHEN length(text) - length(regexp_replace(text, '[ \t\n\r\x0b\x0c]', '', 'g')) >= 0.25 * length(text) THEN 3.0 ELSE 3.6 END) AS BIGINT)) END AS tokens FROM conversations),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS pos, CAST(0 AS BIGINT) AS tokens, CAST(0 AS INTEGER) AS label, CAST(0 AS BIGINT) AS spent, CAST(1 AS INTEGER) AS next FROM (SELECT DISTINCT conv_id FROM conversations)
UNION ALL SELECT conv_id, i, pos, tokens, CASE WHEN gone THEN 0 ELSE next END, CASE WHEN gone THEN spent ELSE spent + tokens + 30 END, CASE WHEN gone THEN next ELSE next + 1 END FROM
  (SELECT w.conv_id, c.i, c.turn AS pos, c.tokens, w.spent, w.next, w.next > 8 OR ((c.tokens + 30 > 250 OR w.spent + c.tokens + 30 > 1000) AND w.next > 3) AS gone FROM w JOIN c ON c.conv_id = w.conv_id AND c.i = w.i + 1))
SELECT conv_id, pos, tokens, label FROM w WHERE i > 0""")
def context_assembly(spark, d):
    rows = t(spark, d, "conversations").select("conv_id", F.col("turn").alias("pos"), tx.token_estimate(F.col("text")).alias("tokens"))
    return evidence.assemble_context(rows, "conv_id", budget=1_000, most=8)


@query()
def extraction_batches(spark, d):
    rows = t(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("doc_id"), (F.col("l_linenumber") % 4).cast("string").alias("clause"))
    chunks = rows.agg(F.sort_array(F.collect_set(F.col("l_suppkey") % 3)).alias("chunks"), F.min("l_linenumber").alias("priority"))
    return evidence.plan_batches(chunks.withColumn("costs", F.transform("chunks", lambda c: 100 + c)), budget=250)


@query("""SELECT c_name AS party, count(DISTINCT o_orderkey) AS contracts FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0 GROUP BY 1 ORDER BY contracts DESC, party LIMIT 100""")
def counterparties(spark, d):
    rows = t(spark, d, "orders").join(t(spark, d, "customer").where("c_acctbal > 0"), F.col("o_custkey") == F.col("c_custkey"))
    return agg.counterparties(rows, F.col("c_name"), "o_orderkey")


@query("""SELECT role AS chunk_type, count(*) AS chunks, CAST(sum(length(text)) AS BIGINT) AS characters, max(turn) + 1 AS next_version FROM conversations GROUP BY 1""")
def chunk_statistics(spark, d):
    return agg.chunk_statistics(t(spark, d, "conversations"), F.col("role"), "text", "turn")


@query("""SELECT o_custkey, count(*) FILTER (o_orderpriority = '1-URGENT') AS critical, count(*) FILTER (o_orderpriority = '2-HIGH') AS high, count(*) FILTER (o_orderpriority > '3') AS rest,
arg_max(o_orderstatus, CASE o_orderstatus WHEN 'P' THEN 3 WHEN 'O' THEN 2 ELSE 1 END) AS top FROM orders GROUP BY 1""")
def risk_breakdown(spark, d):
    level, rank = F.col("o_orderpriority"), F.when(F.col("o_orderstatus") == "P", 3).when(F.col("o_orderstatus") == "O", 2).otherwise(1)
    return agg.severity_breakdown(t(spark, d, "orders"), "o_custkey", {"critical": level == "1-URGENT", "high": level == "2-HIGH", "rest": level > "3"}, F.col("o_orderstatus"), rank)


@query("""WITH x AS (SELECT DISTINCT l_orderkey, unnest([l_returnflag, l_linestatus, l_returnflag || l_linestatus]) AS tag FROM lineitem)
SELECT tag, count(*) AS cases FROM x GROUP BY 1 HAVING count(*) >= 3""")
def tag_slices(spark, d):
    return agg.tag_slices(t(spark, d, "lineitem"), "l_orderkey", F.array("l_returnflag", "l_linestatus", F.concat("l_returnflag", "l_linestatus")))


@query("""SELECT event_type AS stage, count(*) AS total, count(CASE WHEN value > 20 THEN value END) AS indexed, round(count(CASE WHEN value > 20 THEN value END) * 1.0 / count(*), 4) AS coverage,
  min(CASE WHEN value > 95 THEN ts END) AS earliest FROM events GROUP BY 1""")
def index_coverage(spark, d):
    return agg.index_coverage(t(spark, d, "events"), F.col("event_type"), F.when(F.col("value") > 20, F.col("value")), F.when(F.col("value") > 95, F.col("ts")))
