"""Registered queries of searching: the positional index, the partitioned vector index and the descent, beside SQL that says the same.

Documents are chunks, their languages the projects; embeddings stand for vectors of three levels.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docuquarry.catalog import query, t
from docuquarry.plans import context, descent, evidence
from docuquarry.plans import fulltext as ft
from docuquarry.plans import positional
from docuquarry.plans import vector_index as vi

_STOP = ", ".join(f"'{x}'" for x in ft.STOP_WORDS)
#: Words of every document by place, and their stems.
_PLACED = f"""words AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS ws FROM documents),
flat AS (SELECT doc_id, unnest(ws) AS w, unnest(range(len(ws))) AS pos FROM words),
pl AS (SELECT *, CASE WHEN regexp_matches(w, '[^aeious]ies$') THEN regexp_replace(w, 'ies$', 'y') WHEN regexp_matches(w, '(ss|x|z|ch|sh)es$') THEN regexp_replace(w, 'es$', '') WHEN regexp_matches(w, '[^aius]s$') THEN regexp_replace(w, 's$', '') ELSE w END AS s FROM flat),
st AS (SELECT *, regexp_replace(s, '([a-z]{{3}})(ing|edly|ed|ly)$', '\\1') AS p FROM pl),
term AS (SELECT doc_id, pos, w, w IN ({_STOP}) AS stop, CASE WHEN length(w) > 3 AND regexp_matches(p, '[a-z]{{2}}[b-df-hj-np-tv-z]{{2}}$') AND substr(p, length(p) - 1, 1) = right(p, 1) THEN left(p, -1) WHEN length(w) > 3 THEN p ELSE w END AS term FROM st)"""


#: What each question finds among all documents.
_FOUND = f"""{_PLACED},
q AS (SELECT doc_id AS q, pos, term, stop FROM term SEMI JOIN (SELECT doc_id FROM words WHERE doc_id % 100 = 0 AND len(ws) > 12) USING (doc_id)),
tree AS (SELECT q, a, c, neg, term, pos FROM q, (VALUES (0, 0, false, 2, 3), (0, 1, false, 6, 6), (1, 0, false, 8, 10), (1, 1, true, 0, 0), (2, 0, false, 11, 12)) AS v(a, c, neg, lo, hi) WHERE pos BETWEEN lo AND hi AND NOT stop),
part AS (SELECT q, a, c, neg, count(*) AS need, min(pos) AS first FROM tree GROUP BY ALL),
hit AS (SELECT q, a, c, neg, need, term.doc_id, term.pos - tree.pos + first AS spot FROM tree JOIN part USING (q, a, c, neg) JOIN term ON term.term = tree.term AND NOT term.stop),
stood AS (SELECT q, a, c, neg, doc_id, spot FROM hit GROUP BY q, a, c, neg, need, doc_id, spot HAVING count(*) = need),
clause AS (SELECT q, a, c, neg, doc_id, ln(1 + 0.4 * count(*)) AS s FROM stood GROUP BY ALL),
alt AS (SELECT q, a, doc_id, round(sum(s), 6) AS s FROM clause JOIN (SELECT q, a, count(*) FILTER (NOT neg) AS wanted FROM part GROUP BY ALL) USING (q, a) GROUP BY q, a, doc_id, wanted HAVING count(*) FILTER (neg) = 0 AND count(*) = wanted),
f AS (SELECT q, doc_id, max(s) AS score FROM alt GROUP BY ALL)"""


def _questions(spark, d):
    """A question from every hundredth document: its first words as phrases, a word, an alternative and an exclusion."""
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    w = lambda i: F.get("w", F.lit(i))
    asked = t(spark, d, "documents").where("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), words.alias("w")).where(F.size("w") > 12)
    return asked.select("query_id", F.concat(F.lit('"'), w(2), F.lit(" "), w(3), F.lit('" '), w(6), F.lit(' OR "'), w(8), F.lit(" "), w(9), F.lit(" "), w(10), F.lit('" -'), w(0), F.lit(" or "), w(11), F.lit("-"), w(12)).alias("query"))


@query(f"""WITH {_FOUND}
SELECT q AS query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM f QUALIFY rank <= 25""")
def web_search(spark, d):
    """Phrases, alternatives and exclusions from every hundredth document, over all documents."""
    asked = _questions(spark, d)
    return positional.search_texts(t(spark, d, "documents"), asked, "doc_id", {"text": 0.4})


@query(f"""WITH {_PLACED} SELECT term, count(DISTINCT doc_id) AS documents, count(*) AS uses, CAST(max(pos) AS BIGINT) AS last FROM term WHERE NOT stop GROUP BY 1""")
def positional_index(spark, d):
    """The whole index, by term: in how many documents, how often, and the last place of any."""
    postings = positional.index(t(spark, d, "documents"), "doc_id", {"text": 0.4})
    return postings.groupBy("term").agg(F.count("*").alias("documents"), F.sum(F.size("positions")).alias("uses"), F.max(F.array_max("positions")).cast("long").alias("last"))


_UNIT = "u AS (SELECT vec_id, label, list_transform(CAST(embedding AS DOUBLE[]), lambda x: x / sqrt(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])))) AS e FROM embeddings)"


#: Ids, eight bytes each, that are broadcast at most, so that texts stay where they are read.
_IDS = 4_000_000


def _vector_rows(spark, d):
    """Embeddings with what searches filter on: level and model by label, project by id, a risk band as metadata."""
    level = F.when(F.col("label") == 0, "document_summary").when(F.col("label").isin(1, 2), "clause").otherwise("chunk")
    band = F.when(F.col("vec_id") % 3 == 0, "high").otherwise("low")
    return t(spark, d, "embeddings").select("vec_id", "embedding", level.alias("level"), F.when(F.col("vec_id") % 11 == 0, "m1").otherwise("m2").alias("model"), (F.col("vec_id") % 4).alias("project_id"), F.create_map(F.lit("risk_band"), band).alias("filter_metadata"), (F.col("vec_id") % 20).alias("contract_id"))


@query(f"""WITH {_UNIT}, p AS (SELECT q.vec_id AS query_id, u.vec_id, list_inner_product(q.e, u.e) AS s FROM u AS q JOIN u ON u.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0)
SELECT query_id, vec_id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS INTEGER) AS rank FROM p QUALIFY rank <= 10""")
def indexed_knn(spark, d):
    """Every hundredth vector against all rows by way of the partitioned index."""
    rows = t(spark, d, "embeddings").select("vec_id", "embedding")
    centres = vi.fit_centres(rows, "vec_id", n_centres=32)
    asked = rows.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return vi.nearest(vi.assign(rows, centres), centres, asked, 10, "vec_id").select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""WITH {_UNIT}, p AS (SELECT q.vec_id AS query_id, u.vec_id, list_inner_product(q.e, u.e) AS s FROM u AS q JOIN u ON u.vec_id <> q.vec_id
  WHERE q.vec_id % 100 = 0 AND u.label IN (1, 2) AND u.vec_id % 11 <> 0 AND u.vec_id % 3 = 0 AND (q.vec_id % 300 = 0 OR u.vec_id % 4 IN (q.vec_id // 100 % 4, 2)))
SELECT query_id, vec_id, round(s, 6) AS similarity, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(s, 9) DESC, vec_id) AS INTEGER) AS rank FROM p WHERE s >= 0.02 QUALIFY rank <= 7""")
def scoped_knn(spark, d):
    """The index with filters of model, level and metadata, and a scope of projects for each question (every third sees all)."""
    rows = _vector_rows(spark, d)
    centres = vi.fit_centres(rows, "vec_id", n_centres=16)
    scope = F.when(F.col("vec_id") % 300 != 0, F.array((F.floor(F.col("vec_id") / 100) % 4).cast("long"), F.lit(2).cast("long")))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", scope.alias("projects"))
    where = (F.col("model") == "m2") & (F.col("level") == "clause") & (F.col("filter_metadata")["risk_band"] == "high")
    found = vi.nearest(vi.assign(rows, centres), centres, asked, 7, "vec_id", where=where, match={"project_id": "projects"}, floor=0.02)
    return found.select("query_id", "vec_id", F.round("similarity", 6).alias("similarity"), "rank")


@query(f"""WITH {_FOUND}, {_UNIT},
r AS (SELECT vec_id AS ref, vec_id % 20 AS con, vec_id // 20 AS num, CASE label WHEN 0 THEN 'document_summary' WHEN 1 THEN 'clause' WHEN 2 THEN 'clause' ELSE 'chunk' END AS level, e FROM u),
p AS (SELECT a.ref AS q, b.level, b.ref, b.con, list_inner_product(a.e, b.e) AS s FROM r AS a JOIN r AS b ON a.ref <> b.ref WHERE a.ref % 100 = 0),
v0 AS (SELECT q, level, ref, con, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, ref) AS rank FROM p WHERE level = 'document_summary' AND s >= 0.05 QUALIFY rank <= 4),
sc AS (SELECT DISTINCT q, con FROM v0),
pn AS (SELECT * FROM p WHERE q NOT IN (SELECT q FROM sc) OR (q, con) IN (SELECT (q, con) FROM sc)),
kn AS (SELECT q, r.ref, r.con, score FROM f JOIN r ON r.ref = f.doc_id AND r.level = 'chunk' WHERE q IN (SELECT ref FROM r) AND (q NOT IN (SELECT q FROM sc) OR (q, r.con) IN (SELECT (q, con) FROM sc))),
v1 AS (SELECT q, level, ref, con, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, ref) AS rank FROM pn WHERE level = 'clause' AND s >= 0.0 QUALIFY rank <= 10),
v2 AS (SELECT q, level, ref, con, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, ref) AS rank FROM pn WHERE level = 'chunk' AND s >= -1 QUALIFY rank <= 8),
kk AS (SELECT q, ref, con, row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, ref) AS rank FROM kn),
legs AS (SELECT 0 AS step, 'vector' AS leg, * FROM v0 UNION ALL SELECT 1, 'vector', * FROM v1 UNION ALL SELECT 2, 'vector', * FROM v2
  UNION ALL SELECT 1, 'keyword', q, 'chunk', ref, con, rank FROM kk WHERE rank <= 10 UNION ALL SELECT 2, 'keyword', q, 'chunk', ref, con, rank FROM kk WHERE rank <= 8),
fu AS (SELECT step, q, level, ref, con, sum(1.0 / (60 + rank)) AS score, CASE WHEN count(*) > 1 THEN 'fused' ELSE min(leg) END AS source FROM legs GROUP BY ALL),
ev AS (SELECT *, row_number() OVER (PARTITION BY step, q ORDER BY round(score, 9) DESC, ref) AS rank FROM fu QUALIFY rank <= [4, 10, 8][step + 1]),
se AS (SELECT *, row_number() OVER (PARTITION BY q, level ORDER BY step, rank) AS o FROM ev),
ne AS (SELECT q, b.ref, b.con, arg_min(score, o) * 0.5 AS score FROM se JOIN r AS a ON a.ref = se.ref JOIN r AS b ON b.level = 'chunk' AND b.con = a.con AND abs(b.num - a.num) BETWEEN 1 AND 1 WHERE se.level = 'chunk' AND o <= 20 GROUP BY ALL),
ed AS (SELECT DISTINCT x, y FROM (SELECT n AS x, 2 * n + 1 AS y FROM (SELECT DISTINCT num AS n FROM r) UNION ALL SELECT 2 * n + 1, n FROM (SELECT DISTINCT num AS n FROM r)) QUALIFY row_number() OVER (PARTITION BY x ORDER BY y) <= 5),
gr AS (SELECT q, y, arg_min(se.con, o) AS con, arg_min(score, o) * 0.4 AS score FROM se JOIN r AS a ON a.ref = se.ref JOIN ed ON ed.x = a.num WHERE se.level = 'clause' AND o <= 10 GROUP BY ALL),
al AS (SELECT q, level, ref, con, score, source FROM ev UNION ALL SELECT q, 'chunk', ref, con, score, 'neighbour' FROM ne WHERE (q, ref) NOT IN (SELECT (q, ref) FROM ev WHERE level = 'chunk')
  UNION ALL SELECT q, 'clause', r.ref, r.con, score, 'graph' FROM gr JOIN r ON r.level = 'clause' AND r.con = gr.con AND r.num = gr.y),
de AS (SELECT q, level, ref, con, score, coalesce(max(source) FILTER (source NOT IN ('neighbour', 'graph')) OVER (PARTITION BY q, level, ref), source) AS source FROM al),
un AS (SELECT * FROM de QUALIFY row_number() OVER (PARTITION BY q, level, ref ORDER BY score DESC, source) = 1)
SELECT q AS query_id, level, ref AS ref_id, con AS contract_id, round(score, 6) AS score, source, CAST(row_number() OVER (PARTITION BY q ORDER BY round(score, 9) DESC, level, ref) AS INTEGER) AS rank FROM un""")
def descent_of_many(spark, d):
    """All questions through summaries, clauses and chunks at once, with both legs, neighbours and edges."""
    rows = _vector_rows(spark, d).select("level", F.col("vec_id").alias("ref_id"), "contract_id", "embedding", F.floor(F.col("vec_id") / 20).alias("place"))
    asked = rows.where("ref_id % 100 = 0").select(F.col("ref_id").alias("query_id"), "embedding")
    chunks = rows.where("level = 'chunk'").select("ref_id", "contract_id", F.col("place").alias("reading_order"))
    # only documents that are chunks can be hits, and only questions with a vector descend
    texts = t(spark, d, "documents").join(positional.small(chunks.select(F.col("ref_id").alias("doc_id")), _IDS), "doc_id", "left_semi")
    words = positional.search_texts(texts, _questions(spark, d).join(asked.select("query_id"), "query_id", "left_semi"), "doc_id", {"text": 0.4}, limit=None)
    hits = words.select("query_id", F.col("doc_id").alias("ref_id"), "score").join(chunks.select("ref_id", "contract_id"), "ref_id")
    clauses = rows.where("level = 'clause'").select("ref_id", "contract_id", F.col("place").alias("number"))
    edges = rows.select(F.col("place").alias("source_ref"), (2 * F.col("place") + 1).alias("target_ref")).distinct()
    levels = [descent.Level("document_summary", 4, 0.05), descent.Level("clause", 10, 0.0), descent.Level("chunk", 8, -1.0)]
    found = descent.descend(rows.drop("place"), asked, levels, hits, chunks, 1, clauses, edges, 1)
    return found.withColumn("score", F.round("score", 6))


@query("""WITH RECURSIVE t AS (SELECT conv_id, turn, role, trim(text) AS text, CASE WHEN length(trim(text)) - length(replace(replace(trim(text), ' ', ''), chr(10), '')) >= 0.25 * length(trim(text)) THEN floor(length(trim(text)) / 3.0) ELSE floor(length(trim(text)) / 3.6) END AS tk FROM conversations),
k AS (SELECT *, CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, CAST(tk AS INTEGER)) END AS tokens FROM t),
h AS (SELECT *, sum(tokens + 8) OVER (PARTITION BY conv_id ORDER BY turn DESC) AS so, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM k WHERE role = 'user'),
s AS (SELECT conv_id, CAST(sum(tokens + 8) AS BIGINT) AS spent FROM h WHERE n <= 6 AND (n = 1 OR so <= 120) GROUP BY 1),
f AS (SELECT conv_id, length('=== CONTRACT FACTS ===' || chr(10) || '- Talk ' || conv_id || '; agreement type: chat; contract value: ' || count(*) || '; missing clauses: a, b') AS l, '=== CONTRACT FACTS ===' || chr(10) || '- Talk ' || conv_id || '; agreement type: chat; contract value: ' || count(*) || '; missing clauses: a, b' AS fact FROM conversations GROUP BY 1),
c AS (SELECT conv_id, CAST(floor(l / CASE WHEN l - length(replace(replace(fact, ' ', ''), chr(10), '')) >= 0.25 * l THEN 3.0 ELSE 3.6 END) AS BIGINT) AS fact FROM f),
e AS (SELECT conv_id, turn, text, tokens, CASE WHEN turn % 3 = 0 THEN 'clause' ELSE 'chunk' END AS level, CASE WHEN turn % 5 = 4 THEN 'neighbour' ELSE 'vector' END AS source, turn % 2 AS con, row_number() OVER (PARTITION BY conv_id ORDER BY CASE WHEN turn % 5 = 4 THEN 1 WHEN conv_id % 2 = 0 AND turn % 3 = 0 THEN -1 ELSE 0 END, turn) AS pos FROM k),
w AS (SELECT conv_id, CAST(0 AS BIGINT) AS pos, coalesce(spent, 0) + fact AS spent, 1 AS label, CAST(NULL AS INTEGER) AS said FROM c LEFT JOIN s USING (conv_id)
  UNION ALL SELECT w.conv_id, e.pos, CASE WHEN o THEN w.spent ELSE w.spent + e.tokens + 30 END, CASE WHEN o THEN w.label ELSE w.label + 1 END, CASE WHEN o THEN 0 ELSE w.label END
  FROM w JOIN (SELECT * FROM e) AS e ON e.conv_id = w.conv_id AND e.pos = w.pos + 1, LATERAL (SELECT w.label > 5 OR ((e.tokens + 30 > 200 OR w.spent + e.tokens + 30 > 800) AND w.label > 3) AS o)),
l AS (SELECT e.*, w.said FROM e JOIN w USING (conv_id, pos) WHERE said > 0),
b AS (SELECT conv_id, con, min(said) AS first, '=== ' || CASE WHEN con = 1 THEN 'Odd' ELSE 'Contract 0' END || ' ===' || chr(10) || chr(10) || string_agg('[' || said || '] Clause ' || (12 - turn) || '.1' || CASE WHEN level = 'clause' THEN ' (payment terms)' ELSE ' - Part' END
  || CASE WHEN turn % 4 = 3 THEN '' WHEN turn % 4 = 2 THEN ' [pp.3-4]' ELSE ' [p.3]' END || chr(10) || text, chr(10) || chr(10) ORDER BY CASE WHEN turn % 4 = 3 THEN 1000000 ELSE 3 END, 12 - turn, said) AS block FROM l GROUP BY 1, 2)
SELECT conv_id AS query_id, string_agg(block, chr(10) || chr(10) ORDER BY first) AS evidence FROM b GROUP BY 1""")
def context_packages(spark, d):
    """Each conversation's turns as evidence under a budget that its history and facts share, rendered by contract."""
    c = t(spark, d, "conversations").withColumnRenamed("conv_id", "query_id")
    turn = F.col("turn")
    history = context.trimmed_history(c.where("role = 'user'").withColumn("content", F.regexp_replace("text", r"^\s+|\s+$", "")), budget=800)
    facts = context.fact_lines(c.groupBy("query_id").agg(F.count("*").alias("contract_value")).select("query_id", F.lit(1).alias("position"), F.col("query_id").alias("contract_id"), F.concat(F.lit("Talk "), "query_id").alias("title"), F.lit("chat").alias("agreement_type"), F.lit(None).cast("string").alias("risk_band"), "contract_value", F.array(F.lit("a"), F.lit("b")).alias("missing_mandatory_clauses")))
    found = c.select(
        "query_id", turn.alias("position"), "text", F.when(turn % 3 == 0, "clause").otherwise("chunk").alias("level"), F.when(turn % 5 == 4, "neighbour").otherwise("vector").alias("source"), F.when(F.col("query_id") % 2 == 0, "comparison").otherwise("financial").alias("intent"), (turn % 2).alias("contract_id"),
        F.when(turn % 2 == 1, "Odd").alias("contract_title"), F.when(turn % 3 == 0, "payment_terms").alias("clause_type"), F.concat((12 - turn).cast("string"), F.lit(".1")).alias("clause_number"), F.lit("Part").alias("section_title"), F.when(turn % 4 != 3, 3).alias("page_start"), F.when(turn % 4 == 2, 4).when(turn % 4 == 0, 3).alias("page_end"),
    )
    cited = context.packages(context.prioritised(found), history, facts, budget=800, most=5)
    return context.rendered(cited, c.select("query_id").distinct())


@query(f"""WITH {_UNIT}, p AS (SELECT q.vec_id AS q, u.vec_id AS v, u.label, list_inner_product(q.e, u.e) AS s, CASE q.vec_id // 100 % 3 WHEN 0 THEN ['t1'] WHEN 1 THEN ['t9'] ELSE [] END AS types, 't' || u.vec_id % 5 AS kind FROM u AS q JOIN u ON u.vec_id <> q.vec_id WHERE q.vec_id % 100 = 0),
f AS (SELECT *, len(types) > 0 AND NOT bool_or(s >= 0.05 AND list_contains(types, kind)) OVER (PARTITION BY q) AS relaxed FROM p),
r AS (SELECT * FROM f WHERE s >= 0.05 AND (relaxed OR len(types) = 0 OR list_contains(types, kind)) QUALIFY row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, v) <= 5),
g AS (SELECT q, max(s) FILTER (label <> 0) AS s, bool_or(relaxed) AS relaxed FROM r GROUP BY 1)
SELECT a.vec_id AS query_id, round(s, 6) AS similarity, coalesce(s >= 0.2, false) AS answered, coalesce(relaxed, false) AS relaxed FROM embeddings AS a LEFT JOIN g ON q = a.vec_id WHERE a.vec_id % 100 = 0""")
def relaxed_guardrail(spark, d):
    """Questions with a type filter that fits, one that finds nothing and is dropped, or none; and whether what they find answers them."""
    rows = _vector_rows(spark, d).withColumn("kind", F.concat(F.lit("t"), (F.col("vec_id") % 5).cast("string")))
    third = F.floor(F.col("vec_id") / 100) % 3
    types = F.when(third == 0, F.array(F.lit("t1"))).when(third == 1, F.array(F.lit("t9"))).otherwise(F.array().cast("array<string>"))
    asked = rows.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding", types.alias("types"))
    centres = vi.fit_centres(rows, "vec_id", n_centres=16)
    index = vi.assign(rows, centres)
    levels = rows.select("vec_id", "level")
    found = evidence.retried(asked, lambda q: vi.nearest(index, centres, q, 5, "vec_id", match={"kind": "types"}, floor=0.05).select("query_id", "vec_id", "similarity").join(levels, "vec_id"))
    return evidence.answerable(asked, found, 0.2).withColumn("similarity", F.round("similarity", 6))
