"""Registered queries of extraction, graph building, catalogue import and exports, beside SQL that says the same.

Orders stand for contracts and documents, their lines for clauses, chunks and pages, events for model answers, parts for catalogue rows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from docuquarry import catalog
from docuquarry.catalog import query
from docuquarry.functions import costs
from docuquarry.functions import text as tx
from docuquarry.operators import relational as r
from docuquarry.operators import structure
from docuquarry.plans import evaluation as ev
from docuquarry.plans import extraction as ex
from docuquarry.plans import graph
from docuquarry.sources import catalogue as cat
from docuquarry.sources import sinks

_LINE = ["l_suppkey", "l_quantity", "l_extendedprice", "l_returnflag", "l_linestatus"]
_LINES = f"FROM (SELECT l_orderkey, l_linenumber, {', '.join(f'max({c}) AS {c}' for c in _LINE)} FROM lineitem GROUP BY 1, 2) AS lineitem"


def t(spark, d, name):
    """A table; lines of an order that share a number are one."""
    rows = catalog.t(spark, d, name)
    return rows.groupBy("l_orderkey", "l_linenumber").agg(*[F.max(c).alias(c) for c in _LINE]) if name == "lineitem" else rows


def over_lines(sql: str):
    return query(sql.replace("FROM lineitem", _LINES))


_SCHEMA = {
    "type": "object", "required": ["id", "kind", "lines"], "additionalProperties": False,
    "properties": {"id": {"type": "integer"}, "kind": {"type": ["string", "null"], "enum": ["view", "click", "purchase", None]}, "lines": {"type": "array", "items": {"type": "object", "required": ["n"], "properties": {"n": {"type": "number"}}}}},
}
_PAYLOAD = """CASE WHEN value < 5 THEN '{' WHEN value < 10 THEN '[1]' WHEN value < 20 THEN '{"id": 1.5, "kind": null, "lines": 7, "x": 0}' WHEN value < 60 THEN '{"id": 1, "kind": "' || event_type || '", "lines": [{"n": 1}, {"n": true}, {}, 3]}'
  WHEN value < 90 THEN '{"kind": "' || event_type || '"}' ELSE '{"id": 2, "kind": "' || event_type || '", "lines": [{"n": 0.5}], "more": {}}' END"""


@query("""WITH e AS (SELECT event_id, value, CASE WHEN event_type IN ('view', 'click', 'purchase') THEN '' ELSE 'schema_enum_violation kind' END AS k FROM events), r AS (SELECT event_id, unnest(CASE
  WHEN value < 5 THEN ['schema_unreadable (root)'] WHEN value < 10 THEN ['schema_type_mismatch (root)'] WHEN value < 20 THEN ['schema_unexpected_field x', 'schema_type_mismatch id', 'schema_type_mismatch lines']
  WHEN value < 60 THEN [k, 'schema_type_mismatch lines[1].n', 'schema_missing_field lines[2].n', 'schema_type_mismatch lines[3]']
  WHEN value < 90 THEN ['schema_missing_field id', 'schema_missing_field lines', k] ELSE ['schema_unexpected_field more', k] END) AS issue FROM e)
SELECT event_id, string_agg(issue, ';' ORDER BY issue) AS issues FROM r WHERE issue <> '' GROUP BY 1""")
def schema_checks(spark, d):
    found = t(spark, d, "events").select("event_id", F.explode(ex.schema_issues(F.expr(_PAYLOAD), _SCHEMA)).alias("i"))
    said = F.concat_ws(" ", "i.code", "i.field")
    return found.groupBy("event_id").agg(F.array_join(F.array_sort(F.collect_list(said)), ";").alias("issues"))


@query("""SELECT event_id, event_type AS kind, CASE WHEN value > 50 THEN 'fixed' ELSE 'raw' END AS amount FROM events WHERE event_type <> 'error'""")
def accepted_extractions(spark, d):
    e = t(spark, d, "events")
    issue = F.struct(F.lit("x").alias("code"), F.lit("f").alias("field"), F.when(F.col("event_type") == "error", "error").otherwise("warning").alias("severity"))
    rows = e.select("event_id", F.array(issue).alias("issues"), F.create_map(F.lit("kind"), F.col("event_type"), F.lit("amount"), F.lit("raw")).alias("attributes"), F.when(F.col("value") > 50, F.create_map(F.lit("amount"), F.lit("fixed"))).alias("corrections"))
    return ex.accepted(rows).select("event_id", F.col("attributes")["kind"].alias("kind"), F.col("attributes")["amount"].alias("amount"))


_RULE = {"heading_patterns": ["A heading", "No such"], "keywords": ["ship", "flag N"], "must_not_contain": ["quantity 50"], "min_tokens": 5}
_CHUNKS = """c AS (SELECT l_orderkey AS doc, l_linenumber AS chunk_id, l_returnflag AS h, l_linestatus AS st, CAST(l_quantity AS BIGINT) AS q, l_linenumber % 3 AS k, CAST(floor(l_extendedprice / 10) AS BIGINT) AS tokens FROM lineitem),
s AS (SELECT *, 10.0 * CAST(h = 'A' AS INTEGER) + 4.0 * CAST(st = 'O' AS INTEGER) + 2.0 * (CAST(q % 2 = 0 AS INTEGER) + CAST(h = 'N' AS INTEGER)) + CASE k WHEN 0 THEN 2.0 WHEN 1 THEN 0.5 ELSE 0.0 END::DOUBLE AS score FROM c
  WHERE (h = 'A' OR st = 'O' OR q % 2 = 0 OR h = 'N') AND q <> 50 AND (tokens >= 5 OR k = 1)),
r AS (SELECT *, row_number() OVER w AS rank, sum(tokens) OVER (w ROWS UNBOUNDED PRECEDING) AS total FROM s WINDOW w AS (PARTITION BY doc ORDER BY score DESC, chunk_id)),
b AS (SELECT * FROM r WHERE rank <= 12 AND total <= 6000)"""


def _chunks(spark, d):
    line = t(spark, d, "lineitem")
    q = F.col("l_quantity").cast("long")
    text = F.concat(F.lit("part "), F.col("l_linestatus"), F.lit("\nquantity "), q.cast("string"), F.lit(" flag "), F.col("l_returnflag"), F.when(q % 2 == 0, " to ship").otherwise(""))
    kind = F.element_at(F.array(*map(F.lit, ["clause", "table", "other"])), (F.col("l_linenumber") % 3 + 1))
    return line.select(
        F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("chunk_id"), F.col("l_linenumber").alias("reading_order"), F.when(F.col("l_linenumber") > 1, F.col("l_linenumber") - 1).alias("parent_id"),
        F.when(F.col("l_returnflag") == "A", "A heading").otherwise("one").alias("heading"), text.alias("text"), kind.alias("chunk_type"), F.floor(F.col("l_extendedprice") / 10).alias("tokens"),
    )


@over_lines(f"WITH {_CHUNKS} SELECT doc, chunk_id, score, CAST(rank AS INTEGER) AS rank FROM b")
def evidence_selection(spark, d):
    return ex.select_evidence(ex.score_evidence(_chunks(spark, d), _RULE, ["part O"]), "doc").select("doc", "chunk_id", "score", "rank")


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') THEN event_type ELSE 'other' END AS label, event_type NOT IN ('view', 'click') AS fell_back FROM events")
def classified_documents(spark, d):
    label = ex.document_label(F.concat(F.lit(" "), F.upper("event_type")), ["view", "click"], "other")
    return t(spark, d, "events").select("event_id", label.alias("l")).select("event_id", "l.label", "l.fell_back")


@over_lines("SELECT l_orderkey AS doc, l_linenumber AS page FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) <= 5")
def classification_pages(spark, d):
    return ex.first_pages(t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), F.col("l_linenumber").alias("page")), "doc", "page")


@query("""SELECT p_partkey, CASE WHEN p_type = 'PROMO' THEN p_type WHEN p_type = 'ECONOMY' THEN 'nda' ELSE 'other' END AS type, CASE p_type WHEN 'PROMO' THEN NULL WHEN 'ECONOMY' THEN 'cheap' ELSE lower(p_type) || '_1' END AS subtype,
  CASE p_brand WHEN 'Brand#13' THEN 'the_13th' ELSE replace(lower(p_brand), '#', '_') END AS clause_key FROM part""")
def mapped_taxonomy(spark, d):
    label = F.when(F.col("p_type").isin("PROMO", "ECONOMY"), F.col("p_type")).otherwise(F.concat(F.col("p_type"), F.lit(" / 1 ")))
    rows = t(spark, d, "part").select("p_partkey", ex.agreement_type(label, ["PROMO"], {"economy": ("nda", "cheap")}).alias("a"), ex.clause_key(F.col("p_brand"), {"brand 13": "the_13th"}).alias("clause_key"))
    return rows.select("p_partkey", "a.type", "a.subtype", "clause_key")


@over_lines("""WITH f AS (SELECT l_orderkey AS doc, l_returnflag AS k, min(l_linenumber) AS pos FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
r AS (SELECT l_orderkey AS doc, l_returnflag AS k, l_linenumber AS n, l_suppkey AS s, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber) AS i FROM lineitem WHERE l_quantity > 10)
SELECT doc, CAST(row_number() OVER (PARTITION BY doc ORDER BY f.pos, k) AS INTEGER) AS place, k AS clause_key, CASE WHEN n % 2 = 0 THEN 'line ' || n ELSE 'Clause ' || k END AS heading, CAST(s AS VARCHAR) AS lines FROM r JOIN f USING (doc, k) WHERE i = 1""")
def summary_digests(spark, d):
    line = t(spark, d, "lineitem").withColumn("doc", F.col("l_orderkey"))
    said = F.array(F.lit(" "), F.when(F.col("l_quantity") > 10, F.col("l_suppkey").cast("string")), F.lit(None).cast("string"))
    rows = line.select("doc", F.col("l_linenumber").alias("at"), F.concat(F.col("l_returnflag"), F.lit(" ")).alias("clause_key"), F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("line "), F.col("l_linenumber").cast("string"))).otherwise("").alias("heading"), said.alias("lines"))
    found = line.where("l_linestatus = 'O'").select("doc", F.col("l_linenumber").alias("at"), F.col("l_returnflag").alias("clause_type"), F.concat(F.lit("Clause "), F.col("l_returnflag")).alias("label"))
    return ex.digest(rows, found, "doc").withColumn("lines", F.array_join("lines", "|"))


@over_lines("""WITH l AS (SELECT l_orderkey AS section, l_returnflag AS clause, l_linenumber AS pos, CAST(l_linenumber AS VARCHAR) AS ref, l_quantity > 10 AS held FROM lineitem), g AS (SELECT section, clause, max(pos) AS pos FROM l WHERE held GROUP BY 1, 2),
w AS (SELECT section FROM l LEFT JOIN g USING (section, clause) GROUP BY 1 HAVING count(DISTINCT l.clause) = count(DISTINCT g.clause)) SELECT section, clause, CAST(g.pos AS VARCHAR) AS ref FROM g JOIN w USING (section)""")
def shared_section_splits(spark, d):
    line = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("section"), F.col("l_returnflag").alias("clause"), F.col("l_linenumber").alias("at"), F.col("l_quantity").alias("q"))
    ref = F.col("at").cast("string")
    answers = line.select("section", "clause", "at", F.array(F.concat(F.lit(" "), ref), F.lit("none")).alias("refs")).unionByName(line.select("section", F.lit("else").alias("clause"), "at", F.array(ref).alias("refs")))
    return ex.split_sections(answers, line.select("section", "clause"), line.where("q > 10").select("section", ref.alias("ref")), "section")


_WAVES = """w AS (SELECT l_orderkey AS doc, CAST(l_linenumber - 1 AS BIGINT) AS win, l_returnflag AS clause FROM lineitem WHERE l_quantity * 10 >= 200 AND l_returnflag <> 'R'),
c AS (SELECT doc, clause, min(win) AS win FROM w GROUP BY 1, 2), o AS (SELECT DISTINCT l_orderkey AS doc FROM lineitem),
e AS (SELECT o.doc, count(win) AS n, max(win // 2) AS last FROM o LEFT JOIN c USING (doc) GROUP BY 1)"""


def _waves(spark, d):
    line = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") - 1).alias("window"), F.col("l_linenumber").alias("page"), (F.col("l_quantity") * 10).cast("long").alias("chars"), F.col("l_returnflag").alias("clause"))
    wanted = line.select("doc").distinct().select("doc", F.explode(F.array(F.lit("A"), F.lit("N"))).alias("clause"))
    return ex.window_claims(line.select("doc", "window", "page", "chars"), line.select("doc", "window", "clause"), wanted, "doc", 2)


@over_lines(f"WITH {_WAVES} SELECT doc, clause, CAST(win AS INTEGER) AS window_no FROM c")
def window_claims(spark, d):
    return _waves(spark, d)[0].withColumnRenamed("window", "window_no")


@over_lines(f"WITH {_WAVES} SELECT doc, l_linenumber AS page FROM lineitem JOIN e ON doc = l_orderkey WHERE n = 2 AND (l_linenumber - 1) // 2 > last")
def pages_never_read(spark, d):
    return _waves(spark, d)[1]


@over_lines("""WITH c AS (SELECT l_orderkey, count(*) AS n, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS types, CAST(CAST(min_by(l_suppkey, l_linenumber) FILTER (l_returnflag = 'A') AS BIGINT) AS VARCHAR) AS a FROM lineitem GROUP BY 1),
r AS (SELECT user_id, count(*) AS n, count(*) FILTER (event_type IN ('error', 'click')) AS high FROM events GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_orderstatus <> 'O' THEN o_orderpriority ELSE a END AS law, a AS notice, coalesce(types, '') AS clause_types, coalesce(c.n, 0) AS clause_count, coalesce(r.n, 0) AS risk_count, coalesce(high, 0) AS high_risk_count
FROM orders LEFT JOIN c ON l_orderkey = o_orderkey LEFT JOIN r ON user_id = o_orderkey""")
def metadata_projection(spark, d):
    facts = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") != "O", F.col("o_orderpriority")).alias("law"))
    clauses = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_returnflag").alias("clause_type"), F.col("l_linenumber").alias("at"), F.to_json(F.struct(F.col("l_suppkey").alias("s"))).alias("attributes"))
    severity = F.when(F.col("event_type") == "error", "critical").when(F.col("event_type") == "click", "high").otherwise("low")
    risks = t(spark, d, "events").select(F.col("user_id").alias("o_orderkey"), severity.alias("severity"))
    wide = ex.project_metadata(facts, clauses, risks, "o_orderkey", {"law": ("law", "A", "s"), "notice": (None, "A", "s")})
    return wide.withColumn("clause_types", F.array_join("clause_types", ","))


@over_lines("""SELECT 'BELONGS_TO' AS relation, 'party' AS source_type, c_name AS source_ref, 'contract' AS target_type, CAST(o_orderkey AS VARCHAR) AS target_ref, c_mktsegment AS label, true AS resolved FROM orders JOIN customer ON c_custkey = o_custkey
UNION ALL SELECT 'CONTAINS', 'contract', CAST(l_orderkey AS VARCHAR), 'clause', CASE WHEN l_quantity > 25 THEN CAST(l_linenumber AS VARCHAR) ELSE l_returnflag END, l_returnflag, true FROM lineitem""")
def graph_edges(spark, d):
    parties = t(spark, d, "orders").join(t(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    number = F.when(F.col("l_quantity") > 25, F.col("l_linenumber").cast("string"))
    belongs = graph.emit_edges(parties, "BELONGS_TO", ("party", F.col("c_name")), ("contract", F.col("o_orderkey")), F.col("c_mktsegment"))
    holds = graph.emit_edges(t(spark, d, "lineitem"), "CONTAINS", ("contract", F.col("l_orderkey")), ("clause", F.coalesce(number, F.col("l_returnflag"))), F.col("l_returnflag"))
    return belongs.unionByName(holds)


@over_lines("""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber = 1 THEN 'Customer ' || o_custkey WHEN l_linenumber = 2 THEN 'Customer ' || o_custkey ELSE 'the Other' END AS party, l_linenumber <= 2 AS resolved FROM lineitem JOIN orders ON o_orderkey = l_orderkey""")
def resolved_parties(spark, d):
    orders = t(spark, d, "orders")
    name = F.concat(F.lit("Customer "), F.col("o_custkey").cast("string"))
    parties = orders.select("o_orderkey", F.lit(1).alias("at"), name.alias("name"), F.array(F.lit("The Buyer ")).alias("aliases"))
    rows = t(spark, d, "lineitem").join(orders, F.col("o_orderkey") == F.col("l_orderkey"))
    rows = rows.select("o_orderkey", "l_orderkey", "l_linenumber", F.when(F.col("l_linenumber") == 1, "buyer").when(F.col("l_linenumber") == 2, F.upper(name)).otherwise("the Other").alias("named"))
    return graph.resolve_parties(rows, graph.party_aliases(parties, "o_orderkey"), "o_orderkey", "named").select("l_orderkey", "l_linenumber", "party", "resolved")


@query("""SELECT event_id, round(CASE event_type WHEN 'view' THEN (floor(value) + user_id + 500) * 3 + event_id * 15 WHEN 'click' THEN (floor(value) + user_id + 500) * 0.8 + event_id * 4 ELSE 0 END / 1000000, 6) AS usd FROM events""")
def call_costs(spark, d):
    prices = {"view": (3.0, 15.0), "click": (0.8, 4.0)}
    usd = costs.cost_usd(F.col("event_type"), prices, F.floor("value"), F.col("event_id"), F.col("user_id") * 10, F.lit(400))
    return t(spark, d, "events").select("event_id", usd.alias("usd"))


@query("""SELECT event_id, round(least(20.0, 0.5 * pow(2, greatest(0, event_id % 9 - 1))) * CAST('0x' || substr(md5(event_id || ':' || event_id % 9 || ':4'), 1, 7) AS BIGINT) / 268435456, 6) AS wait FROM events""")
def jittered_waits(spark, d):
    wait = costs.jittered_backoff((F.col("event_id") % 9).cast("int"), F.col("event_id"), 0.5, 20.0, seed=4)
    return t(spark, d, "events").select("event_id", F.round(wait, 6).alias("wait"))


@query("""SELECT conv_id, turn, 'fine [removed: markup] ' || turn AS said, true AS suspicious FROM conversations""")
def sanitised_evidence(spark, d):
    dirty = F.concat(F.lit(" ﬁne​ <Ｓystem>\x07"), F.col("turn").cast("string"), F.lit("\n"))
    return t(spark, d, "conversations").select("conv_id", "turn", tx.sanitise(dirty).alias("said"), tx.suspicious(dirty).alias("suspicious"))


def _imported(spark, d):
    part = t(spark, d, "part")
    rows = part.select(F.col("p_partkey").alias("at"), F.col("p_type").alias("agreement_type"), F.concat(F.upper("p_brand"), F.lit(" ")).alias("clause_key"), F.when(F.col("p_size") > 45, F.col("p_name")).alias("name"), F.lit(None).cast("string").alias("description"), F.lit("g").alias("group_name"), (F.col("p_size") > 3).alias("is_active"), F.lit(True).alias("is_mandatory"), F.when(F.col("p_size") > 10, F.col("p_size")).alias("display_order"))
    categories = spark.range(1, 6).select(F.concat(F.lit("brand#"), F.col("id").cast("string")).alias("clause_key"), F.lit("old").alias("name"), F.lit("d").alias("description"), F.lit("g").alias("group_name"), F.col("id").cast("int").alias("priority"))
    mappings = categories.select(F.lit("PROMO").alias("agreement_type"), "clause_key", F.lit(True).alias("is_active"), F.lit(False).alias("is_mandatory"), F.lit(7).alias("display_order"))
    return cat.import_catalogue(rows, ["PROMO", "ECONOMY"], categories, mappings, deactivate_missing=True)


_IMPORT = """p AS (SELECT p_partkey AS pos, p_type AS ty, lower(p_brand) AS k, CASE WHEN p_size > 45 THEN p_name END AS name, p_size AS z, p_type IN ('PROMO', 'ECONOMY') AS right_type FROM part),
old AS (SELECT 'brand#' || i AS k, CAST(i AS INTEGER) AS priority FROM range(1, 6) AS r(i)), m AS (SELECT k, min(pos) AS made FROM p WHERE right_type AND name IS NOT NULL GROUP BY 1),
j AS (SELECT p.*, CASE WHEN NOT right_type THEN '''' || ty || ''' is not a known agreement type' WHEN priority IS NULL AND NOT coalesce(made <= pos, false) THEN 'new clause needs a name' END AS reason, priority FROM p LEFT JOIN old USING (k) LEFT JOIN m USING (k)),
n AS (SELECT k, max_by(name, pos) AS name FROM j WHERE reason IS NULL AND name IS NOT NULL GROUP BY 1),
c AS (SELECT k, coalesce(n.name, 'old') AS name, CASE WHEN n.name IS NULL THEN 'd' END AS description, coalesce(priority, 999) AS priority FROM old FULL JOIN n USING (k)),
g AS (SELECT ty, k, max_by(z, pos) AS z FROM j WHERE reason IS NULL GROUP BY 1, 2),
a AS (SELECT ty, k, z > 3 AS active, true AS mandatory, CASE WHEN z > 10 THEN z ELSE c.priority END AS o FROM g JOIN c USING (k)
  UNION ALL SELECT 'PROMO', k, NOT EXISTS (SELECT 1 FROM g WHERE ty = 'PROMO'), false, 7 FROM old WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.ty = 'PROMO' AND g.k = old.k))"""


@query(f"WITH {_IMPORT} SELECT ty AS agreement_type, k AS clause_key, name, description, 'g' AS group_name, active AS is_active, mandatory AS is_mandatory, o AS display_order FROM a JOIN c USING (k)")
def imported_catalogue(spark, d):
    categories, mappings, _ = _imported(spark, d)
    return cat.export_catalogue(categories, mappings)


@query(f"WITH {_IMPORT} SELECT pos AS row_no, k AS clause_key, reason FROM j WHERE reason IS NOT NULL")
def skipped_catalogue_rows(spark, d):
    return _imported(spark, d)[2].withColumnRenamed("at", "row_no")


@query("""SELECT c_name AS name, CAST(NULL AS VARCHAR) AS role, c_nationkey AS jurisdiction FROM customer""")
def party_sheet(spark, d):
    rows = t(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_nationkey").alias("jurisdiction"), "c_acctbal")
    return cat.sheet(rows, "parties", ["jurisdiction", "name", "role", "c_acctbal"])


@over_lines("""SELECT l_orderkey AS case_id, CAST(l_linenumber AS INTEGER) AS rank, l_suppkey AS ref_id, bool_or(l_quantity > 20) OVER w AS in_context, bool_or(l_quantity > 40) OVER w AS cited FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_suppkey)""")
def case_results(spark, d):
    line = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("rank"), F.col("l_suppkey").alias("ref_id"), F.col("l_quantity").alias("_q"))
    return ev.case_results(line.drop("_q"), line.where("_q > 20"), line.where("_q > 40"), "case_id")


@over_lines("""SELECT l_orderkey AS case_id, l_linenumber AS label, CASE WHEN l_quantity > 20 THEN l_suppkey END AS ref_id, l_quantity > 20 AS resolved FROM lineitem""")
def citation_records(spark, d):
    line = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_linenumber").alias("label"), F.col("l_suppkey").alias("ref_id"), F.col("l_quantity").alias("_q"))
    return ev.citation_records(line, line.where("_q > 20"), "case_id")


@query("""SELECT c_mktsegment, 'customers' AS metric, CAST(count(*) AS DOUBLE) AS value FROM customer GROUP BY 1 UNION ALL SELECT c_mktsegment, 'balance', round(sum(c_acctbal), 2) FROM customer GROUP BY 1""")
def metric_rows(spark, d):
    wide = t(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("customers"), F.round(F.sum("c_acctbal"), 2).alias("balance"))
    return ev.metric_report(wide, ["c_mktsegment"])


@query("""SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'new' ELSE o_orderpriority END AS law FROM orders""")
def metadata_upsert(spark, d):
    old = t(spark, d, "orders").select("o_orderkey", F.col("o_orderpriority").alias("law"))
    fresh = t(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderstatus") == "F", "new").alias("law"))
    return sinks.upsert(old, fresh, ["o_orderkey"])


@over_lines("""WITH l AS (SELECT l_orderkey AS doc_id, l_linenumber AS pos, (l_linenumber + 1) // 2 AS page, l_returnflag = 'A' AS edge, l_quantity > 15 AS kept, l_linestatus AS clause FROM lineitem),
k AS (SELECT doc_id, clause, max(pos) AS pos FROM l WHERE kept AND pos <= 3 GROUP BY 1, 2)
SELECT k.doc_id, k.clause, l.pos FROM k JOIN l p USING (doc_id, pos) JOIN l ON l.doc_id = k.doc_id AND l.pos > k.pos AND l.page <= p.page + 1
WHERE k.pos = 3 AND NOT EXISTS (SELECT 1 FROM l b WHERE b.doc_id = k.doc_id AND b.edge AND b.pos > k.pos AND b.pos <= l.pos)""")
def repaired_boundaries(spark, d):
    line = t(spark, d, "lineitem").select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("pos"), F.floor((F.col("l_linenumber") + 1) / 2).alias("page"), F.col("l_linestatus").alias("clause"), (F.col("l_returnflag") == "A").alias("edge"), F.col("l_quantity").alias("q"))
    kept = line.where("q > 15 AND pos <= 3").select("doc_id", "clause", "pos", F.lit(3).alias("window_end"))
    return structure.repair_boundary(kept, line, F.col("edge"))


@query("""SELECT o_orderkey, o_totalprice, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS total FROM orders WHERE o_orderstatus = 'F' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 25""")
def paged_with_total(spark, d):
    rows = t(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice")
    return r.paged(rows, 2, 25, "price", {"price": "o_totalprice"}, True, "o_orderkey")


@query("""WITH c AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey = 3 ORDER BY c_acctbal DESC NULLS LAST, c_name, c_custkey) AS n, count(*) OVER (PARTITION BY c_nationkey = 3) AS total FROM customer WHERE c_nationkey = 3 OR c_acctbal > -900)
SELECT c_nationkey = 3 AS narrow, CASE WHEN max(total) <= 200 THEN string_agg(CAST(c_custkey AS VARCHAR), ',' ORDER BY n) ELSE '' END AS keys, max(total) > 200 AS truncated FROM c GROUP BY 1""")
def candidate_contracts(spark, d):
    c = t(spark, d, "customer")
    order = [F.desc_nulls_last("c_acctbal"), F.asc_nulls_last("c_name")]
    listed = lambda rows, narrow: r.candidate_keys(rows, "c_custkey", order).select(F.lit(narrow).alias("narrow"), F.array_join(F.transform("keys", lambda k: k.cast("string")), ",").alias("keys"), "truncated")
    return listed(c.where("c_nationkey = 3"), True).unionByName(listed(c.where("c_nationkey <> 3 AND c_acctbal > -900"), False))


#: Documents by line: those are pages, the first word of one its heading, and words the clauses that are looked for; ten windows make a wave.
_DETECTED = """p AS (SELECT doc_id AS doc, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS page, unnest(string_split(text, chr(10))) AS text FROM documents WHERE text IS NOT NULL),
t AS (SELECT DISTINCT doc, unnest(CASE WHEN doc % 2 = 0 THEN ['the', 'In', 'that', 'zzz'] ELSE ['of', 'tion'] END) AS clause FROM p),
h AS (SELECT t.doc, clause, min(page) AS page FROM t JOIN p ON p.doc = t.doc AND lower(regexp_extract(text, '^[A-Za-z]+')) = lower(clause) GROUP BY ALL),
n AS (SELECT doc, max(page) AS last FROM p GROUP BY 1),
w AS (SELECT p.doc, unnest(range(CAST(greatest(0, ceil((page - 3) / 2)) AS BIGINT), CAST(least(floor((page - 1) / 2), greatest(0, ceil((last - 3) / 2))) AS BIGINT) + 1)) AS win, page, text FROM p JOIN n USING (doc)),
z AS (SELECT doc, win, sum(length(text)) AS c FROM w GROUP BY ALL),
a AS (SELECT t.doc, clause, min({'w': w.win, 'p': w.page}) AS f FROM t JOIN w ON w.doc = t.doc AND list_contains(string_split(w.text, ' '), lower(clause)) JOIN z ON z.doc = w.doc AND z.win = w.win AND c >= 50 WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.doc = t.doc AND h.clause = t.clause) GROUP BY ALL),
o AS (SELECT t.doc, count(*) - count(h.clause) AS open, count(*) FILTER (h.clause IS NULL AND a.clause IS NULL) AS missing, max(a.f.w // 10) AS last FROM t LEFT JOIN h ON h.doc = t.doc AND h.clause = t.clause LEFT JOIN a ON a.doc = t.doc AND a.clause = t.clause GROUP BY 1)"""


def _detected(spark, d):
    from docuquarry.plans import detection

    docs = t(spark, d, "documents").where("text IS NOT NULL")
    pages = docs.select(F.col("doc_id").alias("doc"), F.posexplode(F.split("text", "\n")).alias("page", "text")).withColumn("page", (F.col("page") + 1).cast("long"))
    headings = pages.select("doc", "page", F.regexp_extract("text", "^[A-Za-z]+", 0).alias("heading"))
    names = F.when(F.col("doc_id") % 2 == 0, F.array(*map(F.lit, ["the", "In", "that", "zzz"]))).otherwise(F.array(F.lit("of"), F.lit("tion")))
    wanted = docs.select(F.col("doc_id").alias("doc"), F.explode(names).alias("clause"))

    def search(windows):
        asked = windows.withColumn("clause", F.explode("pending"))
        return asked.where(F.array_contains(F.split("text", " "), F.lower("clause"))).select("doc", "window", "page", "clause")

    return detection.detect(pages, headings, wanted, search, lambda c: F.lower(c), size=3, overlap=1, wave=10, least_chars=50)


@query(f"WITH {_DETECTED} SELECT doc, clause, 'heading' AS source, page, CAST(NULL AS BIGINT) AS window_no FROM h UNION ALL SELECT doc, clause, 'window', f.p, f.w FROM a")
def detected_clauses(spark, d):
    """Every claim of the detection driver over all documents."""
    return _detected(spark, d).claims.withColumnRenamed("window", "window_no")


@query(f"""WITH {_DETECTED} SELECT o.doc, CAST(missing AS BIGINT) AS missing, CAST((SELECT count(DISTINCT page) FROM w WHERE w.doc = o.doc AND o.open > 0 AND (o.missing > 0 OR w.win // 10 <= o.last)) AS BIGINT) AS pages_read, n.last AS pages FROM o JOIN n USING (doc)""")
def detection_coverage(spark, d):
    """For each document the clauses found nowhere and the pages read: where one is missing, every page."""
    got = _detected(spark, d)
    pages = got.read.unionByName(got.unread).groupBy("doc").agg(F.count("*").alias("pages"))
    read, missing = got.read.groupBy("doc").agg(F.count("*").alias("pages_read")), got.missing.groupBy("doc").agg(F.count("*").alias("missing"))
    return pages.join(read, "doc", "left").join(missing, "doc", "left").na.fill(0, ["pages_read", "missing"]).select("doc", "missing", "pages_read", "pages")
