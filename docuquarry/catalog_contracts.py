"""Registered queries of the contract repository's filters and exports, beside SQL that says the same: orders are contracts, their customers the parties."""

from __future__ import annotations

from datetime import date, datetime

from pyspark.sql import functions as F

from docuquarry.catalog import query, t
from docuquarry.operators import predicates as p
from docuquarry.plans import contract_filters as cf
from docuquarry.sources import exports

#: Each kind of filter, and its condition in SQL.
_SPECS = [
    ({"search": " r_1 "}, "title ILIKE '%r_1%' OR original_file_name ILIKE '%r_1%' OR coalesce(contract_number, '') ILIKE '%r_1%' OR coalesce(vendor, '') ILIKE '%r_1%' OR coalesce(customer, '') ILIKE '%r_1%' OR coalesce(party_a, '') ILIKE '%r_1%' OR coalesce(party_b, '') ILIKE '%r_1%' OR coalesce(summary, '') ILIKE '%r_1%'"),
    ({"party": "BUILD"}, "coalesce(party_a, '') ILIKE '%BUILD%' OR coalesce(party_b, '') ILIKE '%BUILD%' OR coalesce(vendor, '') ILIKE '%BUILD%' OR coalesce(customer, '') ILIKE '%BUILD%'"),
    ({"status": ["F", "P"]}, "status IN ('F', 'P')"), ({"agreement_type": ["msa", "nda"]}, "agreement_type IN ('msa', 'nda')"), ({"file_type": "pdf"}, "file_type = 'pdf'"), ({"contract_number": " n-33 "}, "lower(coalesce(contract_number, '')) = 'n-33'"),
    ({"needs_review": False}, "needs_review IS FALSE"), ({"uploaded_by": 7}, "uploaded_by = 7"), ({"uploaded_after": datetime(2000, 1, 1)}, "created_at >= TIMESTAMP '2000-01-01'"), ({"language": "de"}, "language = 'de' OR metadata_language = 'de'"),
    ({"tags": ["O", "2-HIGH"]}, "list_has_all(tags, ['O', '2-HIGH'])"), ({"vendor": "0012"}, "vendor ILIKE '%0012%'"), ({"customer": " auto"}, "customer ILIKE '%auto%'"), ({"effective_date": {"from_date": date(1999, 1, 1)}}, "effective_date >= DATE '1999-01-01'"),
    ({"expiration_date": {"from_date": date(1999, 1, 1), "to_date": date(2000, 1, 1)}}, "expiration_date BETWEEN DATE '1999-01-01' AND DATE '2000-01-01'"), ({"expiring_within_days": 200}, "expiration_date BETWEEN DATE '2001-06-01' AND DATE '2001-06-01' + 200"),
    ({"risk_band": ["high"]}, "risk_band IN ('high')"), ({"risk_score": {"min": 20.9, "max": 40.9}}, "risk_score BETWEEN 20 AND 40"), ({"contract_value": {"max": 100000.5}}, "contract_value <= 100000.5"), ({"currency": "eur"}, "currency = 'EUR'"),
    ({"governing_law": "law 3"}, "governing_law = 'law 3'"), ({"country": "c1"}, "country = 'c1'"), ({"category": "k2"}, "category = 'k2'"), ({"department": "d0"}, "department = 'd0'"), ({"owner": "o4"}, "owner = 'o4'"),
    ({"auto_renewal": True}, "auto_renewal IS TRUE"), ({"has_unlimited_liability": False}, "has_unlimited_liability IS FALSE"), ({"missing_clause_types": ["cap", "term"]}, "list_has_any(missing, ['cap', 'term'])"), ({"missing_mandatory": True}, "len(missing) > 0"), ({"missing_mandatory": False}, "NOT len(missing) > 0"),
    ({"search": None, "status": [], "owner": "", "tags": None, "risk_score": {"min": None}}, "true"), ({"status": ["O"], "auto_renewal": True, "country": "c1", "needs_review": None}, "status = 'O' AND auto_renewal IS TRUE AND country = 'c1'"),
]
_REPOSITORY = """j AS (SELECT o_orderkey AS id, o_custkey % 6 AS project_id, 'Order ' || o_orderkey AS title, 'f' || o_orderkey || '.pdf' AS original_file_name, CASE WHEN o_orderkey % 3 = 0 THEN 'N-' || o_orderkey END AS contract_number, o_orderstatus AS status,
  CASE o_orderkey % 4 WHEN 0 THEN 'msa' WHEN 1 THEN 'nda' WHEN 2 THEN 'sow' END AS agreement_type, CASE WHEN o_orderkey % 2 = 0 THEN 'pdf' ELSE 'docx' END AS file_type, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 5 = 0 END AS needs_review, o_custkey % 40 AS uploaded_by,
  o_orderdate AS created_at, CASE o_orderkey % 4 WHEN 0 THEN 'en' WHEN 1 THEN 'de' END AS language, [o_orderpriority, o_orderstatus] AS tags, o_orderkey % 23 = 0 AS gone, m.* EXCLUDE (k) FROM orders LEFT JOIN (
  SELECT o_orderkey AS k, c_name AS vendor, CASE WHEN o_orderkey % 9 > 0 THEN c_mktsegment END AS customer, c_mktsegment AS party_a, CAST(NULL AS VARCHAR) AS party_b, 'for ' || c_mktsegment AS summary, CASE WHEN o_orderkey % 5 = 0 THEN 'de' END AS metadata_language, CAST(o_orderdate AS DATE) AS effective_date,
  CASE WHEN o_orderkey % 8 > 0 THEN CAST(o_orderdate AS DATE) + CAST(o_orderkey % 900 AS INTEGER) END AS expiration_date, CASE WHEN o_totalprice > 300000 THEN 'high' WHEN o_totalprice > 100000 THEN 'medium' END AS risk_band, CAST(floor(o_totalprice / 5000) AS INTEGER) AS risk_score, o_totalprice AS contract_value,
  CASE WHEN o_orderkey % 3 = 0 THEN 'EUR' ELSE 'USD' END AS currency, 'law ' || o_custkey % 5 AS governing_law, 'c' || o_custkey % 3 AS country, 'k' || o_custkey % 4 AS category, 'd' || o_custkey % 2 AS department, 'o' || o_custkey % 7 AS owner, CASE WHEN o_orderkey % 10 > 0 THEN o_orderkey % 2 = 0 END AS auto_renewal,
  o_orderkey % 3 = 0 AS has_unlimited_liability, CASE o_orderkey % 4 WHEN 0 THEN ['cap'] WHEN 1 THEN ['notice', 'term'] WHEN 2 THEN [] END AS missing FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderkey % 7 <> 0) AS m ON m.k = o_orderkey)"""


def repository_tables(spark, d):
    """Contracts and metadata made of orders and customers."""
    o, key = t(spark, d, "orders"), F.col("o_orderkey")
    pick = lambda n, *values: F.coalesce(*[F.when(key % n == i, v) for i, v in enumerate(values)])
    contracts = o.select(
        key.alias("id"), (F.col("o_custkey") % 6).alias("project_id"), F.concat(F.lit("Order "), key).alias("title"), F.concat(F.lit("f"), key, F.lit(".pdf")).alias("original_file_name"), F.when(key % 3 == 0, F.concat(F.lit("N-"), key)).alias("contract_number"), F.col("o_orderstatus").alias("status"),
        pick(4, "msa", "nda", "sow").alias("agreement_type"), pick(2, "pdf", "docx").alias("file_type"), F.when(key % 11 > 0, key % 5 == 0).alias("needs_review"), (F.col("o_custkey") % 40).alias("uploaded_by"), F.col("o_orderdate").alias("created_at"), pick(4, "en", "de").alias("language"),
        F.array("o_orderpriority", "o_orderstatus").alias("tags"), F.when(key % 23 == 0, F.col("o_orderdate")).alias("deleted_at"),
    )
    told = lambda name, n: F.concat(F.lit(name), F.col("o_custkey") % n)
    none = F.array().cast("array<string>")
    metadata = o.where(key % 7 != 0).join(t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(
        key.alias("contract_id"), F.col("c_name").alias("vendor"), F.when(key % 9 > 0, F.col("c_mktsegment")).alias("customer"), F.col("c_mktsegment").alias("party_a"), F.lit(None).cast("string").alias("party_b"), F.concat(F.lit("for "), "c_mktsegment").alias("summary"), F.when(key % 5 == 0, "de").alias("language"),
        F.to_date("o_orderdate").alias("effective_date"), F.when(key % 8 > 0, F.date_add(F.to_date("o_orderdate"), (key % 900).cast("int"))).alias("expiration_date"), F.when(F.col("o_totalprice") > 300000, "high").when(F.col("o_totalprice") > 100000, "medium").alias("risk_band"),
        F.floor(F.col("o_totalprice") / 5000).cast("int").alias("risk_score"), F.col("o_totalprice").alias("contract_value"), F.when(key % 3 == 0, "EUR").otherwise("USD").alias("currency"), told("law ", 5).alias("governing_law"), told("c", 3).alias("country"), told("k", 4).alias("category"), told("d", 2).alias("department"), told("o", 7).alias("owner"),
        F.when(key % 10 > 0, key % 2 == 0).alias("auto_renewal"), (key % 3 == 0).alias("has_unlimited_liability"), F.when(key % 4 == 0, F.array(F.lit("cap"))).when(key % 4 == 1, F.array(F.lit("notice"), F.lit("term"))).when(key % 4 == 2, none).alias("missing_mandatory_clauses"),
    )
    return contracts, metadata


@query(f"WITH {_REPOSITORY}, l AS (SELECT * FROM j WHERE NOT gone AND project_id IN (0, 1, 2, 4)) " + " UNION ALL ".join(f"SELECT {i} AS entry, count(*) AS contracts, coalesce(sum(id), 0)::BIGINT AS ids FROM l WHERE {sql}" for i, (_, sql) in enumerate(_SPECS)))
def contract_filter_kinds(spark, d):
    """How many contracts each kind of filter passes, and their ids' sum: all in one scan."""
    contracts, metadata = repository_tables(spark, d)
    rows = cf.repository(p.scoped(contracts, [0, 1, 2, 4]), metadata)
    hits = [p.all_of(cf.compiled(spec, date(2001, 6, 1))) for spec, _ in _SPECS]
    one = rows.agg(*[F.struct(F.lit(i).alias("entry"), F.count_if(c).alias("contracts"), F.coalesce(F.sum(F.when(c, F.col("id"))), F.lit(0)).alias("ids")).alias(f"c{i}") for i, c in enumerate(hits)])
    return one.select(F.inline(F.array(*one.columns)))


@query(f"""WITH {_REPOSITORY} SELECT id, title, contract_value FROM j WHERE NOT gone AND project_id IN (1, 3) AND status IN ('F', 'O') AND file_type = 'pdf' AND created_at >= TIMESTAMP '1997-01-01' AND risk_score BETWEEN 10 AND 70
  AND expiration_date >= DATE '1999-01-01' AND currency = 'USD' AND (coalesce(party_a, '') ILIKE '%m%' OR coalesce(party_b, '') ILIKE '%m%' OR coalesce(vendor, '') ILIKE '%m%' OR coalesce(customer, '') ILIKE '%m%') AND len(missing) > 0""")
def filtered_contracts(spark, d):
    """One specification of many entries."""
    spec = {"status": ["F", "O"], "file_type": "pdf", "uploaded_after": datetime(1997, 1, 1), "risk_score": {"min": 10, "max": 70}, "expiration_date": {"from_date": date(1999, 1, 1), "to_date": None}, "currency": "usd", "party": "m", "missing_mandatory": True, "owner": None}
    return cf.filtered(*repository_tables(spark, d), [1, 3], spec, date(2001, 6, 1)).select("id", "title", "contract_value")


def _export(spark, d):
    """The six sheets of an export of two projects: lines are clauses, obligations and risks, orders have a key date and a party."""
    contracts, metadata = repository_tables(spark, d)
    chosen = exports.selected(contracts, metadata, [1, 3], {"status": ["F", "O"], "risk_score": {"min": 20}}, date(2001, 6, 1))
    of = contracts.select(F.col("id").alias("contract_id"), "project_id")
    li = t(spark, d, "lineitem").withColumnRenamed("l_orderkey", "contract_id").join(of.hint("shuffle_hash"), "contract_id").withColumn("id", F.concat_ws("-", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_extendedprice").cast("decimal(18,2)")))
    kind = F.when(F.col("l_returnflag") == "R", "confidentiality").when(F.col("l_returnflag") == "A", "term").otherwise("notice")
    clauses = li.select("id", "contract_id", "project_id", kind.alias("clause_type"), F.col("l_linenumber").cast("string").alias("clause_number"), F.lit("").alias("title"), F.concat(F.lit("S "), "l_suppkey").alias("section_title"), F.concat(F.lit("part "), "l_partkey").alias("text"), F.lit("s").alias("summary"))
    obligations = li.where("l_linestatus = 'O'").select("id", "contract_id", "project_id", F.concat(F.lit("ship "), "l_partkey").alias("action"), F.to_date("l_shipdate").alias("due_date"))
    risks = li.where("l_discount > 0.05").select("id", "contract_id", "project_id", F.when(F.col("l_tax") > 0.04, "high").otherwise("low").alias("severity"), F.lit("r").alias("risk_type"))
    dates = contracts.select("id", F.col("id").alias("contract_id"), "project_id", F.to_date("created_at").alias("date_value"))
    parties = contracts.join(metadata.select(F.col("contract_id").alias("id"), "vendor"), "id").select("id", F.col("id").alias("contract_id"), "project_id", F.col("vendor").alias("name"))
    children = {"clauses": clauses, "obligations": obligations, "risks": risks, "key_dates": dates, "parties": parties}
    projects = spark.createDataFrame([(1, "One"), (2, "Two")], "project_id long, name string")
    names = ["parties", "contracts", "clauses", "nothing", "risks", "obligations", "key_dates", "clauses"]
    return exports.export_set(chosen, children, [1, 3], projects, names, {"clauses": ["text", "title", "clause_type"], "risks": ["nothing"]}), clauses, chosen


@query(f"""WITH {_REPOSITORY}, c AS (SELECT * FROM j WHERE NOT gone AND project_id IN (1, 3) AND status IN ('F', 'O') AND risk_score >= 20), li AS (SELECT c.*, lineitem.*, l_linenumber || '-' || l_partkey || '-' || l_suppkey || '-' || CAST(l_extendedprice AS DECIMAL(18, 2)) AS line FROM lineitem JOIN c ON c.id = l_orderkey)
SELECT 'contracts' AS entity, id AS contract, 1 AS place, title || '/' || CASE project_id WHEN 1 THEN 'One' ELSE '' END || '/' || array_to_string(coalesce(missing, []), ', ') AS said FROM c
UNION ALL SELECT 'clauses', id, row_number() OVER (PARTITION BY id ORDER BY CASE l_returnflag WHEN 'R' THEN 'confidentiality' WHEN 'A' THEN 'term' ELSE 'notice' END, CAST(l_linenumber AS VARCHAR), line), 'S ' || l_suppkey || '/' || CASE WHEN l_returnflag = 'R' THEN '[Withheld - requires clause review permission]' ELSE 'part ' || l_partkey END FROM li
UNION ALL SELECT 'obligations', id, row_number() OVER (PARTITION BY id ORDER BY l_shipdate, line), title || '/ship ' || l_partkey FROM li WHERE l_linestatus = 'O'
UNION ALL SELECT 'risks', id, row_number() OVER (PARTITION BY id ORDER BY CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END, line), title || '/' || CASE WHEN l_tax > 0.04 THEN 'high' ELSE 'low' END FROM li WHERE l_discount > 0.05
UNION ALL SELECT 'key_dates', id, 1, CAST(CAST(created_at AS DATE) AS VARCHAR) FROM c UNION ALL SELECT 'parties', id, 1, vendor FROM c WHERE vendor IS NOT NULL""")
def export_sheets(spark, d):
    """Every row of the six sheets, restricted to the chosen contracts."""
    rows = exports.as_rows(_export(spark, d)[0])
    cell = lambda n: F.get_json_object("cells", f"$.{n}")
    said = {"contracts": ["title", "project", "missing_mandatory_clauses"], "clauses": ["title", "text"], "obligations": ["contract_title", "action"], "risks": ["contract_title", "severity"], "key_dates": ["date_value"], "parties": ["name"]}
    shown = F.coalesce(*[F.when(F.col("entity") == e, F.concat_ws("/", *map(cell, cs))) for e, cs in said.items()])
    return rows.select("entity", "contract", F.col("place").cast("long").alias("place"), shown.alias("said"))
