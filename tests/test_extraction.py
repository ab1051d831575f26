"""Cases of extraction, graph and catalogue operators that the driver tables don't hold, and brute force where there is no SQL."""

import random

import pytest
from pyspark.sql import functions as F

from docuquarry.functions import costs
from docuquarry.functions import text as tx
from docuquarry.plans import extraction, graph
from docuquarry.sources import catalogue, pages


def test_schema_issues_of_nested_and_null_values(spark):
    schema = {"type": "object", "properties": {"a": {"type": ["array", "null"], "items": {"type": "array", "items": {"type": "integer"}}}, "b": {"type": "boolean"}, "a b": {"enum": ["x", 1]}}}
    texts = [None, "", "null", "{}", '{"a": null, "b": null}', '{"a": [[1, 2.5], 3], "b": 1}', '{"a b": "x"}', '{"a b": 2}', '{"a b": 1, "z": 0}']
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", extraction.schema_issues(F.col("t"), schema).alias("s")).orderBy("i").collect()
    got = [[(x.code.removeprefix("schema_"), x.field) for x in r.s] for r in rows]
    unread = [("unreadable", "(root)")]
    assert got == [unread, unread, [("type_mismatch", "(root)")], [], [("type_mismatch", "b")], [("type_mismatch", "a[0][1]"), ("type_mismatch", "a[1]"), ("type_mismatch", "b")], [], [("enum_violation", "a b")], []]


def test_accepted_with_nulls(spark):
    kind = "i int, issues array<struct<code:string,field:string,severity:string>>, attributes map<string,string>, corrections map<string,string>"
    rows = [(1, None, {"a": "1"}, None), (2, [], {"a": "1", "b": "2"}, {"a": "9", "c": "3"}), (3, [("x", "f", "error")], {}, {}), (4, [("x", "f", "warning")], None, {"a": "1"})]
    got = {r.i: r.attributes for r in extraction.accepted(spark.createDataFrame(rows, kind)).collect()}
    assert got == {1: {"a": "1"}, 2: {"b": "2", "a": "9", "c": "3"}, 4: None}


def test_evidence_against_brute_force(spark):
    rng = random.Random(5)
    chunks = [(d, c, rng.choice([None, *range(12)]), rng.randint(50, 900), float(rng.randint(1, 6)), c) for d in range(20) for c in range(12)]
    df = spark.createDataFrame(chunks, "doc int, chunk_id int, parent_id int, tokens int, score double, reading_order int")
    chosen = extraction.select_evidence(df.where("chunk_id % 3 > 0"), "doc", 5, 2000)
    got = [(r.doc, r["at"], r.chunk_id) for r in extraction.evidence_parents(chosen, df, "doc", 2000).orderBy("doc", "at").collect()]
    ranks = sorted((r.doc, r["rank"], r.chunk_id) for r in chosen.collect())
    want, want_ranks = [], []
    for d in range(20):
        mine = {c[1]: c for c in chunks if c[0] == d}
        room, picked = 2000, []
        for c in sorted((c for c in mine.values() if c[1] % 3), key=lambda c: (-c[4], c[5])):
            if len(picked) == 5 or c[3] > room:
                break
            picked.append(c)
            room -= c[3]
        want_ranks += [(d, i + 1, c[1]) for i, c in enumerate(picked)]
        seen, at = {c[1] for c in picked}, 0
        for c in picked:
            if c[2] is not None and c[2] not in seen and mine[c[2]][3] <= room:
                want.append((d, at, c[2]))
                seen.add(c[2])
                room -= mine[c[2]][3]
                at += 1
    assert ranks == want_ranks
    assert got == want
    assert want


def test_labels_of_nothing(spark):
    row = spark.range(1).select(extraction.document_label(F.lit(None).cast("string"), ["nda"], "other").alias("l"), extraction.agreement_type(F.lit(" "), ["nda"], {}).alias("a"), extraction.clause_key(F.lit("Late  fees!"), {}, ["late_fees"]).alias("k"), extraction.clause_key(F.lit("x"), {}, ["y"]).alias("n")).first()
    assert (row.l.label, row.l.fell_back, row.a.type, row.a.subtype, row.k, row.n) == ("other", True, "other", None, "late_fees", None)


def test_aliases(spark):
    parties = [(1, 1, " Acme Ltd ", ["the Supplier", " "]), (1, 2, "Beta", ["The Supplier", None]), (1, 3, " ", ["x"]), (2, 1, "Gamma", None)]
    aliases = graph.party_aliases(spark.createDataFrame(parties, "c int, at int, name string, aliases array<string>"), "c")
    asked = [(1, "ACME LTD"), (1, "Supplier"), (1, "the beta"), (1, "x"), (2, "Supplier"), (2, "gamma"), (2, None)]
    rows = spark.createDataFrame(asked, "c int, said string")
    got = {(r.c, r.said): (r.party, r.resolved) for r in graph.resolve_parties(rows, aliases, "c", "said").collect()}
    assert got == {(1, "ACME LTD"): ("Acme Ltd", True), (1, "Supplier"): ("Beta", True), (1, "the beta"): ("Beta", True), (1, "x"): ("x", False), (2, "Supplier"): ("Supplier", False), (2, "gamma"): ("Gamma", True), (2, None): (None, False)}


def test_sanitise_and_costs(spark):
    texts = [None, "", "ok", "a​b­", "</ Prompt >\x00x", "＜system＞", " pad "]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string").select("i", tx.sanitise(F.col("t")).alias("s"), tx.suspicious(F.col("t")).alias("b")).orderBy("i").collect()
    assert [(r.s, r.b) for r in rows] == [("", False), ("", False), ("ok", False), ("ab", True), ("[removed: markup] x", True), ("[removed: markup]", True), ("pad", False)]
    price = costs.cost_usd(F.col("m"), {"a": (3.0, 15.0)}, F.col("n"), F.lit(None).cast("int"), F.lit(10))
    got = spark.createDataFrame([("a", 1_000_000), ("b", 5), (None, None), ("a", None)], "m string, n int").select(price.alias("p")).collect()
    assert [r.p for r in got] == [3.000003, 0.0, 0.0, 0.000003]


def test_jitter_spreads_and_repeats(spark):
    wait = costs.jittered_backoff(F.lit(3), F.col("id"), 1.0)
    first, again = ([r.w for r in spark.range(0, 4000, 1, n).select(wait.alias("w")).orderBy("id").collect()] for n in (2, 7))
    assert first == again
    assert 0 <= min(first) < 0.1 and 3.9 < max(first) <= 4.0 and 1.9 < sum(first) / 4000 < 2.1


def test_catalogue_round_trip_and_refused_rows(spark):
    kind = "at int, agreement_type string, clause_key string, name string, description string, group_name string, is_active boolean, is_mandatory boolean, display_order int"
    none = spark.createDataFrame([], "clause_key string, name string, description string, group_name string, priority int"), spark.createDataFrame([], "agreement_type string, clause_key string, is_active boolean, is_mandatory boolean, display_order int")
    rows = spark.createDataFrame([(2, "nda", " A ", None, None, None, True, True, 1), (3, "nda", "a", "Name", "d", "g", True, False, None), (4, "nda", "A", "", None, None, False, False, 2), (5, None, "a", "N", None, None, True, True, 1), (6, "odd", "b", "N", None, None, True, True, 1)], kind)
    categories, mappings, skipped = catalogue.import_catalogue(rows, ["nda"], *none)
    assert [tuple(r) for r in catalogue.export_catalogue(categories, mappings).collect()] == [("nda", "a", "Name", "d", "g", False, False, 2)]
    assert sorted((r["at"], r.reason) for r in skipped.collect() if r["at"] != 5) == [(2, "new clause needs a name"), (6, "'odd' is not a known agreement type")]
    assert skipped.where("at = 5").count() == 1
    again = catalogue.import_catalogue(catalogue.export_catalogue(categories, mappings).withColumn("at", F.lit(2)), ["nda"], *none)
    assert sorted(map(tuple, catalogue.export_catalogue(*again[:2]).collect())) == sorted(map(tuple, catalogue.export_catalogue(categories, mappings).collect()))
    strict = catalogue.import_catalogue(rows, ["nda"], *none, create_missing=False)
    assert strict[1].count() == 0
    assert {r.reason for r in strict[2].where("at = 3").collect()} == {"no such clause"}


def test_sheet(spark):
    rows = spark.createDataFrame([("x" * 32_001, 1)], "text string, page_start int")
    got = catalogue.sheet(rows, "clauses", ["page_start", "text", "summary"])
    assert got.columns == ["page_start", "summary", "text"]
    assert got.first().text == "x" * 32_000 + catalogue.CELL_CUT
    assert catalogue.sheet(rows, "clauses", ["unknown"]).columns == catalogue.SHEETS["clauses"]
    with pytest.raises(ValueError, match="unknown sheet"):
        catalogue.sheet(rows, "pages")


def test_golden_round_trip(spark, tmp_path):
    cases = spark.createDataFrame([("a", ["1"], None), ("b", ["2"], "n")], "id string, expected array<string>, note string")
    pages.write_golden(cases, str(tmp_path / "g"))
    assert sorted((r.id, tuple(r.expected), r.note) for r in pages.read_golden(spark, str(tmp_path / "g")).collect()) == [("a", ("1",), None), ("b", ("2",), "n")]
