"""The export set: what shares one set of contracts, what is masked, and one write."""

from datetime import date

from pyspark.sql import functions as F

from docuquarry.catalog_contracts import _export
from docuquarry.sources import exports

SF = "/root/testdata/sf0.001"


def test_sheets_share_one_set(spark):
    sheets, clauses, chosen = _export(spark, SF)
    assert list(sheets) == ["parties", "contracts", "clauses", "risks", "obligations", "key_dates"]
    assert sheets["clauses"].columns == ["_contract", "_place", "clause_type", "title", "text"] and "severity" in sheets["risks"].columns
    ids = {r.id for r in chosen.collect()}
    assert ids and all({r._contract for r in s.collect()} <= ids for s in sheets.values()) and sheets["contracts"].count() == len(ids)
    hidden = sheets["clauses"].where(F.col("text") == exports.MASK)
    assert hidden.count() == exports.masked_count(clauses, chosen, [1, 3]).first()[0] > 0 and hidden.where("clause_type <> 'confidentiality'").isEmpty()


def test_one_write(spark, tmp_path):
    sheets, _, _ = _export(spark, SF)
    exports.write_set(sheets, str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.is_dir()) == sorted(f"entity={e}" for e in sheets)
    assert spark.read.json(str(tmp_path / "out")).groupBy("entity").count().exceptAll(exports.as_rows(sheets).groupBy("entity").count()).isEmpty()


def test_names_of_sheets_and_no_scope(spark):
    assert exports.wanted_sheets(None) == exports.wanted_sheets(["x"]) == exports.DEFAULT_SHEETS and exports.wanted_sheets(["risks", "risks"]) == ["risks"]
    from docuquarry.catalog_contracts import repository_tables

    assert exports.selected(*repository_tables(spark, SF), [], None, date(2001, 6, 1)).isEmpty()
    assert exports.selected(*repository_tables(spark, SF), [1, 3], None, date(2001, 6, 1), [3, 4]).count() <= 2
