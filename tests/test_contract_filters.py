"""The filter compiler: what reaches the scan, and what is no filter."""

from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from docuquarry.plans import contract_filters as cf


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("contracts")
    contracts = spark.range(40).select(
        "id", (F.col("id") % 3).alias("project_id"), F.concat(F.lit("T"), "id").alias("title"), F.lit(None).cast("string").alias("original_file_name"), F.lit("N1").alias("contract_number"), F.when(F.col("id") % 2 == 0, "ready").otherwise("failed").alias("status"), F.lit("pdf").alias("file_type"),
        F.lit("en").alias("language"), F.lit("2024-01-01").cast("timestamp").alias("created_at"), F.lit(None).cast("timestamp").alias("deleted_at"),
    )
    metadata = spark.range(20).select(F.col("id").alias("contract_id"), F.lit("de").alias("language"), F.concat(F.lit("V_"), "id").alias("vendor"), (F.col("id") * 5).cast("int").alias("risk_score"), F.lit("EUR").alias("currency"), F.lit(None).cast("string").alias("party_a"), F.lit(None).cast("string").alias("party_b"), F.lit(None).cast("string").alias("customer"), F.lit(None).cast("string").alias("summary"))
    for name, df in (("c", contracts), ("m", metadata)):
        df.write.parquet(str(folder / name))
    return spark.read.parquet(str(folder / "c")), spark.read.parquet(str(folder / "m"))


def ids(tables, spec, projects=(0, 1, 2)):
    return sorted(r.id for r in cf.filtered(*tables, list(projects), spec, date(2024, 1, 1)).collect())


def test_filters_reach_the_scans(spark, tables):
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    spec = {"status": ["ready"], "file_type": "pdf", "uploaded_after": datetime(2023, 1, 1), "risk_score": {"min": 10.5}, "currency": "eur"}
    plan = cf.filtered(*tables, [0, 1], spec, date(2024, 1, 1)).select("id")._jdf.queryExecution().toString()
    pushed = [x for x in plan.split("\n") if "PushedFilters" in x]
    both = " ".join(pushed)
    for said in ("EqualTo(status,ready)", "EqualTo(file_type,pdf)", "GreaterThanOrEqual(created_at", "In(project_id, [0,1])", "GreaterThanOrEqual(risk_score,10)", "EqualTo(currency,EUR)", "IsNull(deleted_at)"):
        assert said in both or said.replace("In(project_id, [0,1])", "Or(EqualTo(project_id") in both, said
    assert "LeftOuter" not in plan.split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0]
    assert "title" not in both and all("title" not in x.split("ReadSchema")[1] for x in pushed)


def test_what_is_no_filter(tables):
    assert ids(tables, None) == ids(tables, {}) == ids(tables, {"status": [], "search": "", "vendor": None, "risk_score": {}, "expiring_within_days": None}) == list(range(40))
    assert ids(tables, {"status": ["ready"]}, projects=()) == []


def test_wildcards_languages_and_absent_metadata(tables):
    assert ids(tables, {"vendor": "v__"}) == list(range(20)) and ids(tables, {"vendor": "V_1%"}) == [1, *range(10, 20)]
    assert ids(tables, {"language": "de"}) == list(range(20)) and ids(tables, {"language": "en"}) == list(range(40))
    assert ids(tables, {"search": " t3 "}) == [3, *range(30, 40)]


@pytest.mark.parametrize("spec", [{"statuz": ["ready"]}, {"risk_score": {"from": 1}}])
def test_unknown_entries_are_refused(tables, spec):
    with pytest.raises(ValueError):
        cf.filtered(*tables, [0], spec, date(2024, 1, 1))
