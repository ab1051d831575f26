"""Append-only logs on disk, run states, and quotes anywhere in long texts."""

from datetime import date

from pyspark.sql import functions as F

from docuquarry.operators import aggregates as agg
from docuquarry.plans import evidence
from docuquarry.streaming import logs


def test_a_batch_is_filed_once_and_days_are_dropped(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(i, f"2024-01-0{1 + i % 4} 12:00:00") for i in range(20)] + [(99, None)], "id int, at string").withColumn("at", F.col("at").cast("timestamp"))
    for batch in (1, 1, 2):
        logs.append(rows, path, batch, "at")
    assert logs.read(spark, path).count() == 42
    assert logs.read(spark, path, date(2024, 1, 2), date(2024, 1, 3)).count() == 20
    assert "PartitionFilters: [isnotnull(day" in logs.read(spark, path, date(2024, 1, 2))._jdf.queryExecution().toString()
    (tmp_path / "log" / "day=notes").mkdir()
    assert logs.drop_before(spark, path, date(2024, 1, 3)) == ["1970-01-01", "2024-01-01", "2024-01-02"] and (tmp_path / "log" / "day=notes").exists()
    (tmp_path / "log" / "day=notes").rmdir()
    assert {str(r.day) for r in spark.read.parquet(path).select("day").distinct().collect()} == {"2024-01-03", "2024-01-04"}


def test_stream_appends_each_trigger_once(spark, tmp_path):
    spark.createDataFrame([(i, "2024-01-01 00:00:00") for i in range(7)], "id int, at string").write.parquet(str(tmp_path / "in"))
    for _ in range(2):  # the second run finds nothing new
        source = spark.readStream.schema("id int, at string").parquet(str(tmp_path / "in"))
        source.writeStream.foreachBatch(logs.each_batch(str(tmp_path / "log"), "at")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    assert logs.read(spark, str(tmp_path / "log")).count() == 7


def test_run_states(spark):
    rows = [("a", 1, "started", None), ("a", 3, "failed", "boom"), ("a", 4, "started", None), ("b", 1, "started", None), ("b", 6, "succeeded", None), ("c", 2, "heartbeat", None), ("d", 5, "skipped", None)]
    log = spark.createDataFrame(rows, "run string, s int, status string, error string").withColumn("at", F.timestamp_seconds("s"))
    got = {r.run: (r.status, r.attempts, r.duration_ms, r.error) for r in logs.stage_runs(log, ["run"], error=F.col("error")).collect()}
    assert got == {"a": ("running", 2, None, None), "b": ("succeeded", 1, 5_000, None), "c": ("pending", 0, None, None), "d": ("skipped", 0, None, None)}


def test_quotes_behind_every_bound(spark):
    quote = " ".join(f"q{i}" for i in range(60))
    altered = quote.replace("q30 ", "x30 ")
    far = " ".join(f"w{i}" for i in range(25_000)) + " " + quote + " tail " * 500
    long = " ".join(f"z{i}" for i in range(3_000))
    rows = spark.createDataFrame([(1, altered, far), (2, long + " other" * 1_500, long), (3, "not there at all", far)], "i int, quote string, text string")
    verdicts = lambda **k: [r.verdict for r in evidence.check_quotes(rows, "quote", "text", **k).orderBy("i").collect()]
    assert verdicts() == ["rejected", "ok", "rejected"]
    assert verdicts(quote_words=None, evidence_words=None) == ["ok", "rejected", "rejected"]


def test_aggregates_of_odd_rows(spark):
    rows = spark.createDataFrame([(None, None, None, None, None), (" ", 1, 5.0, "EUR", "2024-01-02"), ("Acme", 1, 7.0, None, "2024-01-02"), ("ACME ", 1, 7.0, None, None), ("acme", 2, None, "EUR", "2024-01-05")], "name string, contract int, value double, currency string, at string")
    got = agg.party_directory(rows, F.col("name"), "contract", F.lit(None).cast("boolean"), F.lit(""), F.to_date("at"), "contract").collect()
    assert [(r.party_key, r.contracts, r.roles) for r in got] == [("acme", 2, "")]
    assert sorted(map(tuple, agg.value_by_currency(rows.where("contract IS NOT NULL"), "contract", "contract", F.col("value"), F.col("currency")).collect())) == [(1, "EUR", 5.0), (1, "unknown", 7.0)]
    assert agg.success_rate(rows, F.lit(False), F.lit(False)).first()[0] == 0.0 and agg.per_day(rows, "at", before="2024-01-02").collect()[0].n == 2
    assert agg.chunk_statistics(rows.where("name IS NULL"), F.col("name"), "name", "contract").first().next_version == 1
    assert [r.contract for r in agg.expiring_first(rows, "at", "2024-01-01", 3, "name").collect()] == [1, 1]
    assert agg.kpi_counts(rows.limit(0), x=F.lit(True)).first().asDict() == {"total": 0, "x": 0}
