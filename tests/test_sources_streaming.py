import json

from pyspark.sql import functions as F

from docuquarry.sources import pages, sinks
from docuquarry.streaming import queue


def test_pages_in_numeric_order_without_blanks(spark, tmp_path):
    para = lambda x, poly=None: {"content": x, "role": None, "boundingRegions": [{"pageNumber": 1, "polygon": poly}] if poly else []}
    for n in (2, 10):
        (tmp_path / f"page_{n}.json").write_text(json.dumps({"pages": [], "paragraphs": [para("a", [0.5] * 8), para("  "), para("b")]}))
    got = [(r.ref, r.content, len(r.polygon)) for r in pages.read_pages(spark, str(tmp_path)).orderBy("page", "para").collect()]
    assert got == [("2.1", "a", 8), ("2.2", "b", 0), ("10.1", "a", 8), ("10.2", "b", 0)]


def test_golden_rejects_repeats(spark, tmp_path):
    (tmp_path / "g.jsonl").write_text('{"id": "a", "expected": {"pages": [1]}}\n{"id": "a", "expected": {"pages": [2]}}\n')
    try:
        pages.read_golden(spark, str(tmp_path))
    except ValueError as e:
        assert "'a'" in str(e)
    else:
        raise AssertionError("repeated ids pass")


def test_sinks(spark):
    old = spark.createDataFrame([(1, "a", 5), (2, "b", 6)], "k int, v string, n int")
    new = spark.createDataFrame([(2, None, 7), (3, "c", 8)], "k int, v string, n int")
    assert {tuple(r) for r in sinks.upsert(old, new, ["k"]).collect()} == {(1, "a", 5), (2, "b", 7), (3, "c", 8)}
    assert {tuple(r) for r in sinks.replace_keys(old, new, ["k"]).collect()} == {(1, "a", 5), (2, None, 7), (3, "c", 8)}
    assert [r.k for r in sinks.insert_ignore(old, new, "k").collect()] == [3]
    art = spark.createDataFrame([(1, 1, False), (1, 2, True)], "k int, generation int, is_current boolean")
    got = {(r.generation, r.is_current) for r in sinks.supersede(art, spark.createDataFrame([(1,)], "k int"), ["k"]).collect()}
    assert got == {(1, False), (2, False), (3, True)}


def test_streams(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.unionByName(events).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("once", queue.dispatch_once(source, "event_id", "ts"), "append"), ("hours", queue.windowed_counts(source, "ts", ["event_type"], "1 hour", late="60 days"), "complete")):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination(120)
    assert spark.table("once").count() == events.count()
    batch = events.groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("start"), "event_type").agg((2 * F.count("*")).alias("n"))
    assert spark.table("hours").exceptAll(batch).count() == 0 and spark.table("hours").count() == batch.count()


def test_retries_and_leases(spark):
    df = spark.createDataFrame([(1, 3, "CLAIMED", "2024-01-01 00:00:00"), (3, 3, "CLAIMED", "2024-01-01 00:00:00")], "attempt int, max_attempts int, state string, at string")
    df = df.withColumn("claimed_at", F.col("at").cast("timestamp")).withColumn("available_at", F.col("claimed_at"))
    now = F.lit("2024-01-01 02:00:00").cast("timestamp")
    assert [(r.state, r.attempt) for r in queue.expire_leases(df, now).orderBy("attempt").collect()] == [("PENDING", 2), ("DEAD", 3)]
    got = queue.retry(df, now).orderBy("attempt").collect()
    assert [r.state for r in got] == ["PENDING", "DEAD"] and str(got[0].available_at) == "2024-01-01 02:00:01"
