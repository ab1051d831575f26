"""The queue as a stream: a lost lease, a retry, a dead letter, claims by rank, and sweeps once a trigger."""

import json

import pytest
from pyspark.sql import functions as F

from docuquarry.streaming import claims


def event(message, kind, at, worker=None, **more):
    return {"message_id": message, "kind": kind, "worker": worker, "at": f"2024-01-01T{at}Z", **more}


#: One file a trigger. Leases last ten minutes, the first wait is a minute.
TRIGGERS = [
    [event("a", "enqueue", "10:00:00", stage="parser", priority=1, max_attempts=3), event("b", "enqueue", "10:00:00", stage="parser", max_attempts=1), event("a", "enqueue", "10:00:05"), event("c", "enqueue", "10:00:00", stage="embedding")],
    [event("a", "claim", "10:01:00", "w1"), event("b", "claim", "10:01:00", "w1"), event("b", "claim", "10:01:01", "w2"), event("c", "claim", "10:01:00", "w2"), event("c", "heartbeat", "10:09:00", "w2")],
    [event("c", "done", "10:18:00", "w2")],  # moves the watermark past the leases of a and b
    [event("c", "claim", "10:19:00", "w3")],  # their timers fire here
    [event("a", "done", "10:19:30", "w1"), event("a", "claim", "10:20:00", "w2"), event("a", "fail", "10:21:00", "w2"), event("a", "claim", "10:22:00", "w3"), event("a", "claim", "10:23:00", "w3")],
    [event("a", "heartbeat", "10:50:00", "w3"), event("d", "fail", "10:50:00", "w1")],
]


@pytest.fixture(scope="module")
def log(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("claims")
    (folder / "in").mkdir()
    for i, rows in enumerate(TRIGGERS):
        (folder / "in" / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        import os

        os.utime(folder / "in" / f"{i}.json", (1_000_000 + i, 1_000_000 + i))  # read in this order
    source = spark.readStream.schema(claims.EVENT).option("maxFilesPerTrigger", 1).json(str(folder / "in"))
    moved = claims.transitions(source, lease_ms=600_000, backoff_ms=60_000)
    query = moved.writeStream.foreachBatch(claims.append_once(str(folder / "log"))).option("checkpointLocation", str(folder / "cp")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(180)
    return spark.read.parquet(str(folder / "log")).cache()


def of(log, message):
    rows = log.where(F.col("message_id") == message).orderBy("at", F.col("action") != "lease_lost", "trigger").collect()
    return [(r.action, r.state, r.attempt, f"{r.at:%H:%M:%S}") for r in rows]


def test_lost_lease_retry_and_dead_letter(log):
    assert of(log, "a") == [
        ("queued", "PENDING", 1, "10:00:00"), ("ignored", "PENDING", 1, "10:00:05"), ("claimed", "CLAIMED", 1, "10:01:00"), ("lease_lost", "PENDING", 2, "10:11:00"), ("stale", "PENDING", 2, "10:19:30"), ("claimed", "CLAIMED", 2, "10:20:00"),
        ("retry", "PENDING", 3, "10:21:00"), ("refused", "PENDING", 3, "10:22:00"), ("claimed", "CLAIMED", 3, "10:23:00"), ("dead", "DEAD", 3, "10:33:00"), ("stale", "DEAD", 3, "10:50:00"),
    ]
    assert of(log, "b") == [("queued", "PENDING", 1, "10:00:00"), ("claimed", "CLAIMED", 1, "10:01:00"), ("refused", "CLAIMED", 1, "10:01:01"), ("dead", "DEAD", 1, "10:11:00")]
    assert [x[0] for x in of(log, "c")] == ["queued", "claimed", "renewed", "done", "refused"] and [x[0] for x in of(log, "d")] == ["stale"]
    waits = log.where("message_id = 'a' AND action = 'retry'").first()
    assert f"{waits.available_at:%H:%M:%S}" == "10:23:00"  # doubled by the second attempt


def test_view_of_the_queue(log):
    assert {r.message_id: (r.state, r.attempt) for r in claims.queue_view(log).collect() if r.message_id != "d"} == {"a": ("DEAD", 3), "b": ("DEAD", 1), "c": ("DONE", 1)}


def test_claims_by_priority_and_room(spark):
    queue = [(f"m{i}", "PENDING" if i != 4 else "CLAIMED", "parser" if i % 2 else "embedding", i % 3, f"2024-01-01 10:0{9 - i}:00") for i in range(9)]
    queue = spark.createDataFrame(queue, "message_id string, state string, stage string, priority int, at string").withColumn("available_at", F.col("at").cast("timestamp"))
    asked = spark.createDataFrame([("w1", 2, None), ("w2", 1, None), ("w3", 5, ["parser"]), ("w4", 0, None)], "worker string, capacity int, stages array<string>")
    got = {r.message_id: r.worker for r in claims.assign(queue, asked, F.lit("2024-01-01 10:07:00").cast("timestamp")).collect()}
    # due: m2..m8 without m4; all of them suit the requests for any stage
    assert got == {"m6": "w1", "m3": "w1", "m7": "w2"}
    only = {r.message_id: r.worker for r in claims.assign(queue, asked.where("worker = 'w3'"), F.lit("2024-01-01 10:07:00").cast("timestamp")).collect()}
    assert only == {"m3": "w3", "m7": "w3", "m5": "w3"}


def test_sweeps_run_once_a_trigger(spark, tmp_path):
    ran = []

    def broken(session, number):
        raise RuntimeError("no table")

    steps = {"leases": lambda s, n: ran.append(n) or 3, "broken": broken, "exports": lambda s, n: 1}
    each = claims.sweeps(steps, str(tmp_path / "sweeps"))
    for number in (0, 1, 1):
        each(spark.range(1), number)
    assert ran == [0, 1]
    got = {(r.trigger, r.step): (r.changed, r.error) for r in spark.read.parquet(str(tmp_path / "sweeps")).collect()}
    assert got[1, "leases"] == (3, None) and got[0, "exports"] == (1, None) and got[0, "broken"] == (0, "RuntimeError: no table") and len(got) == 6


def test_a_trigger_that_is_rerun_adds_nothing(spark, tmp_path):
    write = claims.append_once(str(tmp_path / "log"))
    for number in (0, 0, 1):
        write(spark.range(5), number)
    assert spark.read.parquet(str(tmp_path / "log")).count() == 10
