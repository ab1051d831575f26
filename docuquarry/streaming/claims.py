"""The stage queue as a stream: keyed state with timers for leases and attempts, claims by rank, and sweeps that run once a trigger.

A message is one key. Its state knows who holds it and until when; a timer on the watermark takes a lease
back whose worker went silent. The streaming query is the single runner: its checkpoint lets one instance
advance, and what a trigger writes is filed under the trigger's number, so a rerun writes it again, not twice.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import astuple, dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "message_id string, kind string, stage string, priority int, max_attempts int, worker string, at timestamp"
TRANSITION = "message_id string, action string, state string, stage string, priority int, attempt int, worker string, at timestamp, available_at timestamp"
_STATE = "state string, stage string, priority int, attempt int, max_attempts int, worker string, until long, available long"
#: The order of kinds at one time, minutes of a lease, the first wait, and how long what has ended is remembered.
KINDS = ["enqueue", "claim", "heartbeat", "done", "fail"]
LEASE_MS, BACKOFF_MS, KEEP_MS = 45 * 60_000, 1_000, 7 * 86_400_000


@dataclass(frozen=True)
class Message:
    state: str = "NEW"
    stage: str = ""
    priority: int = 0
    attempt: int = 1
    max_attempts: int = 3
    worker: str = ""
    until: int = 0
    available: int = 0


def _free(m: Message, at: int, wait: int) -> Message:
    """Back to the queue with one more attempt, or dead once they are spent."""
    if m.attempt < m.max_attempts:
        return replace(m, state="PENDING", attempt=m.attempt + 1, worker="", until=0, available=at + wait)
    return replace(m, state="DEAD", worker="", until=at + KEEP_MS)


def expired(m: Message, at: int) -> tuple[Message, list[tuple[str, int]]]:
    """What a lease that ran out before `at` turns a message into; it may be taken again at once."""
    if m.state != "CLAIMED" or at <= m.until:
        return m, []
    after = _free(m, m.until, 0)
    return after, [("lease_lost" if after.state == "PENDING" else "dead", m.until)]


def advance(m: Message, kind: str, worker: str, stage: str, priority: int | None, max_attempts: int | None, at: int, lease: int, backoff: int) -> tuple[Message, str]:
    """The message and the name of what happened, for one event of a worker."""
    if kind == "enqueue":
        if m.state != "NEW":
            return m, "ignored"  # sent at least once, queued once
        return Message("PENDING", stage or "", priority or 0, 1, max_attempts or 3, "", 0, at), "queued"
    if kind == "claim":
        if m.state == "PENDING" and m.available <= at:
            return replace(m, state="CLAIMED", worker=worker, until=at + lease), "claimed"
        return m, "refused"
    if m.state != "CLAIMED" or m.worker != worker:
        return m, "stale"  # a worker that lost its lease changes nothing
    if kind == "heartbeat":
        return replace(m, until=at + lease), "renewed"
    if kind == "done":
        return replace(m, state="DONE", worker="", until=at + KEEP_MS), "done"
    if kind == "fail":
        after = _free(m, at, backoff * 2 ** (m.attempt - 1))
        return after, "retry" if after.state == "PENDING" else "dead"
    return m, "ignored"


def _ms(at) -> int:
    return int(pd.Timestamp(at).value // 1_000_000)


def _steps(lease: int, backoff: int):
    def run(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        m = Message(*state.get) if state.exists else Message()
        out: list[tuple] = []

        def note(action: str, worker: str, at: int) -> None:
            out.append((key[0], action, m.state, m.stage, m.priority, m.attempt, worker, pd.Timestamp(at, unit="ms"), pd.Timestamp(m.available, unit="ms") if m.state == "PENDING" else pd.NaT))

        if state.hasTimedOut:
            if m.state in ("DONE", "DEAD"):
                state.remove()
                return
            holder = m.worker
            m, lost = expired(m, state.getCurrentWatermarkMs())
            for action, at in lost:
                note(action, holder, at)
        else:
            events = pd.concat(list(frames))
            events = events.assign(_k=events["kind"].map({k: i for i, k in enumerate(KINDS)}).fillna(len(KINDS))).sort_values(["at", "_k", "worker"], kind="stable")
            for e in events.itertuples():
                at, holder = _ms(e.at), m.worker
                m, lost = expired(m, at)
                for action, when in lost:
                    note(action, holder, when)
                whole = lambda x: None if pd.isna(x) else int(x)
                worker = e.worker if isinstance(e.worker, str) else ""
                m, action = advance(m, e.kind, worker, e.stage if isinstance(e.stage, str) else "", whole(e.priority), whole(e.max_attempts), at, lease, backoff)
                note(action, worker, at)
        if m.state != "NEW":
            state.update(astuple(m))
            if m.until:
                state.setTimeoutTimestamp(max(m.until, state.getCurrentWatermarkMs()) + 1)
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TRANSITION.split(", ")])

    return run


def transitions(events: DataFrame, lease_ms: int = LEASE_MS, backoff_ms: int = BACKOFF_MS, late: str = "1 minute") -> DataFrame:
    """The stream of TRANSITION rows that events (EVENT) cause: queued, claimed, refused, renewed, done, retry, lease_lost, dead, stale, ignored.

    Each worker's event holds at its own time: a lease that ran out before it is lost first, so the result
    doesn't depend on where triggers cut the stream. Silent workers lose theirs when the watermark passes
    (events of any message move it). Events later than the watermark are dropped. Ended messages are
    remembered for KEEP_MS, so a message that is sent again isn't queued again, and then forgotten.
    """
    timed = events.withColumn("at", F.col("at").cast("timestamp")).withWatermark("at", late)
    return timed.groupBy("message_id").applyInPandasWithState(_steps(lease_ms, backoff_ms), TRANSITION, _STATE, "append", GroupStateTimeout.EventTimeTimeout)


def queue_view(log: DataFrame) -> DataFrame:
    """Each message as its last transition left it; log is what transitions wrote."""
    last = F.max_by(F.struct("state", "stage", "priority", "attempt", "worker", "available_at"), F.struct("at", F.col("trigger"), F.col("state") != "PENDING"))
    return log.groupBy("message_id").agg(last.alias("m")).select("message_id", "m.*")


def assign(queue: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Claim events (message_id, kind, worker, at) for workers' requests (worker, capacity, stages), stages null for any.

    Due messages go out by priority (the lowest number first), then by how long they are due; a request takes as many as it has room
    for. Only so many messages are ranked as all requests together ask for, per set of stages.
    """
    asked = requests.where("capacity > 0").withColumn("_set", F.coalesce(F.array_join(F.sort_array("stages"), ","), F.lit("*")))
    room = asked.groupBy("_set").agg(F.sum("capacity").cast("int").alias("_room"), F.first("stages").alias("_stages"))
    due = queue.where((F.col("state") == "PENDING") & (F.col("available_at") <= now)).select("message_id", "stage", "priority", "available_at")
    # a message may suit several sets; the first of them by name has it
    fits = due.join(room, F.col("_stages").isNull() | F.array_contains("_stages", F.col("stage"))).groupBy("message_id", "priority", "available_at").agg(F.min(F.struct("_set", "_room")).alias("_s"))
    order = Window.partitionBy("_set").orderBy("priority", "available_at", "message_id")
    ranked = fits.select("message_id", "priority", "available_at", "_s._set", "_s._room").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("_room"))
    before = Window.partitionBy("_set").orderBy("worker").rowsBetween(Window.unboundedPreceding, -1)
    slots = asked.groupBy("_set", "worker").agg(F.sum("capacity").cast("int").alias("_c")).withColumn("_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).cast("int"))
    slots = slots.select("_set", "worker", F.explode(F.sequence(F.col("_b") + 1, F.col("_b") + F.col("_c"))).alias("_n"))
    return ranked.join(slots, ["_set", "_n"]).select("message_id", F.lit("claim").alias("kind"), "worker", now.alias("at"))


def append_once(path: str, partition: Callable[[DataFrame], DataFrame] | None = None) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that files a trigger's rows under its number (trigger=N), replacing what an earlier try of it left."""

    def write(batch: DataFrame, number: int) -> None:
        rows = batch if partition is None else partition(batch)
        rows.write.mode("overwrite").parquet(f"{path}/trigger={number}")

    return write


def sweeps(steps: dict[str, Callable[[SparkSession, int], int]], path: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that runs each named step once a trigger and files what it changed (step, changed, error) under the trigger's number.

    A step that fails is recorded and doesn't stop the others; a trigger that was filed before isn't run again.
    """

    def run(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        where = f"{path}/trigger={number}"
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(where + "/_SUCCESS")
        if hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return
        rows = []
        for name, step in steps.items():
            try:
                rows.append((name, int(step(spark, number)), None))
            except Exception as error:  # noqa: BLE001 - one sweep must not stop another
                rows.append((name, 0, f"{type(error).__name__}: {error}"[:500]))
        spark.createDataFrame(rows, "step string, changed int, error string").coalesce(1).write.mode("overwrite").parquet(where)

    return run
