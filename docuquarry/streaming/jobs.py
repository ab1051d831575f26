"""Jobs and their stages: what to claim, run, retry, resume and expire, and logs that keep their age."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Stages in order with the progress at their begin and end, and what each one needs.
PROGRESS = {"validation": (0, 3), "parser": (3, 35), "docpipeline": (35, 50), "extraction": (50, 85), "embedding": (85, 95), "indexing": (95, 100)}
STAGES = list(PROGRESS)


def stage_position(stage: Column) -> Column:
    """1 for the first stage; null for one that isn't known."""
    at = F.array_position(F.array(*map(F.lit, STAGES)), stage)
    return F.when(at > 0, at)


def progress(stage: Column, completed: Column) -> Column:
    """Percentage at a stage's begin, or end where it is completed."""
    out = F.lit(None).cast("int")
    for name, (begin, end) in PROGRESS.items():
        out = F.when(stage == name, F.when(completed, end).otherwise(begin)).otherwise(out)
    return F.coalesce(out, F.when(completed, 100).otherwise(0))


def next_stage(plan: DataFrame, job: str) -> DataFrame:
    """(job, next): of a plan's stages (stage, should_run, completed) the first to run behind the last completed one."""
    at = stage_position(F.col("stage"))
    done = F.coalesce(F.max(F.when(F.col("completed"), at)).over(Window.partitionBy(job)), F.lit(0))
    rows = plan.withColumn("_at", at).withColumn("_done", done)
    return rows.groupBy(job).agg(F.min_by("stage", F.when(F.col("should_run") & (F.col("_at") > F.col("_done")), F.col("_at"))).alias("next"))


def to_run(stages: DataFrame, job: str) -> DataFrame:
    """stages (stage, reusable) with runs: one whose checkpoint can't be reused, and every one behind it."""
    w = Window.partitionBy(job).orderBy(stage_position(F.col("stage"))).rowsBetween(Window.unboundedPreceding, 0)
    return stages.withColumn("runs", F.max(~F.col("reusable")).over(w))


def ready(stages: DataFrame, needs: DataFrame, job: str) -> DataFrame:
    """(job, stage, ready): whether all stages that a stage needs (stage, needs) have succeeded in the job (stage, status)."""
    done = stages.where("status = 'succeeded'").select(job, F.col("stage").alias("needs"), F.lit(True).alias("_ok"))
    rows = stages.select(job, "stage").join(needs, "stage", "left").join(done, [job, "needs"], "left")
    return rows.groupBy(job, "stage").agg(F.bool_and(F.col("needs").isNull() | F.coalesce("_ok", F.lit(False))).alias("ready"))


def after_failure(runs: DataFrame) -> DataFrame:
    """runs (attempt, max_attempts, retryable) with outcome: retry while attempts are left and it can help, else failed, which alerts."""
    again = F.col("retryable") & (F.col("attempt") < F.col("max_attempts"))
    return runs.withColumn("outcome", F.when(again, "retry").otherwise("failed")).withColumn("alerts", ~again)


def transition(state: Column, event: Column) -> Column:
    """The state of a job after an event; ended ones stay, paused ones only resume or are cancelled."""
    ended = state.isin("ready", "failed", "cancelled")
    moved = F.when(event == "cancel", "cancelled").when(event == "pause", "paused").when(event == "fail", "failed").when(event == "finish", "ready").when(event.isin("start", "resume", "heartbeat"), "running")
    return F.when(ended & (event != "reprocess"), state).when(event == "reprocess", "queued").when((state == "paused") & ~event.isin("resume", "cancel"), state).otherwise(F.coalesce(moved, state))


def claim(queue: DataFrame, now: Column, limit: int, stages: list[str] | None = None) -> DataFrame:
    """Messages (message_id, state, stage, priority, available_at) to take: pending and due, the highest priority first, then the longest due. A top-k, so nothing is sorted whole."""
    rows = queue.where((F.col("state") == "PENDING") & (F.col("available_at") <= now))
    rows = rows.where(F.col("stage").isin(stages)) if stages else rows
    return rows.orderBy(F.desc("priority"), "available_at", "message_id").limit(limit)


def resolve_profiles(contracts: DataFrame, profiles: DataFrame) -> DataFrame:
    """(contract_id, profile_id) for contracts (project_id, agreement_type): an active profile (project_id, agreement_type, priority, is_default, is_active) of its type, its project's before a global one, then the highest priority; else the default."""
    live = profiles.where("is_active").select(F.col("project_id").alias("_p"), "agreement_type", "priority", "profile_id")
    fits = contracts.select("contract_id", "project_id", "agreement_type").join(live, "agreement_type").where(F.col("_p").isNull() | (F.col("_p") == F.col("project_id")))
    w = Window.partitionBy("contract_id").orderBy(F.col("_p").isNull().asc(), F.desc("priority"), "profile_id")
    best = fits.withColumn("_r", F.row_number().over(w)).where("_r = 1").select("contract_id", F.col("profile_id").alias("_found"))
    default = [r[0] for r in profiles.where("is_active AND is_default").orderBy(F.desc("priority"), "profile_id").select("profile_id").limit(1).collect()]
    return contracts.select("contract_id").join(best, "contract_id", "left").select("contract_id", F.coalesce("_found", *[F.lit(x) for x in default]).alias("profile_id"))


def clause_targets(types: DataFrame, mapping: DataFrame, catalogue: DataFrame, fallback: str = "other") -> DataFrame:
    """(agreement_type, key): for types (agreement_type) the active clauses mapped to them (agreement_type, key, is_active) that the catalogue (key) holds; the whole catalogue where nothing is mapped and for the fallback type; none where all are off."""
    from docuquarry.operators.relational import listed

    per = mapping.groupBy("agreement_type").agg(F.collect_set(F.when(F.col("is_active"), F.col("key"))).alias("_on"))
    every = listed(catalogue, "key")
    wanted = F.when((F.col("agreement_type") == fallback) | F.col("_on").isNull(), every).otherwise(F.array_intersect(every, F.col("_on")))
    return types.join(per, "agreement_type", "left").select("agreement_type", F.explode(wanted).alias("key"))


def export_sweep(exports: DataFrame, now: Column, stuck_minutes: int = 30) -> DataFrame:
    """exports (status, started_at, expires_at) with what a sweep does: running too long goes back to the queue, completed beyond its time expires."""
    stuck = (F.col("status") == "running") & (F.col("started_at") < now - F.make_interval(mins=F.lit(stuck_minutes)))
    old = (F.col("status") == "completed") & (F.col("expires_at") < now)
    return exports.withColumn("action", F.when(stuck, "requeue").when(old, "expire").otherwise("keep"))


def within_retention(logs: DataFrame, time: str, now: Column, days: int = 180) -> DataFrame:
    """Rows of an append-only log that aren't older than its retention."""
    return logs.where(F.col(time) >= now - F.make_interval(days=F.lit(days)))


def invalidated(artifacts: DataFrame, stage: str, contracts: DataFrame) -> DataFrame:
    """artifacts (contract_id, stage, is_current) of which those of the stage and later ones of these contracts are no longer current."""
    hit = artifacts.join(contracts.select("contract_id").distinct().withColumn("_hit", F.lit(True)), "contract_id", "left")
    late = F.coalesce(F.col("_hit"), F.lit(False)) & (stage_position(F.col("stage")) >= STAGES.index(stage) + 1)
    return hit.withColumn("is_current", F.col("is_current") & ~F.coalesce(late, F.lit(False))).drop("_hit")
