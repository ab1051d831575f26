"""Deterministic risk findings, severity, alerts and their reconciliation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuquarry.operators.relational import listed

#: Severities of risks and of alerts in rising order.
SEVERITIES = ["low", "medium", "high", "critical"]
ALERT_LADDER = ["info", "low", "medium", "high", "critical"]


def alert_rank(column: Column) -> Column:
    """1 for info up to 5 for critical; others 0."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, ALERT_LADDER)), column), F.lit(0)).cast("int")


def promoted(column: Column) -> Column:
    """One step up the alert ladder."""
    return F.element_at(F.array(*map(F.lit, ALERT_LADDER)), F.least(alert_rank(column) + 1, F.lit(len(ALERT_LADDER))))


def severity_rank(column: Column) -> Column:
    """4 for critical down to 1; others 0."""
    return F.coalesce(F.array_position(F.array(*map(F.lit, SEVERITIES)), column), F.lit(0)).cast("int")


def one_step_up(column: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, SEVERITIES)), F.least(severity_rank(column) + 1, F.lit(len(SEVERITIES))))


def findings(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """One row per rule (risk_type, severity, condition) that fires; a null condition doesn't."""
    hits = [F.when(condition, F.struct(F.lit(name).alias("risk_type"), F.lit(severity).alias("severity"))) for name, severity, condition in rules]
    return df.withColumn("_f", F.explode(F.filter(F.array(*hits), lambda x: x.isNotNull()))).select(*df.columns, "_f.risk_type", "_f.severity")


def at_least(severity: Column, floor: str) -> Column:
    """The more severe of both on the alert ladder."""
    return F.when(alert_rank(severity) >= ALERT_LADDER.index(floor) + 1, severity).otherwise(floor)


def expiry_alert(days: Column, window: int = 90, escalate: int = 30, critical: int = 7, severity: Column | None = None) -> Column:
    """Severity by the days left, at least the rule's own; silent beyond the window and for what has expired."""
    base = F.lit("medium") if severity is None else severity
    raised = F.when(days <= critical, at_least(base, "critical")).when(days <= escalate, at_least(base, "high")).otherwise(base)
    return F.when((days >= 0) & (days <= window), raised)


def renewal_deadline(notice_deadline: Column, expiration: Column, notice_days: Column, lead: int = 45) -> Column:
    """The stated deadline of a notice, else the expiry less the notice days (the lead where none are known)."""
    return F.coalesce(notice_deadline, F.date_sub(expiration, F.coalesce(notice_days, F.lit(lead))))


def renewal_alert(days: Column, lead: int = 45, critical: int = 14, severity: Column | None = None) -> Column:
    base = F.lit("high") if severity is None else severity
    return F.when((days >= 0) & (days <= lead), F.when(days <= critical, at_least(base, "critical")).otherwise(base))


def risk_alert(score: Column, threshold: int = 67, critical: int = 85, severity: Column | None = None) -> Column:
    base = F.lit("high") if severity is None else severity
    return F.when(score >= critical, at_least(base, "critical")).when(score >= threshold, base)


def missing_clause_alert(missing: Column, severity: Column, watched: list[str] | None = None, least: int = 1) -> Column:
    """Where at least so many mandatory clauses (of the watched ones, in any case) are missing."""
    names = F.coalesce(missing, F.array().cast("array<string>"))
    if watched:
        names = F.filter(names, lambda x: F.lower(x).isin([w.lower() for w in watched]))
    return F.when(F.size(names) >= max(1, least), severity)


def review_alert(flagged: Column, pending: Column, severity: Column, least: int = 1) -> Column:
    """Where the document is flagged or clauses wait for a reviewer."""
    return F.when(F.coalesce(flagged, F.lit(False)) | (F.coalesce(pending, F.lit(0)) >= max(1, least)), severity)


def obligation_alert(days: Column, ahead: int = 14, overdue: int = 30, severity: Column | None = None, status: Column | None = None) -> Column:
    """Due soon, or overdue by no more than the days it is kept; only open or running ones where the status is given."""
    base = F.lit("medium") if severity is None else severity
    live = F.lit(True) if status is None else status.isin("open", "in_progress")
    return F.when(live & (days <= ahead) & (days >= -overdue), F.when(days < 0, at_least(base, "high")).otherwise(base))


def resolve_rules(rules: DataFrame, projects: DataFrame) -> DataFrame:
    """For each project and alert type its own rule, else the platform's (null project); disabled ones dropped."""
    own = rules.where("project_id IS NOT NULL").select("project_id", "alert_type", F.struct("severity", "enabled").alias("own"))
    default = rules.where("project_id IS NULL").select("alert_type", F.struct("severity", "enabled").alias("base"))
    each = projects.select("project_id", F.explode(listed(rules, "alert_type")).alias("alert_type"))
    joined = each.join(own, ["project_id", "alert_type"], "left").join(default, "alert_type", "left")
    rule = F.coalesce("own", "base")
    return joined.select("project_id", "alert_type", rule["severity"].alias("severity"), rule["enabled"].alias("enabled")).where("enabled").drop("enabled")


def reconcile(open_alerts: DataFrame, current: DataFrame, rules: DataFrame | None = None, now: Column | None = None) -> DataFrame:
    """What a sweep does with live alerts (dedupe_key, severity) and the conditions that hold (the same columns).

    create, update (severity changed), keep, escalate, resolve, or hold: the condition is gone but its rule
    is off. With rules (alert_type, escalate_after_days; enabled ones only, with project_id where both
    tables have it) and now, alerts also need status, alert_type, created_at and escalated_at: an alert
    keeps an earlier escalation on top of its severity, an open one (not an acknowledged one) of the
    rule's age is raised a step once, and nothing is resolved for a type without a rule. status is the
    operator's and stays.
    """
    full = rules is not None
    keys = [c for c in ("project_id", "alert_type") if full and c in rules.columns]
    a = open_alerts.select("dedupe_key", F.col("severity").alias("_was"), *([*keys, "status", "created_at", "escalated_at"] if full else []))
    b = current.select("dedupe_key", F.col("severity").alias("_now"))
    if not full:
        action = F.when(F.col("_was").isNull(), "create").when(F.col("_now").isNull(), "resolve").when(F.col("_was") != F.col("_now"), "update").otherwise("keep")
        return a.join(b, "dedupe_key", "full").select("dedupe_key", action.alias("action"), F.coalesce("_now", "_was").alias("severity"))
    rows = a.join(rules.select(*keys, "escalate_after_days", F.lit(True).alias("_on")), keys, "left").join(b, "dedupe_key", "full")
    kept = F.when(F.col("escalated_at").isNotNull(), promoted(F.col("_now"))).otherwise(F.col("_now"))
    old = F.datediff(now, F.col("created_at")) - F.when(F.date_format(now, "HH:mm:ss.SSSSSS") < F.date_format("created_at", "HH:mm:ss.SSSSSS"), 1).otherwise(0)
    due = F.coalesce((F.col("status") == "open") & F.col("escalated_at").isNull() & (F.col("escalate_after_days") > 0) & (old >= F.col("escalate_after_days")), F.lit(False))
    action = (
        F.when(F.col("_was").isNull(), "create").when(F.col("_now").isNull(), F.when(F.col("_on"), "resolve").otherwise("hold"))
        .when(due, "escalate").when(F.col("_was") != kept, "update").otherwise("keep")
    )
    severity = F.when(F.col("_now").isNull(), F.col("_was")).when(F.col("_was").isNull(), F.col("_now")).when(due, promoted(kept)).otherwise(kept)
    return rows.select("dedupe_key", action.alias("action"), severity.alias("severity"), "status")
