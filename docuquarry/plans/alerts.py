"""Alert sweeps: six kinds of conditions under rules that are rows, and what a sweep does with the alerts that stand.

One pass over contracts feeds five kinds, one over obligations the sixth. A rule row holds thresholds as
JSON, its own project's before the platform's (null project); disabled rows don't count at all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuquarry.functions.text import let
from docuquarry.operators.steps import settled
from docuquarry.plans.rules import at_least, promoted

#: The kinds that a sweep owns, statuses of contracts that it skips and of alerts that are live.
KINDS = ["contract_expiring", "auto_renewal_notice", "high_risk", "missing_mandatory_clause", "review_required", "obligation_due"]
SKIPPED, LIVE, OPEN_OBLIGATIONS = ["archived", "failed"], ["open", "acknowledged"], ["open", "in_progress"]
#: Defaults of the thresholds.
DEFAULTS = {
    "contract_expiring": {"window_days": 90, "critical_days": 7, "escalate_days": 30}, "auto_renewal_notice": {"lead_days": 45, "critical_days": 14}, "high_risk": {"risk_score_cutoff": 67, "critical_score": 85},
    "missing_mandatory_clause": {"min_missing": 1}, "review_required": {"min_items": 1}, "obligation_due": {"window_days": 14, "overdue_days": 30},
}
DRAFT = "struct<alert_type:string,severity:string,title:string,message:string,dedupe_key:string,due_date:date,details:string>"
_ALERT_TITLE = 255
#: Projects, or rules of projects, are broadcast only when they were counted and are at most so many.
BROADCAST_ROWS = 10_000


def setting(config: Column, name: str, default: int) -> Column:
    """A whole number of a JSON object: numbers are cut, texts must be whole numbers, true and false are 1 and 0; anything else is the default."""

    def read(value: Column) -> Column:
        kind, said = F.schema_of_variant(value), F.variant_get(value, "$", "string")
        whole = F.when(F.trim(said).rlike(r"^[+-]?\d+$"), F.trim(said).try_cast("int"))
        number = F.when(said.rlike("^-?[0-9]"), F.try_variant_get(value, "$", "double").try_cast("int"))
        return F.when(kind == "STRING", whole).when(kind == "BOOLEAN", F.when(said == "true", 1).otherwise(0)).otherwise(number)

    return F.coalesce(let(F.try_variant_get(F.try_parse_json(config), f"$.{name}", "variant"), read), F.lit(default))


def effective_rules(rules: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, rules): for each project a map of kind to (severity, config, escalate_after_days, rule_id).

    rules: (rule_id, project_id, alert_type, severity, config, escalate_after_days, is_enabled). Enabled rows
    alone are read: where a project's own row is disabled, the platform's applies.
    """
    fields = ["severity", "config", "escalate_after_days", "rule_id"]
    on = rules.where(F.col("is_enabled") & F.col("alert_type").isin(KINDS))
    named = F.map_from_entries(F.collect_list(F.struct("alert_type", F.struct(*fields))))
    own = on.where("project_id IS NOT NULL").groupBy("project_id").agg(named.alias("_own"))
    # at most one row a kind
    base = on.where("project_id IS NULL").select("alert_type", *fields).collect()
    kinds = dict(on.dtypes)
    default = F.create_map(*[x for r in base for x in (F.lit(r.alert_type), F.struct(*[F.lit(r[f]).cast(kinds[f]).alias(f) for f in fields]))]) if base else F.create_map().cast("map<string,struct<" + ",".join(f"{f}:{kinds[f]}" for f in fields) + ">>")
    none = F.create_map().cast("map<string,struct<" + ",".join(f"{f}:{kinds[f]}" for f in fields) + ">>")
    both = F.map_concat(F.map_filter(default, lambda k, _: ~F.map_contains_key(F.coalesce("_own", none), k)), F.coalesce("_own", none))
    return projects.select("project_id").distinct().join(own, "project_id", "left").select("project_id", both.alias("rules"))


def _small(rows: DataFrame) -> DataFrame:
    rows = settled(rows)
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def thresholds(rules: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, a column for each kind): its effective rule as (severity, watched, thresholds), null without one; each rule's JSON is read once, not once a contract."""

    def read(kind: str) -> Column:
        def of(rule: Column) -> Column:
            watched = F.coalesce(F.try_variant_get(F.try_parse_json(rule["config"]), "$.clause_types", "array<string>"), F.array().cast("array<string>"))
            return F.when(rule.isNotNull(), F.struct(rule["severity"].alias("severity"), watched.alias("watched"), *[setting(rule["config"], n, v).alias(n) for n, v in DEFAULTS[kind].items()]))

        return let(F.try_element_at("rules", F.lit(kind)), of)

    return effective_rules(rules, projects).select("project_id", *[read(kind).alias(f"_{kind}") for kind in KINDS])


def _label(title: Column, number: Column, file: Column, key: Column) -> Column:
    said = [F.when(c != "", c) for c in (title, number, file)]
    return F.coalesce(*said, F.concat(F.lit("Contract "), key.cast("string")))


def _text(*parts) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in (x if isinstance(x, Column) else str(x) for x in parts)])


def _days(n: Column) -> Column:
    return n.cast("string")


def _draft(holds: Column, kind: str, severity: Column, title: Column, message: Column, key: Column, due: Column | None = None, details: Column | None = None) -> Column:
    made = F.struct(F.lit(kind).alias("alert_type"), severity.alias("severity"), title.alias("title"), message.alias("message"), key.alias("dedupe_key"), (due if due is not None else F.lit(None).cast("date")).alias("due_date"), (F.to_json(details) if details is not None else F.lit(None).cast("string")).alias("details"))
    return F.when(holds, made).cast(DRAFT)


def _under(kind: str, body) -> Column:
    """A draft under the rule of its kind, as thresholds has it; null without a rule."""
    rule = F.col(f"_{kind}")
    return F.when(rule.isNotNull(), body(rule))


def expiring(c: dict[str, Column], today: Column) -> Column:
    left, due = F.datediff(c["expiration_date"], today), c["expiration_date"]

    def body(r: Column) -> Column:
        severity = F.when(left <= r["critical_days"], at_least(r["severity"], "critical")).when(left <= r["escalate_days"], at_least(r["severity"], "high")).otherwise(r["severity"])
        title = F.when(left == 0, _text(c["label"], " expires today")).otherwise(_text(c["label"], " expires in ", _days(left), " days"))
        message = _text("The term ends on ", due.cast("string"), ". Decide whether to renew, renegotiate or let it lapse before then.")
        details = F.struct(left.alias("days_remaining"), due.cast("string").alias("expiration_date"), r["window_days"].alias("window_days"))
        return _draft((left >= 0) & (left <= r["window_days"]), "contract_expiring", severity, title, message, _text("expiring:", c["id"].cast("string"), ":", due.cast("string")), due, details)

    return _under("contract_expiring", body)


def auto_renewal(c: dict[str, Column], today: Column) -> Column:
    def body(r: Column) -> Column:
        derived = c["notice_deadline"].isNull()
        due = F.coalesce(c["notice_deadline"], F.date_sub(c["expiration_date"], F.coalesce(c["auto_renewal_notice_days"], r["lead_days"])))
        left = F.datediff(due, today)
        severity = F.when(left <= r["critical_days"], at_least(r["severity"], "critical")).otherwise(r["severity"])
        why = F.when(derived, " That date is calculated from the expiry date and the notice period, because no explicit notice deadline was extracted.").otherwise("")
        message = _text("This contract renews automatically. Notice must be served within ", _days(left), " days (", due.cast("string"), ") to stop it.", why)
        details = F.struct(left.alias("days_remaining"), due.cast("string").alias("notice_deadline"), derived.alias("derived_deadline"))
        return _draft(c["auto_renewal"] & (left >= 0) & (left <= r["lead_days"]), "auto_renewal_notice", severity, _text(c["label"], " auto-renews unless notice is given by ", due.cast("string")), message, _text("renewal:", c["id"].cast("string"), ":", due.cast("string")), due, details)

    return _under("auto_renewal_notice", body)


def high_risk(c: dict[str, Column], today: Column) -> Column:
    def body(r: Column) -> Column:
        score = c["risk_score"]
        severity = F.when(score >= r["critical_score"], at_least(r["severity"], "critical")).otherwise(r["severity"])
        message = _text("The overall risk score is ", _days(score), ", at or above the ", _days(r["risk_score_cutoff"]), " threshold for this project. ", _days(F.coalesce(c["n_risk_factors"], F.lit(0))), " risk factors were identified.")
        details = F.struct(score.alias("risk_score"), r["risk_score_cutoff"].alias("cutoff"))
        return _draft(score >= r["risk_score_cutoff"], "high_risk", severity, _text(c["label"], " scored ", _days(score), " for risk"), message, _text("high_risk:", c["id"].cast("string")), None, details)

    return _under("high_risk", body)


def missing_clause(c: dict[str, Column], today: Column) -> Column:
    def body(r: Column) -> Column:
        watched = r["watched"]
        every = F.coalesce(c["missing_mandatory_clauses"], F.array().cast("array<string>"))
        low = F.transform(watched, lambda w: F.lower(w))
        missing = F.sort_array(F.when(F.size(watched) > 0, F.filter(every, lambda m: F.array_contains(low, F.lower(m)))).otherwise(every))
        said = _text("These clause types are required by the document profile but were not found: ", F.array_join(F.transform(missing, lambda m: F.replace(m, F.lit("_"), F.lit(" "))), ", "), ".")
        details = F.struct(missing.alias("missing_clauses"), F.size(missing).alias("missing_count"))
        title = _text(c["label"], " is missing ", _days(F.size(missing)), " mandatory clauses")
        return _draft(F.size(missing) >= F.greatest(F.lit(1), r["min_missing"]), "missing_mandatory_clause", r["severity"], title, said, _text("missing_clause:", c["id"].cast("string")), None, details)

    return _under("missing_mandatory_clause", body)


def review_required(c: dict[str, Column], today: Column) -> Column:
    def body(r: Column) -> Column:
        flagged = F.coalesce(c["needs_review"], F.lit(False)) | (c["status"] == "needs_review")
        waiting = F.coalesce(c["pending_clauses"], F.lit(0))
        reason = F.when(waiting > 0, _text(_days(waiting), " clauses are waiting on a reviewer")).otherwise("extraction confidence fell below the profile's threshold")
        details = F.struct(waiting.alias("pending_clauses"), flagged.alias("contract_flagged"))
        return _draft(flagged | (waiting >= F.greatest(F.lit(1), r["min_items"])), "review_required", r["severity"], _text(c["label"], " needs review"), _text("This contract was flagged for human review: ", reason, "."), _text("review_required:", c["id"].cast("string")), None, details)

    return _under("review_required", body)


def obligation_due(o: dict[str, Column], today: Column) -> Column:
    left = F.datediff(o["due_date"], today)

    def body(r: Column) -> Column:
        action = F.coalesce(F.when(o["action"] != "", o["action"]), F.lit("An obligation"))
        short = F.when(F.length(action) <= 90, action).otherwise(_text(F.substring(action, 1, 87), "..."))
        title = F.when(left < 0, _text("Obligation ", _days(F.abs(left)), " days overdue: ", short)).otherwise(_text("Obligation due in ", _days(left), " days: ", short))
        owed = F.coalesce(F.when(o["responsible_party"] != "", _text(", owed by ", o["responsible_party"])), F.lit(""))
        message = _text(action, "\n\nDue ", o["due_date"].cast("string"), owed, ". Contract: ", o["label"], ".")
        severity = F.when(left < 0, at_least(r["severity"], "high")).otherwise(r["severity"])
        details = F.struct(left.alias("days_remaining"), (left < 0).alias("overdue"), o["id"].alias("obligation_id"))
        holds = o["status"].isin(OPEN_OBLIGATIONS) & (left <= r["window_days"]) & (left >= -r["overdue_days"])
        return _draft(holds, "obligation_due", severity, title, message, _text("obligation:", o["id"].cast("string"), ":", o["due_date"].cast("string")), o["due_date"], details)

    return _under("obligation_due", body)


def collect(contracts: DataFrame, metadata: DataFrame, obligations: DataFrame, pending: DataFrame, rules: DataFrame, today: Column) -> DataFrame:
    """(project_id, contract_id, alert_type, severity, title, message, dedupe_key, due_date, details): the conditions that hold today.

    contracts: (id, project_id, title, contract_number, original_file_name, status, needs_review, deleted_at);
    metadata: (contract_id, expiration_date, auto_renewal, notice_deadline, auto_renewal_notice_days,
    risk_score, n_risk_factors, missing_mandatory_clauses), by a left join, as a contract without it may
    still need review; obligations: (id, contract_id, project_id, due_date, status, action,
    responsible_party); pending: (contract_id, pending_clauses). Deleted contracts raise nothing, archived
    and failed ones only through their obligations.
    """
    live = contracts.where("deleted_at IS NULL").withColumn("label", _label(F.col("title"), F.col("contract_number"), F.col("original_file_name"), F.col("id")))
    ruled = _small(thresholds(rules, contracts))
    # rules come last, as no shuffle or sort need carry them
    rows = live.where(~F.col("status").isin(SKIPPED)).join(metadata.withColumnRenamed("contract_id", "id").withColumn("_described", F.lit(True)), "id", "left").join(pending.withColumnRenamed("contract_id", "id"), "id", "left").join(ruled, "project_id")
    c = {n: F.col(n) for n in rows.columns} | {"auto_renewal": F.coalesce("auto_renewal", F.lit(False))}
    made = [F.when(F.col("_described"), f(c, today)) for f in (expiring, auto_renewal, high_risk, missing_clause)] + [review_required(c, today)]
    hits = F.filter(F.array(*made), lambda x: x.isNotNull())
    of_contracts = rows.select("project_id", F.col("id").alias("contract_id"), F.inline(hits))
    # what no rule's window holds goes before it is joined
    widest = ruled.agg(F.max("_obligation_due.window_days"), F.max("_obligation_due.overdue_days")).first()
    left = F.datediff("due_date", today)
    due = obligations.where(F.col("status").isin(OPEN_OBLIGATIONS) & (left <= F.lit(widest[0]).cast("int")) & (left >= -F.lit(widest[1]).cast("int")))
    owed = due.join(live.select(F.col("id").alias("contract_id"), "label"), "contract_id").join(ruled, "project_id")
    o = {n: F.col(n) for n in owed.columns}
    of_obligations = owed.select("project_id", "contract_id", F.inline(F.filter(F.array(obligation_due(o, today)), lambda x: x.isNotNull())))
    return of_contracts.unionByName(of_obligations)


def sweep(alerts: DataFrame, drafts: DataFrame, rules: DataFrame, now: Column) -> DataFrame:
    """(dedupe_key, action, escalated, severity, status, title, due_date) of every live alert and every draft.

    alerts: (dedupe_key, project_id, alert_type, severity, status, title, message, due_date, created_at,
    escalated_at). A draft without an alert is raised; an alert with its draft is refreshed where severity,
    title, message or date changed, else kept, with an earlier escalation on top of the rule's severity; one
    without a draft is retired, or held where no enabled rule governs it. An open alert of the rule's age
    goes up a step once. Status stays the operator's.
    """
    digest = F.unhex(F.sha2("message", 256))  # messages are only compared
    a = alerts.where(F.col("status").isin(LIVE) & F.col("alert_type").isin(KINDS)).select("dedupe_key", "project_id", "alert_type", "status", "created_at", "escalated_at", *[F.col(x).alias(f"_{x}") for x in ("severity", "title", "due_date")], digest.alias("_message"))
    on = rules.where(F.col("is_enabled") & F.col("alert_type").isin(KINDS))
    own = on.where("project_id IS NOT NULL").groupBy("project_id", "alert_type").agg(F.max("escalate_after_days").alias("_after"), F.lit(True).alias("_own"))
    # at most one row a kind
    base = {r.alert_type: r.escalate_after_days for r in on.where("project_id IS NULL").collect()}
    any_project = F.col("project_id").isNotNull() & F.col("alert_type").isin(list(base))
    base_after = F.lit(None).cast("int")
    for kind, days in base.items():
        base_after = F.when(F.col("alert_type") == kind, F.lit(days).cast("int")).otherwise(base_after)
    a = a.join(_small(own), ["project_id", "alert_type"], "left").withColumns({"_governed": F.col("_own").isNotNull() | any_project, "_after": F.when(F.col("_own"), F.col("_after")).when(any_project, base_after)}).drop("_own", "project_id", "alert_type")
    b = drafts.select("dedupe_key", "severity", F.substring("title", 1, _ALERT_TITLE).alias("title"), digest.alias("message"), "due_date", F.lit(True).alias("_holds"))
    rows = a.join(b, "dedupe_key", "full")
    held, known = F.col("_holds").isNotNull(), F.col("status").isNotNull()
    severity = F.when(F.col("escalated_at").isNotNull(), promoted(F.col("severity"))).otherwise(F.col("severity"))
    changed = ~(severity.eqNullSafe(F.col("_severity")) & F.col("title").eqNullSafe(F.col("_title")) & F.col("message").eqNullSafe(F.col("_message")) & F.col("due_date").eqNullSafe(F.col("_due_date")))
    age = F.floor((F.unix_micros(now) - F.unix_micros("created_at")) / 86_400_000_000)
    after = F.col("_after")
    due = F.coalesce(known & held & (F.col("status") == "open") & F.col("escalated_at").isNull() & (after > 0) & (age >= after), F.lit(False))
    action = F.when(~known, "raise").when(~held, F.when(F.col("_governed"), "retire").otherwise("hold")).when(changed, "refresh").otherwise("keep")
    final = F.when(~known, F.col("severity")).when(~held, F.col("_severity")).when(due, promoted(severity)).otherwise(severity)
    status = F.when(~known, "open").when(action == "retire", "resolved").otherwise(F.col("status"))
    return rows.select("dedupe_key", action.alias("action"), due.alias("escalated"), final.alias("severity"), status.alias("status"), F.coalesce("title", "_title").alias("title"), F.when(held, F.col("due_date")).otherwise(F.col("_due_date")).alias("due_date"))
