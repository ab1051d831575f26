"""Registers over the facts of many contracts: obligations, dates, risks, clause tabs, memberships, jobs and change logs.

Every function takes frames with the columns that its docstring names; further columns are left alone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.operators import predicates as p
from docuquarry.operators.relational import listed
from docuquarry.plans.rules import SEVERITIES, severity_rank

#: States of contracts that registers don't show, of jobs that have ended, and keys that logs don't keep or note.
HIDDEN_STATES, ENDED_JOBS = ["archived", "failed"], ["ready", "failed", "cancelled"]
SECRET_MARKERS, NOISE_FIELDS, MOST_CHARS = ["password", "secret", "token", "api_key"], ["updated_at", "created_at", "last_accessed_at", "heartbeat_at"], 2_000


def live_contracts(contracts: DataFrame, project_ids: list) -> DataFrame:
    """Contracts of these projects that are neither deleted nor archived nor failed."""
    return p.scoped(contracts, project_ids).where(~F.col("status").isin(HIDDEN_STATES))


def _with_title(rows: DataFrame, contracts: DataFrame) -> DataFrame:
    return rows.join(contracts.select("contract_id", "title"), "contract_id")


def obligation_register(obligations: DataFrame, contracts: DataFrame, statuses: list | None = None, party: str | None = None, due_from=None, due_to=None, undated: bool | None = None, q: str | None = None) -> DataFrame:
    """Obligations (contract_id, status, responsible_party, due_date, action, due_description, trigger_event, created_at) of these contracts, with title; the soonest first, undated ones last."""
    wanted = [p.one_of("status", statuses), p.contains_text(party, "responsible_party"), p.between("due_date", due_from, due_to), p.is_missing("due_date", undated), p.contains_text(q, "action", "due_description", "trigger_event")]
    return _with_title(obligations.where(p.all_of(wanted)), contracts).orderBy(F.asc_nulls_last("due_date"), F.desc("created_at"))


def key_date_register(dates: DataFrame, contracts: DataFrame, types: list | None = None, date_from=None, date_to=None, unresolved: bool | None = None) -> DataFrame:
    """Key dates (contract_id, date_type, date_value) with title; the earliest first, unresolved ones last."""
    wanted = [p.one_of("date_type", types), p.between("date_value", date_from, date_to), p.is_missing("date_value", unresolved)]
    return _with_title(dates.where(p.all_of(wanted)), contracts).orderBy(F.asc_nulls_last("date_value"), "date_type")


def risk_register(risks: DataFrame, contracts: DataFrame, metadata: DataFrame, severities: list | None = None, risk_type: str | None = None, category: str | None = None, omissions: bool | None = None, q: str | None = None) -> DataFrame:
    """Risks (contract_id, severity, risk_type, category, is_omission, score_contribution, description, recommendation, created_at) with title and the contract's risk_score, if it has one; the most severe first."""
    wanted = [p.one_of("severity", severities), p.flag("is_omission", omissions), p.contains_text(q, "description", "recommendation")]
    wanted += [F.col(c) == v for c, v in (("risk_type", risk_type), ("category", category)) if v]
    rows = _with_title(risks.where(p.all_of(wanted)), contracts).join(metadata.select("contract_id", "risk_score"), "contract_id", "left")
    return rows.orderBy(severity_rank(F.col("severity")).desc(), F.desc_nulls_last("score_contribution"), F.desc("created_at"))


def numbered_page(df: DataFrame, order: list[Column], page: int, size: int) -> DataFrame:
    """One page (from 1) with the total of all rows beside each; order must be total for pages to agree."""
    total = df.count()
    return df.orderBy(*order).offset((page - 1) * size).limit(size).withColumn("total", F.lit(total).cast("long"))


def clause_tabs(categories: DataFrame, clauses: DataFrame) -> DataFrame:
    """(key, name, priority, clauses, missing): a tab for each active category (key, name, priority, is_active) by priority, with the number of its clauses (clause_type)."""
    found = clauses.groupBy(F.col("clause_type").alias("key")).agg(F.count("*").alias("_n"))
    tabs = categories.where("is_active").join(found, "key", "left").withColumn("clauses", F.coalesce("_n", F.lit(0)))
    return tabs.select("key", "name", "priority", "clauses", (F.col("clauses") == 0).alias("missing")).orderBy("priority", "key")


def accessible_projects(projects: DataFrame, members: DataFrame, user_id, is_admin: bool = False, q: str | None = None, status: str | None = None, favourites: bool = False) -> DataFrame:
    """Projects (project_id, name, status) that a user may see: those with a membership (project_id, user_id, is_favourite), all for an admin."""
    mine = members.where(F.col("user_id") == user_id)
    rows = projects.where(p.all_of([p.contains_text(q, "name"), F.col("status") == status if status else None]))
    if favourites:
        return rows.join(mine.where("is_favourite"), "project_id", "left_semi")
    return rows if is_admin else rows.join(mine, "project_id", "left_semi")


def members_with_permission(users: DataFrame, members: DataFrame, roles: DataFrame, project_id, permission: str) -> DataFrame:
    """Users (user_id) who are members (project_id, user_id, role) of a project in a role (role, permissions) with the permission."""
    able = members.where(F.col("project_id") == project_id).join(roles.where(F.array_contains("permissions", permission)), "role", "left_semi")
    return users.join(able, "user_id", "left_semi")


def search_users(users: DataFrame, q: str | None = None, is_active: bool | None = None, members: DataFrame | None = None, role: str | None = None) -> DataFrame:
    """Users (user_id, name, email, title, is_active) by text and state, and by a role held anywhere; a semi join, so none comes twice."""
    rows = users.where(p.all_of([p.contains_text(q, "name", "email", "title"), p.flag("is_active", is_active)]))
    return rows.join(members.where(F.col("role") == role), "user_id", "left_semi") if role and members is not None else rows


def filter_jobs(jobs: DataFrame, states: list | None = None, stage: str | None = None, contract_id=None, failed_only: bool = False) -> DataFrame:
    """Jobs (state, stage, contract_id); failed_only overrides the states."""
    wanted = [p.one_of("state", ["failed"] if failed_only else states), F.col("stage") == stage if stage else None, F.col("contract_id") == contract_id if contract_id is not None else None]
    return jobs.where(p.all_of(wanted))


def in_flight(jobs: DataFrame) -> DataFrame:
    """(in_flight): jobs whose state isn't an end."""
    return jobs.agg(F.count_if(~F.col("state").isin(ENDED_JOBS)).alias("in_flight"))


def active_job(jobs: DataFrame, order: list[Column]) -> DataFrame:
    """The newest unended job of each contract."""
    w = Window.partitionBy("contract_id").orderBy(*order)
    return jobs.where(~F.col("state").isin(ENDED_JOBS)).withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def latest_checkpoint(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key's succeeded runs (status, finished_at, attempt) the one that finished last, then of the highest attempt."""
    w = Window.partitionBy(*keys).orderBy(F.desc_nulls_last("finished_at"), F.desc("attempt"))
    return runs.where("status = 'succeeded'").withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def highest_attempts(runs: DataFrame, keys: list[str]) -> DataFrame:
    """Of each key the status of the highest attempt: not the same as the latest checkpoint, as attempts restart with each job."""
    return runs.groupBy(*keys).agg(F.max("attempt").alias("attempt"), F.max_by("status", F.struct("attempt", "finished_at")).alias("status"))


def hydrated(evidence: DataFrame, chunks: DataFrame, clauses: DataFrame) -> DataFrame:
    """Hits (level, ref_id, title) with the text and title of the chunk or clause (ref_id, text, title) that they name; a title that is there stays."""
    parts = [src.select(F.lit(level).alias("level"), "ref_id", F.col("text").alias("_text"), F.col("title").alias("_title")) for level, src in (("chunk", chunks), ("clause", clauses))]
    joined = evidence.join(parts[0].unionByName(parts[1]), ["level", "ref_id"], "left")
    return joined.select(*[c for c in evidence.columns if c != "title"], F.coalesce("title", "_title").alias("title"), F.col("_text").alias("text"))


def clauses_by_type(mapping: DataFrame, clauses: DataFrame, unmapped: bool = True) -> DataFrame:
    """(agreement_type, key, display_order, mapped): for each type of mapping (agreement_type, key, display_order) its clauses, and then every other of clauses (key)."""
    own = mapping.groupBy("agreement_type").agg(F.collect_set("key").alias("_own"))
    mapped = mapping.join(clauses.select("key"), "key", "left_semi").select("agreement_type", "key", "display_order", F.lit(True).alias("mapped"))
    if not unmapped:
        return mapped
    rest = own.select("agreement_type", F.explode(F.array_except(listed(clauses, "key"), "_own")).alias("key"), F.lit(None).cast("int").alias("display_order"), F.lit(False).alias("mapped"))
    return mapped.unionByName(rest)


def masked_clauses(clauses: DataFrame, masked_types: list[str], permitted: bool, mark: str = "[masked]") -> DataFrame:
    """Text and summary of these clause types replaced, unless permitted; attributes stay."""
    hide = F.lit(not permitted) & F.col("clause_type").isin(masked_types)
    return clauses.withColumns({c: F.when(hide, mark).otherwise(F.col(c)) for c in ("text", "summary")})


def grouped_counts(df: DataFrame, keys: list[str], **conditions: Column) -> DataFrame:
    """Rows of each key that meet each named condition."""
    return df.groupBy(*keys).agg(*[F.count_if(c).alias(name) for name, c in conditions.items()])


def knowledge_counts(children: dict[str, DataFrame]) -> DataFrame:
    """(contract_id, a count for each named child table), of contracts that have rows in any; one aggregation over their union."""
    rows = reduce(DataFrame.unionByName, [df.select("contract_id", F.lit(name).alias("_of")) for name, df in children.items()])
    return grouped_counts(rows, ["contract_id"], **{name: F.col("_of") == name for name in children})


def document_totals(clauses: DataFrame, contracts: DataFrame) -> DataFrame:
    """(documents, clauses, boxes, per_document): counts, the sum of the boxes' numbers, clauses a document to one place."""
    rows = contracts.select(F.lit(1).alias("d"), F.lit(0).alias("c"), F.lit(0).alias("b")).unionByName(clauses.select(F.lit(0).alias("d"), F.lit(1).alias("c"), F.coalesce(F.size("boxes"), F.lit(0)).alias("b")))
    totals = rows.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(name) for c, name in (("d", "documents"), ("c", "clauses"), ("b", "boxes"))])
    return totals.select("documents", "clauses", "boxes", F.round(F.col("clauses") / F.greatest("documents", F.lit(1)), 1).alias("per_document"))


def expected_clause_counts(profiles: DataFrame) -> DataFrame:
    """(agreement_type, expected): of profiles (agreement_type, mandatory, optional) the largest number of distinct clauses named."""
    none = F.array().cast("array<string>")
    named = F.size(F.array_union(F.coalesce("mandatory", none), F.coalesce("optional", none)))
    return profiles.groupBy("agreement_type").agg(F.max(named).alias("expected"))


def documents_by_type(contracts: DataFrame, expected: DataFrame) -> DataFrame:
    """(agreement_type, documents, expected), most first."""
    rows = contracts.groupBy("agreement_type").agg(F.count("*").alias("documents"))
    return rows.join(expected, "agreement_type", "left").orderBy(F.desc("documents"), "agreement_type")


def rejection_diagnostics(rejections: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rejected, reasons, dominant_rule) of rejections (reason, rule): rows, distinct reasons, and the rule of most rows, of equal ones the first by name."""
    per = rejections.groupBy(*keys, "rule").agg(F.count("*").alias("_n"), F.collect_set("reason").alias("_r"))
    best = F.min_by("rule", F.struct(-F.col("_n"), "rule"))
    return per.groupBy(*keys).agg(F.sum("_n").alias("rejected"), F.size(F.array_distinct(F.flatten(F.collect_list("_r")))).alias("reasons"), best.alias("dominant_rule"))


def document_position(number: Column) -> Column:
    """A clause number as integers to sort by; empty where it isn't one."""
    return F.when(number.rlike(r"^[0-9]+(\.[0-9]+)*\.?$"), F.transform(F.filter(F.split(number, r"\."), lambda x: x != ""), lambda x: x.cast("int"))).otherwise(F.array().cast("array<int>"))


def document_order(page: str, number: str, label: str) -> list[Column]:
    """Order of citations as they stand in the document: page (null last), clause number and label."""
    return [F.asc_nulls_last(page), document_position(F.coalesce(F.col(number), F.lit(""))).asc(), F.asc(label)]


def top_cases(df: DataFrame, score: str, tie: str, n: int = 20, worst: bool = True) -> DataFrame:
    """The n cases of the highest (or lowest) score, ties by name; null scores don't count."""
    return df.where(F.col(score).isNotNull()).orderBy(F.desc(score) if worst else F.asc(score), tie).limit(n)


def newest(df: DataFrame, project_ids: list, n: int = 20, tie: str = "id") -> DataFrame:
    """The n newest rows (project_id, created_at) of these projects."""
    return p.scoped(df, project_ids).orderBy(F.desc("created_at"), tie).limit(n)


def change_history(before: DataFrame, after: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, old_value, new_value): a row for each field that differs, values as text cut to MOST_CHARS."""
    old = before.select(key, *[F.col(f).alias(f"_{f}") for f in fields])
    cut = lambda c: F.substring(F.col(c).cast("string"), 1, MOST_CHARS)
    pairs = F.array(*[F.when(~F.col(f).eqNullSafe(F.col(f"_{f}")), F.struct(F.lit(f).alias("field_name"), cut(f"_{f}").alias("old_value"), cut(f).alias("new_value"))) for f in fields])
    return after.join(old, key).select(key, F.inline(F.filter(pairs, lambda x: x.isNotNull())))


def merged_metrics(old: Column, new: Column) -> Column:
    """Maps of numbers added key by key."""
    none = F.create_map().cast("map<string,double>")
    return F.map_zip_with(F.coalesce(old, none), F.coalesce(new, none), lambda _, a, b: F.coalesce(a + b, b, a))


def corrected(clauses: DataFrame, attributes: Column) -> DataFrame:
    """Clauses (attributes, original_attributes, review_status) with a reviewer's attributes laid over; the first original is kept."""
    done = attributes.isNotNull()
    whole = F.map_from_entries(F.concat(F.filter(F.map_entries("attributes"), lambda e: ~F.map_contains_key(attributes, e["key"])), F.map_entries(attributes)))
    return clauses.withColumns({
        "original_attributes": F.when(done, F.coalesce("original_attributes", "attributes")).otherwise(F.col("original_attributes")),
        "attributes": F.when(done, whole).otherwise(F.col("attributes")),
        "review_status": F.when(done, "corrected").otherwise(F.col("review_status")),
    })


def redacted(payload: Column) -> Column:
    """A map of text with secret keys masked and long values cut."""
    secret = lambda k: reduce(lambda a, b: a | b, [F.contains(F.lower(k), F.lit(m)) for m in SECRET_MARKERS])
    cut = lambda v: F.when(F.length(v) > MOST_CHARS, F.concat(F.substring(v, 1, MOST_CHARS), F.lit("... ["), F.length(v).cast("string"), F.lit(" chars]"))).otherwise(v)
    return F.transform_values(payload, lambda k, v: F.when(secret(k), "***redacted***").otherwise(cut(v)))


def changed_only(before: Column, after: Column) -> tuple[Column, Column]:
    """The entries of both maps that differ, redacted; noise fields left out."""
    none = F.create_map().cast("map<string,string>")
    a, b = F.coalesce(before, none), F.coalesce(after, none)
    pairs = F.filter(F.map_entries(F.map_zip_with(a, b, lambda _, x, y: F.struct(x.alias("x"), y.alias("y")))), lambda e: ~e["value"]["x"].eqNullSafe(e["value"]["y"]) & ~e["key"].isin(NOISE_FIELDS))
    side = lambda c: redacted(F.map_from_entries(F.transform(pairs, lambda e: F.struct(e["key"], e["value"][c]))))
    return side("x"), side("y")


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is among ids."""
    return rows.join(ids.select(key), key, "left_semi")


def child_list(rows: DataFrame, contract_id, project_id, types: tuple[str, list] | None = None, order: list[Column] | None = None) -> DataFrame:
    """A contract's rows (contract_id, project_id) of some types in a fixed order."""
    mine = rows.where((F.col("contract_id") == contract_id) & (F.col("project_id") == project_id)).where(p.all_of([p.one_of(*types)] if types else []))
    return mine.orderBy(*order) if order else mine


def alert_list(alerts: DataFrame, project_ids: list, statuses: list | None = None) -> DataFrame:
    """Alerts (project_id, status, due_date, created_at) of a scope, the earliest due first and undated ones last, newest first among equals."""
    return p.scoped(alerts, project_ids).where(p.all_of([p.one_of("status", statuses)])).orderBy(F.asc_nulls_last("due_date"), F.desc("created_at"))


def severity_counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """A column for each severity with the rows of each key that have it."""
    return grouped_counts(rows, keys, **{s: F.col("severity") == s for s in reversed(SEVERITIES)})
