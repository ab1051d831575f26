"""Risk findings from clause attributes, their merge with a model's, the score, and what asks for a reviewer."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.functions import text as tx

#: Carve-outs that make exposure unlimited; days and multiples from which terms are tight.
MATERIAL_CARVE_OUTS = ["ip_infringement", "confidentiality_breach", "gross_negligence", "wilful_misconduct", "data_protection_breach", "indemnification_obligations", "breach_of_law"]
TIGHT_NOTICE, TIGHT_PAYMENT, SHORT_CURE, LOW_MULTIPLE, LONG_MONTHS = 30, 15, 15, 1.0, 24
LIABILITY, REVIEW_CONFIDENCE = "limitation_of_liability", 0.85


def attribute(name: str, column: str = "attributes") -> Column:
    """A clause attribute as its JSON text; null where it is absent or null."""
    return F.get_json_object(F.col(column), f"$.{name}")


def _number(value: Column) -> Column:
    return value.try_cast("double")


def _is(value: Column, *values: str) -> Column:
    return F.coalesce(value.isin(list(values)), F.lit(False))


def _true(value: Column) -> Column:
    """The JSON literal true, or anything else that isn't empty, none or false."""
    return F.coalesce(~value.isin("false", "0", "", "[]", "{}"), F.lit(False))


def _list(value: Column) -> Column:
    return F.coalesce(F.from_json(value, "array<string>"), F.array().cast("array<string>"))


def _no(condition: Column) -> Column:
    return ~F.coalesce(condition, F.lit(False))


def clause_rules(at: Callable[[str], Column] = attribute) -> list[tuple[str, str, Column | str, Column, bool]]:
    """(clause type, risk type, severity, condition, whether a profile's weight replaces the severity), by at, the text of an attribute; a null condition doesn't fire."""
    carved = F.filter(_list(at("carve_outs")), lambda x: x.isin(MATERIAL_CARVE_OUTS))
    n_carved, basis = F.size(carved), at("cap_basis")
    tight = F.when(_number(at("renewal_notice_days")) < TIGHT_NOTICE, "high").otherwise("medium")
    against_us = _is(at("terminating_side"), "counterparty") | _is(at("can_we_terminate"), "neither")
    convenience, cause, notice = "termination_for_convenience", "termination_for_cause", _number(at("notice_days"))
    return [
        (LIABILITY, "unlimited_liability", "critical", basis == "uncapped", True),
        (LIABILITY, "missing_liability_cap", "high", basis == "not_specified", True),
        (LIABILITY, "unlimited_liability", F.when(n_carved >= 3, "critical").otherwise("high"), n_carved > 0, False),
        (LIABILITY, "unlimited_liability", "medium", _true(at("has_carve_outs")) & (F.size(_list(at("carve_outs"))) == 0), False),
        (LIABILITY, "other", "low", (_number(at("cap_multiple")) <= LOW_MULTIPLE) & _no(basis == "uncapped"), False),
        (LIABILITY, "other", "medium", at("is_mutual") == "false", False),
        ("indemnification", "uncapped_indemnity", "critical", at("is_capped") == "false", True),
        ("indemnification", "other", "high", at("posture") == "one_sided_against_us", False),
        ("auto_renewal", "auto_renewal", tight, _true(at("auto_renews")), True),
        ("payment_terms", "short_payment_terms", "medium", (_number(at("payment_days")) > 0) & (_number(at("payment_days")) <= TIGHT_PAYMENT), True),
        ("payment_terms", "late_payment_penalty", "low", _number(at("late_fee_percent")) > 0, True),
        (convenience, "unilateral_termination", "high", _no(at("is_permitted") == "false") & against_us, True),
        (convenience, "broad_termination_rights", "medium", (notice <= TIGHT_NOTICE) & _is(at("terminating_side"), "counterparty", "both"), True),
        (cause, "broad_termination_rights", "high", at("is_curable") == "false", False),
        (cause, "broad_termination_rights", "medium", (_number(at("cure_period_days")) > 0) & (_number(at("cure_period_days")) < SHORT_CURE), False),
        ("intellectual_property", "ip_assignment_risk", "critical", _is(at("we_retain_pre_existing_ip"), "counterparty", "neither"), True),
        ("intellectual_property", "ip_assignment_risk", "high", _is(at("work_product_owner_side"), "counterparty"), False),
        ("governing_law", "unfavourable_governing_law", "medium", ~_true(at("governing_law")) & ~_true(at("country")), False),
        ("exclusivity", "exclusivity", "high", _is(at("bound_side"), "our_organisation", "both"), True),
        ("assignment", "change_of_control", "medium", _true(at("consent_required_on_change_of_control")) | _true(at("change_of_control_permits_termination")), True),
        ("audit_rights", "no_audit_rights", "low", at("has_audit_rights") == "false", True),
        ("audit_rights", "other", "medium", notice <= 0, False),
        ("force_majeure", "other", "high", at("excuses_payment") == "true", False),
        ("force_majeure", "other", "low", at("covers_pandemic") == "false", False),
        ("non_solicitation", "non_compete_breadth", "medium", (_number(at("duration_months")) > LONG_MONTHS) & _no(at("bound_side") == "counterparty"), True),
    ]


def clause_findings(clauses: DataFrame, weights: dict[str, str] | None = None) -> DataFrame:
    """Clauses (clause_type, attributes as JSON) with risk_type and severity, a row for each rule that fires; weights: severities of a profile by risk type."""
    read: dict[str, str] = {}
    fired: dict[str, list[Column]] = {}
    for kind, risk, severity, condition, weighted in clause_rules(lambda name: F.col(read.setdefault(name, f"_a{len(read)}"))):
        level = (weights or {}).get(risk) if weighted else None
        named = F.lit(level or severity) if isinstance(severity, str) or level else severity
        fired.setdefault(kind, []).append(F.when(condition, F.struct(F.lit(risk).alias("risk_type"), named.alias("severity"))))
    # a clause meets the rules of its own type alone
    of = F.coalesce(*[F.when(F.col("clause_type") == kind, F.array(*found)) for kind, found in fired.items()])
    told = clauses.select("*", F.json_tuple("attributes", *read).alias(*read.values()))  # the JSON is read once, not once a rule
    return told.select(*clauses.columns, F.inline(F.filter(of, lambda x: x.isNotNull())))


def omissions(contracts: DataFrame, clauses: DataFrame, mandatory: list[str], weights: dict[str, str] | None = None) -> DataFrame:
    """(contract_id, clause_type, risk_type, severity) for each mandatory clause that a contract has not."""
    found = clauses.where(F.col("clause_type").isin(mandatory)).groupBy("contract_id").agg(F.collect_set("clause_type").alias("_found"))
    none = F.array().cast("array<string>")
    absent = F.array_except(F.array(*map(F.lit, mandatory)) if mandatory else none, F.coalesce("_found", none))
    rows = contracts.select("contract_id").join(found, "contract_id", "left").select("contract_id", F.explode(absent).alias("clause_type"))
    risk = F.when(F.col("clause_type") == LIABILITY, "missing_liability_cap").otherwise("missing_mandatory_clause")
    severity = reduce(lambda out, w: F.when(F.col("risk_type") == w[0], w[1]).otherwise(out), (weights or {}).items(), F.lit("high"))
    return rows.withColumn("risk_type", risk).withColumn("severity", severity)


def merged_findings(rules: DataFrame, model: DataFrame) -> DataFrame:
    """Findings (contract_id, risk_type, clause_type, severity) of the rules, and a model's of which none has the same risk and clause; of equal ones of the model the most severe."""
    keys = ["contract_id", "risk_type", "clause_type"]
    cols = [*keys, "severity"]
    # the rules' findings are worked out once: both meet in one grouping, the rules' before the model's
    both = rules.select(*cols, F.lit("rule").alias("origin")).unionByName(model.select(*cols, F.lit("model").alias("origin")))
    w = Window.partitionBy(*keys).orderBy(F.desc("origin"), tx.severity_weight(F.col("severity")).desc())
    return both.withColumn("_r", F.row_number().over(w)).where("origin = 'rule' OR _r = 1").drop("_r")


def assessments(findings: DataFrame, low_max: int = tx.LOW_MAX, medium_max: int = tx.MEDIUM_MAX) -> DataFrame:
    """(contract_id, findings, risk_score, band) of findings (contract_id, severity)."""
    rows = findings.groupBy("contract_id").agg(F.count("*").alias("findings"), tx.risk_score(F.collect_list("severity"), low_max, medium_max).alias("risk_score"))
    return rows.withColumn("band", F.when(F.col("risk_score") > medium_max, "high").when(F.col("risk_score") > low_max, "medium").otherwise("low"))


def unlimited_liability(clauses: DataFrame) -> DataFrame:
    """(contract_id, has_unlimited_liability): a liability clause without a cap or with a material carve-out."""
    hit = (F.col("clause_type") == LIABILITY) & (_is(attribute("cap_basis"), "uncapped") | F.arrays_overlap(_list(attribute("carve_outs")), F.array(*map(F.lit, MATERIAL_CARVE_OUTS))))
    return clauses.groupBy("contract_id").agg(F.bool_or(F.coalesce(hit, F.lit(False))).alias("has_unlimited_liability"))


def review_triggers(low: Column, missing: Column, critical: Column, failed: Column, conflicting: Column, corrected: Column, off: list[str] | None = None) -> Column:
    """Names of the triggers whose count is above zero, those that a profile turned off left out (corrections can't be)."""
    parts = [("low_confidence", low), ("missing_mandatory_clause", missing), ("high_risk_clause", critical), ("validation_failure", failed), ("conflicting_dates", conflicting), ("auto_corrected", corrected)]
    live = [(n, c) for n, c in parts if n == "auto_corrected" or n not in (off or [])]
    return F.filter(F.array(*[F.when(c > 0, n) for n, c in live]), lambda x: x.isNotNull())
