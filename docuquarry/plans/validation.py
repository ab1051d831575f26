"""Checks of extracted attributes by the convention of their names and across fields, each an issue or nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docuquarry.functions.text import party_name, strict_date

#: Months beyond which a duration is implausible, hints of names, and multiples that a basis implies.
MOST_MONTHS, MONTHS_OF = 1_200, {"_days": 1 / 30, "_months": 1.0, "_years": 12.0, "_hours": 0.0}
AMOUNT_HINTS, DATE_HINTS = ("amount", "value", "fee", "price", "penalty", "premium"), ("date", "deadline")
IMPLIED_MULTIPLE = {"one_x_fees_paid": 1.0, "two_x_fees_paid": 2.0}
_ISSUE = "struct<code:string,field:string,severity:string>"


def issue(condition: Column, code: str, field: str, severity: str = "error") -> Column:
    """The issue where the condition holds; a null condition is none."""
    return F.when(condition, F.struct(F.lit(code).alias("code"), F.lit(field).alias("field"), F.lit(severity).alias("severity")))


def issues(*checks: Column) -> Column:
    return F.filter(F.array(*checks), lambda x: x.isNotNull()) if checks else F.array().cast(f"array<{_ISSUE}>")


def attribute_checks(kinds: dict[str, str], max_value: float | None = None, column=F.col) -> list[Column]:
    """Checks of attributes (name: number or string) by name: durations, amounts with a currency, currency codes, dates."""
    out = []
    currencies = [n for n, k in kinds.items() if "currency" in n and k == "string"]
    for name, kind in kinds.items():
        value = column(name)
        if kind == "number":
            for suffix, months in MONTHS_OF.items():
                if name.endswith(suffix):
                    out += [issue(value < 0, "negative_duration", name), issue(value * months > MOST_MONTHS, "implausible_duration", name, "warning")]
                    break
            if any(h in name for h in AMOUNT_HINTS):
                stated = F.lit(False)
                for c in currencies:
                    stated = stated | (F.trim(F.coalesce(column(c), F.lit(""))) != "")
                out += [issue(value < 0, "negative_amount", name), issue(value.isNotNull() & ~stated, "amount_without_currency", name, "warning")]
                if max_value:
                    out.append(issue(value > max_value, "implausible_amount", name, "warning"))
        else:
            if "currency" in name:
                out.append(issue(~F.trim(value).rlike(r"^\p{L}{3}$"), "invalid_currency_code", name, "warning"))
            if any(h in name for h in DATE_HINTS) and not name.endswith("_expression"):
                out.append(issue((F.trim(value) != "") & strict_date(F.trim(value)).isNull(), "invalid_date", name, "warning"))
    return out


def cap_checks(basis: Column, multiple: Column, amount: Column, period_months: Column) -> list[Column]:
    """Whether a liability cap's basis and its numbers agree."""
    implied = F.lit(None).cast("double")
    for name, x in IMPLIED_MULTIPLE.items():
        implied = F.when(basis == name, x).otherwise(implied)
    some = multiple.isNotNull() | amount.isNotNull()
    return [
        issue(multiple != implied, "cap_multiple_conflicts_with_basis", "cap_multiple"),
        issue((basis == "other_multiple_of_fees") & multiple.isNull(), "cap_multiple_required", "cap_multiple"),
        issue((basis == "fixed_amount") & amount.isNull(), "cap_amount_required", "cap_amount"),
        issue((basis == "uncapped") & some, "uncapped_with_cap_value", "cap_basis"),
        issue((basis.isNull() | (basis == "not_specified")) & some, "cap_value_without_basis", "cap_basis"),
        issue((basis == "fees_paid_in_period") & period_months.isNull(), "cap_period_missing", "cap_reference_period_months", "warning"),
    ]


def cap_multiple(basis: Column, multiple: Column) -> Column:
    """The multiple, filled in where the basis implies it."""
    out = multiple
    for name, x in IMPLIED_MULTIPLE.items():
        out = F.when(multiple.isNull() & (basis == name), x).otherwise(out)
    return out


def indemnity_checks(posture: Column, is_mutual: Column) -> list[Column]:
    one_sided = posture.isin("one_sided_in_our_favour", "one_sided_against_us")
    return [issue(is_mutual & one_sided, "indemnity_posture_conflict", "posture"), issue(~is_mutual & (posture == "mutual"), "indemnity_posture_conflict", "is_mutual")]


def termination_checks(notice_days: Column, cure_days: Column, is_curable: Column) -> list[Column]:
    return [
        issue((cure_days > notice_days) & (notice_days != 0), "cure_exceeds_notice", "cure_period_days", "warning"),
        issue(~is_curable & (cure_days > 0), "cure_period_contradicts_incurable", "is_curable", "warning"),
    ]


def date_order_checks(effective: Column, expiration: Column, execution: Column | None = None) -> list[Column]:
    out = [issue(effective > expiration, "effective_after_expiration", "effective_date")]
    return out if execution is None else [*out, issue(execution > effective, "execution_after_effective", "execution_date", "warning")]


def confidence(value: Column) -> Column:
    """(confidence, issue): a number clamped to 0..1, 0 where it is none."""
    x = value.try_cast("double")
    code = F.when(x.isNull() | F.isnan(x), "invalid_confidence").when((x < 0) | (x > 1), "confidence_out_of_range")
    return F.struct(F.when(x.isNull() | F.isnan(x), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(x, F.lit(1.0)))).alias("confidence"), code.alias("issue"))


def party_side(name: Column, aliases: list[str], ours: Column | None = None) -> Column:
    """our_organisation where the folded name holds an alias or the other way round, else as ours (a known party's flag) says, else unknown."""
    needle = party_name(name)
    by_alias = F.lit(False)
    for alias in aliases:
        folded = party_name(F.lit(alias))
        by_alias = by_alias | ((folded != "") & (F.contains(needle, folded) | F.contains(folded, needle)))
    known = F.when(ours, "our_organisation").when(~ours, "counterparty") if ours is not None else F.lit(None).cast("string")
    return F.when(needle == "", "unknown").when(by_alias, "our_organisation").otherwise(F.coalesce(known, F.lit("unknown")))


def stated_side(stated: Column, resolved: Column) -> Column:
    """The side to keep: what the name resolves to, unless that is unknown."""
    return F.when(resolved != "unknown", resolved).otherwise(stated)


def passed_share(run: Column, failed: Column) -> Column:
    """Share of the checks passed to four places; 1 without checks."""
    return F.when(run == 0, 1.0).otherwise(F.bround((run - failed) / run, 4))


def enum_or(value: Column, known: list[str], fallback: str | None = None) -> Column:
    folded = F.lower(F.trim(value))
    return F.when(folded.isin(known), folded).otherwise(fallback)


def number_or_null(value: Column) -> Column:
    return F.try_to_number(F.regexp_replace(value, r"[,\s]", ""), F.lit("S999999999999999.999999")).cast("double")


def currency_or_null(value: Column) -> Column:
    code = F.upper(F.trim(value))
    return F.when(code.rlike(r"^[A-Z]{3}$"), code)
