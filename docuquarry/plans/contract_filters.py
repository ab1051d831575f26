"""The contract repository's filters: a specification compiled to predicates over contracts left-joined with their metadata."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuquarry.operators import predicates as p

#: Columns that free text and a party are looked for in; those of the contract itself come first.
SEARCHED = ["title", "original_file_name", "contract_number", "vendor", "customer", "party_a", "party_b", "summary"]
PARTIES = ["party_a", "party_b", "vendor", "customer"]


def _like(columns: list[str]) -> Callable[[Any], Column | None]:
    """Anywhere in any of the columns, in any case; % and _ are wildcards, null columns are empty."""

    def build(value: str) -> Column | None:
        return p.any_of(F.coalesce(F.col(c), F.lit("")).ilike(f"%{value.strip()}%") for c in columns) if value else None

    return build


def _within(column: str, ends: tuple[str, str], kind: type | None = None) -> Callable[[Any], Column | None]:
    """An inclusive range {low, high} with either end open; whole-number ranges cut their ends."""

    def build(value: dict) -> Column | None:
        unknown = set(value) - set(ends)
        if unknown:
            raise ValueError(f"{column} has no ends {sorted(unknown)}")
        low, high = (None if value.get(e) is None else kind(value[e]) if kind else value[e] for e in ends)
        return p.between(column, low, high)

    return build


def _equal(column: str, fold: Callable[[str], str] = lambda x: x) -> Callable[[Any], Column | None]:
    return lambda value: F.col(column) == F.lit(fold(value)) if value else None


def _flag(column: str) -> Callable[[Any], Column | None]:
    return lambda value: p.flag(column, value)


def _any_of(column: str) -> Callable[[Any], Column | None]:
    return lambda value: p.one_of(column, value)


_DATES, _NUMBERS = ("from_date", "to_date"), ("min", "max")
#: Every entry of a specification and how it is compiled; a null, an empty text and an empty list are no filter.
ENTRIES: dict[str, Callable[[Any], Column | None]] = {
    "search": _like(SEARCHED), "party": _like(PARTIES), "status": _any_of("status"), "agreement_type": _any_of("agreement_type"), "file_type": _equal("file_type"),
    "contract_number": lambda v: p.same_folded("contract_number", v) if v and v.strip() else (F.coalesce("contract_number", F.lit("")) == "" if v else None),
    "needs_review": _flag("needs_review"), "uploaded_by": lambda v: None if not v else F.col("uploaded_by") == F.lit(v), "uploaded_after": lambda v: None if not v else F.col("created_at") >= F.lit(v),
    "language": lambda v: ((F.col("language") == v) | (F.col("metadata_language") == v)) if v else None, "tags": lambda v: p.has_all("tags", v),
    "vendor": lambda v: F.col("vendor").ilike(f"%{v.strip()}%") if v else None, "customer": lambda v: F.col("customer").ilike(f"%{v.strip()}%") if v else None,
    "effective_date": _within("effective_date", _DATES), "expiration_date": _within("expiration_date", _DATES), "risk_band": _any_of("risk_band"), "risk_score": _within("risk_score", _NUMBERS, int),
    "contract_value": _within("contract_value", _NUMBERS), "currency": _equal("currency", str.upper), "governing_law": _equal("governing_law"), "country": _equal("country"), "category": _equal("category"),
    "department": _equal("department"), "owner": _equal("owner"), "auto_renewal": _flag("auto_renewal"), "has_unlimited_liability": _flag("has_unlimited_liability"),
    "missing_clause_types": lambda v: p.has_any("missing_mandatory_clauses", v), "missing_mandatory": lambda v: p.non_empty("missing_mandatory_clauses", v),
}


def compiled(spec: dict[str, Any], today: date) -> list[Column]:
    """The predicates of a specification; unknown entries are refused, so a misspelt filter never widens a result."""
    unknown = set(spec) - set(ENTRIES) - {"expiring_within_days"}
    if unknown:
        raise ValueError(f"unknown filters: {', '.join(sorted(unknown))}")
    made = [ENTRIES[name](value) for name, value in spec.items() if value is not None and name in ENTRIES]
    made.append(p.within_days("expiration_date", today, spec.get("expiring_within_days")))
    return [c for c in made if c is not None]


def repository(contracts: DataFrame, metadata: DataFrame) -> DataFrame:
    """Contracts with their metadata where there is any; the metadata's language is metadata_language."""
    told = metadata.withColumnRenamed("language", "metadata_language") if "language" in metadata.columns else metadata
    return contracts.join(told.withColumnRenamed("contract_id", "id"), "id", "left")


def filtered(contracts: DataFrame, metadata: DataFrame, project_ids: list, spec: dict[str, Any] | None, today: date) -> DataFrame:
    """Live contracts of the projects that pass all entries; no projects, no contracts.

    Predicates on one table's columns are pushed into its scan, and one that no null passes makes the left join an inner one.
    """
    rows = repository(p.scoped(contracts, project_ids), metadata)
    for condition in compiled(spec or {}, today):
        rows = rows.where(condition)
    return rows
