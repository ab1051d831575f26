"""The export set: one resolved set of contracts that six sheets share, written in one go."""

from __future__ import annotations

from datetime import date
from typing import Any

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.operators.layout import attribute_lines
from docuquarry.operators.registers import masked_clauses
from docuquarry.plans import contract_filters as cf
from docuquarry.sources.catalogue import SHEETS, sheet

#: Clause types whose text needs the permission to review, what stands in its place, and the sheets of an export that names none.
MASKED_TYPES, MASK = ["confidentiality", "non_solicit", "exclusivity"], "[Withheld - requires clause review permission]"
DEFAULT_SHEETS = ["contracts", "clauses", "obligations", "risks", "key_dates"]
#: What the rows of a contract are ordered by in each sheet, before their id.
_ORDER = {"clauses": ["clause_type", "clause_number"], "obligations": ["due_date"], "risks": ["severity"], "key_dates": ["date_value"], "parties": ["name"]}


def wanted_sheets(entities: list[str] | None) -> list[str]:
    """The known ones among the names, once each in their order; the default ones where none is known."""
    return list(dict.fromkeys(e for e in entities or [] if e in SHEETS)) or DEFAULT_SHEETS


def selected(contracts: DataFrame, metadata: DataFrame, project_ids: list, spec: dict[str, Any] | None, today: date, contract_ids: list | None = None) -> DataFrame:
    """The contracts of an export: what the repository's filters pass, narrowed to named ids."""
    rows = cf.filtered(contracts, metadata, project_ids, spec, today)
    return rows.where(F.col("id").isin(contract_ids)) if contract_ids else rows


def export_set(chosen: DataFrame, children: dict[str, DataFrame], project_ids: list, projects: DataFrame, entities: list[str] | None = None, fields: dict[str, list[str]] | None = None, may_see_masked: bool = False) -> dict[str, DataFrame]:
    """Sheets by entity, each with _contract (its contract's id) and _place (its row's place within the contract) before the columns.

    chosen: contracts of selected(); children: clauses, obligations, risks, key_dates and parties with
    contract_id and project_id. A child stands in its sheet when its contract was chosen and its project is
    in scope, whatever the filters say of it. Clause types of MASKED_TYPES are masked without the permission.
    """
    titles = chosen.select(F.col("id").alias("contract_id"), F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("original_file_name")).alias("contract_title"))
    out = {}
    for entity in wanted_sheets(entities):
        if entity == "contracts":
            named = chosen.join(projects.select("project_id", F.col("name").alias("project")), "project_id", "left").withColumn("project", F.coalesce("project", F.lit("")))
            rows = named.withColumns({"contract_id": F.col("id"), "file_name": F.col("original_file_name"), "missing_mandatory_clauses": F.array_join(F.coalesce("missing_mandatory_clauses", F.array().cast("array<string>")), ", "), "uploaded_at": F.col("created_at")})
            place: Column = F.lit(1)
        else:
            # a hashed title a contract, so that the rows are sorted for their places alone
            rows = children[entity].where(F.col("project_id").isin(project_ids)).join(titles.hint("shuffle_hash"), "contract_id")
            if entity == "clauses":
                rows = masked_clauses(rows, MASKED_TYPES, may_see_masked, MASK)
                if dict(rows.dtypes).get("attributes", "").startswith("map"):
                    rows = rows.withColumn("attributes", attribute_lines(F.col("attributes")))
                if "section_title" in rows.columns:
                    rows = rows.withColumn("title", F.coalesce(F.when(F.col("title") != "", F.col("title")), "section_title"))
            order = [F.col(c).asc_nulls_last() for c in _ORDER[entity] if c in rows.columns]
            if entity == "parties" and "is_primary" in rows.columns:
                order.insert(0, F.desc_nulls_last("is_primary"))
            place = F.row_number().over(Window.partitionBy("contract_id").orderBy(*order, *([F.col("id")] if "id" in rows.columns else [])))
        placed = rows.withColumns({"_place": place, "_contract": F.col("contract_id")})
        out[entity] = sheet(placed, entity, (fields or {}).get(entity), ("_contract", "_place"))
    return out


def masked_count(clauses: DataFrame, chosen: DataFrame, project_ids: list) -> DataFrame:
    """One row (masked): clause bodies that an account without the permission doesn't see."""
    hidden = clauses.where(F.col("project_id").isin(project_ids) & F.col("clause_type").isin(MASKED_TYPES))
    return hidden.join(chosen.select(F.col("id").alias("contract_id")), "contract_id", "left_semi").agg(F.count("*").alias("masked"))


def as_rows(sheets: dict[str, DataFrame]) -> DataFrame:
    """(entity, contract, place, cells): all sheets as one table, cells a JSON object of a row's columns in the sheet's order, nulls included."""
    out = None
    for entity, rows in sheets.items():
        cells = F.to_json(F.struct(*[c for c in rows.columns if not c.startswith("_")]), {"ignoreNullFields": "false"})
        one = rows.select(F.lit(entity).alias("entity"), F.col("_contract").alias("contract"), F.col("_place").alias("place"), cells.alias("cells"))
        out = one if out is None else out.unionByName(one)
    return out


def write_set(sheets: dict[str, DataFrame], path: str) -> None:
    """All sheets by one job, a folder for each entity, ordered by contract and place inside each file."""
    as_rows(sheets).repartition("entity", F.pmod(F.xxhash64("contract"), F.lit(64))).sortWithinPartitions("entity", "contract", "place").write.mode("overwrite").partitionBy("entity").json(path)
