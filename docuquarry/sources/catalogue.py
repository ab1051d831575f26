"""Import and export of a clause catalogue, and the sheets of an export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAPPING = ["agreement_type", "clause_key"]
#: The columns of each sheet of an export, the texts among them, and the longest cell with the mark behind it.
SHEETS = {
    "contracts": """contract_id title file_name project agreement_type status party_a party_b vendor effective_date expiration_date term_months auto_renewal auto_renewal_notice_days
      contract_value currency payment_terms_days governing_law jurisdiction risk_score risk_band has_unlimited_liability missing_mandatory_clauses clause_count needs_review page_count uploaded_at""".split(),
    "clauses": "contract_title clause_type clause_number title page_start is_mandatory is_risk_flagged confidence review_status attributes summary text".split(),
    "obligations": "contract_title action responsible_party due_date due_description trigger_event frequency is_recurring status penalty page_start".split(),
    "risks": "contract_title risk_type severity category is_omission score_contribution description recommendation page_start".split(),
    "key_dates": "contract_title date_type date_value date_expression description page_start".split(),
    "parties": "contract_title name legal_name entity_type role jurisdiction registration_number is_primary page_start".split(),
}
LONG_TEXTS, CELL_CHARS, CELL_CUT = ("action", "penalty", "description", "recommendation", "summary", "text"), 32_000, "\n[truncated - see the contract for the full text]"


def import_catalogue(rows: DataFrame, types: list[str], categories: DataFrame, mappings: DataFrame, create_missing: bool = True, deactivate_missing: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(categories, mappings, skipped) after an import of rows (at, agreement_type, clause_key, name, description, group_name, is_active, is_mandatory, display_order).

    categories are (clause_key, name, description, group_name, priority), mappings MAPPING with is_active,
    is_mandatory, display_order. Rows count in the order of at, so the last of a key stands. A row is skipped, with a
    reason, if its type is unknown or its clause is and isn't made by it or a row before it; new clauses have
    priority 999; null types and keys are empty ones. Without a display_order the clause's priority stands. With deactivate_missing, mappings that the
    sheet leaves out go inactive, but only of types it mentions. Synonyms aren't imported.
    """
    sheet = rows.withColumns({"agreement_type": F.trim(F.coalesce("agreement_type", F.lit(""))), "clause_key": F.lower(F.trim(F.coalesce("clause_key", F.lit("")))), "name": F.when(F.col("name") != "", F.col("name"))})
    known = sheet.join(categories.select("clause_key", F.lit(True).alias("_known")), "clause_key", "left")
    right_type = F.coalesce(F.col("agreement_type").isin(types), F.lit(False))
    makes = F.min(F.when(right_type & F.col("name").isNotNull() & F.lit(create_missing), F.col("at"))).over(Window.partitionBy("clause_key"))
    there = F.col("_known").isNotNull() | F.coalesce(F.col("_makes") <= F.col("at"), F.lit(False))
    reason = F.when(~right_type, F.concat(F.lit("'"), F.col("agreement_type"), F.lit("' is not a known agreement type"))).when(~there, F.lit("new clause needs a name" if create_missing else "no such clause"))
    judged = known.withColumn("_makes", makes).withColumn("reason", reason)
    good = judged.where("reason IS NULL")
    last = lambda df, keys: df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("at")))).where("_r = 1").drop("_r")
    named = last(good.where("name IS NOT NULL"), ["clause_key"]).select("clause_key", *[F.col(c).alias(f"_{c}") for c in ("name", "description", "group_name")], F.lit(True).alias("_new"))
    after = categories.join(named, "clause_key", "full")
    fresh = lambda c: F.when(F.col("_new"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c)
    merged = after.select("clause_key", *map(fresh, ("name", "description", "group_name")), F.coalesce("priority", F.lit(999)).alias("priority"))
    mapped = last(good, MAPPING).join(merged.select("clause_key", "priority"), "clause_key")
    order = F.coalesce("display_order", F.when(F.col("priority") != 0, F.col("priority")), F.lit(100)).alias("display_order")
    new = mapped.select(*MAPPING, "is_active", "is_mandatory", order)
    rest = mappings.join(new.select(*MAPPING), MAPPING, "left_anti")
    if deactivate_missing:
        touched = new.select("agreement_type").distinct().withColumn("_t", F.lit(True))
        rest = rest.join(touched, "agreement_type", "left").withColumn("is_active", F.col("is_active") & F.col("_t").isNull())
    both = new.unionByName(rest.select(*MAPPING, "is_active", "is_mandatory", "display_order"))
    return merged, both, judged.where("reason IS NOT NULL").select("at", "clause_key", "reason")


def export_catalogue(categories: DataFrame, mappings: DataFrame) -> DataFrame:
    """The rows that an import takes, by type, display_order and key; mappings of no clause are left out."""
    columns = ["agreement_type", "clause_key", "name", "description", "group_name", "is_active", "is_mandatory", "display_order"]
    return mappings.join(categories.drop("priority"), "clause_key").select(*columns).orderBy("agreement_type", "display_order", "clause_key")


def sheet(rows: DataFrame, entity: str, wanted: list[str] | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """The columns of an entity's sheet, or those wanted of them, in the sheet's order; all where none of the wanted is known.

    Columns of keep stand before them. Columns that rows lack are null. Texts over CELL_CHARS, which a cell can't hold, end there with a mark.
    """
    if entity not in SHEETS:
        raise ValueError(f"unknown sheet {entity}; there are {', '.join(SHEETS)}")
    columns = [c for c in SHEETS[entity] if c in (wanted or [])] or SHEETS[entity]

    def cell(c: str) -> Column:
        if c not in rows.columns:
            return F.lit(None).cast("string").alias(c)
        cut = F.when(F.length(c) > CELL_CHARS, F.concat(F.substring(c, 1, CELL_CHARS), F.lit(CELL_CUT))).otherwise(F.col(c))
        return (cut if c in LONG_TEXTS else F.col(c)).alias(c)

    return rows.select(*keep, *map(cell, columns))
