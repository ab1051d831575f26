"""Context packages: history and evidence under one budget, and their text for the prompt, in the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.functions import text as tx
from docuquarry.operators.registers import document_position
from docuquarry.plans.evidence import CONTEXT_BUDGET, assemble_context

#: Turns that stay, history's share of the budget, a turn's overhead, intents that want whole clauses first, and facts of a contract.
KEEP_TURNS, HISTORY_SHARE, TURN_TOKENS = 6, 0.15, 8
CLAUSE_FIRST = ["clause_lookup", "comparison", "risk_assessment", "compliance"]
FACTS = ["agreement_type", "risk_band", "effective_date", "expiration_date", "contract_value", "currency", "party_a", "party_b"]
NOTHING = "(no supporting evidence was retrieved)"
_NO_PAGE = 10**6


def trimmed_history(turns: DataFrame, budget: int = CONTEXT_BUDGET, keep: int = KEEP_TURNS) -> DataFrame:
    """turns (query_id, turn, role, content) that stay, with cost: the newest ones, the last always, as far as their share of the budget goes."""
    newest = Window.partitionBy("query_id").orderBy(F.desc("turn"))
    cost = tx.token_estimate(F.coalesce("content", F.lit(""))) + TURN_TOKENS
    few = turns.withColumn("_n", F.row_number().over(newest)).where(F.col("_n") <= keep).withColumn("cost", cost)
    so_far = F.sum("cost").over(newest.rowsBetween(Window.unboundedPreceding, 0))
    fits = few.withColumn("_sum", so_far).where((F.col("_n") == 1) | (F.col("_sum") <= int(budget * HISTORY_SHARE)))
    return fits.drop("_n", "_sum")


def prioritised(evidence: DataFrame, intent: str = "intent") -> DataFrame:
    """evidence (query_id, position, level, source) with pos: whole clauses first where the intent wants them, expansions last, else as retrieved."""
    rank = F.when(F.col("source").isin("neighbour", "graph"), 1).when(F.col(intent).isin(CLAUSE_FIRST) & (F.col("level") == "clause"), -1).otherwise(0)
    return evidence.withColumn("pos", F.row_number().over(Window.partitionBy("query_id").orderBy(rank, "position")))


def packages(evidence: DataFrame, history: DataFrame | None = None, facts: DataFrame | None = None, budget: int = CONTEXT_BUDGET, most: int = 20) -> DataFrame:
    """evidence (query_id, pos, text, ...) with text stripped and label: its citation number, 0 where it was dropped, null where it says nothing.

    What the facts (query_id, text) and the history of a question cost is spent before its evidence.
    """
    said = F.regexp_replace(F.coalesce("text", F.lit("")), f"^{tx.SPACE}+|{tx.SPACE}+$", "")
    rows = evidence.withColumn("text", said)
    costs = None
    for df, cost in ((history, F.col("cost")), (facts, tx.token_estimate(F.col("text")))):
        if df is not None:
            one = df.select("query_id", cost.cast("long").alias("_cost"))
            costs = one if costs is None else costs.unionByName(one)
    priced = rows.select("query_id", "pos", F.when(F.col("text") != "", tx.token_estimate(F.col("text"))).alias("tokens"))
    if costs is not None:
        priced = priced.join(costs.groupBy("query_id").agg(F.sum("_cost").alias("_spent")), "query_id", "left").withColumn("_spent", F.coalesce("_spent", F.lit(0)))
    labelled = assemble_context(priced, "query_id", budget, most, "_spent" if costs is not None else None)
    return rows.join(labelled.select("query_id", "pos", "label"), ["query_id", "pos"])


def page_range(first: Column, last: Column) -> Column:
    return F.when(first.isNull(), "").when(last.isNull() | (first == last), F.concat(F.lit("p."), first)).otherwise(F.concat(F.lit("pp."), first, F.lit("-"), last))


def rendered(citations: DataFrame, queries: DataFrame, clean: Callable[[Column], Column] = tx.sanitise) -> DataFrame:
    """(query_id, evidence): the labelled citations of each question as text, a block for each contract in the order of its first label, each as it stands in the document.

    citations: (query_id, label, contract_id, contract_title, clause_type, clause_number, section_title,
    page_start, page_end, text). A question without citations says that there is none.
    """
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    about = F.when(given("clause_type"), F.concat(F.lit(" ("), F.replace(F.col("clause_type"), F.lit("_"), F.lit(" ")), F.lit(")"))).when(given("section_title"), F.concat(F.lit(" - "), "section_title")).otherwise("")
    number = F.when(given("clause_number"), F.concat(F.lit(" Clause "), "clause_number")).otherwise("")
    pages = page_range(F.col("page_start"), F.col("page_end"))
    line = F.concat(F.lit("["), "label", F.lit("]"), number, about, F.when(pages != "", F.concat(F.lit(" ["), pages, F.lit("]"))).otherwise(""), F.lit("\n"), clean(F.col("text")))
    kept = citations.where("label > 0")
    place = F.struct(F.coalesce("page_start", F.lit(_NO_PAGE)).alias("page"), document_position(F.coalesce("clause_number", F.lit(""))).alias("parts"), "label", line.alias("line"), F.col("contract_title"))
    groups = kept.groupBy("query_id", "contract_id").agg(F.sort_array(F.collect_list(place)).alias("_lines"), F.min("label").alias("_first"), F.min_by("contract_title", "label").alias("_title"))
    title = F.coalesce(F.when(F.col("_title") != "", F.col("_title")), F.concat(F.lit("Contract "), F.col("contract_id").cast("string")))
    block = F.concat(F.lit("=== "), title, F.lit(" ===\n\n"), F.array_join(F.transform("_lines", lambda x: x["line"]), "\n\n"))
    blocks = groups.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_first", block.alias("block")))).alias("_b"))
    whole = F.array_join(F.transform("_b", lambda x: x["block"]), "\n\n")
    return queries.select("query_id").join(blocks.select("query_id", whole.alias("evidence")), "query_id", "left").withColumn("evidence", F.coalesce("evidence", F.lit(NOTHING)))


def fact_lines(rows: DataFrame, most: int = 25) -> DataFrame:
    """(query_id, text): the facts of each question's first contracts (query_id, position, contract_id, title, FACTS, missing_mandatory_clauses), a line each, behind a heading."""
    first = rows.withColumn("_n", F.row_number().over(Window.partitionBy("query_id").orderBy("position"))).where(F.col("_n") <= most)
    parts = [F.concat(F.lit("- "), F.coalesce(F.when(F.col("title") != "", F.col("title")), F.col("contract_id").cast("string")))]
    parts += [F.when(F.col(f).isNotNull() & (F.col(f).cast("string") != ""), F.concat(F.lit(f.replace("_", " ") + ": "), F.col(f).cast("string"))) for f in FACTS if f in rows.columns]
    if "missing_mandatory_clauses" in rows.columns:
        parts.append(F.when(F.size("missing_mandatory_clauses") > 0, F.concat(F.lit("missing clauses: "), F.array_join("missing_mandatory_clauses", ", "))))
    lines = first.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("_n", F.concat_ws("; ", *parts).alias("line")))).alias("_l"))
    return lines.select("query_id", F.concat(F.lit("=== CONTRACT FACTS ===\n"), F.array_join(F.transform("_l", lambda x: x["line"]), "\n")).alias("text"))
