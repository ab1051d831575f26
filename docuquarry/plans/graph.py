"""Nodes and edges of a contract graph from the rows that name them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def emit_edges(rows: DataFrame, relation: str, source: tuple[str, Column], target: tuple[str, Column], label: Column, resolved: Column | None = None) -> DataFrame:
    """(relation, source_type, source_ref, target_type, target_ref, label, resolved) of rows whose two references aren't blank."""
    ref = lambda c: F.trim(F.coalesce(c.cast("string"), F.lit("")))
    edges = rows.select(
        F.lit(relation).alias("relation"), F.lit(source[0]).alias("source_type"), ref(source[1]).alias("source_ref"), F.lit(target[0]).alias("target_type"), ref(target[1]).alias("target_ref"),
        label.cast("string").alias("label"), (F.lit(True) if resolved is None else F.coalesce(resolved, F.lit(False))).alias("resolved"),
    )
    return edges.where("source_ref <> '' AND target_ref <> ''")


def party_aliases(parties: DataFrame, contract: str) -> DataFrame:
    """(contract, alias, party): what a contract's parties (at, name, aliases) are called, in lower case; an alias counts with and without its article, and the last party that claims one has it."""
    name = F.trim("name")
    called = F.transform(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(F.trim(a)))
    bare = F.transform(called, lambda a: F.regexp_replace(a, r"^the\s+", ""))
    rows = parties.where(name != "").select(contract, "at", name.alias("party"), F.explode(F.array_distinct(F.concat(F.array(F.lower(name)), called, bare))).alias("alias"))
    return rows.where("alias <> ''").groupBy(contract, "alias").agg(F.max_by("party", F.struct("at", "party")).alias("party"))


def resolve_parties(rows: DataFrame, aliases: DataFrame, contract: str, named: str) -> DataFrame:
    """rows with party, the one that named stands for, and resolved; a name that no party has stays as it is."""
    asked = F.lower(F.trim(F.col(named)))
    keyed = rows.withColumn("alias", asked)
    bare = F.regexp_replace(asked, r"^the\s+", "")
    without = aliases.select(contract, F.col("alias").alias("_bare"), F.col("party").alias("_party"))
    joined = keyed.join(aliases, [contract, "alias"], "left").withColumn("_bare", bare).join(without, [contract, "_bare"], "left")
    hit = F.coalesce("party", "_party")
    return joined.select(*rows.columns, F.coalesce(hit, F.trim(F.col(named))).alias("party"), hit.isNotNull().alias("resolved"))
