"""Upkeep of embeddings: what is embedded, what is reused, which vectors are stale, and a model for tests."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuquarry.functions import text as tx
from docuquarry.functions import vectors as vx

#: What identifies a vector space, the longest text that is embedded, and attributes that tell clauses apart.
SPACE, MOST_CHARS = ["model", "provider", "dim", "embedding_version", "strategy_version"], 24_000
SALIENT = [
    "cap_basis", "cap_multiple", "cap_amount", "has_carve_outs", "carve_outs", "posture", "is_mutual", "is_capped", "auto_renews", "renewal_notice_days", "payment_days", "notice_days", "cure_period_days",
    "governing_law", "duration_months", "is_exclusive", "work_product_owner_side", "terminating_side",
]


def _line(prefix: str, value: Column) -> Column:
    return F.when(F.trim(F.coalesce(value, F.lit(""))) != "", F.concat(F.lit(prefix), value))


def summary_text(title: Column, agreement_type: Column, parties: Column, summary: Column, topics: Column, includes: list[str] | None = None) -> Column:
    """Text of a document vector, a line a part; null where there is none."""
    wanted = set(includes or ["summary", "key_topics", "parties", "agreement_type"])
    joined = lambda c: F.when(F.size(c) > 0, F.array_join(c, ", "))
    parts = [_line("", title)]
    parts += [_line("Agreement type: ", F.replace(agreement_type, F.lit("_"), F.lit(" ")))] if "agreement_type" in wanted else []
    parts += [_line("Parties: ", joined(parties))] if "parties" in wanted else []
    parts += [_line("", summary)] if "summary" in wanted else []
    parts += [_line("Topics: ", joined(topics))] if "key_topics" in wanted else []
    text = F.concat_ws("\n", *[F.trim(p) for p in parts])
    return F.when(text != "", text)


def salient_attributes(attributes: Column) -> Column:
    """key: value parts of a JSON object for the fixed keys that it holds, joined by semicolons.

    Lists are joined by commas, true and false are yes and no, underscores are spaces; null, an empty text
    and an empty list say nothing. In a list, true, false and null are named in words that begin with a capital.
    """

    def shown(value: Column) -> Column:
        kind, said = F.schema_of_variant(value), F.variant_get(value, "$", "string")
        spaced = lambda x: F.replace(x, F.lit("_"), F.lit(" "))
        entry = lambda e: F.when(F.is_variant_null(e), "None").when(F.schema_of_variant(e) == "BOOLEAN", F.initcap(F.variant_get(e, "$", "string"))).otherwise(spaced(F.variant_get(e, "$", "string")))
        listed = F.array_join(F.transform(F.variant_get(value, "$", "array<variant>"), entry), ", ")
        one = F.when(kind == "BOOLEAN", F.when(said == "true", "yes").otherwise("no")).when(said != "", spaced(said))
        return F.when(F.startswith(kind, F.lit("ARRAY")), F.when(F.size(F.try_variant_get(value, "$", "array<variant>")) > 0, listed)).otherwise(one)

    value = lambda k: F.try_variant_get(F.try_parse_json(attributes), f"$.{k}", "variant")
    return F.concat_ws("; ", *[F.concat(F.lit(k.replace("_", " ") + ": "), tx.let(value(k), shown)) for k in SALIENT])


def clause_text(clause_type: Column, number: Column, title: Column, text: Column, attributes: Column | None = None) -> Column:
    """Text of a clause vector: a header of type, number, title and salient attributes, then the clause; null without text."""
    salient = salient_attributes(attributes) if attributes is not None else F.lit("")
    head = F.concat_ws(" | ", F.concat(F.lit("Clause type: "), F.replace(clause_type, F.lit("_"), F.lit(" "))), _line("Clause ", number), _line("", title), _line("", salient))
    return F.when(F.trim(text) != "", F.concat(head, F.lit("\n"), F.trim(text)))


def chunk_text(section: Column, number: Column, text: Column) -> Column:
    head = F.concat_ws(" | ", _line("", section), _line("Clause ", number))
    return F.when(F.trim(text) != "", F.concat(F.when(head != "", F.concat(head, F.lit("\n"))).otherwise(""), F.trim(text)))


def to_embed(items: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(reused, fresh) of items (text): reused rows have the vector of existing (content_hash, vector), fresh has each other text once, cut to MOST_CHARS; blank items are in neither."""
    rows = items.where(F.trim(F.coalesce("text", F.lit(""))) != "").withColumn("content_hash", tx.content_hash(F.col("text")))
    reused = rows.join(existing.select("content_hash", "vector"), "content_hash")
    missing = rows.join(existing.select("content_hash"), "content_hash", "left_anti")
    fresh = missing.groupBy("content_hash").agg(F.min(F.substring("text", 1, MOST_CHARS)).alias("text"), F.count("*").alias("items"))
    return reused, fresh


def census(embeddings: DataFrame, extra: list[str] | None = None) -> DataFrame:
    """Vectors of each space."""
    return embeddings.groupBy(*SPACE, *(extra or [])).agg(F.count("*").alias("vectors"))


def stale(target: dict) -> Column:
    """Not in the target space: any of its columns differs."""
    return reduce(lambda a, b: a | b, [F.col(c) != F.lit(target[c]) for c in SPACE])


def reindex_list(embeddings: DataFrame, target: dict, project_ids: list | None = None, limit: int | None = None, everything: bool = False) -> DataFrame:
    """(contract_id) of contracts with a stale vector (or all), in order."""
    rows = embeddings if everything else embeddings.where(stale(target))
    rows = rows.where(F.col("project_id").isin(project_ids)) if project_ids is not None else rows
    out = rows.select("contract_id").distinct().orderBy("contract_id")
    return out if limit is None else out.limit(limit)


def mock_vector(text: Column, width: int) -> Column:
    """A unit vector from sha256 digests of the text and a counter: a model for tests."""
    digests = F.concat(*[F.unhex(F.sha2(F.concat(text.cast("binary"), F.unhex(F.lit(f"{i:08x}"))), 256)) for i in range(-(-width // 32))])
    # a lambda evaluates what it names again for every component, so digests and components are bound first
    raw = tx.let(digests, lambda d: F.transform(F.sequence(F.lit(1), F.lit(width)), lambda i: (F.conv(F.hex(F.substring(d, i, F.lit(1))), 16, 10).cast("double") - 127.5) / 127.5))
    return vx.unit(raw)
