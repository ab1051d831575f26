"""Structured answers about documents: checks against a schema, evidence for them, and what of them is kept."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.functions.text import let

#: Points of a match, of a chunk's kind, and the bounds of an evidence bundle.
HEADING, KEYWORD, TITLE_KEYWORD, SYNONYM = 10.0, 2.0, 3.0, 4.0
KIND_POINTS = {"clause": 2.0, "section": 1.0, "list": 0.75, "table": 0.5, "paragraph": 0.25}
EVIDENCE_CHUNKS, EVIDENCE_TOKENS = 12, 6_000
#: Pages that a document is classified by, windows searched at once, and the least text of one.
CLASSIFY_PAGES, WAVE, LEAST_CHARS = 5, 4, 200
_ISSUES = "array<struct<code:string,field:string,severity:string>>"
#: What a variant's schema begins with, by the type's name in a JSON schema.
_TYPES = {"null": "VOID", "string": "STRING", "boolean": "BOOLEAN", "integer": "BIGINT", "number": "BIGINT|DECIMAL|DOUBLE|FLOAT", "object": "OBJECT", "array": "ARRAY"}


def _none() -> Column:
    return F.array().cast(_ISSUES)


def _found(condition: Column, code: str, field: Column, severity: str = "error") -> Column:
    one = F.struct(F.lit(code).alias("code"), field.alias("field"), F.lit(severity).alias("severity"))
    return F.when(F.coalesce(condition, F.lit(False)), F.array(one)).otherwise(_none())


def _under(path: Column, name: str) -> Column:
    return F.when(path == "", F.lit(name)).otherwise(F.concat(path, F.lit(f".{name}")))


def _issues(value: Column, kind: Column, schema: dict, path: Column) -> Column:
    """What a variant of a kind, as schema_of_variant has it, has against a schema; the kind and the names in an object are read once each."""
    declared = schema.get("type")
    types = [declared] if isinstance(declared, str) else list(declared or [])
    where = F.when(path == "", "(root)").otherwise(path)
    is_a = lambda *names: kind.rlike(f"^({'|'.join(_TYPES[n] for n in names)})")
    parts = []
    if "enum" in schema:
        allowed = [json.dumps(e, ensure_ascii=False, separators=(",", ":")) for e in schema["enum"]]
        parts.append(_found(~F.to_json(value).isin(allowed), "schema_enum_violation", where))
    if "object" in types:
        named = schema.get("properties", {})

        def inside_object(held: Column) -> Column:
            inner = [_found(~F.array_contains(held, n), "schema_missing_field", _under(path, n)) for n in schema.get("required", [])]
            if schema.get("additionalProperties") is False:
                extra = F.array_sort(F.array_except(held, F.array(*map(F.lit, named)).cast("array<string>")))
                issue = lambda n: F.struct(F.lit("schema_unexpected_field").alias("code"), F.when(path == "", n).otherwise(F.concat(path, F.lit("."), n)).alias("field"), F.lit("warning").alias("severity"))
                inner.append(F.transform(extra, issue))
            for name, sub in named.items():
                child = F.try_variant_get(value, f"$['{name}']", "variant")
                inner.append(F.when(F.array_contains(held, name), _judged(child, sub, _under(path, name))).otherwise(_none()))
            return F.concat(*inner) if inner else _none()

        if named or schema.get("required") or schema.get("additionalProperties") is False:
            parts.append(F.when(is_a("object"), let(F.map_keys(F.try_variant_get(value, "$", "map<string,variant>")), inside_object)).otherwise(_none()))
    if "array" in types and isinstance(schema.get("items"), dict):
        entries = F.try_variant_get(value, "$", "array<variant>")
        each = lambda x, i: _judged(x, schema["items"], F.concat(path, F.lit("["), i.cast("string"), F.lit("]")))
        parts.append(F.when(is_a("array"), F.flatten(F.transform(entries, each))).otherwise(_none()))
    inside = F.when(is_a("null"), _none()).otherwise(F.concat(*parts)) if parts else _none()
    if not types:
        return inside
    return F.when(is_a(*types), inside).otherwise(_found(F.lit(True), "schema_type_mismatch", where))


def _judged(value: Column, schema: dict, path: Column) -> Column:
    """_issues of a value, with the value and its kind bound before they are used."""
    return let(F.struct(value.alias("v"), F.schema_of_variant(value).alias("k")), lambda x: _issues(x["v"], x["k"], schema, path))


def schema_issues(payload: Column, schema: dict) -> Column:
    """What a JSON text has against a schema: types and their unions, enums, required and unexpected fields, items.

    An array of (code, field, severity), the field as its path; unexpected fields are warnings. Whole numbers of
    64 bits are integers, and a boolean is no number. Null or broken JSON is schema_unreadable at (root). Other
    keywords of a schema are not looked at.
    """
    unreadable = _found(F.lit(True), "schema_unreadable", F.lit("(root)"))
    return let(F.try_parse_json(payload), lambda value: F.when(value.isNull(), unreadable).otherwise(_judged(value, schema, F.lit(""))))


def accepted(rows: DataFrame, issues: str = "issues", attributes: str = "attributes", corrections: str = "corrections") -> DataFrame:
    """The rows without an issue that is an error, their corrections (a map) put over their attributes."""
    good = rows.where(~F.exists(F.coalesce(F.col(issues), _none()), lambda i: i["severity"] == "error"))
    return good.withColumn(attributes, F.coalesce(F.map_concat(F.map_filter(attributes, lambda k, _: ~F.array_contains(F.coalesce(F.map_keys(corrections), F.array().cast("array<string>")), k)), corrections), F.col(attributes)))


def _has(text: Column, terms: list[str]) -> list[Column]:
    return [F.contains(text, F.lit(x.lower())) for x in terms if x]


def _count(conditions: list[Column]) -> Column:
    return sum((c.cast("int") for c in conditions), F.lit(0))


def score_evidence(chunks: DataFrame, rule: dict, synonyms: list[str] | None = None) -> DataFrame:
    """The chunks (heading, text, chunk_type, tokens) that a rule matches, with score.

    A rule names heading_patterns, keywords, must_not_contain and min_tokens; the last spares tables and lists.
    A heading counts in the heading or the text's first line. A null heading or text is empty.
    """
    text, heading = F.lower(F.coalesce("text", F.lit(""))), F.lower(F.coalesce("heading", F.lit("")))
    first = F.split_part(text, F.lit("\n"), F.lit(1))
    heads = [a | b for a, b in zip(_has(heading, rule.get("heading_patterns", [])), _has(first, rule.get("heading_patterns", [])), strict=True)]
    same = [a | b for a, b in zip(_has(heading, synonyms or []), _has(first, synonyms or []), strict=True)]
    words, titled = _has(text, rule.get("keywords", [])), _has(heading, rule.get("keywords", []))
    kind = F.coalesce(*[F.when(F.col("chunk_type") == k, F.lit(p)) for k, p in KIND_POINTS.items()], F.lit(0.0))
    score = HEADING * _count(heads) + SYNONYM * _count(same) + KEYWORD * _count(words) + TITLE_KEYWORD * _count(titled) + kind
    matched = _count(heads) + _count(same) + _count(words) > 0
    barred = _count(_has(text, rule.get("must_not_contain", []))) > 0
    long_enough = (F.col("tokens") >= int(rule.get("min_tokens") or 0)) | F.coalesce(F.col("chunk_type").isin("table", "list"), F.lit(False))
    return chunks.where(matched & ~barred & long_enough).withColumn("score", score)


def select_evidence(scored: DataFrame, doc: str, limit: int = EVIDENCE_CHUNKS, budget: int = EVIDENCE_TOKENS) -> DataFrame:
    """The best scored chunks of each document with rank: by score, then reading_order, up to the first that goes over the limit or the budget."""
    w = Window.partitionBy(doc).orderBy(F.desc("score"), "reading_order", "chunk_id")
    ranked = scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit)
    return ranked.withColumn("_s", F.sum("tokens").over(w)).where(F.col("_s") <= budget).drop("_s")


def evidence_parents(chosen: DataFrame, chunks: DataFrame, doc: str, budget: int = EVIDENCE_TOKENS) -> DataFrame:
    """(doc, chunk_id, at): parents of the chosen chunks that aren't chosen themselves, in the order of rank, while the rest of the budget has room; one too large is passed over.

    A document's list is bounded by the limit of select_evidence.
    """
    spent = chosen.groupBy(doc).agg((budget - F.sum("tokens")).alias("_room"))
    wanted = chosen.where("parent_id IS NOT NULL").groupBy(doc, F.col("parent_id").alias("chunk_id")).agg(F.min("rank").alias("_r"))
    wanted = wanted.join(chosen.select(doc, "chunk_id"), [doc, "chunk_id"], "left_anti").join(chunks.select(doc, "chunk_id", "tokens"), [doc, "chunk_id"])
    listed = wanted.groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("_r", "chunk_id", F.col("tokens").cast("long").alias("tokens")))).alias("_l")).join(spent, doc)
    left = F.col("_room").cast("long")
    start = F.struct(left.alias("room"), F.slice(F.transform("_l", lambda x: x["chunk_id"]), 1, 0).alias("ids"))
    step = lambda a, x: F.when(x["tokens"] <= a["room"], F.struct((a["room"] - x["tokens"]).alias("room"), F.concat(a["ids"], F.array(x["chunk_id"])).alias("ids"))).otherwise(a)
    return listed.select(doc, F.posexplode(F.aggregate("_l", start, step)["ids"]).alias("at", "chunk_id"))


def first_pages(pages: DataFrame, doc: str, page: str, n: int = CLASSIFY_PAGES) -> DataFrame:
    """The first n pages of each document, which is what a classifier is shown."""
    return pages.withColumn("_r", F.row_number().over(Window.partitionBy(doc).orderBy(page))).where(F.col("_r") <= n).drop("_r")


def document_label(raw: Column, labels: list[str], fallback: str) -> Column:
    """(label, fell_back): the label that raw names whatever its case, the first of several, else the fallback."""
    said = F.lower(F.trim(F.coalesce(raw, F.lit(""))))
    label = F.coalesce(*[F.when(said == x.lower(), F.lit(x)) for x in labels], F.lit(None).cast("string"))
    return F.struct(F.coalesce(label, F.lit(fallback)).alias("label"), label.isNull().alias("fell_back"))


def agreement_type(label: Column, known: list[str], legacy: dict[str, tuple[str, str | None]]) -> Column:
    """(type, subtype): a known label as it is, a retired one (its key in words_only form) translated, any other as other with its words as the subtype."""
    said = F.trim(F.coalesce(label, F.lit("")))
    key = F.trim(F.regexp_replace(F.lower(said), "[^a-z0-9]+", " "))
    words = F.substring(F.replace(key, F.lit(" "), F.lit("_")), 1, 64)
    pair = lambda a, b: F.struct(a.alias("type"), b.alias("subtype"))
    old = [F.when(key == k, pair(F.lit(a), F.lit(b).cast("string"))) for k, (a, b) in legacy.items()]
    return F.coalesce(F.when(said.isin(known), pair(said, F.lit(None).cast("string"))), *old, pair(F.lit("other"), F.when(words != "", words)))


def clause_key(name: Column, explicit: dict[str, str], known: list[str] | None = None) -> Column:
    """The catalogue key of a clause name: from the explicit list or its words joined by _; null where known lacks it."""
    words = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(name, F.lit("")))), "[^a-z0-9]+", " "))
    key = F.coalesce(*[F.when(words == k, F.lit(v)) for k, v in explicit.items()], F.replace(words, F.lit(" "), F.lit("_")))
    return key if known is None else F.when(key.isin(known), key)


def digest(rows: DataFrame, found: DataFrame, doc: str) -> DataFrame:
    """(doc, place, clause_key, heading, lines): the first digest row (at, clause_key, heading, lines) with a line for each clause found (at, clause_type, label), in the order found.

    Blank lines go; rows for clauses that weren't found go. A blank heading takes the label, else the key.
    """
    said = F.filter(F.transform("lines", lambda x: F.trim(x)), lambda x: F.coalesce(x, F.lit("")) != "")
    w = Window.partitionBy(doc, "clause_key").orderBy("at")
    firsts = rows.withColumns({"clause_key": F.trim("clause_key"), "lines": said}).where(F.size("lines") > 0).withColumn("_r", F.row_number().over(w)).where("_r = 1")
    kinds = found.groupBy(doc, F.col("clause_type").alias("clause_key")).agg(F.min("at").alias("_at"), F.min_by("label", "at").alias("_label"))
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    place = F.row_number().over(Window.partitionBy(doc).orderBy("_at", "clause_key"))
    return firsts.join(kinds, [doc, "clause_key"]).select(doc, place.alias("place"), "clause_key", F.coalesce(blank("heading"), blank("_label"), "clause_key").alias("heading"), "lines")


def split_sections(answers: DataFrame, claims: DataFrame, paragraphs: DataFrame, section: str) -> DataFrame:
    """(section, clause, ref): paragraphs of a shared section by the clause that an answer (at, clause, refs) gives them to.

    Only claimed clauses and references of the section count, and of several answers for a clause the last with any.
    A section of which some claimant got nothing isn't split: it has no rows.
    """
    held = answers.join(claims.select(section, "clause").distinct(), [section, "clause"]).select(section, "clause", "at", F.explode("refs").alias("ref"))
    held = held.withColumn("ref", F.trim("ref")).join(paragraphs.select(section, "ref").distinct(), [section, "ref"]).distinct()
    last = held.withColumn("_m", F.max("at").over(Window.partitionBy(section, "clause"))).where("at = _m")
    whole = claims.groupBy(section).agg(F.countDistinct("clause").alias("_c")).join(last.groupBy(section).agg(F.countDistinct("clause").alias("_g")), section).where("_c = _g")
    return last.join(whole.select(section), section, "left_semi").select(section, "clause", "ref")


def window_claims(windows: DataFrame, answers: DataFrame, wanted: DataFrame, doc: str, wave: int = WAVE) -> tuple[DataFrame, DataFrame]:
    """Searching windows in waves: ((doc, clause, window) claimed, (doc, page) never read).

    windows (window, page, chars) count from 0; those with under LEAST_CHARS are skipped. The first window whose
    answer (window, clause) names a wanted clause claims it. Once a wave has claimed the last of them, later waves
    aren't searched, and pages that only they hold are never read; with a clause left, every page is.
    """
    searched = windows.groupBy(doc, "window").agg(F.sum("chars").alias("_c")).where(F.col("_c") >= LEAST_CHARS)
    claims = answers.join(wanted, [doc, "clause"], "left_semi").join(searched, [doc, "window"], "left_semi").groupBy(doc, "clause").agg(F.min("window").alias("window"))
    ends = wanted.join(claims, [doc, "clause"], "left").groupBy(doc).agg(F.count_if(F.col("window").isNull()).alias("_left"), F.max(F.floor(F.col("window") / wave)).alias("_last"))
    pages = windows.groupBy(doc, "page").agg(F.min(F.floor(F.col("window") / wave)).alias("_w"))
    unread = pages.join(ends.where("_left = 0"), doc).where("_w > _last").select(doc, "page")
    return claims, unread


def project_metadata(facts: DataFrame, clauses: DataFrame, risks: DataFrame, key: str, fields: dict[str, tuple[str | None, str | None, str | None]]) -> DataFrame:
    """One row a contract: fields from its facts, else from an attribute of a clause, with flags and counts.

    fields names each column as (fact, clause type, attribute). clauses (clause_type, at, attributes JSON): the first
    of a type counts. A null means nothing is known: sinks.upsert leaves the old value then.
    """
    kinds = sorted({c for _, c, _ in fields.values() if c})
    firsts = clauses.groupBy(key).agg(F.count("*").alias("clause_count"), F.array_sort(F.collect_set("clause_type")).alias("clause_types"), *[F.min_by("attributes", F.when(F.col("clause_type") == k, F.col("at"))).alias(f"_{k}") for k in kinds])
    counted = risks.groupBy(key).agg(F.count("*").alias("risk_count"), F.count_if(F.col("severity").isin("critical", "high")).alias("high_risk_count"))
    wide = facts.join(firsts, key, "left").join(counted, key, "left")

    def value(fact: str | None, kind: str | None, name: str | None) -> Column:
        options = ([F.col(fact).cast("string")] if fact else []) + ([F.get_json_object(f"_{kind}", f"$.{name}")] if kind else [])
        return F.coalesce(*options)

    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("clause_count", "risk_count", "high_risk_count")]
    types = F.coalesce("clause_types", F.array().cast("array<string>")).alias("clause_types")
    return wide.select(key, *[value(*f).alias(name) for name, f in fields.items()], types, *counts)
