"""Evidence for questions and extractions: batches, context, quotes, citations, expansion and answer scores."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.functions.text import let, squeeze
from docuquarry.operators.folds import fold
from docuquarry.operators.steps import settled
from docuquarry.plans.retrieval import GRAPH_FACTOR

#: Shares of a quote's words found from which it is clean, or doubtful; words compared by default, and the least words of a window.
QUOTE_CLEAN, QUOTE_MATCH, QUOTE_WORDS, EVIDENCE_WORDS, WINDOW_WORDS = 0.98, 0.85, 2_000, 20_000, 1_000
#: What text extraction mangles: marks and the plain ones they count as, and ligatures.
QUOTE_MARKS = ("\u2018\u2019\u201c\u201d\u2013\u2014\u2212", "''\"\"---")
LIGATURES = [("\ufb01", "fi"), ("\ufb02", "fl")]
#: Fixed values of context assembly: token budget, largest share of one item, items exempt, overhead of an item.
CONTEXT_BUDGET, SINGLE_SHARE, LEAST_ITEMS, ITEM_TOKENS = 24_000, 0.25, 3, 30


def _batches(budget: int, size: int, overlap: float):
    def run(clauses: list[tuple]) -> list[tuple]:
        held = [dict(zip(r[3], r[4], strict=True)) for r in clauses]
        batch, n = [-1] * len(held), 0
        for i, seed in enumerate(held):
            if batch[i] >= 0:
                continue
            batch[i], union, members = n, dict(seed), 1
            for j in range(i + 1, len(held)):
                if members == size:
                    break
                both = len(seed.keys() & held[j].keys())
                either = len(seed.keys() | held[j].keys())
                if batch[j] >= 0 or not either or both < overlap * either or sum((union | held[j]).values()) > budget:
                    continue
                batch[j], members = n, members + 1
                union |= held[j]
            n += 1
        return [(r[0], r[1], m) for r, m in zip(clauses, batch, strict=True)]

    return run


def plan_batches(clauses: DataFrame, budget: int, size: int = 5, overlap: float = 0.5) -> DataFrame:
    """(doc_id, clause, batch) for rows (doc_id, clause, priority, chunks, costs): every clause in exactly one batch.

    In order of priority and name the first free clause seeds a batch; later ones join it while their
    chunks overlap the seed's by Jaccard, it has room, and the tokens of all its chunks fit the budget.
    """
    rows = clauses.select("doc_id", "clause", F.col("priority").cast("int"), "chunks", "costs")
    kinds = dict(clauses.dtypes)
    return fold(rows, ["priority", "clause"], _batches(budget, size, overlap), f"doc_id {kinds['doc_id']}, clause {kinds['clause']}, batch int")


def assemble_context(evidence: DataFrame, query: str, budget: int = CONTEXT_BUDGET, most: int = 20, spent: str | None = None) -> DataFrame:
    """Rows (query, pos, tokens) with label: the citation number in pos order, 0 where dropped, null where tokens are null (nothing to cite).

    An item over a quarter of the budget or over what is left is dropped, and later ones may still fit; the first items
    always stay. spent names a column of what a query has spent before. A query's evidence is a bounded list,
    which is folded in the JVM.
    """
    before = F.col(spent).cast("long") if spent else F.lit(0).cast("long")
    listed = evidence.groupBy(query).agg(F.sort_array(F.collect_list(F.struct(F.col("pos").cast("long").alias("pos"), F.col("tokens").cast("long").alias("tokens")))).alias("_items"), F.max(before).alias("_spent"))
    start = F.struct(F.col("_spent").alias("spent"), F.lit(1).alias("label"), F.array().cast("array<int>").alias("labels"))

    def admit(state: Column, item: Column) -> Column:
        cost = item["tokens"] + ITEM_TOKENS
        too_big = (cost > int(budget * SINGLE_SHARE)) | (state["spent"] + cost > budget)
        out = (state["label"] > most) | (too_big & (state["label"] > LEAST_ITEMS))
        stays = item["tokens"].isNotNull() & ~out
        said = F.when(item["tokens"].isNotNull() | (state["label"] > most), F.when(out, 0).otherwise(state["label"]))
        return F.struct(F.when(stays, state["spent"] + cost).otherwise(state["spent"]).alias("spent"), F.when(stays, state["label"] + 1).otherwise(state["label"]).alias("label"), F.concat(state["labels"], F.array(said)).alias("labels"))

    folded = listed.select(query, "_items", F.aggregate("_items", start, admit)["labels"].alias("_labels"))
    placed = F.zip_with("_items", "_labels", lambda i, n: F.struct(i["pos"].alias("pos"), i["tokens"].alias("tokens"), n.alias("label")))
    return folded.select(query, F.inline(placed))


def _found(matcher: SequenceMatcher, words: list[str]) -> int:
    matcher.set_seq1(words)
    return sum(b.size for b in matcher.get_matching_blocks())


def _coverage(quote_words: int | None, evidence_words: int | None):
    """The share of a quote's words that stand in the evidence in order; without a bound the whole evidence, in windows that overlap by half.

    Below QUOTE_MATCH it may be the share that stands there in any order, which is never less. A text is
    read once for all quotes of it that follow each other.
    """

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for quotes, evidence in batches:
            shares, read, held, known, whole = [], None, [], frozenset(), None
            for quote, text in zip(quotes, evidence, strict=True):
                words = (quote or "").split()[:quote_words]
                if not words:
                    shares.append(0.0)
                    continue
                if text != read:
                    read, held, whole = text, (text or "").split()[:evidence_words], None
                    known = frozenset(held)
                most = sum(w in known for w in words)
                if most / len(words) < QUOTE_MATCH:
                    shares.append(most / len(words))
                    continue
                width, best = len(held) if evidence_words else max(4 * len(words), WINDOW_WORDS), 0
                for i in range(0, max(1, len(held) - width // 2), max(1, width // 2)):
                    if i or width < len(held):
                        matcher = SequenceMatcher(None, (), held[i : i + width], autojunk=False)
                    else:
                        matcher = whole = whole or SequenceMatcher(None, (), held, autojunk=False)
                    best = max(best, _found(matcher, words))
                    if best == most:
                        break
                shares.append(best / len(words))
            yield pd.Series(shares, dtype="float64")

    return run


def folded(text: Column) -> Column:
    """Lower case, with plain quotes, dashes, fi and fl for typographic ones and one space for any white space, that of Unicode included; null is empty."""

    def plain(small: Column) -> Column:
        out = F.translate(small, *QUOTE_MARKS)
        for ligature, letters in LIGATURES:
            out = F.replace(out, F.lit(ligature), F.lit(letters))
        return F.when(F.length(small) == F.octet_length(small), small).otherwise(out)  # ASCII holds none of them

    # both are bound, as squeeze names its text many times over
    return let(F.lower(F.coalesce(text, F.lit(""))), lambda small: let(plain(small), squeeze))


def check_quotes(rows: DataFrame, quote: str, evidence: str, quote_words: int | None = QUOTE_WORDS, evidence_words: int | None = EVIDENCE_WORDS) -> DataFrame:
    """rows with verdict: empty, ok (in the evidence as it stands, or nearly all words in order), partial or rejected.

    rows are read, and both texts folded, once. Python sees only the quotes that a substring test, over whole texts,
    leaves open; for the others it gets nulls, so that rows need no second reading. Of the open ones it compares the first
    quote_words words with the first evidence_words of the evidence: an altered quote behind them is rejected, and
    words of a quote beyond them aren't looked at. None takes whole quotes, and whole texts in windows of at least four
    times the quote's length that overlap by half, so that a quote altered anywhere is found.
    """
    share = F.pandas_udf(_coverage(quote_words, evidence_words), "double")
    told = rows.withColumns({"_q": folded(F.col(quote)), "_e": folded(F.col(evidence))})
    told = told.withColumn("_v", F.when(F.col("_q") == "", "empty").when(F.contains("_e", "_q"), "ok"))
    open_ = F.col("_v").isNull()
    left = told.withColumn("_s", share(F.when(open_, F.col("_q")), F.when(open_, F.col("_e"))))
    verdict = F.coalesce("_v", F.when(F.col("_s") >= QUOTE_CLEAN, "ok").when(F.col("_s") >= QUOTE_MATCH, "partial").otherwise("rejected"))
    return left.select(*[F.col(f"`{c}`") for c in rows.columns], verdict.alias("verdict"))


def citation_verdict(cited: Column, offered: Column) -> Column:
    """missing without citations, fabricated if one was not offered, else ok."""
    return F.when(F.coalesce(F.size(cited), F.lit(0)) <= 0, "missing").when(F.size(F.array_except(cited, F.coalesce(offered, F.array()))) > 0, "fabricated").otherwise("ok")


def answer_confidence(cited: Column, offered: Column, strength: Column, fabricated: Column, dropped: Column, non_answer: Column, refused: Column | None = None) -> Column:
    """Grounding of an answer: 0.55 of coverage (of at most five) and 0.45 of evidence strength (0.5 unmeasured), halved when a citation is fabricated, less a tenth when evidence was dropped; 0 for a refusal."""
    coverage = F.least(cited / F.least(F.greatest(offered, F.lit(1)), F.lit(5)), F.lit(1.0))
    measured = F.greatest(F.lit(0.0), F.least(F.coalesce(strength, F.lit(0.5)), F.lit(1.0)))
    score = (0.55 * coverage + 0.45 * measured) * F.when(fabricated, 0.5).otherwise(1.0) * F.when(dropped, 0.9).otherwise(1.0)
    no = F.lit(False) if refused is None else F.coalesce(refused, F.lit(False))
    return F.when(no, 0.0).when((cited == 0) & non_answer, F.when(offered > 0, 0.75).otherwise(0.6)).when(cited == 0, 0.15).otherwise(F.round(score, 4))


def guardrail(evidence: DataFrame, query: str, floor: float = 0.45) -> DataFrame:
    """(query, similarity, answered) from the best cosine of clause and chunk hits; a summary alone answers nothing."""
    usable = F.when(F.col("level").isin("clause", "chunk"), F.col("similarity"))
    return evidence.groupBy(query).agg(F.max(usable).alias("similarity")).withColumn("answered", F.coalesce(F.col("similarity") >= floor, F.lit(False)))


def retried(questions: DataFrame, search: Callable[[DataFrame], DataFrame], types: str = "types") -> DataFrame:
    """Evidence of search, with relaxed: a question whose type filter found nothing at all is asked once more without it.

    questions: (query_id, types, ...), types an array of document types, null or empty for no filter. search
    takes questions, with null types for no filter, and returns rows with query_id. What a filter found,
    however little, stands.
    """
    told = questions.withColumn(types, F.when(F.size(types) > 0, F.col(types)))
    first = settled(search(told))  # a question's few hits, read three times
    empty = told.where(F.col(types).isNotNull()).join(first.select("query_id").distinct(), "query_id", "left_anti")
    again = search(empty.withColumn(types, F.lit(None).cast(dict(told.dtypes)[types])))
    return first.withColumn("relaxed", F.lit(False)).unionByName(again.withColumn("relaxed", F.lit(True)))


def answerable(questions: DataFrame, evidence: DataFrame, floor: float = 0.45) -> DataFrame:
    """(query_id, similarity, answered, relaxed) of every question, also of those without evidence."""
    found = guardrail(evidence, "query_id", floor).join(evidence.groupBy("query_id").agg(F.bool_or("relaxed").alias("relaxed")), "query_id")
    known = questions.select("query_id").join(found, "query_id", "left")
    return known.withColumns({"answered": F.coalesce("answered", F.lit(False)), "relaxed": F.coalesce("relaxed", F.lit(False))})


def expand_graph(hits: DataFrame, edges: DataFrame, query: str, seeds: int = 10) -> DataFrame:
    """(query, node, score): nodes one edge from a query's best hits (node, rank, score) in either direction, at 0.4 of the best seed's score, hits left out.

    Two equality joins instead of one on either end.
    """
    best = hits.where(F.col("rank") <= seeds).select(query, F.col("node").alias("_n"), "score")
    ways = edges.select(F.col("source").alias("_n"), F.col("target").alias("node")).unionByName(edges.select(F.col("target").alias("_n"), F.col("source").alias("node"))).distinct()
    near = best.join(ways, "_n").groupBy(query, "node").agg((F.max("score") * GRAPH_FACTOR).alias("score"))
    return near.join(hits.select(query, "node"), [query, "node"], "left_anti")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One edge (source, target, kind) of many: resolved if any is, its origin corroborated where origins differ."""
    origin = F.when(F.min("origin") != F.max("origin"), "corroborated").otherwise(F.min("origin"))
    return edges.groupBy("source", "target", "kind").agg(F.bool_or("resolved").alias("resolved"), origin.alias("origin"))


def first_nodes(nodes: DataFrame) -> DataFrame:
    """The first of the nodes (ref, ord, ...) that share a reference."""
    return nodes.withColumn("_r", F.row_number().over(Window.partitionBy("ref").orderBy("ord"))).where("_r = 1").drop("_r")


def rerank(hits: DataFrame, query: str) -> DataFrame:
    """rank among hits (query, pos, rerank_score): scored ones by score, the others behind them in their order."""
    w = Window.partitionBy(query).orderBy(F.desc_nulls_last("rerank_score"), "pos")
    return hits.withColumn("rank", F.row_number().over(w))
