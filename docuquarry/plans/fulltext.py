"""Full-text search over an inverted index, and the descent through summaries, clauses and chunks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.functions.text import let
from docuquarry.operators.relational import latest_per_key
from docuquarry.plans import retrieval

#: Weights of title and body, and words that aren't indexed.
WEIGHTS = {"A": 1.0, "B": 0.4}
STOP_WORDS = "a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split()


def stem(word: Column) -> Column:
    """A light English stem: plurals and the endings of verbs and adverbs off, where three letters stay."""
    plural = F.when(word.rlike("[^aeious]ies$"), F.regexp_replace(word, "ies$", "y")).when(word.rlike("(ss|x|z|ch|sh)es$"), F.regexp_replace(word, "es$", "")).when(word.rlike("[^aius]s$"), F.regexp_replace(word, "s$", "")).otherwise(word)
    bare = F.regexp_replace(plural, "(?<=[a-z]{3})(ing|edly|ed|ly)$", "")
    single = lambda w: F.regexp_replace(w, "(?<=[a-z]{2})([b-df-hj-np-tv-z])\\1$", "$1")
    # most words have none of the endings, which plain comparisons tell
    ends = reduce(lambda a, b: a | b, [F.endswith(word, F.lit(e)) for e in ("s", "ing", "ed", "ly")])
    return F.when(F.length(word) <= 3, word).when(ends, single(bare)).when(F.substring(word, -1, 1) == F.substring(word, -2, 1), single(word)).otherwise(word)


def words(text: Column) -> Column:
    """The words of a text in lower case, in order: letters and digits of any script."""

    def cut(low: Column) -> Column:
        return F.when(F.length(low) == F.octet_length(low), F.split(low, "[^a-z0-9]+")).otherwise(F.split(low, r"[^\p{L}\p{N}]+"))  # the short expression for ASCII

    return F.array_remove(let(F.lower(F.coalesce(text, F.lit(""))), cut), "")


def terms(text: Column) -> Column:
    """Stems of the words that aren't stop words, in order."""
    return F.transform(F.filter(words(text), lambda w: ~w.isin(STOP_WORDS)), stem)


def index(rows: DataFrame, key: str, title: str | None, body: str) -> DataFrame:
    """(term, key, weight): the inverted index of rows, to be written once, partitioned or sorted by term."""
    parts = [(body, "B"), *([(title, "A")] if title else [])]
    said = reduce(DataFrame.unionByName, [rows.select(key, F.lit(WEIGHTS[w]).cast("decimal(18,2)").alias("w"), F.explode(words(F.col(c))).alias("word")) for c, w in parts])
    # words are stemmed as rows, by compiled code
    posted = said.where(~F.col("word").isin(STOP_WORDS)).select(stem(F.col("word")).alias("term"), key, "w")
    return posted.groupBy("term", key).agg(F.sum("w").cast("double").alias("weight"))


def search(postings: DataFrame, queries: DataFrame, key: str, query: str = "query", limit: int = 25) -> DataFrame:
    """(query_id, key, score, rank): for queries (query_id, query) the rows that hold every term, by the logarithms of their weights.

    Only the postings of the queries' terms are read; a query without terms finds nothing.
    """
    asked = queries.select("query_id", F.explode(F.array_distinct(terms(F.col(query)))).alias("term"))
    need = asked.groupBy("query_id").agg(F.count("*").alias("_need"))
    hits = postings.join(asked, "term").groupBy("query_id", key).agg(F.count("*").alias("_have"), F.round(F.sum(F.log1p("weight")), 6).alias("score"))
    whole = hits.join(need, "query_id").where("_have = _need")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), key)
    return whole.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= limit).select("query_id", key, "score", "rank")


def descend(rows: DataFrame, vector: list[float], levels: list[tuple[str, int, float]], key: str = "ref_id") -> DataFrame:
    """(level, ref_id, contract_id, similarity): the hits of each (level, hits, floor) in turn among rows (level, ref_id, contract_id, embedding); summaries narrow the contracts of the levels behind them, if they find any."""
    out, narrowed = None, None
    for level, hits, floor in levels:
        some = rows.where(F.col("level") == level)
        if narrowed is not None:
            some = some.join(narrowed, "contract_id", "left_semi")
        found = retrieval.knn(some, vector, hits, key, floor=floor).select("level", key, "contract_id", "similarity")
        if level == "document_summary":
            names = [r[0] for r in found.select("contract_id").distinct().collect()]  # at most so many as the level's hits
            narrowed = rows.sparkSession.createDataFrame([(n,) for n in names], rows.select("contract_id").schema) if names else None
        out = found if out is None else out.unionByName(found)
    return out


def deduplicated(hits: DataFrame, query: list[str] | None = None) -> DataFrame:
    """Hits (level, ref_id, score, source) once each, at their best score; a real hit's source wins over that of an expansion."""
    keys = [*(query or []), "level", "ref_id"]
    real = F.max(F.when(~F.col("source").isin("neighbour", "graph"), F.col("source"))).over(Window.partitionBy(*keys))
    return latest_per_key(hits.withColumn("source", F.coalesce(real, "source")), keys, F.desc("score"), F.asc("source"))


def neighbours_of(hits: DataFrame, chunks: DataFrame, window: int, seeds: int = 20) -> DataFrame:
    """(contract_id, reading_order, score): chunks beside the first hits (contract_id, reading_order, score, rank), at half the best seed's score, without what was hit."""
    offsets = F.array(*[F.lit(i) for i in range(-window, window + 1) if i])
    beside = hits.where(F.col("rank") <= seeds).select("contract_id", F.explode(F.transform(offsets, lambda i: F.col("reading_order") + i)).alias("reading_order"), "score")
    best = beside.groupBy("contract_id", "reading_order").agg((F.max("score") * retrieval.NEIGHBOUR_FACTOR).alias("score"))
    return best.join(chunks.select("contract_id", "reading_order"), ["contract_id", "reading_order"], "left_semi").join(hits.select("contract_id", "reading_order"), ["contract_id", "reading_order"], "left_anti")
