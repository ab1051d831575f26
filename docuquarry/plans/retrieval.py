"""Retrieval: filtered k-NN, keyword ranking, rank fusion, expansion and near-duplicate suppression."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.functions import vectors
from docuquarry.operators.folds import fold
from docuquarry.operators.steps import settled

#: Fixed values of the ranking: fusion constant, and factors of neighbours and of graph hits.
RRF_K, NEIGHBOUR_FACTOR, GRAPH_FACTOR = 60, 0.5, 0.4
#: Rows of a block in which many queries meet many rows, and scores of a block that are held at once.
BLOCK_ROWS, STRIP_SCORES = 4_096, 262_144
#: Counts of blocks are broadcast for at most so many values that rows and queries share.
MOST_VALUES = 400_000


def knn(rows: DataFrame, query: list[float], k: int, key: str, vector: str = "embedding", floor: float | None = None) -> DataFrame:
    """The k rows nearest by cosine, ties by key, with similarity at least floor. One projection and a top-k: nothing is shuffled but k rows a task."""
    q = F.array(*[F.lit(float(x)) for x in query])
    scored = rows.withColumn("similarity", vectors.cosine(F.col(vector), q))
    if floor is not None:
        scored = scored.where(F.col("similarity") >= floor)
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def _equals(term: str, word: Column) -> Column:
    return word == term


def best_of_block(names: np.ndarray, asked: np.ndarray, ids: np.ndarray, held: np.ndarray, k: int, floor: float | None = None, scope: Callable[[slice], np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(names, ids, scores) of each question's k best rows by inner product to nine places, ties by id, never the row of its own id.

    Questions are taken in strips, so that only STRIP_SCORES scores are held at once. scope says for a strip which rows
    each of its questions may see.
    """
    out, strip = [], max(1, STRIP_SCORES // max(1, len(ids)))
    for lo in range(0, len(names), strip):
        at = slice(lo, lo + strip)
        score = asked[at] @ held.T
        seen = names[at, None] != ids[None, :]
        if floor is not None:
            seen &= score >= floor
        if scope is not None:
            seen &= scope(at)
        if 0 < k < len(ids):  # what may be among the first k once rounded is sorted, no more
            shown = np.where(seen & ~np.isnan(score), score, -np.inf)
            seen &= ~(shown < np.partition(shown, len(ids) - k, axis=1)[:, len(ids) - k, None] - 2e-9)
        i, j = np.nonzero(seen)
        order = np.lexsort((ids[j], -np.round(score[i, j], 9), i))
        i, j = i[order], j[order]
        first = np.arange(len(i)) - np.searchsorted(i, i) < k
        i, j = i[first], j[first]
        out.append((names[at][i], ids[j], score[i, j]))
    return tuple(np.concatenate(c) for c in zip(*out, strict=True)) if out else (names[:0], ids[:0], np.zeros(0))


def knn_of(rows: DataFrame, queries: DataFrame, k: int, key: str, vector: str = "embedding", within: str | None = None, floor: float | None = None) -> DataFrame:
    """(query_id, key, similarity, rank): the k rows nearest by cosine to each of queries (query_id, vector), never the row of its own id, ties by key.

    within names a column of both: a query, which may stand in several rows, meets only rows of its values. floor is
    the least similarity. Queries and rows meet in blocks of about BLOCK_ROWS each, by an equality join on their
    numbers, and a block returns k rows a query. Rows without a vector are near to nothing.
    """
    kind = {} if within is None else {"_w": F.col(within)}
    held = rows.where(F.col(vector).isNotNull()).select(key, vector, *[c.alias(n) for n, c in kind.items()])
    asked = queries.where(F.col(vector).isNotNull()).select("query_id", F.col(vector).alias("_q"), *[c.alias(n) for n, c in kind.items()])
    sized = [df.groupBy(*kind).agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias(n)) for df, n in ((held, "_parts"), (asked, "_blocks"))]
    # what only one side has meets nothing, and without queries or rows nothing is dealt
    met = settled((sized[0].join(sized[1], "_w") if kind else sized[0].crossJoin(sized[1])).where("_parts > 0 AND _blocks > 0"))
    met = F.broadcast(met) if met.count() <= MOST_VALUES else met

    def dealt(df: DataFrame, own: str, name: str, number: str, others: str, other: str) -> DataFrame:
        """df in blocks by its own number, each as often as the other side has blocks."""
        both = df.join(met, "_w") if kind else df.crossJoin(met)
        return both.withColumn(number, F.pmod(F.xxhash64(own), F.col(name)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.col(others) - 1))).drop(name, others)

    left, right = dealt(asked, "query_id", "_blocks", "_b", "_parts", "_p"), dealt(held, key, "_parts", "_p", "_blocks", "_b")

    def near(questions: pd.DataFrame, some: pd.DataFrame) -> pd.DataFrame:
        if not len(questions) or not len(some):
            return pd.DataFrame({"query_id": [], key: [], "similarity": []})
        x, q = (np.stack(v.to_numpy()).astype(np.float64) for v in (some[vector], questions["_q"]))
        x, q = (v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-300) for v in (x, q))
        found = best_of_block(questions["query_id"].to_numpy(), q, some[key].to_numpy(), x, k, floor)
        return pd.DataFrame(dict(zip(("query_id", key, "similarity"), found, strict=True)))

    kinds, by = dict(rows.dtypes), [*kind, "_p", "_b"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(near, f"query_id {dict(queries.dtypes)['query_id']}, `{key}` {kinds[key]}, similarity double")
    w = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), key)
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def keyword_rank(rows: DataFrame, terms: list[str], key: str, limit: int, text: str = "text") -> DataFrame:
    """Rows that hold every term as a whole word, by the logarithm of its uses over that of the text's words."""
    words = F.split(F.lower(F.col(text)), r"[^\p{L}\p{N}]+")
    uses = [F.size(F.filter(words, partial(_equals, t.lower()))) for t in terms]
    score = sum((F.log1p(u.cast("double")) for u in uses), F.lit(0.0)) / F.log1p(F.size(words).cast("double") + 1)
    held = rows.withColumn("score", score)
    for u in uses:
        held = held.where(u > 0)
    return held.orderBy(F.desc("score"), key).limit(limit)


def ranked(df: DataFrame, score: Column, key: str, by: list[str] | None = None) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*(by or [])).orderBy(score.desc(), key)))


def fuse(legs: dict[str, DataFrame], key: str, limit: int) -> DataFrame:
    """Reciprocal rank fusion of ranked legs (key, rank): sum of 1 / (60 + rank), source fused where several legs hold the key."""
    rows = None
    for name, leg in legs.items():
        one = leg.select(key, F.lit(name).alias("leg"), (1.0 / (RRF_K + F.col("rank"))).alias("part"))
        rows = one if rows is None else rows.unionByName(one)
    source = F.when(F.count("*") > 1, "fused").otherwise(F.min("leg"))
    return rows.groupBy(key).agg(F.sum("part").alias("score"), source.alias("source")).orderBy(F.round("score", 12).desc(), key).limit(limit)


def suppress_near_duplicates(evidence: DataFrame, query: str, order: str, shingle_column: str, threshold: float = 0.8) -> DataFrame:
    """Greedy per query: a row goes when a kept one contains threshold of the smaller shingle set; rows without shingles stay and drop nothing. Groups are a query's evidence, a bounded list."""
    cols = evidence.select(query, order, shingle_column, *[c for c in evidence.columns if c not in (query, order, shingle_column)])

    def first_of_kind(rows: list[tuple]) -> list[tuple]:
        kept: list[tuple[frozenset, tuple]] = []
        for row in rows:
            s = frozenset(row[2] or ())
            if not s or not any(t and len(s & t) / min(len(s), len(t)) >= threshold for t, _ in kept):
                kept.append((s, row))
        return [row for _, row in kept]

    return fold(cols, [order], first_of_kind, ", ".join(f"`{c}` {k}" for c, k in cols.dtypes)).select(evidence.columns)
