"""Exact nearest neighbours over a partitioned vector index: cells round centres, pruned by a distance bound.

Rows lie in the cell of their nearest centre, by the distance of unit vectors, which falls as cosine
rises. No row of a cell is nearer to a question than the centre's distance less the cell's radius, so once
k rows of one cell are known, only cells whose bound is within the k-th distance are read: the result is
that of a full scan. Filters on columns act before anything is compared, so the bound holds for what they leave.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.operators.steps import settled
from docuquarry.plans.retrieval import best_of_block

#: Rows that centres are fitted on at most (the first by a hash of the key), rounds of fitting, and most centres.
SAMPLE_ROWS, ROUNDS, MOST_CENTRES = 8_192, 10, 1_024
#: Rows and questions that meet in one group.
BLOCK_ROWS = 4_096
_SLACK = 1e-6


def _unit(vectors) -> np.ndarray:
    x = np.stack([np.asarray(v, np.float64) for v in vectors])
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _usable(vector: str) -> Column:
    """Vectors with a direction: not null, finite, and some component not 0."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x)) & F.exists(vector, lambda x: x != 0), F.lit(False))


def fit_centres(rows: DataFrame, key: str, vector: str = "embedding", n_centres: int = 64, seed: int = 3) -> np.ndarray:
    """Unit centres of a bounded sample, by rounds of assignment and mean; they decide how much is read, never what is found."""
    if not 0 < n_centres <= MOST_CENTRES:
        raise ValueError(f"1 to {MOST_CENTRES} centres")
    got = rows.where(_usable(vector)).orderBy(F.xxhash64(F.lit(seed), key), key).select(vector).limit(SAMPLE_ROWS).collect()
    if not got:
        return np.zeros((0, 0))
    x = _unit([r[0] for r in got])
    centres = x[np.random.default_rng(seed).permutation(len(x))[:n_centres]].copy()
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(axis=1)
        for c in np.unique(nearest):
            centres[c] = x[nearest == c].mean(axis=0)
        centres = _unit(centres)
    return centres


def assign(rows: DataFrame, centres: np.ndarray, vector: str = "embedding") -> DataFrame:
    """rows with cell and far, the distance to its centre; rows whose vector has no direction are left out, as they are near to nothing.

    Write the result partitioned by what searches filter on (level, model) and by cell.
    """
    shared = rows.sparkSession.sparkContext.broadcast(centres)

    def placed(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                yield pd.DataFrame({"cell": np.zeros(0, np.int32), "far": np.zeros(0)})
                continue
            cos = _unit(batch) @ shared.value.T
            cell = cos.argmax(axis=1)
            yield pd.DataFrame({"cell": cell.astype(np.int32), "far": np.sqrt(np.maximum(0.0, 2 - 2 * cos[np.arange(len(cell)), cell]))})

    put = F.pandas_udf(placed, "cell int, far double")
    kept = rows.where(_usable(vector))
    return kept.withColumn("_at", put(F.col(vector))).withColumns({"cell": F.col("_at.cell"), "far": F.col("_at.far")}).drop("_at")


def _distances(centres: np.ndarray, asked: DataFrame) -> DataFrame:
    """(query_id, cell, gap): the distance of each question to each centre, of which there are at most MOST_CENTRES."""
    shared = asked.sparkSession.sparkContext.broadcast(centres)

    def gaps(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(list(np.sqrt(np.maximum(0.0, 2 - 2 * (_unit(batch) @ shared.value.T))))) if len(batch) else pd.Series([], dtype=object)

    return asked.select("query_id", F.posexplode(F.pandas_udf(gaps, "array<double>")("_q")).alias("cell", "gap"))


def _meet(index: DataFrame, visits: DataFrame, cells: DataFrame, asked: DataFrame, n_asked: int, k: int, key: str, vector: str, match: dict[str, str], floor: float | None) -> DataFrame:
    """(query_id, key, similarity) of the k nearest rows of each visited part of a cell; rows and questions meet in blocks of about BLOCK_ROWS each."""
    blocks = max(1, -(-n_asked // BLOCK_ROWS))
    sized = cells.select("cell", F.ceil(F.col("rows") / BLOCK_ROWS).cast("int").alias("_parts"))
    going = visits.select("query_id", "cell").join(sized, "cell").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumn("_b", F.pmod(F.xxhash64("query_id"), F.lit(blocks)))
    asking = going.join(asked, "query_id").select(F.col("cell").alias("_c"), F.col("_part").alias("_p"), F.col("_b").alias("_block"), "query_id", "_q", *match.values())
    wanted = going.select("cell", "_part", "_b").distinct()
    dealt = index.join(sized, "cell").withColumn("_part", F.pmod(F.xxhash64(key), F.col("_parts")).cast("int")).select("cell", "_part", key, vector, *match).join(wanted, ["cell", "_part"])
    kinds = dict(index.dtypes)

    def near(rows: pd.DataFrame, questions: pd.DataFrame) -> pd.DataFrame:
        names, ids = questions["query_id"].to_numpy(), rows[key].to_numpy()
        if not len(names) or not len(ids):
            return pd.DataFrame({"query_id": [], key: [], "similarity": []})

        def scope(at: slice) -> np.ndarray:
            allowed = np.ones((len(names[at]), len(ids)), bool)
            for column, of in match.items():
                values, within = rows[column].to_numpy(), {}
                for i, wanted in enumerate(questions[of].iloc[at]):
                    if wanted is not None:
                        kinds = tuple(wanted)
                        if kinds not in within:  # questions that share a filter test the rows once
                            within[kinds] = np.isin(values, list(kinds))
                        allowed[i] &= within[kinds]
            return allowed

        found = best_of_block(names, _unit(questions["_q"]), ids, _unit(rows[vector]), k, floor, scope if match else None)
        return pd.DataFrame(dict(zip(("query_id", key, "similarity"), found, strict=True)))

    grouped = dealt.groupBy("cell", "_part", "_b").cogroup(asking.groupBy("_c", "_p", "_block"))
    return grouped.applyInPandas(near, f"query_id {dict(asked.dtypes)['query_id']}, `{key}` {kinds[key]}, similarity double")


def nearest(index: DataFrame, centres: np.ndarray, queries: DataFrame, k: int, key: str, vector: str = "embedding", where: Column | None = None, match: dict[str, str] | None = None, floor: float | None = None) -> DataFrame:
    """(query_id, key, similarity, rank, cells_read): the k rows of index nearest by cosine to each of queries (query_id, vector), ties by key.

    where filters rows for all questions (columns that the index is partitioned by are pruned when it is
    read); match maps a column of rows to a column of queries, an array of the values that a question may
    see (null: any; empty: none). floor is the least similarity. A question never finds the row of its own id.
    """
    match = match or {}
    rows = index if where is None else index.where(where)
    # read by both rounds: the questions, a row a cell, and each question's first hits
    asked = settled(queries.where(_usable(vector)).select("query_id", F.col(vector).alias("_q"), *match.values()))
    cells = settled(rows.groupBy("cell").agg(F.count("*").alias("rows"), F.max("far").alias("radius")))
    gaps = _distances(centres, asked).join(cells, "cell")  # cells without rows aren't visited
    nearest_first = Window.partitionBy("query_id").orderBy("gap", "cell")
    ordered = gaps.withColumn("_n", F.row_number().over(nearest_first))
    n = asked.count()
    seeds = settled(_meet(rows, ordered.where("_n = 1"), cells, asked, n, k, key, vector, match, floor))
    by_rank = Window.partitionBy("query_id").orderBy(F.round("similarity", 9).desc(), key)
    kth = seeds.withColumn("_r", F.row_number().over(by_rank)).where(F.col("_r") == k).select("query_id", F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("_kth"))
    # below the floor nothing counts, so cells beyond its distance aren't read either
    least = F.lit(3.0) if floor is None else F.lit(float(np.sqrt(max(0.0, 2 - 2 * floor))))
    visits = ordered.where("_n > 1").join(kth, "query_id", "left").where(F.col("gap") - F.col("radius") <= F.least(F.coalesce("_kth", F.lit(3.0)), least) + _SLACK)
    found = seeds.unionByName(_meet(rows, visits, cells, asked, n, k, key, vector, match, floor))
    read = visits.groupBy("query_id").agg((F.count("*") + 1).alias("cells_read"))
    ranked = found.withColumn("rank", F.row_number().over(by_rank)).where(F.col("rank") <= k)
    return ranked.join(read, "query_id", "left").withColumn("cells_read", F.coalesce("cells_read", F.lit(1)).cast("long"))
