"""Exact top-k inner-product search over an impact-ordered index, processed score at a time.

Components are integers floor(scale * x). Candidates are dealt into cells of bounded size, and each
cell is indexed once: its non-zero entries become posting segments, one for each dimension and each
quantised impact (the power of two of |x|), stored in descending impact. A block of queries takes up
the segments of one impact after another. What a score may still gain or lose is bounded by the
lengths of the query and of the candidate's entries left, so a candidate whose upper bound is below a
k-th score that is already certain is proved out; once few possible members are left, or no segment,
they are rescored exactly from whole numbers.

The certain k-th score of a query comes from one seed cell that all queries search first, so the
other cells stop early. Every query block meets every cell by an equality join on the cell's number;
an index is never copied for a query, only for each QUERY_PART of them.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.llm.runtime import materialize, small_side

#: Queries scored at a time, and those that share one copy of a cell's index (fewer in the seed round).
QUERY_BLOCK, QUERY_PART, SEED_PART = 128, 65_536, 1_024
#: Most rows and bytes of a cell, and least rows, below which a cell isn't worth its own index.
CELL_ROWS, CELL_BYTES, LEAST_ROWS = 32_768, 8 << 20, 1_024
#: Cells for each core, at least, where the rows allow: a small table still uses the executors.
CELLS = 2
#: Share of a block's pairs that may be left for exact rescoring before its segments are used up.
RESCORE_SHARE = 0.01
#: Relative allowance for the rounding of sums of doubles, which is at most width * 2^-53.
ROUNDING = 1e-9
_INT = pa.int64()
_INDEX = "n int, w int, ids binary, rows binary, vals binary, small int, heads binary"


def build_index(ids: np.ndarray, x: np.ndarray) -> dict:
    """The posting segments of vectors x (whole numbers), rows in the order of ids.

    rows and vals: the non-zero entries by impact descending, dimension and row; heads: (impact,
    dimension, start) of every segment.
    """
    order = np.argsort(ids, kind="stable")
    ids, x = ids[order], x[order]
    row, dim = np.nonzero(x)
    val = x[row, dim]
    impact = np.frexp(np.abs(val.astype(np.float64)))[1]
    by = np.lexsort((row, dim, -impact))
    row, dim, val, impact = row[by], dim[by], val[by], impact[by]
    new = np.ones(len(row), bool)
    new[1:] = (impact[1:] != impact[:-1]) | (dim[1:] != dim[:-1])
    start = np.flatnonzero(new)
    heads = np.column_stack([impact[start], dim[start], start]).astype(np.int64)
    small = int(not len(val) or np.abs(val).max() < 1 << 31)
    return {"n": len(ids), "w": x.shape[1], "ids": ids, "rows": row.astype(np.int32), "vals": val.astype(np.int32 if small else np.int64), "small": small, "heads": heads}


class Cell:
    """A cell's index, ready for query blocks."""

    def __init__(self, index: dict):
        self.ids, self.rows, self.heads = index["ids"], index["rows"], index["heads"]
        self.vals = index["vals"].astype(np.int64)
        self.ends = np.append(self.heads[1:, 2], len(self.rows))
        self.x = np.zeros((index["n"], index["w"]), np.int64)
        dim = np.repeat(self.heads[:, 1], self.ends - self.heads[:, 2])
        self.x[self.rows, dim] = self.vals
        self.floats = self.vals.astype(np.float64)
        # lengths of the entries that are left below each impact, summed upwards from the least one
        self.rest, left = {}, np.zeros(index["n"])
        for impact in np.unique(self.heads[:, 0]).tolist():
            self.rest[impact] = np.sqrt(left)
            for i in np.flatnonzero(self.heads[:, 0] == impact).tolist():
                part = slice(self.heads[i, 2], self.ends[i])
                left[self.rows[part]] += self.floats[part] ** 2
        self.length = np.sqrt(left)

    def search(self, q_ids: np.ndarray, q: np.ndarray, known: np.ndarray, k: int) -> list[tuple[int, int, list[int]]]:
        """(query's place, candidate's id, score) of the members of each query's k best that reach known, its certain k-th score (-inf: none).

        Highest score first, then smallest id; never a candidate with the query's own id.
        """
        n, width = self.x.shape
        qf = q.astype(np.float64)
        reach = np.sqrt((qf**2).sum(1))
        own = [slice(a, b) for a, b in zip(np.searchsorted(self.ids, q_ids), np.searchsorted(self.ids, q_ids, "right"), strict=True)]
        part = np.zeros((n, len(q_ids)))
        slack = ROUNDING * np.outer(self.length, reach)
        floor = known - ROUNDING * np.abs(np.where(np.isfinite(known), known, 0))
        alive = np.ones((n, len(q_ids)), bool)
        top, at = min(k, n), 0
        while at < len(self.heads):
            impact = self.heads[at, 0]
            while at < len(self.heads) and self.heads[at, 0] == impact:
                some = slice(self.heads[at, 2], self.ends[at])
                part[self.rows[some]] += self.floats[some, None] * qf[:, self.heads[at, 1]]
                at += 1
            gain = np.outer(self.rest[impact], reach) + slack
            least = floor
            if not np.isfinite(known).all():
                low = part - gain
                for i, mine in enumerate(own):
                    low[mine, i] = -np.inf
                least = np.maximum(floor, np.partition(low, n - top, axis=0)[n - top])
            alive = part + gain >= least
            for i, mine in enumerate(own):
                alive[mine, i] = False
            if alive.mean() <= RESCORE_SHARE:
                break
        if not len(self.heads):
            for i, mine in enumerate(own):
                alive[mine, i] = False
        safe = width * float(np.abs(self.x).max(initial=0)) * float(np.abs(qf).max(initial=0)) < 2.0**62
        out = []
        for i in range(len(q_ids)):
            m = np.flatnonzero(alive[:, i])
            s = self.x[m] @ q[i] if safe else self.x[m].astype(object) @ q[i].astype(object)
            if safe:
                best = np.lexsort((self.ids[m], -s))[:k].tolist()
            else:
                best = sorted(range(len(m)), key=lambda j: (-s[j], self.ids[m[j]]))[:k]
            out.append((i, [int(self.ids[m[j]]) for j in best], [max(-(1 << 63), min((1 << 63) - 1, int(s[j]))) for j in best]))
        return out


def _vectors(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(width, places, matrix) of the vectors of a list column, by width."""
    column = batch.column(at)
    widths = np.diff(column.offsets.to_numpy())
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    begin = np.concatenate([[0], np.cumsum(widths)[:-1]]).astype(np.int64)
    for w in np.unique(widths).tolist():
        here = np.flatnonzero(widths == w)
        yield w, here, flat[begin[here][:, None] + np.arange(w)[None, :]].reshape(len(here), w)


def _index_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cell, w, id, vec) sorted by (cell, w) to one index for each run of them, cut at CELL_ROWS."""
    held: list[tuple[np.ndarray, np.ndarray]] = []
    key = None

    def settle() -> pa.RecordBatch:
        index = build_index(np.concatenate([i for i, _ in held]), np.concatenate([x for _, x in held]))
        blob = lambda name: pa.array([index[name].tobytes()], pa.binary())
        one = lambda v: pa.array([v], pa.int32())
        return pa.RecordBatch.from_arrays([one(key[0]), one(index["n"]), one(index["w"]), blob("ids"), blob("rows"), blob("vals"), one(index["small"]), blob("heads")], ["cell", "n", "w", "ids", "rows", "vals", "small", "heads"])

    for batch in batches:
        cells, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for w, here, x in _vectors(batch, 3):
            for cell in np.unique(cells[here]).tolist():
                mine = cells[here] == cell
                if held and (key != (cell, w) or sum(len(i) for i, _ in held) >= CELL_ROWS):
                    yield settle()
                    held = []
                key = (cell, w)
                held.append((ids[here[mine]], x[mine]))
    if held:
        yield settle()


def _pack_queries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, uid, id, vec, known) to blocks of at most QUERY_BLOCK queries of one part and width."""
    for batch in batches:
        parts, uids, ids, known = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1, 2, 4))
        for w, here, x in _vectors(batch, 3):
            for p in np.unique(parts[here]).tolist():
                mine = np.flatnonzero(parts[here] == p)
                for a in range(0, len(mine), QUERY_BLOCK):
                    m = mine[a : a + QUERY_BLOCK]
                    small = int(not x[m].size or np.abs(x[m]).max() < 1 << 31)
                    cols = [uids[here[m]].astype(np.int64), ids[here[m]].astype(np.int64), x[m].astype(np.int32 if small else np.int64), known[here[m]].astype(np.float64)]
                    yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32()), pa.array([len(m)], pa.int32()), pa.array([w], pa.int32()), pa.array([small], pa.int32()), *[pa.array([c.tobytes()], pa.binary()) for c in cols]], ["part", "n", "w", "small", "uids", "q_ids", "q_vecs", "known"])


def _meet(k: int):
    """Units of rows sorted by (w, cell, part, kind): a cell's index (kind 0, several if it was cut), then its query blocks (kind 1)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, cells = None, []
        for batch in batches:
            for r in (row for i in range(len(batch)) for row in batch.slice(i, 1).to_pylist()):
                if key != (r["w"], r["cell"], r["part"]):
                    key, cells = (r["w"], r["cell"], r["part"]), []
                ints = np.int32 if r["small"] else np.int64
                if r["kind"] == 0:
                    index = {"n": r["n"], "w": r["w"], "ids": np.frombuffer(r["a"], np.int64), "rows": np.frombuffer(r["b"], np.int32), "vals": np.frombuffer(r["c"], ints), "heads": np.frombuffer(r["d"], np.int64).reshape(-1, 3)}
                    cells.append(Cell(index))
                    continue
                uids, q_ids, known = (np.frombuffer(r[c], t) for c, t in (("a", np.int64), ("b", np.int64), ("d", np.float64)))
                q = np.frombuffer(r["c"], ints).astype(np.int64).reshape(r["n"], r["w"])
                found = [(uids[i], q_ids[i], c, s) for cell in cells for i, cs, ss in cell.search(q_ids, q, known, k) for c, s in zip(cs, ss, strict=True)]
                cols = list(zip(*found, strict=True)) if found else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, _INT) for c in cols], ["uid", "query_id", "vec_id", "score"])

    return run


def integer_vectors(df: DataFrame, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(id, vec) of the rows whose vector has only finite components, each floor(scale * x) as a whole number.

    Components beyond the range of long count as its ends.
    """
    vec = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).filter("id IS NOT NULL AND vec IS NOT NULL")
    sound = F.forall("vec", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    return rows.filter(sound).select("id", F.transform("vec", lambda x: F.floor(F.greatest(F.least(x * scale, F.lit(9.2e18)), F.lit(-9.2e18)))).alias("vec"))


def _round(index: DataFrame, queries: DataFrame, cells: list[int] | int, part_size: int, n_queries: int, k: int, units: int) -> DataFrame:
    """(uid, query_id, vec_id, score): what each query (uid, id, vec, known) finds in each of the cells."""
    n_parts = max(1, -(-n_queries // part_size))
    part = F.pmod(F.xxhash64("uid"), F.lit(n_parts)).cast("int")
    blocks = queries.select(part.alias("part"), "uid", "id", "vec", "known").repartition(max(1, min(units, n_queries // QUERY_BLOCK)), "part", F.pmod("uid", F.lit(max(1, part_size // QUERY_BLOCK))))
    blocks = blocks.mapInArrow(_pack_queries, "part int, n int, w int, small int, uids binary, q_ids binary, q_vecs binary, known binary")
    every = F.sequence(F.lit(0), F.lit(cells - 1)) if isinstance(cells, int) else F.array(*map(F.lit, cells))
    asked = blocks.select(F.explode(every).alias("cell"), "part", "w", F.lit(1).alias("kind"), "n", "small", F.col("uids").alias("a"), F.col("q_ids").alias("b"), F.col("q_vecs").alias("c"), F.col("known").alias("d"))
    dealt = index.select("cell", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))).alias("part"), "w", F.lit(0).alias("kind"), "n", "small", F.col("ids").alias("a"), F.col("rows").alias("b"), F.col("vals").alias("c"), F.col("heads").alias("d"))
    met = dealt.unionByName(asked).repartition(units, "w", "cell", "part").sortWithinPartitions("w", "cell", "part", "kind")
    return met.mapInArrow(_meet(k), "uid long, query_id long, vec_id long, score long")


def exact_top_k(df: DataFrame, k: int = 5, every: int = 50, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best of all other rows for each row whose id is divisible by every.

    Vectors that are null or hold a null or non-finite component take no part, nor do null ids; vectors
    of different widths aren't compared; empty vectors score 0 with each other. Ties go to the smaller
    id. Rows that share an id are each a candidate of other queries, and a query finds no row with its
    own id; query rows that share an id have a ranking each, so that every rank stands as often as such
    rows do. Scores beyond the range of long count as its ends. An empty table has an empty result;
    other columns are ignored.
    """
    vectors = materialize(integer_vectors(df, scale, id_col, vec_col).withColumn("uid", F.monotonically_increasing_id()), "vectors")
    counts = vectors.agg(F.count("*").alias("n"), F.count_if(F.col("id") % every == 0).alias("q"), F.coalesce(F.max(F.size("vec")), F.lit(0)).alias("w")).first()
    most = max(LEAST_ROWS, min(CELL_ROWS, CELL_BYTES // max(1, 8 * counts.w)))
    n_cells = max(1, -(-counts.n // most), min(CELLS * df.sparkSession.sparkContext.defaultParallelism, counts.n // LEAST_ROWS))
    cell = F.pmod(F.xxhash64("uid"), F.lit(n_cells)).cast("int")
    dealt = vectors.select(cell.alias("cell"), F.size("vec").alias("w"), "id", "vec").repartition(n_cells, "cell").sortWithinPartitions("cell", "w")
    index = materialize(dealt.mapInArrow(_index_cells, "cell int, " + _INDEX), "index")
    queries = vectors.filter(F.col("id") % every == 0)
    first = _round(index.filter("cell = 0"), queries.withColumn("known", F.lit(float("-inf"))), [0], SEED_PART, counts.q, k, max(1, counts.q // SEED_PART))
    # a query's k-th score in the seed cell, if it has as many there, is certain
    scores = F.sort_array(F.collect_list("score"), asc=False)
    seeds = materialize(first.groupBy("uid").agg(scores.alias("s")).filter(F.size("s") >= k).select("uid", F.col("s")[k - 1].cast("double").alias("known")), "seeds")
    bounded = queries.join(small_side(seeds, counts.q), "uid", "left").withColumn("known", F.coalesce("known", F.lit(float("-inf"))))
    n_units = n_cells * max(1, -(-counts.q // QUERY_PART))
    hits = _round(index, bounded, n_cells, QUERY_PART, counts.q, k, n_units)
    ranked = hits.withColumn("rank", F.row_number().over(Window.partitionBy("uid").orderBy(F.desc("score"), "vec_id")))
    return ranked.filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
