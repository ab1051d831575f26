"""Factorisation machines over hashed words, hashed word beginnings and structure statistics of a text.

score = sigmoid(b + sum_i w_i x_i + sum_{i<j} <v_i, v_j> x_i x_j); the pair sum is taken in linear
time as half of (sum_i v_i x_i)^2 - sum_i (v_i x_i)^2 over the factors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuquarry.llm import textkit as tk
from docuquarry.llm.runtime import BROADCAST_ROWS, forget, materialize

#: Labelled rows of each class that a fit reads at most, and bytes of their distinct terms together.
SAMPLE_ROWS, SAMPLE_BYTES = 3_000, 128 << 20
#: Hashed features: words in the lower half of the buckets, word beginnings in the upper.
BITS = 19
HALF = 1 << (BITS - 1)
#: Bytes of a word beginning.
STEM = 5
N_STATS = 13
_CLASS = {
    "upper": range(0x41, 0x5B), "lower": range(0x61, 0x7B), "digit": range(0x30, 0x3A), "bang": b"!", "pipe": b"|",
    "symbol": b"#$%&*@~^_=+<>{}[]\\/", "stop": b".,;:?'\"()-", "line": b"\n", "space": b" \t\r\x0b\x0c", "wide": range(0x80, 0x100),
}
_CODE = np.full(256, len(_CLASS), np.uint8)
for _i, _b in enumerate(_CLASS.values()):
    _CODE[list(_b)] = _i


def features(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every word and word beginning, repeats included, and N_STATS statistics of each document."""
    n_docs, k = len(off) - 1, len(_CLASS) + 1
    low = tk.LOWER[buf]
    start, end, doc = tk.words(low, off, tk.ALNUM)
    pre = tk.prefix(low)
    h = tk.span_hash(pre, start, end)
    stem = tk.span_hash(pre, start, np.minimum(end, start + STEM))
    half = np.uint64(HALF - 1)
    bucket = np.concatenate([(h & half).astype(np.int64), (stem & half).astype(np.int64) + HALF])

    at = np.repeat(np.arange(n_docs, dtype=np.int64) * k, np.diff(off))
    kinds = np.bincount(at + _CODE[buf], minlength=n_docs * k).reshape(n_docs, k)
    share = kinds / np.maximum(np.diff(off), 1)[:, None]
    n_words = np.bincount(doc, minlength=n_docs)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    again = np.bincount(doc[same], minlength=n_docs) / np.maximum(n_words, 1)
    width = np.bincount(doc, end - start, minlength=n_docs) / np.maximum(n_words, 1)
    per_line = n_words / (kinds[:, 7] + 1)
    stats = np.column_stack([np.log1p(n_words), again, width, np.log1p(per_line), kinds[:, 0] / np.maximum(kinds[:, 0] + kinds[:, 1], 1), share[:, [2, 3, 4, 5, 6, 7, 8, 9]]])
    return np.concatenate([doc, doc]), bucket, stats


@dataclass
class Machine:
    slot: np.ndarray  # bucket -> feature, or -1
    edges: np.ndarray  # N_STATS x bins - 1: inner edges of the statistics' bins
    n_terms: int
    b: float
    w: np.ndarray
    v: np.ndarray

    def inputs(self, doc: np.ndarray, bucket: np.ndarray, stats: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (document, feature) pairs with value 1."""
        s = self.slot[bucket]
        keep = s >= 0
        width = len(self.w)
        codes = np.unique(doc[keep] * width + s[keep])
        n, m = stats.shape
        bins = np.column_stack([np.searchsorted(self.edges[j], stats[:, j], "right") for j in range(m)])
        place = self.n_terms + np.arange(m) * (self.edges.shape[1] + 1) + bins
        return np.concatenate([codes // width, np.repeat(np.arange(n), m)]), np.concatenate([codes % width, place.ravel()])

    def score(self, doc: np.ndarray, bucket: np.ndarray, stats: np.ndarray) -> np.ndarray:
        d, f = self.inputs(doc, bucket, stats)
        n = len(stats)
        out = self.b + np.bincount(d, self.w[f], minlength=n)
        for k in range(self.v.shape[1]):
            x = self.v[f, k]
            out += 0.5 * (np.bincount(d, x, minlength=n) ** 2 - np.bincount(d, x * x, minlength=n))
        return 1 / (1 + np.exp(-np.clip(out, -30, 30)))


def train(docs: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, weight: np.ndarray, n_terms: int, use_terms: float, factors: int = 6, steps: int = 160, rate: float = 0.04, decay: float = 2e-3, bins: int = 8, seed: int = 7) -> Machine:
    """docs: distinct buckets and statistics of each; weight: of each row, mean 1. Full-batch Adam on logistic loss.

    Terms are the n_terms buckets, in use_terms of the rows at least, whose classes differ most.
    """
    n = len(docs)
    lens = np.array([len(b) for b, _ in docs])
    row, bucket = np.repeat(np.arange(n), lens), np.concatenate([b for b, _ in docs]).astype(np.int64)
    stats = np.array([s for _, s in docs])
    size = 1 << BITS
    pos = np.bincount(bucket, (weight * y)[row], minlength=size) + 0.5
    neg = np.bincount(bucket, (weight * (1 - y))[row], minlength=size) + 0.5
    have = np.bincount(bucket, minlength=size)
    p, q = pos / ((weight * y).sum() + 1), neg / ((weight * (1 - y)).sum() + 1)
    gain = np.where(have >= max(3, use_terms * n), np.abs(p - q) * np.abs(np.log(p / q)), 0)
    best = np.argsort(-gain, kind="stable")[:n_terms]
    best = best[gain[best] > 0]
    slot = np.full(size, -1, np.int32)
    slot[best] = np.arange(len(best))
    edges = np.array([np.quantile(stats[:, j], np.linspace(0, 1, bins + 1)[1:-1]) for j in range(stats.shape[1])])
    width = len(best) + stats.shape[1] * bins
    rng = np.random.default_rng(seed)
    m = Machine(slot, edges, len(best), float(np.log(((weight * y).sum() + 1) / ((weight * (1 - y)).sum() + 1))), np.zeros(width), rng.normal(0, 0.02, (width, factors)))
    d, f = m.inputs(row, bucket, stats)
    x = np.zeros((n, width), np.float32)
    x[d, f] = 1
    params = [np.zeros(1, np.float32), m.w.astype(np.float32), m.v.astype(np.float32)]
    one, two = [np.zeros_like(a) for a in params], [np.zeros_like(a) for a in params]
    g_of = (weight / n).astype(np.float32)
    for t in range(1, steps + 1):
        db, w, v = params
        xv = x @ v
        z = m.b + db + x @ w + 0.5 * ((xv**2).sum(1) - x @ (v**2).sum(1))
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y).astype(np.float32) * g_of
        xg = x.T @ g
        grads = [g.sum(keepdims=True), xg + decay / width * w, x.T @ (g[:, None] * xv) - v * xg[:, None] + decay / width * v]
        for i, grad in enumerate(grads):
            one[i] = 0.9 * one[i] + 0.1 * grad
            two[i] = 0.999 * two[i] + 0.001 * grad**2
            params[i] = params[i] - rate * (one[i] / (1 - 0.9**t)) / (np.sqrt(two[i] / (1 - 0.999**t)) + 1e-8)
    m.b += float(params[0][0])
    m.w, m.v = params[1].astype(np.float64), params[2].astype(np.float64)
    return m


def _sample_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = tk.buffers(batch.column(1))
        for a, b in tk.slices(off):
            doc, bucket, stats = features(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            codes = np.unique((doc << BITS) | bucket)
            cut = np.searchsorted(codes >> BITS, np.arange(b - a + 1))
            terms = (codes & ((1 << BITS) - 1)).astype(np.uint32)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), pa.array([terms[i:j].tobytes() for i, j in zip(cut[:-1], cut[1:], strict=True)], pa.binary()), pa.array([s.tobytes() for s in stats], pa.binary())],
                ["y", "terms", "stats"],
            )


def _bounded(read: DataFrame, most_rows: int) -> list:
    """The rows of read (y, terms, stats), or of each class the first by a hash as far as most_rows and, together, SAMPLE_BYTES go; rows of one hash are alike."""
    n, size = read.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("terms")), F.lit(0))).first()
    if n <= most_rows and size <= SAMPLE_BYTES:
        return read.collect()
    order = F.xxhash64(F.lit(13), "terms", "stats", "y")
    of = {y: read.filter(F.col("y") == y) for y in (0, 1)}
    sizes = sorted((r[0], y, r[1]) for y in of for r in of[y].select(order.alias("_h"), F.octet_length("terms")).orderBy("_h").limit(most_rows // 2).collect())
    fits = np.cumsum([n for *_, n in sizes]) <= SAMPLE_BYTES
    return [r for y in of for r in of[y].orderBy(order).limit(sum(1 for (_, c, _), ok in zip(sizes, fits, strict=True) if ok and c == y)).collect()]


def fit(docs: DataFrame, labels: DataFrame, label_col: str, learn: str, n_terms: int, use_terms: float = 0.0, sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> Machine | None:
    """A machine learnt from at most sample_rows labelled rows of each class for which the SQL condition learn holds.

    Ids with null or several different labels aren't used; of rows that share an id each is a row of the
    sample, which has at most 2 * sample_rows rows. The sample is the first rows by a seeded hash of the id,
    as far as their distinct terms fit SAMPLE_BYTES; weights restore the classes' shares. None without any label of either class. Null and
    empty texts count as texts without words; columns but the three named aren't read.
    """
    if sample_rows > BROADCAST_ROWS // 2:
        raise ValueError("the sample is broadcast")
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(learn)
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).filter("y = _most").drop("_most")
    counts = dict(marked.groupBy("y").count().collect())
    if len(counts) < 2:
        return None
    chosen = [r for y in (0, 1) for r in marked.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(11), "doc_id"), "doc_id").limit(sample_rows).collect()]
    sample = docs.sparkSession.createDataFrame([tuple(r) for r in chosen], marked.schema)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id").select("y", "text")
    read = materialize(rows.mapInArrow(_sample_features, "y int, terms binary, stats binary"), "sample")
    got = _bounded(read, 2 * sample_rows)
    forget(read)
    y = np.array([r.y for r in got], np.float64)
    if not 0 < y.sum() < len(y):
        return None
    weight = np.where(y == 1, counts[1] / y.sum(), counts[0] / (len(y) - y.sum()))
    order = sorted(range(len(got)), key=lambda i: (got[i].y, bytes(got[i].terms), bytes(got[i].stats)))
    parts = [(np.frombuffer(got[i].terms, np.uint32), np.frombuffer(got[i].stats, np.float64)) for i in order]
    return train(parts, y[order], (weight / weight.mean())[order], n_terms, use_terms)


def score(docs: DataFrame, machine: Machine | None, prior: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, score) of every row; prior for all without a machine."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            buf, off = tk.buffers(batch.column(1))
            for a, b in tk.slices(off):
                s = m.score(*features(buf[off[a] : off[b]], off[a : b + 1] - off[a])) if m else np.full(b - a, prior)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array(s)], ["doc_id", "score"])

    kind = dict(docs.select(id_col).dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, score double")
