"""Benchmark decontamination by a broadcast hash set of normalised test n-grams.

The windows of a benchmark are sorted hashes with offsets into one buffer of its normalised words, 20
bytes a window beside the words, so 16 MiB of text make a table of some 80 MiB. A larger benchmark is
dealt into several tables; each scans all texts in its own pass, and what the passes found meets by text.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuquarry.llm import textkit as tk
from docuquarry.llm.runtime import filter_texts, materialize, small_side

#: Text of the benchmark that one pass broadcasts.
PASS_BYTES = 16 << 20
_FILTER_BITS = 20


@dataclass
class Windows:
    """The windows of one length, by hash: where each stands in words, and the number of its item (-1: without an id)."""

    hashes: np.ndarray
    start: np.ndarray
    end: np.ndarray
    item: np.ndarray
    seen: np.ndarray


@dataclass
class Table:
    words: bytes
    names: list[str]
    by_length: dict[int, Windows]


def benchmark_table(rows: list[tuple[str | None, str]], n: int) -> Table:
    """Windows of n words of the items (id, text); an item of fewer words is one window, one without words has none."""
    words, at, names = [], 0, sorted({str(i) for i, _ in rows if i is not None})
    number = {name: k for k, name in enumerate(names)}
    found = defaultdict(list)
    for item, text in rows:
        buf, off = tk.buffers(pa.array([text], pa.string()))
        low = tk.LOWER[buf]
        start, end, _ = tk.words(low, off, tk.ALNUM)
        if not len(start):
            continue
        size = min(n, len(start))
        h = tk.run_hash(tk.span_hash(tk.prefix(low), start, end), size)
        words.append(tk.word_texts(low, start, end) + b" ")
        begin = at + np.concatenate([[0], np.cumsum(end - start + 1)])
        found[size].append((h, begin[: len(h)], begin[size:][: len(h)] - 1, np.full(len(h), number.get(str(item), -1) if item is not None else -1)))
        at = int(begin[-1])
    tables = {}
    for size, parts in found.items():
        h, start, end, item = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.argsort(h, kind="stable")
        seen = np.zeros(1 << _FILTER_BITS, bool)
        seen[h & np.uint64((1 << _FILTER_BITS) - 1)] = True
        tables[size] = Windows(h[order], start[order].astype(np.int32), end[order].astype(np.int32), item[order].astype(np.int32), seen)
    return Table(b"".join(words), names, tables)


def scan(low: np.ndarray, off: np.ndarray, table: Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[set[int]], np.ndarray]:
    """Word starts, ends, documents, the items found in each document, and which words are hit."""
    start, end, doc = tk.words(low, off, tk.ALNUM)
    h = tk.span_hash(tk.prefix(low), start, end)
    items: list[set[int]] = [set() for _ in range(len(off) - 1)]
    edge = np.zeros(len(start) + 1, np.int64)
    for size, w in table.by_length.items():
        if len(start) < size:
            continue
        runs = tk.run_hash(h, size)
        maybe = np.flatnonzero(w.seen[runs & np.uint64((1 << _FILTER_BITS) - 1)] & (doc[: len(runs)] == doc[size - 1 :]))
        first = np.searchsorted(w.hashes, runs[maybe])
        last = np.searchsorted(w.hashes, runs[maybe], "right")
        for i, a, b in zip(maybe[last > first].tolist(), first[last > first].tolist(), last[last > first].tolist(), strict=True):
            key = tk.word_texts(low[start[i] : end[i + size - 1]], start[i : i + size] - start[i], end[i : i + size] - start[i])
            for k in range(a, b):
                if table.words[w.start[k] : w.end[k]] == key:
                    items[doc[i]].add(int(w.item[k]))
                    edge[i] += 1
                    edge[i + size] -= 1
    for x in items:
        x.discard(-1)
    return start, end, doc, items, np.cumsum(edge[:-1]) > 0


def _strip(raw: bytes, start: np.ndarray, end: np.ndarray, hit: np.ndarray) -> bytes:
    """The text without its runs of hit words (from the first word's start to the last one's end)."""
    if not hit.any():
        return raw
    out, at = [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    for a, b in edges.reshape(-1, 2).tolist():
        out.append(raw[at : start[a]])
        at = end[b - 1]
    return b"".join([*out, raw[at:]])


def _tables(docs: DataFrame, benchmark: DataFrame, n: int, item_col: str, text_col: str) -> tuple[int, Iterator[Broadcast]]:
    """How many passes a benchmark takes, and their broadcast tables one after another, each of about PASS_BYTES of text at most (an item is never cut)."""
    bench = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(text_col).alias("text")).filter("text IS NOT NULL")
    total = bench.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    passes = 1 if total <= PASS_BYTES else -(-2 * total // PASS_BYTES)
    share = lambda p: bench.filter(F.pmod(F.xxhash64("item", "text"), F.lit(passes)) == p) if passes > 1 else bench
    return passes, (docs.sparkSession.sparkContext.broadcast(benchmark_table([tuple(r) for r in share(p).collect()], n)) for p in range(passes))


def _find(shared: Broadcast):
    """Texts (x, text) with hits: x, runs of hit words, and the items' ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            buf, off = tk.buffers(batch.column(1))
            for a, b in tk.slices(off):
                _, _, doc, items, hit = scan(tk.LOWER[buf[off[a] : off[b]]], off[a : b + 1] - off[a], table)
                first = np.searchsorted(doc, np.arange(b - a + 1))
                for d in np.unique(doc[hit]).tolist():
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit[first[d] : first[d + 1]].view(np.int8), [0]]))).reshape(-1, 2)
                    yield pa.RecordBatch.from_pylist(
                        [{"x": batch.column(0)[a + d].as_py(), "hits": [{"a": i, "b": j} for i, j in edges.tolist()], "items": [table.names[k] for k in sorted(items[d])]}],
                        schema=pa.schema([("x", pa.binary()), ("hits", pa.list_(pa.struct([("a", pa.int64()), ("b", pa.int64())]))), ("items", pa.list_(pa.string()))]),
                    )

    return run


def _judged(ids: pa.Array, part: np.ndarray, o: np.ndarray, words: tuple, items: list[list[str]], hit: np.ndarray, share: float, clean_text: bool) -> pa.RecordBatch:
    start, end, doc = words
    n = len(o) - 1
    n_words, n_hit = np.bincount(doc, minlength=n), np.bincount(doc[hit], minlength=n)
    cols = [
        ids, pa.array(n_words), pa.array(n_hit), pa.array([len(x) for x in items], pa.int64()),
        pa.array([hashlib.sha256(",".join(sorted(x)).encode()).hexdigest() for x in items]), pa.array((n_hit > 0) & (n_hit >= share * n_words - 1e-9)),
    ]
    names = ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"]
    if clean_text:
        w = np.searchsorted(doc, np.arange(n + 1))
        cols.append(pa.array([_strip(part[o[d] : o[d + 1]].tobytes(), start[w[d] : w[d + 1]] - o[d], end[w[d] : w[d + 1]] - o[d], hit[w[d] : w[d + 1]]).decode() for d in range(n)], pa.string()))
        names.append("clean_text")
    return pa.RecordBatch.from_arrays(cols, names)


def _identity(text: str) -> Column:
    """What a text is known by where several passes have to agree on it: its SHA-256, null for a null text."""
    return F.unhex(F.sha2(F.col(text).cast("binary"), 256))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: float = 0.05) -> DataFrame:
    """The rows of docs, all columns kept, that decontaminate doesn't call contaminated; cases as there (null and empty texts stay)."""
    passes, tables = _tables(docs, benchmark, n, "item_id", "text")
    if passes > 1:
        by_text = docs.select(_identity("text").alias("_x"), "text")
        judged = _in_passes(by_text, tables, share, "_x", "text", False)
        bad = materialize(judged.filter("contaminated").select(F.col("doc_id").alias("_x")).distinct(), "contaminated")
        return docs.withColumn("_x", _identity("text")).join(small_side(bad, bad.count()), "_x", "left_anti").select(docs.columns)
    shared = next(tables)

    def clean(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        _, _, doc, _, hit = scan(tk.LOWER[buf], off, shared.value)
        n_hit = np.bincount(doc[hit], minlength=len(off) - 1)
        return (n_hit == 0) | (n_hit < share * np.bincount(doc, minlength=len(off) - 1) - 1e-9)

    return filter_texts(docs, "text", clean)


def _schema(docs: DataFrame, id_col: str, clean_text: bool) -> str:
    return f"doc_id {dict(docs.select(id_col).dtypes)[id_col]}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean" + ", clean_text string" * clean_text


def _in_passes(docs: DataFrame, tables: Iterator[Broadcast], share: float, id_col: str, text_col: str, clean_text: bool) -> DataFrame:
    """decontaminate() with several tables: a scan of all texts for each, and one to judge what they found."""
    texts = docs.select(_identity(text_col).alias("x"), F.col(text_col).alias("text"))
    schema = "x binary, hits array<struct<a:long,b:long>>, items array<string>"
    found = None
    for shared in tables:
        one = materialize(texts.mapInArrow(_find(shared), schema), "hits")
        shared.unpersist()
        found = one if found is None else found.unionByName(one)
    once = found.distinct().groupBy("x").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    once = materialize(once, "found")
    joined = docs.select(_identity(text_col).alias("x"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(small_side(once, once.count()), "x", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.buffers(batch.column(1))
            for a, b in tk.slices(off):
                part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                words = tk.words(tk.LOWER[part], o, tk.ALNUM)
                first = np.searchsorted(words[2], np.arange(b - a))
                hit = np.zeros(len(words[0]), bool)
                for d, runs in enumerate(batch.column(2).slice(a, b - a).to_pylist()):
                    for r in runs or ():
                        hit[first[d] + r["a"] : first[d] + r["b"]] = True
                items = [x or [] for x in batch.column(3).slice(a, b - a).to_pylist()]
                yield _judged(batch.column(0).slice(a, b - a), part, o, words, items, hit, share, clean_text)

    return joined.select("doc_id", "text", "hits", "items").mapInArrow(run, _schema(docs, id_col, clean_text))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: float = 0.05, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", clean_text: bool = False) -> DataFrame:
    """For each row of docs: n_words, n_hit, n_items, items_sha256, contaminated, and with clean_text the text without hit spans.

    Words are runs of ASCII letters (lower-cased), digits and characters beyond ASCII. A window is n
    consecutive words of an item; an item of fewer words is one window, one without words none. Hash
    hits are verified on the words. A document is contaminated when it has a hit and n_hit is at least
    share of its words. Null and empty texts have no words; null items no windows; an item without an id
    hits words but isn't counted or named, items that share an id are one; an empty benchmark hits
    nothing; repeated rows are judged each; other columns are ignored.
    """
    passes, tables = _tables(docs, benchmark, n, item_col, item_text_col)
    if passes > 1:
        return _in_passes(docs, tables, share, id_col, text_col, clean_text)
    shared = next(tables)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = shared.value
        for batch in batches:
            buf, off = tk.buffers(batch.column(1))
            for a, b in tk.slices(off):
                part, o = buf[off[a] : off[b]], off[a : b + 1] - off[a]
                *words, items, hit = scan(tk.LOWER[part], o, table)
                yield _judged(batch.column(0).slice(a, b - a), part, o, tuple(words), [[table.names[k] for k in x] for x in items], hit, share, clean_text)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _schema(docs, id_col, clean_text))
