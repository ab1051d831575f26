"""Suffix-array dedup: bytes covered by a string of min_len bytes that also starts earlier are removed.

Which starts have an earlier match of min_len bytes is read from longest-previous-factor arrays. A
suffix array of the whole corpus can't be built in one place, so starts are first dealt into classes
that no match can leave: the class of a start is the smallest hash of the GRAM-byte strings inside its
min_len bytes, which equal strings share. A run of starts of one class is a segment.

1. Segments are written once, range-partitioned by (class, content, document, position) and sorted:
   later copies of a whole segment are removed at once, which pre-aggregates groups of copies of any
   size, and segments whose class occurs nowhere else are dropped. Equal content: 64 bits of xxh3 over
   its bytes beside the class's own 64 bits and the length.
2. First copies of differing segments of a class meet in one task, in blocks of bounded size. There
   the suffixes are ordered by their first min_len bytes, and the previous and next smaller positions
   in that order give the longest previous factor of every start, cut at min_len.
3. A class whose segments exceed a block's size is too frequent for one task: its min_len-byte windows
   are matched by a 128-bit hash instead, any number of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuquarry.llm import textkit as tk
from docuquarry.llm.runtime import forget, materialize, meet_texts

GRAM = 24
#: Bytes of segments that one suffix array takes; a class with more goes to the window hashes.
BLOCK_BYTES = 2 << 20
_COPY, _SOURCE = 0, 1


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of every w consecutive values (block prefix and suffix minima)."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    pad = -len(x) % w
    full = np.concatenate([x, np.full(pad, np.iinfo(x.dtype).max, x.dtype)]).reshape(-1, w)
    ahead = np.minimum.accumulate(full, axis=1).ravel()
    back = np.minimum.accumulate(full[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(buf: np.ndarray, off: np.ndarray, min_len: int) -> tuple[np.ndarray, ...]:
    """(document, first start, last start, class, content hash, whether it may repeat itself) of the segments; starts are of the whole buffer."""
    gram = min(GRAM, min_len)
    n = len(buf)
    z = np.zeros(0, np.int64)
    if n < min_len:
        return z, z, z, z.astype(np.uint64), z.astype(np.uint64), z.astype(bool)
    pre = tk.prefix(buf)
    at = np.arange(n - gram + 1)
    w = min_len - gram + 1
    grams = tk.span_hash(pre, at, at + gram)
    least = sliding_min(grams, w)
    edge = np.zeros(n + 1, np.int32)
    long = np.diff(off) >= min_len
    edge[off[:-1][long]] += 1
    edge[off[1:][long] - min_len + 1] -= 1
    valid = np.cumsum(edge[: len(least)]) > 0
    same = np.zeros(len(least), bool)
    same[1:] = valid[1:] & valid[:-1] & (least[1:] == least[:-1])
    first = np.flatnonzero(valid & ~same)
    follows = np.zeros(len(least), bool)
    follows[:-1] = same[1:]
    last = np.flatnonzero(valid & ~follows)
    doc = np.searchsorted(off, first, "right") - 1
    # a gram is the least of a window that holds it if it equals the greatest least of these windows
    around = np.concatenate([np.zeros(w - 1, np.uint64), least, np.zeros(w - 1, np.uint64)])
    anchor = np.flatnonzero(~sliding_min(~around, w) == grams)
    twice = anchor[:-1][(grams[anchor[1:]] == grams[anchor[:-1]]) & (np.diff(anchor) <= w)]
    again = np.searchsorted(twice, last + w) > np.searchsorted(twice, first)
    raw = memoryview(np.ascontiguousarray(buf))
    content = [xxhash.xxh3_64_intdigest(raw[i:j]) for i, j in zip(first.tolist(), (last + min_len).tolist(), strict=True)]
    return doc, first, last, least[first], np.array(content, np.uint64), again


def _emit_segments(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.buffers(batch.column(2))
            ids, ties = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for a, b in tk.slices(off):
                o = off[a : b + 1] - off[a]
                doc, first, last, kind, content, again = segments(buf[off[a] : off[b]], o, min_len)
                cols = [kind.view(np.int64), content.view(np.int64), ids[a + doc], ties[a + doc], (first - o[doc]).astype(np.int32), (last - first).astype(np.int32), again]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["kind", "content", "doc", "tie", "s", "n", "again"])

    return run


def _stream_copies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (kind, content, doc, tie, s): later copies of a segment, and first ones whose class has other rows or may have them in the next or previous partition."""
    def settle(rows: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        """rows: runs of classes; the first and last of them may go on elsewhere."""
        kind, content, doc, tie, s, n, again = rows
        if not len(kind):
            return
        new = np.ones(len(kind), bool)
        new[1:] = kind[1:] != kind[:-1]
        head = new.copy()
        head[1:] |= content[1:] != content[:-1]
        run = np.cumsum(new) - 1
        several = (np.bincount(run, head)[run] > 1) | (run == 0) | (run == run[-1]) | again
        at = np.maximum.accumulate(np.where(head, np.arange(len(kind)), 0))
        itself = (doc == doc[at]) & (tie == tie[at]) & (s == s[at])
        for which, mask in ((_COPY, ~itself), (_SOURCE, head & several)):
            if mask.any():
                yield pa.RecordBatch.from_arrays([pa.array(np.full(mask.sum(), which, np.int8)), *[pa.array(c[mask]) for c in (kind, doc, tie, s, n, again)]], ["what", "kind", "doc", "tie", "s", "n", "again"])

    cut = None
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if cut is not None:
            rows = [np.concatenate([x, y]) for x, y in zip(cut, rows, strict=True)]
        if not len(rows[0]):
            continue
        # the last class may go on in the next batch; of a class that fills whole batches only what decides is held
        start = int(np.searchsorted(rows[0], rows[0][-1]))
        if start == 0 and len(rows[0]) > 1 << 20:
            yield from settle(rows)
            cut = [x[-1:] for x in rows]
            continue
        yield from settle([x[:start] for x in rows])
        cut = [x[start:] for x in rows]
    if cut is not None:
        yield from settle(cut)


class Suffixes:
    """The suffixes of text in the order of their first limit bytes, equal ones by position.

    Ranks over 8 bytes are doubled, and only suffixes that still share a rank are sorted again. Bytes
    beyond the end count as zero; limit is at least 8.
    """

    def __init__(self, text: np.ndarray, limit: int):
        n = len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        key = np.zeros(n, np.uint64)
        for j in range(8):
            key = key << np.uint64(8) | padded[j : j + n].astype(np.uint64)
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        head = np.ones(n, bool)
        head[1:] = sorted_key[1:] != sorted_key[:-1]
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        self.limit, self.key, self.order, self.ranks = limit, key, order, [(8, rank)]
        length = 8
        while length < limit:
            step = min(length, limit - length)
            slots = np.flatnonzero(~(head & np.append(head[1:], True)))
            if not len(slots):
                break
            where = order[slots]
            after = where + step
            second = np.where(after < n, rank[np.minimum(after, n - 1)], -1)
            by = np.lexsort((where, second, rank[where]))
            where, second = where[by], second[by]
            base = rank[where]
            order[slots] = where
            fresh = np.ones(len(slots), bool)
            fresh[1:] = (base[1:] != base[:-1]) | (second[1:] != second[:-1])
            head[slots] = fresh
            rank = rank.copy()
            rank[where] = np.maximum.accumulate(np.where(fresh, slots, 0))
            length += step
            self.ranks.append((length, rank))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the common prefix of each pair of suffixes, cut at limit; both have limit bytes."""
        got, last = np.zeros(len(a), np.int64), len(self.key) - 1
        for length, rank in reversed(self.ranks):
            x, y = np.minimum(a + got, last), np.minimum(b + got, last)
            got += np.where((got + length <= self.limit) & (rank[x] == rank[y]), length, 0)
        differ = self.key[np.minimum(a + got, last)] ^ self.key[np.minimum(b + got, last)]
        for j in range(8):
            got += differ < np.uint64(1 << (8 * j))
        return np.minimum(got, self.limit)


def previous_smaller(x: np.ndarray, rounds: int = 48) -> np.ndarray:
    """For each place of distinct values, the nearest one before it with a smaller value, or -1.

    All places follow their pointers at once; the few left after some rounds are walked from left to
    right, where what a place has passed is never passed again.
    """
    at = np.arange(-1, len(x) - 1)
    left = np.flatnonzero((at >= 0) & (x[at] > x))
    for _ in range(rounds):
        if not len(left):
            return at
        at[left] = at[at[left]]
        left = left[(at[left] >= 0) & (x[at[left]] > x[left])]
    for i in left.tolist():
        j = at[i]
        while j >= 0 and x[j] > x[i]:
            j = at[j]
        at[i] = j
    return at


def longest_previous_factors(text: np.ndarray, limit: int, starts: np.ndarray) -> np.ndarray:
    """LPF array, cut at limit: how long a prefix of the suffix at each start also begins at an earlier start; 0 elsewhere.

    starts: mask of places with limit bytes behind them. Of all earlier starts, the previous and the next
    smaller position in suffix order share the longest prefix.
    """
    lpf = np.zeros(len(text), np.int64)
    if not starts.any():
        return lpf
    suffixes = Suffixes(text, limit)
    places = suffixes.order[starts[suffixes.order]]
    m = len(places)
    for near in (previous_smaller(places), m - 1 - previous_smaller(places[::-1])[::-1]):
        has = np.flatnonzero((near >= 0) & (near < m))
        here = places[has]
        lpf[here] = np.maximum(lpf[here], suffixes.common(here, places[near[has]]))
    return lpf


def _match_blocks(min_len: int):
    """Rows (kind, doc, tie, s, body) sorted in this order, repeated ones once: the intervals that earlier rows of the class cover."""

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        bodies = [np.frombuffer(r[4], np.uint8) for r in rows]
        text = np.concatenate(bodies)
        begin = np.concatenate([[0], np.cumsum([len(b) for b in bodies])])
        starts = np.ones(len(text), bool)
        for e in begin[1:].tolist():
            starts[e - min_len + 1 : e] = False
        hit = longest_previous_factors(text, min_len, starts) >= min_len
        edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]]))).reshape(-1, 2)
        of = np.searchsorted(begin, edges[:, 0], "right") - 1
        col = lambda i, t: np.array([r[i] for r in rows], t)[of]
        a = edges[:, 0] - begin[of] + col(3, np.int64)
        b = edges[:, 1] - 1 - begin[of] + col(3, np.int64) + min_len
        return pa.RecordBatch.from_arrays([pa.array(col(1, np.int64)), pa.array(col(2, np.int32)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc", "tie", "a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and size > BLOCK_BYTES and r[0] != rows[-1][0]:
                    yield settle(rows)
                    rows, size = [], 0
                if rows and r[:4] == rows[-1][:4]:
                    continue
                rows.append(r)
                size += len(r[4])
        if rows:
            yield settle(rows)

    return run


def _cut_bodies(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for doc, tie, text, parts in zip(*[batch.column(i) for i in range(4)], strict=True):
                raw = text.as_py().encode()
                for p in parts.as_py():
                    out.append((p["kind"], doc.as_py(), tie.as_py(), p["s"], p["hot"], raw[p["s"] : p["s"] + p["n"] + min_len]))
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["kind", "doc", "tie", "s", "hot", "body"])

    return run


def _hash_windows(min_len: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, tie, s, body in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                raw = memoryview(body)
                for a in range(0, len(body) - min_len + 1, tk.SLICE_BYTES):
                    at = np.arange(a, min(a + tk.SLICE_BYTES, len(body) - min_len + 1))
                    h = np.frombuffer(b"".join([xxhash.xxh3_128_digest(raw[i : i + min_len]) for i in at.tolist()]), ">i8").astype(np.int64).reshape(-1, 2)
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array(h[:, 0]), pa.array(h[:, 1]), pa.array(np.full(n, doc)), pa.array(np.full(n, tie, np.int32)), pa.array((s + at).astype(np.int32))], ["h1", "h2", "doc", "tie", "a"])

    return run


def _merge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc, tie, a, b) sorted by (doc, tie, a): one row a document with its spans, those that touch joined."""
    doc = tie = None
    ends: list[list[int]] = []

    def settle() -> pa.RecordBatch:
        spans = pa.StructArray.from_arrays([pa.array([x[i] for x in ends], pa.int32()) for i in (0, 1)], ["a", "b"])
        return pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([tie], pa.int32()), pa.ListArray.from_arrays(pa.array([0, len(ends)], pa.int32()), spans)], ["doc", "tie", "spans"])

    for batch in batches:
        cols = [c.to_numpy() for c in batch.columns]
        if not len(cols[0]):
            continue
        same = (cols[0][1:] == cols[0][:-1]) & (cols[1][1:] == cols[1][:-1])
        starts = np.concatenate([[0], np.flatnonzero(~same) + 1, [len(cols[0])]]).tolist()
        for i, j in zip(starts[:-1], starts[1:], strict=True):
            if (cols[0][i], cols[1][i]) != (doc, tie):
                if ends:
                    yield settle()
                doc, tie, ends = cols[0][i], cols[1][i], []
            a, b = cols[2][i:j], np.maximum.accumulate(cols[3][i:j])
            first = np.concatenate([[0], np.flatnonzero(a[1:] > b[:-1]) + 1])
            for x, y in zip(a[first].tolist(), np.append(b[first[1:] - 1], b[-1]).tolist(), strict=True):
                if ends and x <= ends[-1][1]:
                    ends[-1][1] = max(y, ends[-1][1])
                else:
                    ends.append([x, y])
    if ends:
        yield settle()


def covered_spans(docs: DataFrame, min_len: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc, tie, spans): the byte ranges of each distinct row of docs that earlier strings of min_len bytes cover, apart and in order.

    Earlier: smaller id, or same id and smaller tie (a hash of the text), or same row and smaller start.
    Null ids, null texts and texts of fewer bytes have no spans; equal rows are one row; an empty table
    gives an empty result; other columns are ignored. Ids must be integral.
    """
    if min_len < 8:
        raise ValueError("min_len is at least 8")
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.pmod(F.xxhash64(F.col(text_col)), F.lit(2147483647)).cast("int").alias("tie"), F.col(text_col).alias("text")).filter("doc IS NOT NULL AND text IS NOT NULL")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["kind", "content", "doc", "tie", "s"]
    # written before they are ranged: the sample that finds the ranges then reads segments, not texts
    found = materialize(d.mapInArrow(_emit_segments(min_len), "kind long, content long, doc long, tie int, s int, n int, again boolean"), "found")
    ranged = found.repartitionByRange(n, *order).sortWithinPartitions(*order)
    seen = materialize(ranged.mapInArrow(_stream_copies, "what byte, kind long, doc long, tie int, s int, n int, again boolean"), "segments")
    forget(found)
    copies = seen.filter(F.col("what") == _COPY).select("doc", "tie", F.col("s").alias("a"), (F.col("s") + F.col("n") + min_len).alias("b"))
    source = seen.filter(F.col("what") == _SOURCE)
    sizes = source.groupBy("kind").agg(F.count("*").alias("rows"), F.sum(F.col("n").cast("long") + min_len).alias("bytes"), F.max("again").alias("again")).filter("rows > 1 OR again").drop("again")
    marked = source.join(sizes, "kind").withColumn("hot", F.col("bytes") > BLOCK_BYTES)
    parts = materialize(marked.groupBy("doc", "tie").agg(F.collect_set(F.struct("kind", "s", "n", "hot")).alias("parts")), "parts")
    held = meet_texts(d, parts, ["doc", "tie"]).filter("parts IS NOT NULL")
    bodies = materialize(held.select("doc", "tie", "text", "parts").mapInArrow(_cut_bodies(min_len), "kind long, doc long, tie int, s int, hot boolean, body binary"), "bodies")
    forget(parts)
    by_class = bodies.filter("NOT hot").drop("hot").repartition(n, "kind").sortWithinPartitions("kind", "doc", "tie", "s")
    matched = by_class.mapInArrow(_match_blocks(min_len), "doc long, tie int, a int, b int")
    windows = bodies.filter("hot").select("doc", "tie", "s", "body").repartition(n).mapInArrow(_hash_windows(min_len), "h1 long, h2 long, doc long, tie int, a int")
    first = windows.groupBy("h1", "h2").agg(F.min(F.struct("doc", "tie", "a")).alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows")
    again = windows.join(first, ["h1", "h2"]).filter(F.struct("doc", "tie", "a") > F.col("first")).select("doc", "tie", "a", (F.col("a") + min_len).alias("b"))
    by_doc = copies.unionByName(matched).unionByName(again).repartition(n, "doc", "tie").sortWithinPartitions("doc", "tie", "a")
    spans = materialize(by_doc.mapInArrow(_merge_spans, "doc long, tie int, spans array<struct<a:int,b:int>>"), "spans")
    forget(seen, bodies)
    return spans


def _remove(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, gone, runs, digests, kept = [], [], [], [], []
            spans = batch.column(2)
            for i, text in enumerate(batch.column(1)):
                raw = (text.as_py() or "").encode()
                left = raw
                removed = n_runs = 0
                if spans[i].is_valid:
                    v = spans[i].values
                    edge = np.zeros(len(raw) + 1, np.int32)
                    np.add.at(edge, v.field("a").to_numpy(), 1)
                    np.add.at(edge, v.field("b").to_numpy(), -1)
                    drop = np.cumsum(edge[:-1]) > 0
                    removed = int(drop.sum())
                    n_runs = int((np.diff(drop.view(np.int8), prepend=0) == 1).sum())
                    left = np.frombuffer(raw, np.uint8)[~drop].tobytes()
                for out, x in zip((sizes, gone, runs, digests, kept), (len(raw), removed, n_runs, hashlib.sha256(left).hexdigest(), left), strict=True):
                    out.append(x)
            cols = [batch.column(0), *[pa.array(x, pa.int64()) for x in (sizes, gone, runs)], pa.array(digests, pa.string())]
            names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                cols, names = [*cols, pa.array(kept, pa.binary())], [*names, "kept"]
            yield pa.RecordBatch.from_arrays(cols, names)

    return run


def remove_repeats(docs: DataFrame, min_len: int = 100, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """For each row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, and with_text the bytes kept; see covered_spans."""
    spans = covered_spans(docs, min_len, id_col, text_col)
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.pmod(F.xxhash64(F.col(text_col)), F.lit(2147483647)).cast("int").alias("tie"), F.col(text_col).alias("text"))
    joined = meet_texts(d, spans, ["doc", "tie"]).select("doc", "text", "spans")
    return joined.mapInArrow(_remove(with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
