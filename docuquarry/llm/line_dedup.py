"""Line dedup: keep each long line in the first document that holds it.

Hashes of line keys are written once, range-partitioned by (hash, document, position) and sorted
inside each partition, so a line that a third of all documents hold is spread over many tasks. Each
task streams its rows and knows the first document of every run but the one that may have begun in an
earlier partition; that one is settled by a table with at most two rows for each partition.

What the stream returns is each document's bitmap in pieces of 64 lines, those without a dropped line
left out; the pieces of a document meet, and only the texts that may lose a line are shuffled to them.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuquarry.llm.runtime import forget, materialize, meet_texts

#: Bytes taken off both ends of a line for its key.
STRIP = b" \t\n\x0b\x0c\r"
_DROP, _OPEN, _FACT = 0, 1, 2


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """Stripped, A-Z lower-cased line, or None when it has fewer than min_chars code points."""
    key = line.strip(STRIP).lower()
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return key


def _hash_lines(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, ties, texts = (batch.column(i) for i in range(3))
            step = max(1, min(len(batch), 512))
            for a in range(0, len(batch), step):
                digests, rows, pos = [], [], []
                for r, text in enumerate(texts.slice(a, step)):
                    for p, line in enumerate((text.as_py() or "").encode().split(b"\n")):
                        key = line_key(line, min_chars)
                        if key is not None:
                            digests.append(xxhash.xxh3_128_digest(key))
                            rows.append(a + r)
                            pos.append(p)
                h = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(h[:, 0]), pa.array(h[:, 1]), ids.take(at), ties.take(at), pa.array(pos, pa.int32())],
                    ["h1", "h2", "doc", "tie", "pos"],
                )

    return run


def _stream_first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (h1, h2, doc, tie, pos): bitmap pieces of the lines outside the first document of their run.

    A piece is the place of 64 lines and the bits of those dropped. Lines of the run that opens the
    partition keep their hash, as do the facts (first document of the opening and of the last run).
    """
    key, first, opening = None, None, True

    def out(kind, h1, h2, doc, tie, pos):
        n = len(doc)
        if kind == _DROP:
            h1 = h2 = np.zeros(n, np.int64)
        bits = np.left_shift(np.uint64(1), (pos & 63).astype(np.uint64)).view(np.int64)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(n, kind, np.int8)), pa.array(h1), pa.array(h2), pa.array(doc), pa.array(tie), pa.array(pos >> 6), pa.array(bits)],
            ["kind", "h1", "h2", "doc", "tie", "piece", "bits"],
        )

    def fact(k, d):
        one = lambda v: np.array([v], np.int64)
        return out(_FACT, one(k[0]), one(k[1]), one(d), one(0), np.zeros(1, np.int32))

    for batch in batches:
        h1, h2, doc, tie, pos = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        if not len(doc):
            continue
        new = np.ones(len(doc), bool)
        new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
        new[0] = key is None or (h1[0], h2[0]) != key
        begin = np.flatnonzero(new)
        run = np.cumsum(new) - 1
        heads = doc[begin]
        if not new[0]:
            heads, run = np.concatenate([[first], heads]), run + 1
        of = heads[run]
        undecided = np.zeros(len(doc), bool)
        if opening:
            limit = begin[1] if key is None and len(begin) > 1 else begin[0] if key is not None and len(begin) else len(doc)
            undecided[:limit] = True
            if key is None:
                yield fact((h1[0], h2[0]), doc[0])
            opening = limit == len(doc)
        drop = (doc != of) & ~undecided
        for kind, mask in ((_DROP, drop), (_OPEN, undecided)):
            if mask.any():
                yield out(kind, h1[mask], h2[mask], doc[mask], tie[mask], pos[mask])
        key, first = (h1[-1], h2[-1]), of[-1]
    if key is not None:
        yield fact(key, first)


def keep_bitmap(n_lines: int, pieces: np.ndarray, bits: np.ndarray) -> bytes:
    """One compressed bitmap of the lines kept, from the pieces of dropped ones (several may share a place)."""
    dropped = np.zeros(-(-n_lines // 64), np.uint64)
    np.bitwise_or.at(dropped, pieces, bits.view(np.uint64))
    return zlib.compress((~dropped).astype("<u8").tobytes(), 1)


def unpack(bitmap: bytes, n_lines: int) -> np.ndarray:
    """The keep flags of a document's lines."""
    return np.unpackbits(np.frombuffer(zlib.decompress(bitmap), np.uint8), bitorder="little")[:n_lines].astype(bool)


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """(doc, tie, lost): bitmap pieces (piece, bits) of the lines that each distinct row of docs loses, if any.

    A line's key (white space stripped, A-Z lower-cased) of min_chars code points or more stays only
    in the smallest id that holds it, all its lines there included. Rows that share an id are one
    document here; tie (a hash of the text) tells them apart, and equal rows share their bitmap. Null
    ids take no part; null and empty texts have one empty line; an empty table gives an empty result.
    Ids must be integral; other columns are ignored.
    """
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text")).filter("doc IS NOT NULL")
    # written before it is ranged: the sample that finds the ranges then reads hashes, not texts
    lines = materialize(d.mapInArrow(_hash_lines(min_chars), "h1 long, h2 long, doc long, tie long, pos int"), "hashes")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["h1", "h2", "doc", "tie", "pos"]
    ranged = lines.repartitionByRange(n, *order).sortWithinPartitions(*order)
    seen = materialize(ranged.mapInArrow(_stream_first, "kind byte, h1 long, h2 long, doc long, tie long, piece int, bits long"), "lines")
    forget(lines)
    # at most two rows for each partition of the range exchange, so the broadcast is bounded by n
    facts = seen.filter(F.col("kind") == _FACT).groupBy("h1", "h2").agg(F.min("doc").alias("first"))
    late = seen.filter(F.col("kind") == _OPEN).join(F.broadcast(facts), ["h1", "h2"]).filter(F.col("doc") > F.col("first"))
    drops = seen.filter(F.col("kind") == _DROP).select("doc", "tie", "piece", "bits").unionByName(late.select("doc", "tie", "piece", "bits"))
    return drops.groupBy("doc", "tie").agg(F.collect_set(F.struct("piece", "bits")).alias("lost"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_lines, n_dropped, maps, kept = [], [], [], []
        for text, lost in zip(batch.column(1), batch.column(2), strict=True):
            lines = (text.as_py() or "").encode().split(b"\n")
            at = lost.values if lost.is_valid else None
            pieces, bits = (at.field(i).to_numpy() for i in (0, 1)) if at is not None else (np.zeros(0, np.int32), np.zeros(0, np.int64))
            packed = keep_bitmap(len(lines), pieces, bits)
            keep = unpack(packed, len(lines))
            n_lines.append(len(lines))
            n_dropped.append(int((~keep).sum()))
            maps.append(packed)
            kept.append(hashlib.sha256(b"\n".join(x for x, k in zip(lines, keep, strict=True) if k)).hexdigest())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64()), pa.array(maps, pa.binary()), pa.array(kept, pa.string())],
            ["doc_id", "n_lines", "n_dropped", "keep_bitmap", "kept_sha256"],
        )


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10) -> DataFrame:
    """For each row of docs: doc_id, n_lines, n_dropped, keep_bitmap (zlib over 64-bit words, first line in the lowest bit), kept_sha256.

    Rows with a null id keep all their lines; see dropped_lines for the other cases.
    """
    lost = materialize(dropped_lines(docs, id_col, text_col, min_chars), "bitmaps")
    d = docs.select(F.col(id_col).cast("long").alias("doc"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
    joined = meet_texts(d, lost, ["doc", "tie"]).select("doc", "text", "lost")
    return joined.mapInArrow(_apply, "doc_id long, n_lines long, n_dropped long, keep_bitmap binary, kept_sha256 string")
