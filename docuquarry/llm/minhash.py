"""Near-duplicate documents by HyperMinHash.

A document's distinct word shingles fall by their hash into REGISTERS buckets. Each register holds the
leading-zero count of the bucket's least hash and ten bits of its mantissa. Runs of registers (empty
ones filled from others by fixed choices) are hashed to band keys; documents that share a key are
candidates, those whose collision-corrected similarity estimate can't reach the threshold are let go,
and links are confirmed on the full sets. Documents with equal sets are one class from the start.

No bucket's pairs are all made: members are first compared with the bucket's least member, those still
outside its component with a few others of it (which differ from bucket to bucket). Of a bucket whose
members are still in different components afterwards, those outside its largest component meet that
component and each other, in blocks of bounded size, where the members whose estimates allow a link
are compared on their sets; members of one component never meet again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuquarry.llm import textkit as tk
from docuquarry.llm.graph import components
from docuquarry.llm.runtime import forget, join_by_key, materialize, small_side

REGISTERS, BAND_ROWS, BANDS = 256, 5, 48
#: Registers, of a byte each, that the similarity estimate compares.
ESTIMATE = 256
#: Sets of up to so many shingles also emit the keys of an exact prefix filter.
SMALL_SET = 22
#: Pivots of a bucket in the second round, for members outside its first component.
PIVOTS = 4
#: Members of a block, and shingles of their sets together; larger buckets are dealt out in pairs of blocks.
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Standard errors below the threshold at which an estimate rules a pair out.
MARGIN = 5.0
_NO_ID = (1 << 63) - 1
_rng = np.random.default_rng(4242)
_FILL = np.stack([_rng.permutation(REGISTERS) for _ in range(24)])
_ROW = _rng.integers(1, 1 << 62, BAND_ROWS * BANDS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SALT = _rng.integers(1, 1 << 62, BANDS, dtype=np.uint64)


def registers(sets: list[np.ndarray]) -> np.ndarray:
    """One row of REGISTERS 16-bit registers for each set of sorted hashes: leading zeros and mantissa of each bucket's least hash; 0 if empty."""
    out = np.zeros((len(sets), REGISTERS), np.uint16)
    shift = np.uint64(64 - (REGISTERS.bit_length() - 1))
    for i, h in enumerate(sets):
        if not len(h):
            continue
        bucket = (h >> shift).astype(np.int64)
        first = np.concatenate([[True], bucket[1:] != bucket[:-1]])
        mantissa, exponent = np.frexp((h[first] << np.uint64(REGISTERS.bit_length() - 1)).astype(np.float64))
        zeros = np.minimum(64 - exponent, 62)
        out[i, bucket[first]] = zeros * 1024 + ((mantissa - 0.5) * 2048).clip(0, 1023).astype(np.int64) + 1
    return out


def band_keys(regs: np.ndarray) -> np.ndarray:
    """BANDS keys of each row; empty registers take the value of the first filled one in a fixed order of others."""
    full = regs.copy()
    for order in _FILL:
        full = np.where(full == 0, regs[:, order], full)
    for j in range(1, REGISTERS):
        if full.all():
            break
        full = np.where(full == 0, np.roll(regs, -j, axis=1), full)
    rows = full[:, : BAND_ROWS * BANDS].astype(np.uint64) * _ROW
    return tk.mix(rows.reshape(len(regs), BANDS, BAND_ROWS).sum(2, dtype=np.uint64) + _SALT)


def estimate(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(similarity, standard error at threshold .75) of rows of ESTIMATE one-byte registers, corrected for chance agreement of unlike ones."""
    used = ((a != 0) | (b != 0)).sum(1)
    same = ((a == b) & (a != 0)).sum(1)
    chance = 1 / 255
    share = same / np.maximum(used, 1)
    return (share - chance) / (1 - chance), np.sqrt(0.75 * 0.25 / np.maximum(used, 1))


def _sketch(batches: Iterator[pa.RecordBatch], words: int, percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, off = tk.buffers(batch.column(2))
        for a, b in tk.slices(off):
            sets = tk.shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a], words)
            regs = registers(sets)
            keys = band_keys(regs).view(np.int64)
            short = (regs[:, :ESTIMATE] % 255 + 1).astype(np.uint8) * (regs[:, :ESTIMATE] != 0).astype(np.uint8)
            out_keys = []
            for h, k in zip(sets, keys, strict=True):
                few = len(h) - -(-percent * len(h) // 100) + 1 if 0 < len(h) <= SMALL_SET else 0
                out_keys.append(np.concatenate([k[: BANDS * bool(len(h))], tk.mix(h[:few], 99).view(np.int64)]))
            sums = [np.array([int(tk.mix(h, salt).sum(dtype=np.uint64)) for h in sets], np.uint64).view(np.int64) for salt in (1, 2)]
            offsets = np.concatenate([[0], np.cumsum([len(k) for k in out_keys])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(out_keys)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), pa.array([len(h) for h in sets], pa.int64()), *[pa.array(s) for s in sums], pa.array([r.tobytes() for r in short], pa.binary()), lists],
                ["doc", "tie", "n", "s1", "s2", "regs", "keys"],
            )


def _near(na: np.ndarray, nb: np.ndarray, ra: np.ndarray, rb: np.ndarray, percent: int) -> np.ndarray:
    """Pairs whose sizes and estimate allow the threshold."""
    sized = 100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)
    near, err = estimate(ra, rb)
    return sized & (near >= percent / 100 - MARGIN * err)


def _possible(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            mat = lambda i: np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint8).reshape(-1, ESTIMATE)
            keep = pa.array(_near(batch.column(2).to_numpy(), batch.column(3).to_numpy(), mat(4), mat(5), percent))
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    return run


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs of sets, by products of 0/1 matrices over some elements at a time."""
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row, column = row[seen[column] > 1], column[seen[column] > 1]
    _, column = np.unique(column, return_inverse=True)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out, width = np.zeros((len(sets), len(sets))), 8192
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, width):
        part = slice(*np.searchsorted(column, [at, at + width]))
        some = np.zeros((len(sets), width), np.float32)
        some[row[part], column[part] - at] = 1
        out += some @ some.T
    return out


def _meet(percent: int):
    """Rows (key, x, y, block, id, comp, n, regs, set) sorted by (key, x, y): pairs of different components that 32-bit sets link.

    A 32-bit set can miss as many shared elements as fell together in either set, and is given as many more.
    """

    def settle(rows: list[tuple]) -> pa.RecordBatch:
        x, y = rows[0][1:3]
        block, ids, comp, n = (np.array([r[i] for r in rows], np.int64) for i in (3, 4, 5, 6))
        regs = np.frombuffer(b"".join(r[7] for r in rows), np.uint8).reshape(-1, ESTIMATE)
        near = np.zeros((len(rows), len(rows)), bool)
        for i in range(len(rows) - 1):
            j = np.arange(i + 1, len(rows))
            j = j[(comp[j] != comp[i]) & (ids[j] != ids[i]) & ((x == y) | (block[j] != block[i]))]
            near[i, j[_near(n[i], n[j], regs[i][None], regs[j], percent)]] = True
        live = np.flatnonzero(near.any(0) | near.any(1))
        near = near[np.ix_(live, live)]
        if not len(live):
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, ["a", "b"])
        sets = [np.frombuffer(rows[i][8], np.uint32) for i in live]
        sizes = n[live]
        fell = sizes - [len(np.unique(s)) for s in sets]  # elements that fell together: a shared part loses no more of them than either set
        both = shared_counts(sets) + np.minimum(fell[:, None], fell[None, :])
        i, j = np.nonzero(near & (100 * both >= percent * (sizes[:, None] + sizes[None, :] - both)))
        i, j = ids[live[i]], ids[live[j]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j)), pa.array(np.maximum(i, j))], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for r in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if rows and rows[0][:3] != r[:3]:
                    yield settle(rows)
                    rows = []
                rows.append(r)
        if rows:
            yield settle(rows)

    return run


def _confirm(words: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = [tk.buffers(batch.column(i)) for i in (2, 3)]
            keep = np.zeros(len(batch), bool)
            step = 64
            for at in range(0, len(batch), step):
                end = min(at + step, len(batch))
                left, right = (tk.shingle_sets(buf[off[at] : off[end]], off[at : end + 1] - off[at], words) for buf, off in cols)
                for i, (x, y) in enumerate(zip(left, right, strict=True)):
                    both = len(np.intersect1d(x, y, assume_unique=True))
                    keep[at + i] = 100 * both >= percent * (len(x) + len(y) - both)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep))], ["a", "b"])

    return run


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """The pairs (a, b) of classes that are links."""
    side = lambda c: classes.select(F.col("id").alias(c), F.col("n").alias(f"n{c}"), F.col("regs").alias(f"r{c}"))
    with_regs = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "ra", "rb")
    maybe = materialize(with_regs.mapInArrow(_possible(percent), "a long, b long"), "maybe")
    ids = maybe.select(F.col("a").alias("id")).union(maybe.select("b")).distinct()
    texts = _texts(ids, classes, docs)
    side = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"t{c}"))
    both = maybe.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ta", "tb")
    links = materialize(both.mapInArrow(_confirm(words, percent), "a long, b long"), "links")
    forget(maybe, texts)
    return links


def _mixed(members: DataFrame) -> DataFrame | None:
    """(key, id, comp, main, size): the members (key, id, comp) of the buckets with several components; main: the one of most members. None if there is none."""
    per = members.groupBy("key", "comp").agg(F.count("*").alias("_n"))
    keys = per.groupBy("key").agg(F.sum("_n").alias("size"), F.max_by("comp", F.struct("_n", "comp")).alias("main"), F.count("*").alias("_c")).filter("_c > 1").drop("_c")
    keys = materialize(keys, "mixed-keys")
    out = None if keys.isEmpty() else materialize(join_by_key(members, keys, "key", "size"), "mixed")
    forget(keys)
    return out


def _more_stars(mixed: DataFrame) -> DataFrame:
    """Members outside their bucket's main component, each with PIVOTS members of it that differ from bucket to bucket."""
    masks = [F.expr(f"min(id ^ xxhash64(key, {m}))").alias(f"_p{m}") for m in range(PIVOTS)]
    centres = F.array_distinct(F.array(*[F.expr(f"_p{m} ^ xxhash64(key, {m})") for m in range(PIVOTS)]))
    pivots = materialize(mixed.filter("comp = main").groupBy("key").agg(F.max("size").alias("size"), *masks).select("key", "size", centres.alias("pivots")), "pivots")
    wanted = join_by_key(mixed.filter("comp <> main").select("key", "id"), pivots, "key", "size").select("id", F.explode("pivots").alias("pivot"))
    return wanted.select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.buffers(batch.column(1))
            for a, b in tk.slices(off):
                sets = tk.shingle_sets(buf[off[a] : off[b]], off[a : b + 1] - off[a], words)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.array([h.astype(np.uint32).tobytes() for h in sets], pa.binary())], ["id", "set"])

    return run


def _texts(ids: DataFrame, classes: DataFrame, docs: DataFrame) -> DataFrame:
    """(id, text) of these classes: the text of each one's first document."""
    ids = materialize(ids.join(classes.select("id", "doc", "tie"), "id"), "ids")
    texts = materialize(docs.join(small_side(ids, ids.count()), ["doc", "tie"]).select("id", "text").dropDuplicates(["id"]), "texts")
    forget(ids)
    return texts


def _pairs_apart(mixed: DataFrame, classes: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Pairs (a, b) of ids that share a key, are in different components and seem linked, of _mixed members.

    Members of the main component are dealt into blocks -1, -2, ..., the others into blocks 0, 1, ...;
    each block of others meets every block of main members and every block of others.
    """
    texts = _texts(mixed.select("id").distinct(), classes, docs)
    sets = materialize(texts.mapInArrow(_sets(words), "id long, set binary"), "sets")
    weighed = mixed.join(classes.select("id", "n"), "id").withColumn("other", F.col("comp") != F.col("main"))
    blocks = F.ceil(F.greatest(F.count("*") / F.lit(BLOCK), F.sum("n") / F.lit(BLOCK_SHINGLES)))
    sizes = weighed.groupBy("key", "other").agg(blocks.cast("int").alias("g"), F.count("*").alias("of"))
    sizes = sizes.groupBy("key").agg(F.max(F.when(F.col("other"), F.col("g"))).alias("g2"), F.max(F.when(~F.col("other"), F.col("g"))).alias("g1"), F.sum("of").alias("of"))
    sizes = materialize(sizes, "sizes")
    members = join_by_key(weighed.select("key", "id", "comp", "other"), sizes, "key", "of")
    at = F.when(F.col("other"), F.pmod(F.xxhash64("id"), F.col("g2"))).otherwise(-1 - F.pmod(F.xxhash64("id"), F.col("g1"))).cast("int")
    up_to = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    unit = lambda x, y: F.struct(x.cast("int").alias("x"), y.cast("int").alias("y"))
    of_main = F.transform(up_to("g2"), lambda j: unit(j, F.col("block")))
    of_other = F.concat(F.transform(up_to("g1"), lambda i: unit(F.col("block"), -1 - i)), F.transform(up_to("g2"), lambda j: unit(F.least(F.col("block"), j), F.greatest(F.col("block"), j))))
    dealt = members.withColumn("block", at).select("key", "id", "comp", "block", F.explode(F.when(F.col("other"), of_other).otherwise(of_main)).alias("u")).select("key", "u.x", "u.y", "block", "id", "comp")
    full = dealt.join(classes.select("id", "n", "regs").join(sets, "id"), "id").select("key", "x", "y", "block", "id", "comp", "n", "regs", "set")
    n = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = full.repartition(n, "key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(_meet(percent), "a long, b long").distinct()
    pairs = materialize(met, "apart")
    forget(texts, sets, sizes)
    return pairs


def near_duplicates(docs: DataFrame, percent: int = 75, words: int = 5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row of docs: doc_id, n_shingles, component_id, kept.

    Two documents are linked when their sets of distinct shingles (words lower-cased words in a row; the
    whole text if it has fewer) have 100 * intersection >= percent * union; components are those of the
    links. Rows without words are linked with nothing. component_id is the smallest id of the component,
    null where it has none; kept: the row's id is component_id (both null included). Repeated rows are in
    one class. Pairs at the threshold itself are missed with a chance of about two in a million by the
    bands; sets of up to SMALL_SET shingles are found exactly.
    """
    d = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc"), F.xxhash64(F.col(text_col)).alias("tie"), F.col(text_col).alias("text"))
    sketched = d.mapInArrow(lambda it: _sketch(it, words, percent), "doc long, tie long, n long, s1 long, s2 long, regs binary, keys array<long>")
    rows = materialize(sketched, "sketch")
    same = ["s1", "s2", "n"]
    grouped = rows.filter("n > 0").groupBy(*same).agg(F.min(F.struct("doc", "tie")).alias("_rep"), F.first("regs").alias("regs"), F.first("keys").alias("keys"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("id"), *same, "_rep.doc", "_rep.tie", "regs", "keys"), "classes")
    members = classes.select("id", F.explode("keys").alias("key"))
    # the least id: buckets of the same members have the same pivot, and their pairs fall together
    pivots = materialize(members.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("pivot")).filter("size > 1"), "buckets")
    shared = materialize(join_by_key(members, pivots, "key", "size").select("key", "id", "size", "pivot"), "shared")
    forget(pivots)
    stars = shared.filter("id <> pivot").select(F.least("id", "pivot").alias("a"), F.greatest("id", "pivot").alias("b")).distinct()
    links = _links(stars, classes, d, words, percent)
    found = components(links)
    several = shared.filter("size > 2").select("key", "id")
    for pairs_of in (_more_stars, lambda m: _pairs_apart(m, classes, d, words, percent)):
        mixed = _mixed(several.join(found, "id", "left").select("key", "id", F.coalesce("comp", "id").alias("comp")))
        if mixed is None:
            break
        more = _links(pairs_of(mixed), classes, d, words, percent)
        forget(mixed)
        if not more.isEmpty():
            links = links.unionByName(more)
            found = components(links)
    forget(shared)
    of = classes.select(*same, "id", "doc").join(found, "id", "left").withColumn("comp", F.coalesce("comp", "id"))
    least = of.groupBy("comp").agg(F.min("doc").alias("first"))
    named = of.join(least, "comp").select(*same, "first")
    named = rows.select("doc", "n", "s1", "s2").join(named, same, "left").withColumn("first", F.coalesce("first", "doc"))
    as_id = lambda c: F.when(F.col(c) != _NO_ID, F.col(c))
    return named.select(as_id("doc").alias("doc_id"), F.col("n").alias("n_shingles"), as_id("first").alias("component_id"), (F.col("doc") == F.col("first")).alias("kept"))
