"""Conversation prefix trie: the nodes that conversations share, and what sharing saves.

Turns are numbered in one range-partitioned, sorted stream, where each becomes a digest. Every prefix of
a conversation is a digest chained over its turns' digests; (depth, digest) names a node. A chain runs in
blocks of BLOCK_TURNS turns that are digested independently; the prefixes behind the first block also
carry the digest of all before the block, so the turns of a conversation of any length are dealt over many tasks.

Sums over subtrees: a node belongs to its smallest member, which owns all nodes below it on its own path
as well. So what a conversation owns is summed along its path, and every prefix of the conversation hands
that sum to the node it stands at: a node reaches all its ancestors through its owner, with one row for
each prefix instead of one for each node and ancestor. Nodes that many conversations share (the root, a
common first turn) are counted before the shuffle and joined by broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.llm.runtime import forget, join_by_key, materialize

#: Turns of a block of a chain, and the binary logarithm of how many ids share a piece of a node's ends.
BLOCK_TURNS, PIECE_BITS = 1_024, 9


def _digest_turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (conv, part, role, text): (conv, part, i, turn, words), i from 0 in each conversation's rows of the partition."""
    last, i = None, -1
    for batch in batches:
        at, digests, words = [], [], []
        for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(2), batch.column(3), strict=True):
            i = i + 1 if conv == last else 0
            last = conv
            role, text = role.as_py().encode(), text.as_py().encode()
            at.append(i)
            digests.append(hashlib.sha256(len(role).to_bytes(8, "big") + role + text).digest())
            words.append(len(text.split()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(at, pa.int64()), pa.array(digests, pa.binary()), pa.array(words, pa.int64())], ["conv", "part", "i", "turn", "words"])


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (conv, block, pos, turn, ...) sorted by the first three: turn becomes before and digest, chained from the block's start."""
    key, digest = None, b""
    for batch in batches:
        before, digests = [], []
        for conv, block, turn in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if (conv, block) != key:
                key, digest = (conv, block), b""
            before.append(digest)
            digest = hashlib.sha256(digest + turn).digest()
            digests.append(digest)
        names = batch.schema.names
        rest = [batch.column(i) for i in range(4, len(names))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(before, pa.binary()), pa.array(digests, pa.binary()), *rest], [*names[:3], "before", "digest", *names[4:]])


def _tops(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last digests (conv, block, digest) of whole blocks, sorted: (conv, block, top), the digest of the prefix that ends before the block."""
    last, top = None, b""
    for batch in batches:
        tops = []
        for conv, digest in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            top = digest if conv != last else hashlib.sha256(top + digest).digest()
            last = conv
            tops.append(top)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.asarray(batch.column(1)) + 1), pa.array(tops, pa.binary())], ["conv", "block", "top"])


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (digest, piece, ids): (digest, ends_sha256) of the ids of all pieces; one piece is held at a time."""
    key, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([state.hexdigest()])], ["digest", "ends_sha256"])

    for batch in batches:
        keys, values = [], []
        for digest, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if digest == key:
                state.update(b"," + ids.encode())
                continue
            if state is not None:
                keys.append(key)
                values.append(state.hexdigest())
            key, state = digest, hashlib.sha256(ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(values, pa.string())], ["digest", "ends_sha256"])
    if state is not None:
        yield out()


def shared_turns(conv: Column) -> Column:
    """How many turns a conversation takes from the one it is based on."""
    return F.pmod(F.crc32(conv.cast("string").cast("binary")), F.lit(4))


def numbered_turns(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, turn, words) of rows (conv, turn, role, text): pos from 0, turn a digest of role and text; and the written table that it reads.

    The range key ends with the start of the text, so only turns that agree in all of it must share a task.
    """
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text")
    streamed = dealt.select("conv", F.spark_partition_id().alias("part"), "role", "text")
    out = materialize(streamed.mapInArrow(_digest_turns, "conv long, part int, i long, turn binary, words long"), "turns")
    spans = out.groupBy("conv", "part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # a partition opens with at most one conversation that began before it
    offsets = spans.withColumn("offset", F.sum("n").over(before)).filter("offset > 0").select("conv", "part", "offset")
    return out.join(F.broadcast(offsets), ["conv", "part"], "left").select("conv", (F.col("i") + F.coalesce("offset", F.lit(0))).alias("pos"), "turn", "words"), out


def rebuilt(turns: DataFrame, every: int = 20) -> tuple[DataFrame, DataFrame]:
    """(conv, pos, turn, words, ends) of the rebuilt conversations, and (conv, n, total) of all of them, written."""
    sizes = turns.groupBy("conv").agg(F.count("*").alias("n"))
    base = sizes.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    plan = sizes.withColumn("base", F.col("conv") - F.col("conv") % every).join(base, "base", "left").withColumn("h", shared_turns(F.col("conv")))
    plan = plan.withColumn("k", F.least("h", F.coalesce("base_n", F.lit(0))))
    plan = materialize(plan.select("conv", "n", "base", "h", "k", (F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("total")), "conversations")
    own = join_by_key(turns.filter(F.col("pos") >= shared_turns(F.col("conv"))), plan, "conv", "n").withColumn("pos", F.col("pos") - F.col("h") + F.col("k"))
    first = turns.filter((F.col("pos") < 3) & (F.col("conv") % every == 0)).withColumnRenamed("conv", "base")
    lent = first.join(plan, "base").filter("pos < k")
    fields = ["conv", "pos", "turn", "words", (F.col("pos") + 1 == F.col("total")).alias("ends")]
    return own.select(*fields).unionByName(lent.select(*fields)), plan


def prefixes(turns: DataFrame, plan: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(conv, depth, before, digest, words, ends) of every prefix, the empty one included; before is the digest of the prefix one turn shorter; written."""
    dealt = turns.withColumn("block", F.floor(F.col("pos") / block_turns)).select("conv", "block", "pos", "turn", "words", "ends")
    dealt = dealt.repartition("conv", "block").sortWithinPartitions("conv", "block", "pos")
    chained = materialize(dealt.mapInArrow(_chain, "conv long, block long, pos long, before binary, digest binary, words long, ends boolean"), "chains")
    fields = ["conv", (F.col("pos") + 1).alias("depth"), "before", "digest", "words", "ends"]
    out = chained.filter("block = 0").select(*fields)
    if not chained.filter("block > 0").isEmpty():
        whole = chained.filter(F.col("pos") % block_turns == block_turns - 1).select("conv", "block", "digest")
        tops = whole.repartition("conv").sortWithinPartitions("conv", "block").mapInArrow(_tops, "conv long, block long, top binary")
        behind = chained.filter("block > 0").join(tops, ["conv", "block"])
        over = lambda c: F.unhex(F.sha2(F.concat("top", c), 256))
        behind = behind.withColumn("before", F.when(F.octet_length("before") == 0, F.col("top")).otherwise(over("before"))).withColumn("digest", over("digest"))
        out = out.unionByName(behind.select(*fields))
    none = F.lit(b"")
    root = plan.select("conv", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("before"), none.alias("digest"), F.lit(0).cast("long").alias("words"), (F.col("total") == 0).alias("ends"))
    out = materialize(out.unionByName(root), "prefixes")
    forget(chained)
    return out


def subtree_sums(every: DataFrame, nodes: DataFrame, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """(digest, n_leaves, saved_tokens) of every node over its subtree."""
    known = nodes.select("digest", F.col("conv_id").alias("owner"), "n_convs", "n_ends")
    path = join_by_key(every.select("conv", "depth", "digest", "words"), known, "digest", "n_convs").withColumn("block", F.floor(F.col("depth") / block_turns))
    mine = F.col("owner") == F.col("conv")
    path = path.select("conv", "block", "depth", "digest", F.when(mine & (F.col("n_ends") == F.col("n_convs")), 1).otherwise(0).cast("long").alias("leaf"), F.when(mine, (F.col("n_convs") - 1) * F.col("words")).otherwise(0).alias("saved"))
    below = Window.partitionBy("conv", "block").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    sums = path.withColumns({c: F.sum(c).over(below) for c in ("leaf", "saved")})
    if not every.filter(F.col("depth") >= block_turns).isEmpty():
        behind = Window.partitionBy("conv").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
        later = path.groupBy("conv", "block").agg(F.sum("leaf").alias("leaf"), F.sum("saved").alias("saved"))
        later = later.select("conv", "block", F.sum("leaf").over(behind).alias("more_leaf"), F.sum("saved").over(behind).alias("more_saved")).filter("more_leaf IS NOT NULL")
        sums = sums.join(later, ["conv", "block"], "left").withColumns({c: F.col(c) + F.coalesce(f"more_{c}", F.lit(0)) for c in ("leaf", "saved")})
    return sums.groupBy("digest").agg(F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))


def end_digests(every: DataFrame) -> DataFrame:
    """(digest, ends_sha256) of the nodes where conversations end: their ids meet in pieces of a bounded range of ids, which are digested in order."""
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv")), lambda c: c.cast("string")), ",")
    pieces = every.filter("ends").groupBy("digest", F.shiftright("conv", PIECE_BITS).alias("piece")).agg(ids.alias("ids"))
    return pieces.repartition("digest").sortWithinPartitions("digest", "piece").mapInArrow(_end_digests, "digest binary, ends_sha256 string")


def prefix_trie(conversations: DataFrame, every: int = 20, block_turns: int = BLOCK_TURNS) -> DataFrame:
    """One row a node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    conversations: conv_id, turn, role, text; a null role or text is empty, further columns aren't read.
    Turns stand in the order of turn, nulls first, ties by role and then text in the order of UTF-8 bytes;
    repeated rows are turns of their own. Rows without conv_id belong to no conversation. The remainder of
    a negative id has its sign. An empty table has no nodes, not even the root.
    """
    empty = F.lit("")
    rows = conversations.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    turns, written = numbered_turns(rows)
    again, plan = rebuilt(turns, every)
    path = prefixes(again, plan, block_turns)
    forget(written, plan)
    nodes = path.groupBy("depth", "digest").agg(F.min("conv").alias("conv_id"), F.count("*").alias("n_convs"), F.count_if("ends").alias("n_ends"), F.min("before").alias("before"))
    nodes = materialize(nodes, "nodes")
    children = nodes.filter("depth > 0").groupBy(F.col("before").alias("digest")).agg(F.count("*").alias("n_children"))
    parents = materialize(nodes.join(children, "digest").select(F.col("digest").alias("before"), F.col("conv_id").alias("parent_conv_id"), "n_children"), "parents")
    below = join_by_key(nodes.filter("depth > 0"), parents.withColumnRenamed("n_children", "_siblings"), "before", "_siblings").drop("_siblings")
    root = nodes.filter("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))
    out = below.unionByName(root).join(parents.select(F.col("before").alias("digest"), "n_children"), "digest", "left")
    out = out.join(subtree_sums(path, nodes, block_turns), "digest").join(end_digests(path), "digest", "left")
    none = F.lit(hashlib.sha256().hexdigest())
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", none).alias("ends_sha256"))
