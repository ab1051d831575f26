"""Sharding by proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuquarry.llm.ranking import buckets_for, with_rank
from docuquarry.llm.runtime import materialize, small_side


def interleave(docs: DataFrame, n_shards: int, seed: str = "shard", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """For each row: doc_id, size, text_crc32, law, shard, slot, grown_shard, and position in the whole.

    Rows of a source are shuffled by md5 of seed and id, ranked, and placed at (rank + 1/2) / rows of
    the source; all rows in that order are cut into n_shards runs whose lengths differ by one at most,
    so that each shard has every source's share. size: UTF-8 bytes plus 16. Null sources are a source;
    null ids and null texts count as empty; repeated rows are interchangeable and each get a place.
    Only ids, sizes and checksums are shuffled, never texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("_source"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary")).alias("_h"),
    )
    sources = materialize(rows.groupBy("_source").agg(F.count("*").alias("_of")), "sources")
    n_sources, total = sources.agg(F.count("*"), F.coalesce(F.sum("_of"), F.lit(0))).first()
    nb = buckets_for(total)
    # a shuffle by source would put a hot source in one task, and the ranks would then stay there
    rows = rows.join(small_side(sources, n_sources), "_source").withColumn("_b", F.floor(F.conv(F.substring("_h", 1, 8), 16, 10).cast("double") / 4294967296.0 * nb))
    ties = ["_h", "doc_id", "text_crc32", "size"]
    ranked = with_rank(rows, ["_source"], "_b", ties, "_r")
    placed = ranked.withColumn("_at", (F.col("_r") + 0.5) / F.col("_of")).withColumn("_b", F.floor(F.col("_at") * nb)).withColumn("_all", F.lit(0))
    order = with_rank(placed, ["_all"], "_b", ["_at", "_source", *ties], "position")
    shard = f"(position * {n_shards} div {max(total, 1)})"
    return order.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.expr(shard).cast("int").alias("shard"),
        (F.col("position") - F.expr(f"({shard} * {total} + {n_shards - 1}) div {n_shards}")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "position",
    )

