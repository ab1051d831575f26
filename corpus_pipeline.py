"""A corpus pipeline: quality, near duplicates, benchmark passages, mixture, shards.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. In every stage a null id is an id like another, null and empty texts
are texts without words, and an empty table stays empty; what a stage does beyond that with ties and
repeated rows stands at the stage. Further columns of documents are carried along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuquarry.llm import decontam, minhash, mixing, quality, sharding
from docuquarry.llm.runtime import forget, materialize, small_side, table

N_SHARDS = 40
WEIGHTS = [5, 2, 1]
#: The stages are an iterated fit and samples, so SQL expresses none of them; tests/llm/test_pipeline.py compares them with brute force.
ORACLE_SQL = None


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; equal texts stay or go together, and all stay without labels of both classes."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each near-duplicate group stays (rows that share it stay together), and rows with a null id."""
    gone = materialize(minhash.near_duplicates(docs).filter("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct(), "gone")
    return docs.join(small_side(gone, gone.count()), "doc_id", "left_anti").select(docs.columns)


def drop_benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents contaminated by the benchmark go; each row is judged by its own text, so repeated rows go together."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mixture takes it: up to twice, or not at all.

    Rows of equal id, text and source are interchangeable: what the mixture takes of them stands as
    copies of one of them. Rows that share an id alone are documents of their own.
    """
    mixed = mixing.mix_sources(docs, WEIGHTS)
    keys = ["_id", "_text", "_source"]
    taken = mixed.groupBy(F.col("doc_id").alias("_id"), F.col("row").alias("_text"), F.col("source").alias("_source")).agg(F.sum("copies").cast("int").alias("_copies"), F.count("*").alias("_rows"))
    taken = materialize(taken.filter("_copies > 0"), "copies")
    count, repeated = taken.agg(F.count("*"), F.count_if(F.col("_rows") > 1)).first()
    keyed = docs.withColumns({"_id": F.col("doc_id"), "_text": F.xxhash64("text"), "_source": F.col("source")})

    def of(some: DataFrame, rows: int) -> DataFrame:
        right = small_side(some.select(*[F.col(k).alias(f"_{k}") for k in keys], "_copies"), rows)
        return keyed.join(right, [keyed[k].eqNullSafe(right[f"_{k}"]) for k in keys])

    out = of(taken.filter("_rows = 1"), count)
    if repeated:
        out = out.unionByName(of(taken.filter("_rows > 1"), repeated).dropDuplicates(keys))
    return out.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(docs.columns)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row of the mixture gets a shard and a slot in it; copies are rows of their own."""
    return sharding.interleave(docs, N_SHARDS).drop("position")


STAGES = [
    ("quality", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_benchmark_passages),
    ("mixture", mix),
    ("shards", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the whole documents table."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        forget(before)  # written whole, so nothing reads it any more
    return STAGES[-1][1](spark, docs, sf_dir)
