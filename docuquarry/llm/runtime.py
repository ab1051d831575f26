"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
import weakref
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docuquarry.llm import textkit as tk

#: A side of a join is broadcast only when it was counted and has at most so many narrow rows.
BROADCAST_ROWS = 400_000
#: Keys of more rows are joined by broadcast where a shuffle would put their rows in one task.
HOT_ROWS = 1_000


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share, as spark.checkpoint.dir names it; a temporary one only where all run in one process."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        return named.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not getattr(spark.sparkContext, "_corpus_scratch", None):
        spark.sparkContext._corpus_scratch = "file://" + tempfile.mkdtemp(prefix="corpus-scratch-")
    return spark.sparkContext._corpus_scratch


def materialize(df: DataFrame, name: str = "step") -> DataFrame:
    """Write df as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/corpus-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    _written[id(back)] = (weakref.ref(back), path)
    atexit.register(_drop, spark, path)
    return back


#: Paths of the steps by the frames that materialize returned.
_written: dict[int, tuple[weakref.ref, str]] = {}


def forget(*steps: DataFrame) -> None:
    """Deletes steps that materialize wrote, once all that reads them has been written itself; results still to be computed mustn't use them."""
    for df in steps:
        ref, path = _written.pop(id(df), (None, ""))
        if ref is not None and ref() is df:
            _drop(df.sparkSession, path)


def _drop(spark: SparkSession, path: str) -> None:
    """Best effort, also at the end of the process: the JVM may be gone by then."""
    try:
        jvm = spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # noqa: BLE001
        pass


def filter_texts(docs: DataFrame, text_col: str, keep: Callable) -> DataFrame:
    """Rows of docs, with all columns, for which keep holds; keep maps (bytes, offsets) of some texts to flags."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buf, off = tk.buffers(batch.column(at))
            for a, b in tk.slices(off):
                yield batch.slice(a, b - a).filter(pa.array(keep(buf[off[a] : off[b]], off[a : b + 1] - off[a])))

    return docs.mapInArrow(run, docs.schema)


def small_side(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast hint for a side counted to have few rows; beyond the bound Spark shuffles both sides."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, size: str) -> DataFrame:
    """rows joined with keyed, a written table of one row a key whose size says how many rows the key has.

    Keys of more than HOT_ROWS rows are broadcast, so that no key's rows have to meet in one task, and
    only the rows of the others are shuffled by key. Were the former too many, the bound would rise.
    """
    bound = HOT_ROWS
    while (n_hot := keyed.filter(F.col(size) > bound).count()) > BROADCAST_ROWS:
        bound *= 8
    if not n_hot:
        return rows.join(keyed, key)
    hot = F.broadcast(keyed.filter(F.col(size) > bound))
    rest = rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(keyed.filter(F.col(size) <= bound), key)
    return rows.join(hot, key).unionByName(rest)


def meet_texts(docs: DataFrame, found: DataFrame, keys: list[str]) -> DataFrame:
    """docs with the columns of found, one row a key, or nulls; texts are shuffled only where found may have a row for them.

    A broadcast bit set over hashes of found's keys says where. Its size is fixed, 2^24 bits; a larger found
    fills more of it, so that more of the other texts are shuffled too, and the result is the same.
    """
    slot = F.pmod(F.xxhash64(*keys), F.lit(1 << 24))
    place, bit = F.shiftright(slot, 6).cast("int"), F.expr("shiftleft(1L, cast(_slot & 63 as int))")
    # at most 2^18 rows
    bits = found.select(slot.alias("_slot")).select(F.shiftright("_slot", 6).cast("int").alias("_place"), bit.alias("_bit")).groupBy("_place").agg(F.bit_or("_bit").alias("_bits"))
    marked = docs.withColumns({"_slot": slot, "_place": place}).join(F.broadcast(bits), "_place", "left").withColumn("_maybe", F.coalesce(F.col("_bits").bitwiseAND(bit) != 0, F.lit(False)))
    plain = marked.select(*docs.columns, "_maybe")
    rest = plain.filter("NOT _maybe").drop("_maybe")
    return plain.filter("_maybe").drop("_maybe").join(found.hint("shuffle_hash"), keys, "left").unionByName(rest, allowMissingColumns=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
