"""Quality classifier: a factorisation machine over hashed words and structure statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuquarry.llm import fm
from docuquarry.llm.runtime import filter_texts

#: Texts score as label 1 from here on.
THRESHOLD = 0.3


def held_out(mod: int, remainder: int, id_col: str = "doc_id") -> str:
    """SQL condition: crc32 of the id as text has this remainder; a null id counts as the empty text."""
    return f"pmod(crc32(cast(coalesce(cast({id_col} as string), '') as binary)), {mod}) = {remainder}"


def classify(docs: DataFrame, labels: DataFrame, label_col: str, n_terms: int, prior: float, mod: int, remainder: int, use_terms: float = 0.0) -> DataFrame:
    """For each row: doc_id, held_out, score, predicted (1 from THRESHOLD on); held-out ids are never learnt from."""
    out = held_out(mod, remainder)
    machine = fm.fit(docs, labels, label_col, f"NOT ({out})", n_terms, use_terms)
    scored = fm.score(docs, machine, prior)
    return scored.select("doc_id", F.expr(out).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def classify_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Quality of every row's whole text as labels.quality marks it; see classify and fm.fit.

    Inputs are hashed words, word beginnings and statistics taken from the text alone (its length
    among them): no other column. Null and empty texts get a score from the statistics; without
    labels all score 0.5; repeated rows score alike.
    """
    return classify(docs, labels, "quality", n_terms=600, prior=0.5, mod=5, remainder=0, use_terms=0.01)


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs, all columns kept, that classify_quality predicts as 1; all of them without labels.

    Null and empty texts are judged by their statistics like any other; repeated rows stay or go together.
    """
    machine = fm.fit(docs, labels, "quality", f"NOT ({held_out(5, 0)})", 600, 0.01)
    if machine is None:
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return filter_texts(docs, "text", lambda buf, off: shared.value.score(*fm.features(buf, off)) >= THRESHOLD)
