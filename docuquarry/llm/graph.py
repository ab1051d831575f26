"""Connected components of an edge table, without collecting any of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docuquarry.llm.runtime import forget, materialize


def components(edges: DataFrame) -> DataFrame:
    """(id, comp) of every end of the edges (a, b): comp is the smallest id reachable.

    Rounds of taking the neighbours' least label and of following labels to their labels' labels;
    long chains halve, so rounds grow with the logarithm of the longest path.
    """
    both = materialize(edges.select(F.col("a").alias("id"), F.col("b").alias("to")).unionByName(edges.select(F.col("b").alias("id"), F.col("a").alias("to"))).distinct(), "edges")
    step = materialize(both.groupBy("id").agg(F.min("to").alias("to")).select("id", F.least("id", "to").alias("comp")), "labels")
    while True:
        labels = step.select("id", "comp")
        heard = both.join(labels.select(F.col("id").alias("to"), "comp"), "to").groupBy("id").agg(F.min("comp").alias("heard"))
        told = labels.join(heard, "id").select("id", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        roots = told.select(F.col("id").alias("comp"), F.col("comp").alias("root"))
        before, step = step, materialize(told.join(roots, "comp").select("id", "was", F.least("comp", "root").alias("comp")), "labels")
        forget(before)
        if step.filter("comp <> was").isEmpty():
            forget(both)
            return step.select("id", "comp")
