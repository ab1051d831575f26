"""Toxicity: a factorisation machine over hashed terms, whose factors learn which terms are toxic together."""

from __future__ import annotations

from pyspark.sql import DataFrame

from docuquarry.llm.quality import classify


def classify_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Toxicity of every row's whole text as labels.toxic marks it; cases as in quality.classify_quality."""
    return classify(docs, labels, "toxic", n_terms=2_000, prior=0.0, mod=4, remainder=2)
