"""The factorisation machines: their formula, an interaction that no sum of weights can say, and odd inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docuquarry.llm import fm, quality, toxicity


def machine(seed=0):
    rng = np.random.default_rng(seed)
    slot = np.full(1 << fm.BITS, -1, np.int32)
    slot[:40] = np.arange(40)
    width = 40 + fm.N_STATS * 4
    return fm.Machine(slot, np.sort(rng.random((fm.N_STATS, 3)), axis=1), 40, 0.3, rng.normal(0, 0.3, width), rng.normal(0, 0.3, (width, 5)))


def test_score_is_the_pair_sum():
    """Linear time against every pair of inputs."""
    m, rng = machine(), np.random.default_rng(1)
    doc, bucket = np.repeat(np.arange(6), 30), rng.integers(0, 60, 180)
    stats = rng.random((6, fm.N_STATS))
    got = m.score(doc, bucket, stats)
    d, f = m.inputs(doc, bucket, stats)
    for i in range(6):
        on = f[d == i].tolist()
        assert len(set(on)) == len(on)
        z = m.b + sum(m.w[j] for j in on) + sum(m.v[j] @ m.v[k] for n, j in enumerate(on) for k in on[n + 1 :])
        assert abs(got[i] - 1 / (1 + np.exp(-z))) < 1e-12


def interaction_rows():
    """Insult alone and group alone are clean, both together toxic; each word is as frequent in either class."""
    rng = np.random.default_rng(4)
    rows, labels = [], []
    for i in range(4_000):
        kind = i % 4
        w = [f"w{x}" for x in rng.integers(0, 200, 30)] + ["idiots"] * (kind in (0, 2)) + ["foreigners"] * (kind in (1, 2))
        rng.shuffle(w)
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(kind in (2, 3))))  # with neither word: toxic too, so that no weight of a word tells anything
    return rows, labels


def test_the_factors_learn_what_no_weight_of_a_word_says(spark):
    rows, labels = interaction_rows()
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    m = fm.fit(docs, marks, "toxic", f"NOT ({quality.held_out(4, 2)})", 2_000)
    truth = {i: t for i, _, t in labels}

    def right(machine):
        got = [r for r in fm.score(docs, machine, 0.0).withColumn("out", F.expr(quality.held_out(4, 2))).collect() if r.out]
        assert len(got) > 500
        return sum((r.score >= 0.5) == truth[r.doc_id] for r in got) / len(got)

    assert right(m) > 0.95
    m.v[:] = 0
    assert right(m) < 0.7


@pytest.mark.parametrize("classify", [quality.classify_quality, toxicity.classify_toxicity])
def test_odd_rows_have_scores(spark, classify):
    rows, labels = interaction_rows()
    rows = rows[:400] + [(9000, None), (9001, ""), (9002, "  \n\t"), (None, "idiots"), (9003, "word " * 200_000), (3, rows[3][1]), (3, "another text")]
    labels = [(i, int(i % 3 > 0), t) for i, _, t in labels[:400]] + [(3, 0, 1), (5, None, None), (None, 1, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("y", F.lit(7)).withColumn("score", F.lit("x")).withColumn("held_out", F.lit(1)).withColumn("terms", F.lit(0))
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int").withColumn("text", F.lit("label")).withColumn("y", F.lit(0))
    got = classify(docs, marks).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(i) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    scores = {}
    for r in got:
        scores.setdefault(r.doc_id, []).append(r.score)
    assert len(set(scores[3])) <= 2 and len(scores[3]) == 3
    assert scores[9000] == scores[9001]
    assert sorted(r.score for r in classify(docs, marks).collect()) == sorted(r.score for r in got)


def test_labels_and_other_columns_are_no_inputs(spark):
    """A score depends on the text alone."""
    rows, labels = interaction_rows()
    docs = spark.createDataFrame([(i, t, "a") for i, t in rows[:800]], "doc_id long, text string, source string")
    marks = spark.createDataFrame(labels[:800], "doc_id long, quality int, toxic int")
    m = fm.fit(docs, marks, "toxic", f"NOT ({quality.held_out(4, 2)})", 200)
    renamed = docs.select((F.col("doc_id") + 10_000).alias("doc_id"), "text", F.lit("other").alias("source"))
    assert sorted(r.score for r in fm.score(docs, m, 0.0).collect()) == sorted(r.score for r in fm.score(renamed, m, 0.0).collect())


def test_a_sample_of_many_terms_is_cut(spark, monkeypatch):
    rows, labels = interaction_rows()
    docs, marks = spark.createDataFrame(rows[:800], "doc_id long, text string"), spark.createDataFrame(labels[:800], "doc_id long, quality int, toxic int")
    read = []
    train = fm.train
    monkeypatch.setattr(fm, "train", lambda parts, *a, **k: read.append(sum(4 * len(b) for b, _ in parts)) or train(parts, *a, **k))
    monkeypatch.setattr(fm, "SAMPLE_BYTES", 20_000)
    assert fm.fit(docs, marks, "toxic", "true", 50) is not None and 15_000 < read[0] <= 20_000


@pytest.mark.parametrize("classify, prior", [(quality.classify_quality, 0.5), (toxicity.classify_toxicity, 0.0)])
def test_tables_without_rows(spark, classify, prior):
    docs, marks = spark.createDataFrame([(1, "a")], "doc_id long, text string"), spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert classify(docs.limit(0), marks).count() == 0
    assert [r.score for r in classify(docs, marks.limit(0)).collect()] == [prior]
    assert [r.score for r in classify(docs, marks).collect()] == [prior]
    assert quality.keep_good(docs, marks.limit(0)).count() == 1 and quality.keep_good(docs.limit(0), marks).count() == 0


def test_rows_that_share_an_id_are_bounded(spark, monkeypatch):
    seen = []
    train = fm.train
    monkeypatch.setattr(fm, "train", lambda docs, *a, **k: seen.append(len(docs)) or train(docs, *a, **k))
    rows = [(1, "")] * 3_000 + [(i, f"word{i % 7} good text") for i in range(2, 60)] + [(i, "bad bad bad") for i in range(60, 120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 60)) for i in range(1, 120)], "doc_id long, quality int")
    machine = fm.fit(docs, labels, "quality", "true", 50, sample_rows=70)
    assert seen == [70 + 60] and machine is not None
