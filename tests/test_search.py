"""Positional full text, the partitioned vector index and the descent, against brute force on small tables."""

import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docuquarry.plans import descent, positional
from docuquarry.plans import vector_index as vi

TEXTS = ["Notice of termination must be written", "termination notice", "written notice, of the termination", "auto-renew unless written", "auto then renew", None, "", "notice notice of terminations"]


@pytest.fixture(scope="module")
def texts(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")


@pytest.mark.parametrize("query,found", [
    ("termination", [0, 1, 2, 7]), ('"notice of termination"', [0, 7]), ('"termination notice"', [1]), ("termination -written", [1, 7]), ("auto-renew", [3]), ("renew -auto-renew", [4]),
    ('"auto-renew" or "termination notice"', [1, 3]), ('written -"notice of termination"', [2, 3]), ("-written", []), ("", []), ("of the", []), ("or", []), ('"notice of terminat', []), ("written notice or auto -unless", [0, 2, 4]),
])
def test_query_syntax(spark, texts, query, found):
    asked = spark.createDataFrame([(1, query)], "query_id int, query string")
    assert sorted(r.id for r in positional.search_texts(texts, asked, "id", {"text": 1.0}).collect()) == found


def test_written_index_fields_and_many_questions(spark, texts):
    rows = texts.withColumn("title", F.when(F.col("id") == 4, "Termination of notice"))
    index = positional.index(rows, "id", {"title": 1.0, "text": 0.4})
    asked = spark.createDataFrame([(1, "termination notice"), (2, '"termination of notice"'), (3, None), (1_000, "renew")], "query_id int, query string")
    got = positional.search(index, asked, "id", limit=3).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.rank) if r.query_id == 1][0] == 4  # the title weighs more
    assert [(r.id, r["rank"]) for r in got if r.query_id == 2] == [(4, 1)] and {r.query_id for r in got} == {1, 2, 1_000}
    both = positional.search_texts(rows, asked, "id", {"title": 1.0, "text": 0.4}, limit=3)
    assert sorted(map(tuple, both.collect())) == sorted(map(tuple, got))


def test_plain_words_keep_stop_words(spark, texts):
    asked = spark.createDataFrame([(1, '"of the"')], "query_id int, query string")
    assert [r.id for r in positional.search_texts(texts, asked, "id", {"text": 1.0}, plain=True).collect()] == [2]


def brute(x, ids, asked, k, allowed=None, floor=-2.0):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    for q in asked:
        s = unit @ unit[q]
        order = sorted((i for i in range(len(x)) if ids[i] != q and s[i] >= floor and (allowed is None or allowed(q, i))), key=lambda i: (-round(s[i], 9), ids[i]))[:k]
        out += [(q, ids[i], r + 1) for r, i in enumerate(order)]
    return sorted(out)


def test_index_equals_the_full_scan_and_reads_less(spark):
    rng = np.random.default_rng(5)
    heads = rng.normal(size=(12, 8))
    x = np.repeat(heads, 40, axis=0) + 0.05 * rng.normal(size=(480, 8))
    x[100:110] = x[99]  # ties
    rows = [(i, [float(v) for v in x[i]], i % 3) for i in range(480)]
    odd = [(900, [0.0] * 8, 0), (901, None, 0), (902, [float("nan")] * 8, 1), (903, [None] * 8, 1)]
    df = spark.createDataFrame(rows + odd, "id long, embedding array<double>, project long")
    centres = vi.fit_centres(df, "id", n_centres=12)
    index = vi.assign(df, centres)
    assert index.count() == 480
    asked = df.where("id % 48 = 0").select(F.col("id").alias("query_id"), "embedding", F.when(F.col("id") < 200, F.array(F.lit(0), F.lit(2)).cast("array<long>")).alias("projects"))
    got = vi.nearest(index, centres, asked, 5, "id").collect()
    assert sorted((r.query_id, r.id, r["rank"]) for r in got) == brute(x, range(480), range(0, 480, 48), 5)
    assert max(r.cells_read for r in got) < 12 and np.mean([r.cells_read for r in got]) < 5
    some = vi.nearest(index, centres, asked, 60, "id", where=F.col("id") % 2 == 0, match={"project": "projects"}, floor=0.5).collect()
    allowed = lambda q, i: i % 2 == 0 and (q >= 200 or i % 3 in (0, 2))
    assert sorted((r.query_id, r.id, r["rank"]) for r in some) == brute(x, range(480), range(0, 480, 48), 60, allowed, 0.5)


def test_index_in_small_blocks_and_without_rows(spark, monkeypatch):
    monkeypatch.setattr(vi, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 4))
    df = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(60)], "id long, embedding array<double>")
    centres = vi.fit_centres(df, "id", n_centres=3)
    asked = df.where("id < 20").withColumnRenamed("id", "query_id")
    assert sorted((r.query_id, r.id, r["rank"]) for r in vi.nearest(vi.assign(df, centres), centres, asked, 4, "id").collect()) == brute(x, range(60), range(20), 4)
    assert vi.nearest(vi.assign(df, centres), centres, asked, 4, "id", where=F.lit(False)).count() == 0


def test_descent_narrows_each_question_by_itself(spark):
    at = lambda a: [float(np.cos(a)), float(np.sin(a))]
    rows = [("document_summary", 1, 10, at(0.0)), ("document_summary", 2, 20, at(1.5)), ("clause", 3, 10, at(0.1)), ("clause", 4, 20, at(0.05)), ("clause", 5, 20, at(1.4)), ("chunk", 6, 10, at(0.2)), ("chunk", 7, 20, at(1.3)), ("chunk", 8, 10, at(3.0))]
    rows = spark.createDataFrame(rows, "level string, ref_id long, contract_id long, embedding array<double>")
    asked = spark.createDataFrame([(100, at(0.02)), (200, at(1.45)), (300, at(-1.5))], "query_id long, embedding array<double>")
    levels = [descent.Level("document_summary", 2, 0.9), descent.Level("clause", 5, 0.0), descent.Level("chunk", 1, 0.0)]
    chunks = spark.createDataFrame([(6, 10, 1), (8, 10, 2), (7, 20, 1)], "ref_id long, contract_id long, reading_order long")
    got = {q: {(r.level, r.ref_id, r.source) for r in rs} for q, rs in ((q, [r for r in descent.descend(rows, asked, levels, chunks=chunks, window=1).collect() if r.query_id == q]) for q in (100, 200, 300))}
    assert got[100] == {("document_summary", 1, "vector"), ("clause", 3, "vector"), ("chunk", 6, "vector"), ("chunk", 8, "neighbour")}
    assert got[200] == {("document_summary", 2, "vector"), ("clause", 5, "vector"), ("clause", 4, "vector"), ("chunk", 7, "vector")}
    assert {x[:2] for x in got[300]} <= {("clause", 4), ("clause", 3), ("chunk", 6)} and got[300]  # no summary: nothing narrows


def test_a_filter_that_finds_nothing_is_dropped_once(spark):
    from docuquarry.plans import evidence

    kinds = spark.createDataFrame([("a", "clause", 0.9), ("b", "document_summary", 0.8)], "kind string, level string, similarity double")
    asked = spark.createDataFrame([(1, ["a"]), (2, ["zz"]), (3, []), (4, None), (5, ["b"])], "query_id int, types array<string>")
    found = evidence.retried(asked, lambda q: q.join(kinds, F.col("types").isNull() | F.array_contains("types", F.col("kind"))).select("query_id", "level", "similarity"))
    got = {r.query_id: (r.similarity, r.answered, r.relaxed) for r in evidence.answerable(asked, found).collect()}
    assert got == {1: (0.9, True, False), 2: (0.9, True, True), 3: (0.9, True, False), 4: (0.9, True, False), 5: (None, False, False)}


def test_a_frequent_term_does_not_meet_every_question_that_names_it(spark):
    """Each question's phrase stands in one text, its other word in all: what is joined stays near the texts' size."""
    n = 300
    rows = spark.createDataFrame([(i, f"alpha{i} beta{i} common gamma{i} tail") for i in range(n)], "id int, text string")
    asked = spark.createDataFrame([(i, f'"alpha{i} beta{i}" common -gamma{(i + i % 2)} or "common gamma{i} tail"') for i in range(n)], "query_id int, query string")
    index = positional.index(rows, "id", {"text": 1.0})
    for found in (positional.search(index, asked, "id"), positional.search_texts(rows, asked, "id", {"text": 1.0})):
        assert sorted((r.query_id, r.id, r.score, r["rank"]) for r in found.collect()) == [(i, i, 1.386294 if i % 2 else 0.693147, 1) for i in range(n)]
    plan = positional.search_texts(rows, asked, "id", {"text": 1.0})._jdf.queryExecution().optimizedPlan().toString()
    assert "starts" not in plan  # no list of starts for each question and row that share a term


def test_phrases_of_many_steps_and_repeated_clauses(spark):
    texts = spark.createDataFrame([(1, "one two three one two four"), (2, "one two x three"), (3, "one of three, one of three"), (None, "one two three")], "id int, text string")
    asked = spark.createDataFrame([(1, '"one two three"'), (2, '"one of three"'), (3, '"one two" "one two"'), (4, "three three -two")], "query_id int, query string")
    got = lambda found: sorted((r.query_id, r.id or 0, r.score) for r in found.collect())
    want = [(1, 0, 0.693147), (1, 1, 0.693147), (2, 0, 0.693147), (2, 1, 0.693147), (2, 3, 1.098612), (3, 0, 1.386294), (3, 1, 2.197225), (3, 2, 1.386294), (4, 3, 2.197225)]
    assert got(positional.search_texts(texts, asked, "id", {"text": 1.0})) == want
    assert got(positional.search(positional.index(texts, "id", {"text": 1.0}), asked, "id")) == want


def test_questions_that_are_all_narrowed_leave_no_empty_block(spark):
    """Far more chunks than a block holds, and no question that sees all of them: the wide leg has rows and no questions."""
    rows = spark.range(9_000).select(F.when(F.col("id") < 3, "document_summary").otherwise("chunk").alias("level"), F.col("id").alias("ref_id"), (F.col("id") % 3).alias("contract_id"), F.array(F.cos(F.col("id") / 3_000), F.sin(F.col("id") / 3_000)).cast("array<float>").alias("embedding"))
    asked = rows.where("ref_id IN (300, 6000)").select(F.col("ref_id").alias("query_id"), "embedding")
    assert descent.retrieval.knn_of(rows, asked.where("false"), 3, "ref_id").count() == 0
    assert descent.retrieval.knn_of(rows.where("false"), asked, 3, "ref_id").count() == 0
    hits = asked.select("query_id", F.explode(F.expr("array(7L, 9L, 11L)")).alias("ref_id"), F.lit(1.0).alias("score")).withColumn("contract_id", F.col("ref_id") % 3)
    got = descent.descend(rows, asked, [descent.Level("document_summary", 1, -1.0), descent.Level("chunk", 4, -1.0)], hits)
    text = got._jdf.queryExecution().optimizedPlan().toString()
    assert "InMemoryRelation" not in text and "FlatMapCoGroups" not in text  # levels are written, no plan carries those before
    found = {q: [r.ref_id for r in sorted(got.where(f"query_id = {q} AND level = 'chunk'").collect(), key=lambda r: r["rank"])] for q in (300, 6_000)}
    # the nearest of the contract of the nearest summary, 2, and what its words found there
    assert found == {300: [11, 299, 302, 296], 6_000: [11, 5_999, 6_002, 5_996]}


@pytest.mark.parametrize("share,pieces", [(2, 400_000), (1_000, 50)])
def test_search_writes_no_row_for_each_question_and_text_that_meet(spark, monkeypatch, share, pieces):
    """Every question meets every text: what is written between the steps stays near the texts' size, and the first of each are those of a full evaluation."""
    monkeypatch.setattr(positional, "SHARE", share, raising=False)
    monkeypatch.setattr(positional, "BROADCAST_ROWS", pieces)
    written = []
    monkeypatch.setattr(positional, "settled", lambda df, held=positional.settled: (out := held(df), written.append(out.count()))[0])
    n, words = 60, ["alpha", "beta", "gamma", "delta", "omega"]
    said = {i: " ".join([*words, *(["alpha beta"] * (i * 7 % 5)), *(["gammas"] * (i * 3 % 4)), *([f"own{i}"] if i % 3 else [])]) for i in range(n)}
    rows = spark.createDataFrame([*said.items(), (None, "alpha beta gamma")], "id int, text string")
    asked = spark.createDataFrame([(q, f'"alpha beta" gamma -own{q} or "beta gamma delta omega" alpha alpha -"own{q}"') for q in range(n)], "query_id int, query string")
    got = {(r.query_id, r["rank"]): (r.id, r.score) for r in positional.search_texts(rows, asked, "id", {"text": 0.4}, limit=5).collect()}
    assert max(written) <= 8 * n
    want = {}
    for q in range(n):
        score = {None: round(2 * np.log(1.4), 6)} if q >= 0 else {}
        for i, text in said.items():
            if i == q and q % 3:
                continue
            w = text.split()
            pairs = sum(w[j : j + 2] == ["alpha", "beta"] for j in range(len(w)))
            gammas, alphas = sum(x in ("gamma", "gammas") for x in w), w.count("alpha")
            score[i] = round(max(np.log1p(0.4 * pairs) + np.log1p(0.4 * gammas), np.log1p(0.4) + 2 * np.log1p(0.4 * alphas)), 6)
        best = sorted(score.items(), key=lambda x: (-x[1], -1 if x[0] is None else x[0]))[:5]
        want |= {(q, r + 1): x for r, x in enumerate(best)}
    assert got.keys() == want.keys() and all(got[k][0] == want[k][0] and abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
