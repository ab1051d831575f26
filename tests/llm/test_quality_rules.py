"""Quality rules: statistics against brute force, the learnt list against a planted rule and held-out labels."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from docuquarry.llm import quality_rules as q
from docuquarry.llm.quality import held_out


def brute(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = {}
    for i in range(len(w) - 7):
        seen.setdefault(tuple(w[i : i + 8]), []).append(i)
    hit = {i + j for at in seen.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def texts():
    r = random.Random(4)
    some = "alpha beta gamma é# $5 \U00010437x | <b> one two".split()
    out = [None, "", " \n\t ", "a", "\x0b".join(["w"] * 8), " ".join(["w"] * 9), " ".join(f"w{i}" for i in range(19)), " ".join(f"w{i}" for i in range(20)), "x y\nx y\n\n \n x y\r\nx y\n"]
    out += [" ".join(f"w{i % k}" for i in range(60)) for k in (7, 8, 9, 25, 31, 59)]
    for _ in range(120):
        words = [r.choice(some[: r.choice([2, 9])]) for _ in range(r.randrange(70))]
        part = words[: r.randrange(20)]
        out.append(r.choice([" ", "\n", "\t \x0c"]).join(words + part * r.randrange(3)))
    return out + [" ".join(f"w{i % 40_000}" for i in range(60_000)), "x" * 200_000]


def test_statistics_match_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(rows)], "doc_id long, text string, n_words string")
    got = {r[0]: tuple(r)[1:] for r in q.judge(docs, []).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed").collect()}
    assert got == {i: brute(t) for i, t in enumerate(rows)}
    assert q.judge(docs, []).filter("kept = base_failed").isEmpty()


def test_planted_rules_are_found():
    r = np.random.default_rng(1)
    x = r.random((4_000, len(q.FEATURES)))
    bad = (x[:, 1] > 0.8) & (x[:, 4] <= 0.5) | (x[:, 6] > 0.95)
    rules = q.learn(x, bad, np.ones(len(x)))
    said = np.zeros(len(x), bool)
    for rule in rules:
        said |= rule.holds(x)
    assert (said == bad).mean() > 0.985 and len(rules) <= 6
    assert q.learn(x, np.zeros(len(x), bool), np.ones(len(x))) == []


def test_list_is_ordered_conditions(spark):
    first, second = q.Rule((("mean_word", True, 3.0), ("symbols_per_word", False, 0.1))), q.Rule((("mean_word", True, 2.0),))
    stats = spark.createDataFrame([(10, 40, 0), (10, 40, 5), (10, 10, 0)], "n_words long, word_chars long, n_symbols long")
    assert [r[0] for r in stats.select(q.verdict([first, second])).collect()] == [1, 2, None]
    assert stats.select(q.verdict([])).first()[0] is None


@pytest.fixture(scope="module")
def judged(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{n}.parquet") for n in ("documents", "labels"))
    return q.filter_quality(docs, labels), labels.filter(held_out(5, 0)), docs


def test_held_out_labels(judged):
    out, labels, _ = judged
    seen = dict(((r[0], r[1]), r[2]) for r in out.join(labels, "doc_id").filter("NOT base_failed").groupBy("quality", "kept").count().collect())
    good, bad = seen.get((1, True), 0) / sum(n for (y, _), n in seen.items() if y == 1), seen.get((0, False), 0) / sum(n for (y, _), n in seen.items() if y == 0)
    assert good > 0.99 and bad > 0.9


def test_no_python_on_the_executors(judged):
    plan = judged[0]._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def test_odd_inputs(spark):
    schema, marks = "doc_id long, text string, tie string", "doc_id long, quality int"
    docs = spark.createDataFrame([(1, "a b", "x"), (1, "a b", "x"), (None, None, None)], schema)
    none = spark.createDataFrame([], marks)
    assert q.filter_quality(docs, none).count() == 3
    assert q.filter_quality(spark.createDataFrame([], schema), none).count() == 0
    odd = spark.createDataFrame([(1, 0), (1, 1), (2, None), (None, 1), (3, 1), (4, 0)], marks)
    assert q.filter_quality(docs, odd).filter(F.col("kept")).isEmpty()
