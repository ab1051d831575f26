"""The pipeline's stages against brute force, on rows with null ids, null and empty texts, repeats and further columns, and on empty tables."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from docuquarry.llm import mixing, quality
from tests.llm.test_operators import brute_groups, brute_mixture, reachable

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards watch from the hill"


def rows():
    rng = np.random.default_rng(11)
    prose = lambda n: " ".join(f"w{x}" for x in rng.integers(0, 400, n))
    out = []
    for i in range(240):
        text = prose(40) if i % 4 else " ".join([f"w{i}"] * 40)
        out.append((i, text, "s%d" % (i % 3)))
    base = out[1][1]
    out += [(300, base, "s1"), (301, base + " tail", "s2"), (302, f"{prose(20)} {ITEM} {prose(20)}", "s0"), (303, f"{ITEM} {prose(2000)}", "s0")]
    out += [(304, None, "s0"), (305, "", None), (None, prose(30), None), (306, prose(25), "s1"), (306, prose(26), "s1"), (307, out[5][1] + " x", "s2"), (307, out[5][1] + " x", "s2")]
    return out


def frame(spark, data):
    df = spark.createDataFrame([(i, t, "en", s, None if t is None else len(t)) for i, t, s in data], "doc_id long, text string, lang string, source string, n_chars int")
    return df.withColumn("copies", F.lit("c")).withColumn("row", F.lit(0)).withColumn("id", F.lit(1)).repartition(4)


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(240)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([("a", ITEM)], "item_id string, text string").write.parquet(f"{d}/benchmark.parquet")
    frame(spark, rows()).write.parquet(f"{d}/documents.parquet")
    return d


def as_rows(df):
    return Counter((r.doc_id, r.text, r.source) for r in df.collect())


def test_quality_keeps_what_the_operator_accepts(spark, sf_dir):
    docs = frame(spark, rows())
    kept = cp.keep_quality(spark, docs, sf_dir)
    marks = spark.read.parquet(f"{sf_dir}/labels.parquet")
    by_id = {}
    for r in quality.classify_quality(docs, marks).collect():
        by_id.setdefault(r.doc_id, []).append(r.predicted)
    assert kept.columns == docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got == Counter({i: sum(p) for i, p in by_id.items() if sum(p)})
    held = [i for i in range(240) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert sum((got[i] > 0) == (i % 4 > 0) for i in held) >= 0.95 * len(held)


def test_near_duplicates_keep_the_smallest_id(spark, sf_dir):
    data = rows()
    once = {i: t for i, t, _ in data if i not in (None, 306)}
    groups = brute_groups(list(once.items()))
    want = Counter((i, t, s) for i, t, s in data if i in (None, 306) or groups[i][2])
    docs = frame(spark, data)
    got = cp.drop_near_duplicates(spark, docs, sf_dir)
    assert got.columns == docs.columns and as_rows(got) == want
    assert (300, data[1][1], "s1") not in want and want[304, None, "s0"] == 1


def test_contaminated_documents_go(spark, sf_dir):
    data = rows()
    docs = frame(spark, data)
    got = cp.drop_benchmark_passages(spark, docs, sf_dir)
    assert got.columns == docs.columns
    assert as_rows(got) == Counter(r for r in data if r[0] != 302)  # 303 has the passage in under a twentieth of its words


def test_the_mixture_takes_what_the_operator_says(spark, sf_dir):
    data = rows()
    docs = frame(spark, data)
    got = cp.mix(spark, docs, sf_dir)
    assert got.columns == docs.columns
    seen = as_rows(got)
    size, target, copies = brute_mixture(data, cp.WEIGHTS)
    assert Counter(i for i, *_ in seen.elements()) == +copies
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    for s in size:
        lengths = Counter(words(t) for _, t, x in data if x == s)
        rest = round(target[s] - size[s] * (target[s] // size[s])) if size[s] else 0
        off = min(abs(x - rest) for x in reachable(list(lengths), list(lengths.values())))
        assert abs(sum(words(t) * n for (_, t, x), n in seen.items() if x == s) - target[s]) <= off + 0.5  # as near as its lengths allow
    for (i, t, s), n in seen.items():
        assert n <= 2 * data.count((i, t, s))
    assert as_rows(cp.mix(spark, docs.repartition(2), sf_dir)) == seen


def test_the_whole_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
    want = Counter((r.doc_id, zlib.crc32((r.text or "").encode())) for r in docs.collect())
    out = cp.run(spark, sf_dir).collect()
    assert Counter((r.doc_id, r.text_crc32) for r in out) == want and len(out) > 100
    per = Counter(r.shard for r in out)
    assert set(per) == set(range(cp.N_SHARDS)) and max(per.values()) - min(per.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in per.items())


@pytest.mark.parametrize("stage", [f for _, f in cp.STAGES], ids=[n for n, _ in cp.STAGES])
def test_empty_documents_stay_empty(spark, sf_dir, stage):
    docs = frame(spark, rows()).limit(0)
    assert stage(spark, docs, sf_dir).count() == 0


def test_sources_of_many_repeats(spark, sf_dir):
    """A third of all rows is one row: its copies are of that row, and the source comes near its target."""
    data = [(1, "a b c", "s0")] * 100 + [(i, f"x{i} y z", "s%d" % (i % 2)) for i in range(2, 202)]
    got = as_rows(cp.mix(spark, frame(spark, data), sf_dir))
    _, target, copies = brute_mixture(data, cp.WEIGHTS)
    assert got[1, "a b c", "s0"] == copies[1] and sum(got.values()) * 3 == pytest.approx(sum(target.values()), abs=6)
    assert mixing.MAX_SOURCES >= 2
