"""Sharding by brute force, url rules in number, edge rows of line dedup, and the corpus queries beside their SQL."""

import glob
import hashlib
import os
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from docuquarry.llm import line_dedup, quality, queries, runtime, sharding, toxicity, url_filter
from tests.test_catalog import plain

DATA = "/root/testdata/sf0.001"


def brute_shards(rows, n_shards, seed="shard"):
    """(shard, slot) of each row as the docstring says: shuffled in its source, placed at the middle of its share, cut in equal runs."""
    named = []
    for i, t, s in rows:
        text = (t or "").encode()
        named.append(("" if s is None else "=" + s, hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, zlib.crc32(text), len(text) + 16))
    by = defaultdict(list)
    for r in named:
        by[r[0]].append(r)
    placed = sorted(((at + 0.5) / len(part), *r) for part in by.values() for at, r in enumerate(sorted(part, key=lambda r: r[1:])))
    cut = [len([p for p in range(len(rows)) if p * n_shards // len(rows) < k]) for k in range(n_shards)]
    return Counter((None if r[3] == -1 else r[3], r[5], r[4], p * n_shards // len(rows), p - cut[p * n_shards // len(rows)]) for p, r in enumerate(placed))


@pytest.mark.parametrize("n_shards", [7, 40])
def test_shards_against_brute_force(spark, n_shards):
    rng = np.random.default_rng(2)
    rows = [(int(i), "t" * int(rng.integers(0, 9)), ["a", "b", None, ""][int(rng.integers(0, 4))]) for i in rng.permutation(333)]
    rows += [(None, "x", "a"), (5000, None, "b"), (5001, "é", None), (7, "same", "a"), (7, "same", "a"), (7, "other", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", F.lit("x")).withColumn("shard", F.lit(1)).withColumn("_of", F.lit(2)).repartition(5)
    got = sharding.interleave(docs, n_shards).collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in got) == brute_shards(rows, n_shards)


def test_more_shards_than_rows(spark):
    got = sharding.interleave(spark.createDataFrame([(1, "a", "s"), (2, "b", "s")], "doc_id long, text string, source string"), 40).collect()
    assert len(got) == 2 and all(r.slot == 0 for r in got) and len({r.shard for r in got}) == 2


def test_many_rules_run_few_expressions(spark):
    """300 host rules: a url's tokens fetch its own, not the others."""
    rules = [url_filter.host_path_rule("block", f"site{k}.net", "/") for k in range(300)] + url_filter.GENERAL
    urls = [(k, f"http://www.site{k}.net/a/b?c") for k in range(0, 320, 5)] + [(1000, None), (1001, ""), (1002, "http://site3.net/"), (1002, "http://site3.net/"), (None, "http://x/ads/")]
    pages = spark.createDataFrame(urls, "page_id long, url string").withColumn("verdict", F.lit(0)).withColumn("_hit", F.lit(0))
    got = url_filter.filter_urls(pages, rules).collect()
    assert len(got) == len(urls) and max(r.n_candidates for r in got) <= 2
    by = Counter((r.page_id, r.rule, r.verdict) for r in got)
    for k in range(0, 300, 5):
        assert by[k, f"site{k}.net/", "block"] == 1
    assert by[300, None, "allow"] == 1 and by[1000, None, "allow"] == 1 and by[1001, None, "allow"] == 1 and by[1002, "site3.net/", "block"] == 2 and by[None, None, "block"] == 1


def test_rules_are_bounded_and_need_a_token(spark):
    pages = spark.createDataFrame([(1, "http://a/")], "page_id long, url string")
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, [url_filter.host_path_rule("block", f"s{k}", "/") for k in range(url_filter.MAX_RULES + 1)])
    with pytest.raises(ValueError):
        url_filter.filter_urls(pages, [url_filter.pattern_rule("x", "block", "--")])
    assert [r.verdict for r in url_filter.filter_urls(pages, []).collect()] == ["allow"]
    assert url_filter.filter_urls(pages.limit(0), url_filter.GENERAL).count() == 0


def test_lines_of_null_ids_and_repeated_rows(spark):
    long = "a line that is long enough"
    rows = [(None, f"{long}\nx"), (3, long), (3, long), (3, f"{long}\n{long}"), (4, f"y\n{long}"), (5, None), (6, "")] + [(100 + k, "\n".join([long] * 130 + ["z"])) for k in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("tie", F.lit("t")).withColumn("lost", F.lit(1)).repartition(3)
    got = line_dedup.line_dedup(docs).collect()
    assert Counter((r.doc_id, r.n_lines, r.n_dropped) for r in got) == Counter({(None, 2, 0): 1, (3, 1, 0): 2, (3, 2, 0): 1, (4, 2, 1): 1, (5, 1, 0): 1, (6, 1, 0): 1, (100, 131, 130): 1, (101, 131, 130): 1, (102, 131, 130): 1})
    keep = next(r for r in got if r.doc_id == 101)
    assert line_dedup.unpack(keep.keep_bitmap, 131).tolist() == [False] * 130 + [True] and len(keep.keep_bitmap) < 60
    assert next(r for r in got if r.doc_id == 4).kept_sha256 == hashlib.sha256(b"y").hexdigest()


def test_texts_meet_what_was_found_for_them(spark):
    docs = spark.createDataFrame([(i if i % 10 else None, i % 3, f"t{i}") for i in range(300)], "doc long, tie int, text string")
    found = spark.createDataFrame([(i, i % 3, i * i) for i in range(0, 400, 7)], "doc long, tie int, n int")
    got = runtime.meet_texts(docs, found, ["doc", "tie"])
    assert Counter(map(tuple, got.select("doc", "tie", "text", "n").collect())) == Counter(map(tuple, docs.join(found, ["doc", "tie"], "left").select("doc", "tie", "text", "n").collect()))
    assert runtime.meet_texts(docs, found.limit(0), ["doc", "tie"]).filter("n IS NULL").count() == 300


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", list(queries.oracle_sql()))
def test_corpus_query_beside_its_sql(spark, duck, name):
    df = queries.queries()[name](spark, DATA)
    result = duck.execute(queries.oracle_sql()[name])
    names = sorted(c[0] for c in result.description)
    at = [[c[0] for c in result.description].index(n) for n in names]
    assert names == sorted(df.columns)
    assert sorted(tuple(plain(r[c]) for c in names) for r in df.collect()) == sorted(tuple(plain(r[i]) for i in at) for r in result.fetchall())


def test_steps_need_a_shared_folder_off_local_mode(spark, monkeypatch):
    class Other:
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Other

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        runtime.shared_dir(Session)


def test_forgotten_steps_are_deleted(spark):
    step = runtime.materialize(spark.range(5), "trial")
    path = step.inputFiles()[0].removeprefix("file://")
    assert os.path.exists(path)
    runtime.forget(step)
    assert not os.path.exists(path)


def test_keys_of_many_rows_are_joined_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(runtime, "HOT_ROWS", 20)
    rows = spark.range(200).select((F.when(F.col("id") < 120, 0).otherwise(F.col("id") % 8)).alias("key"), "id")
    keyed = runtime.materialize(rows.groupBy("key").agg(F.count("*").alias("size"), F.min("id").alias("least")), "keyed")
    got = runtime.join_by_key(rows, keyed, "key", "size")
    assert Counter(map(tuple, got.select("id", "key", "least").collect())) == Counter(map(tuple, rows.join(keyed, "key").select("id", "key", "least").collect()))
    assert quality.THRESHOLD == 0.3 and toxicity.classify_toxicity is not None
