"""Queries over every row of their tables, against brute force, and quotes as text extraction mangles them."""

import pytest

from docuquarry import catalog, catalog_documents  # noqa: F401  (registers its queries)
from docuquarry.plans import evidence


def put(spark, tmp_path, name, rows, schema):
    spark.createDataFrame(rows, schema).write.parquet(f"{tmp_path}/{name}.parquet")


def test_the_walk_starts_from_every_part(spark, tmp_path):
    put(spark, tmp_path, "part", [(i,) for i in range(1, 101)], "p_partkey long")
    want = set()
    for i in range(1, 101):
        up, depth = i // 3, 1
        while up and depth <= 12:
            want.add((i, up, depth))
            up, depth = up // 3, depth + 1
    got = [tuple(r) for r in catalog.QUERIES["ancestor_walk_all"](spark, str(tmp_path)).select("id", "ancestor", "depth").collect()]
    assert len(got) == len(want) and set(got) == want
    assert {i for i, _, _ in got} == set(range(3, 101))


def test_edges_start_from_every_order(spark, tmp_path):
    orders = [(k, k % 4, float(k * 7 % 50)) for k in range(1, 61)]
    put(spark, tmp_path, "orders", orders, "o_orderkey long, o_custkey long, o_totalprice double")
    want = {}
    for q in range(4):
        hits = [k for _, k in sorted((-price, k) for k, c, price in orders if c == q)]
        for rank, k in enumerate(hits[:10], 1):
            for node in [k + 1] + [k - 1] * (k > 1):
                if node not in hits:
                    want[q, node] = max(want.get((q, node), 0), round(0.4 / rank, 6))
    got = {(r["q"], r["node"]): r["score"] for r in catalog.QUERIES["graph_expansion_all"](spark, str(tmp_path)).collect()}
    assert got == want


PLAIN = """The supplier's "final" fees - less five - fl oz of fluid"""
SET = "The\u00a0supplier\u2019s \u201c\ufb01nal\u201d fees \u2013 less\u2003\ufb01ve \u2212 \ufb02 oz\u202fof\u3000\ufb02uid"


@pytest.mark.parametrize("quote, text", [(PLAIN, SET), (SET, PLAIN), ("it\u2018s", "it's"), ("a \u2014 b", "a - b"), ("A\u2013B", "a\u2212b")])
def test_typographic_quotes_are_verbatim(spark, quote, text):
    rows = spark.createDataFrame([(quote, f"Before.\n{text} after")], "quote string, text string")
    assert [r["verdict"] for r in evidence.check_quotes(rows, "quote", "text").collect()] == ["ok"]


def test_a_quote_of_white_space_is_empty(spark):
    rows = spark.createDataFrame([("\u00a0\u2003\u3000", "text")], "quote string, text string")
    assert [r["verdict"] for r in evidence.check_quotes(rows, "quote", "text").collect()] == ["empty"]


def test_altered_quotes_reach_every_verdict(spark):
    got = {(r["kind"], r["verdict"]) for r in catalog.QUERIES["altered_quote_checks"](spark, "/root/testdata/sf0.001").collect()}
    assert {("typographic", "ok"), ("short", "partial"), ("long", "ok"), ("invented", "rejected")} <= got
