"""The registered queries of the corpus operators, each over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docuquarry.llm import decontam, divergence, line_dedup, lpf, minhash, mixing, prefix_trie, quality, quality_rules, sharding, topk, toxicity, url_filter
from docuquarry.llm.runtime import table

#: (verdict, host, path) of the url rules.
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.line_dedup(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "kept_sha256")


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"), [5, 2, 1])
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lpf.remove_repeats(table(spark, sf_dir, "documents"), min_len=100)


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.interleave(table(spark, sf_dir, "documents"), 40).drop("position")


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [url_filter.host_path_rule(*r) for r in URL_RULES] + url_filter.GENERAL
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), rules).drop("n_candidates")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.divergence(table(spark, sf_dir, "documents"))


def op12_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.filter_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_conversation_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_line_dedup, op2_quality_classifier, op3_exact_top_k, op4_minhash_near_dedup, op5_benchmark_decontamination, op6_mix_sources, op7_suffix_array_dedup, op8_sharding, op9_url_filters, op10_toxicity, op11_source_divergence, op12_quality_rules, op13_conversation_prefix_trie, pipeline)}


_LINES = r"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(1 + length(coalesce(text, '')) - length(replace(coalesce(text, ''), chr(10), '')))) AS pos FROM documents),
k AS (SELECT *, regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', '') AS s FROM l),
t AS (SELECT *, CASE WHEN length(s) >= 10 THEN translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') END AS key FROM k),
f AS (SELECT key, min(doc_id) AS first FROM t WHERE key IS NOT NULL GROUP BY key),
m AS (SELECT t.*, coalesce(t.doc_id > f.first, false) AS gone FROM t LEFT JOIN f USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""

_URLS = r"""
WITH p AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r AS (SELECT * FROM (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')) AS r(verdict, h, q)),
b AS (SELECT p.*, (SELECT arg_max(h || q || ' ' || verdict, length(h || q)) FROM r WHERE (p.host = h OR suffix(p.host, '.' || h)) AND starts_with(p.path, q)) AS best FROM p)
SELECT page_id, host, path, split_part(best, ' ', 1) AS rule,
  CASE WHEN best IS NOT NULL THEN split_part(best, ' ', 2)
       WHEN regexp_matches(path, '(?i)(^|/)ads/') OR regexp_matches(path, '(?i)(^|/)banner[/.-]') OR regexp_matches(host, '(^|[.-])casino([.-]|$)')
         OR regexp_matches(path, '(?i)/login(\.[a-z]+)?/?$') OR regexp_matches(path, '(?i)/cart/?$') THEN 'block' ELSE 'allow' END AS verdict
FROM b"""


_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, v.vec_id, CAST(list_inner_product(CAST(q.e AS DOUBLE[]), CAST(v.e AS DOUBLE[])) AS BIGINT) AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 30),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM w JOIN k USING (lang, term) GROUP BY lang, source, term),
e AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS total, v.v FROM g JOIN k ON k.lang = g.lang JOIN v ON v.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
p AS (SELECT lang, source, term, n, 1 + (CAST(1000000000 AS HUGEINT) * (n + 5)) // (total + 5 * v) AS p FROM e),
q AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(n) + 5)) // (sum(sum(n)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM e GROUP BY lang, term),
f AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(f.value, 0) AS BIGINT) AS value FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source
    LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
  UNION ALL SELECT p.lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r)
SELECT lang, source, part, item, value, rank FROM o WHERE part = 'pair' OR rank <= 50"""

_TRIE = r"""
WITH t AS (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
n AS (SELECT c, count(*) AS n, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT))),
    lambda crc, x: list_reduce(list_prepend(xor(crc, x), range(8)), lambda r, i: xor(r >> 1, (r & 1) * 3988292384))), 4294967295) % 4 AS h FROM t GROUP BY c),
p AS (SELECT n.c, n.h, n.c - n.c % 20 AS base, least(n.h, coalesce(b.n, 0)) AS k FROM n LEFT JOIN n AS b ON b.c = n.c - n.c % 20),
r AS (SELECT c, pos - h + k AS pos, role, text FROM t JOIN p USING (c) WHERE pos >= h
  UNION ALL SELECT p.c, pos, role, text FROM t JOIN p ON t.c = base WHERE pos < k),
x AS (SELECT c, pos + 1 AS depth, sha256(string_agg(sha256(length(role) || ':' || role || text), '') OVER (PARTITION BY c ORDER BY pos)) AS d, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words FROM r
  UNION ALL SELECT c, 0, '', 0 FROM n),
e AS (SELECT *, depth = max(depth) OVER (PARTITION BY c) AS ends, lag(d) OVER (PARTITION BY c ORDER BY depth) AS up FROM x),
g AS (SELECT depth, d, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (ends), '')) AS ends_sha256,
  count(*) FILTER (ends) AS n_ends FROM e GROUP BY depth, d),
k AS (SELECT up AS d, depth - 1 AS depth, count(*) AS n FROM g WHERE depth > 0 GROUP BY ALL),
s AS (SELECT e.depth, e.d, count(*) FILTER (g.n_ends = g.n_convs) AS n_leaves, sum((g.n_convs - 1) * g.words) AS saved FROM g JOIN e ON e.c = g.conv_id AND e.depth <= g.depth GROUP BY ALL)
SELECT g.conv_id, g.depth, u.conv_id AS parent_conv_id, g.n_convs, coalesce(k.n, 0) AS n_children, s.n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, g.ends_sha256
FROM g JOIN s USING (depth, d) LEFT JOIN k USING (depth, d) LEFT JOIN g AS u ON u.depth = g.depth - 1 AND u.d = g.up"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _LINES, "op3_exact_top_k": _TOP_K, "op9_url_filters": _URLS, "op11_source_divergence": _DIVERGENCE, "op13_conversation_prefix_trie": _TRIE}
