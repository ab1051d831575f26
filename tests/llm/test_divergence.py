"""The source divergence audit against brute force: odd rows, ties, several ranges of the vocabulary, several blocks of sources."""

import re
from collections import Counter, defaultdict

import pytest

from docuquarry.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string"


def brute(rows, least, top):
    docs = [(r[1] or "", r[2] or "", r[3] or "") for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t)) for t, _, _ in docs]
    df = defaultdict(Counter)
    for (_, lang, _), w in zip(docs, words, strict=True):
        df[lang].update(set(w))
    kept = {lang: sorted((t for t, n in c.items() if n >= least), key=str.encode) for lang, c in df.items()}
    uses = defaultdict(Counter)
    for (_, lang, source), w in zip(docs, words, strict=True):
        uses[lang, source].update(t for t in w if t in set(kept[lang]))

    def shares(lang, count):
        total = sum(count.values()) + 5 * len(kept[lang])
        return {t: 1 + 10**9 * (count[t] + 5) // total for t in kept[lang]}

    p = {g: shares(g[0], c) for g, c in uses.items()}
    q = {lang: shares(lang, sum((c for g, c in uses.items() if g[0] == lang), Counter())) for lang in kept}
    out = set()
    for lang, source in p:
        mine = p[lang, source]
        pairs = [(o, sum(abs(mine[t] - p[lang, o][t]) for t in mine)) for la, o in p if la == lang and o != source]
        terms = [(t, mine[t] - q[lang][t]) for t in mine if uses[lang, source][t] and mine[t] > q[lang][t]]
        for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
            ordered = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
            out |= {(lang, source, part, item, value, i) for i, (item, value) in enumerate(ordered, 1)}
    return out


def rows_of(n=240):
    some = ["alpha", "Beta", "éclat", "naïve", "x", "gamma1delta", "ﬁn", "\U00010437z", "ALPHA", "omega"]
    out = []
    for i in range(n):
        words = [some[(i * 7 + j * j) % (len(some) if i % 3 else 4)] for j in range(i % 23)]
        out.append((i, " ".join(words) + "\n" * (i % 2), ["en", "fr", None][i % 3], f"s{i % 11}" if i % 13 else None, "clash"))
    out += [(None, None, "en", "s1", None), (7, "", "de", "alone", None), (7, "beta " * 20_000, "en", "s2", None), out[5], out[5], (9, "! ?", "", "", "")]
    return out


@pytest.mark.parametrize("least,top", [(3, 50), (1, 4), (1000, 50)])
def test_matches_brute_force(spark, least, top):
    rows = rows_of()
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), least, top).collect()
    assert len(got) == len(set(got)) and {tuple(r) for r in got} == brute(rows, least, top)


def test_ranges_blocks_and_flushes(spark, monkeypatch):
    rows = rows_of(150)
    want = brute(rows, 2, 50)
    monkeypatch.setattr(divergence, "VOCABULARY_BYTES", 24)
    monkeypatch.setattr(divergence, "BLOCK_SOURCES", 4)
    monkeypatch.setattr(divergence, "BLOCK_POSTINGS", 9)
    monkeypatch.setattr(divergence, "HELD_COUNTS", 3)
    texts = spark.createDataFrame(rows, SCHEMA)
    assert {tuple(r) for r in divergence.divergence(texts, 2, 50).collect()} == want


def test_empty_table(spark):
    assert divergence.divergence(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_of_huge_counts(spark):
    got = spark.createDataFrame([(9 * 10**17, 10**18)], "c long, t long").select(divergence.share("c", "t")).first()[0]
    assert got == 1 + 10**9 * (9 * 10**17 + 5) // 10**18
