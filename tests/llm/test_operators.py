"""The corpus operators against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from docuquarry.llm import decontam, graph, line_dedup, lpf, minhash, mixing, quality, sharding, topk, toxicity, url_filter
from docuquarry.llm import textkit as tk

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
LINE = "The same long line stands here again"
PASSAGE = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega and one more word to pass a hundred bytes"


def corpus():
    rng = np.random.default_rng(3)
    word = lambda: "".join(rng.choice(list("abcdefgé"), rng.integers(1, 6)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base = prose(60)
    rows = [(1, None), (2, ""), (3, "   \n\t"), (4, "one two"), (5, "One  TWO"), (6, base), (7, base + " tail"), (8, base), (9, f"{prose(20)}\n{LINE}\nend"), (10, f"  {LINE.upper()}\n{LINE}\n{prose(15)}")]
    rows += [(11, f"{prose(30)} {PASSAGE} {prose(30)}"), (12, f"{PASSAGE} {PASSAGE}"), (13, "ab" * 400), (14, prose(6000)), (15, "é" * 300), (16, "x" * 99)]
    near = base.split(" ")
    for i in range(20, 50):
        w = list(near)
        for j in rng.integers(0, 60, 1 + i % 4):
            w[j] = word()
        rows.append((i, " ".join(w)))
    return rows


def frame(spark, rows):
    """With columns whose names clash with those the operators use."""
    df = spark.createDataFrame([(i, t, None if i % 7 == 0 else f"s{i % 3}" if i % 2 else "s0") for i, t in rows], "doc_id long, text string, source string")
    return df.withColumn("doc", F.lit("x")).withColumn("score", F.lit(1)).withColumn("key", F.lit(2)).withColumn("id", F.lit(3)).repartition(5)


def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, source string, n_chars long, lang string")


def test_line_dedup(spark):
    rows = corpus()
    split = {i: (t or "").split("\n") for i, t in rows}
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(LOWER)
    first = {}
    for i in sorted(split):
        for x in map(key, split[i]):
            if len(x) >= 10:
                first.setdefault(x, i)
    want = {}
    for i, lines in split.items():
        left = [x for x in lines if first.get(key(x), i) == i]
        want[i] = (len(lines), len(lines) - len(left), hashlib.sha256("\n".join(left).encode()).hexdigest())
    got = line_dedup.line_dedup(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_lines, r.n_dropped, r.kept_sha256) for r in got} == want
    assert want[10][1] == 2
    keep = next(r for r in got if r.doc_id == 10)
    assert line_dedup.unpack(keep.keep_bitmap, keep.n_lines).tolist() == [False, False, True]


def test_line_stream_over_partitions():
    """One key over several batches: only the opening run stays open."""
    import pyarrow as pa

    h, doc = np.array([1, 1, 1, 1, 2, 2]), np.array([1, 1, 2, 3, 5, 6])
    batch = lambda a, b: pa.RecordBatch.from_arrays([pa.array(x[a:b]) for x in (h, h, doc, doc * 0, np.arange(6, dtype=np.int32))], ["h1", "h2", "doc", "tie", "pos"])
    out = [r for b in line_dedup._stream_first(iter([batch(0, 2), batch(2, 5), batch(5, 6)])) for r in b.to_pylist()]
    assert sorted((r["doc"]) for r in out if r["kind"] == 1) == [1, 1, 2, 3]
    assert [r["doc"] for r in out if r["kind"] == 0] == [6]
    assert {(r["h1"], r["doc"]) for r in out if r["kind"] == 2} == {(1, 1), (2, 5)}


def shingled(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute_groups(rows):
    sets = {i: shingled(t) for i, t in rows}
    low = {i: i for i in sets}
    links = [(i, j) for i, a in sets.items() for j, b in sets.items() if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b)]
    for _ in sets:
        for i, j in links:
            low[i] = min(low[i], low[j])
    return {i: (len(s), low[i], low[i] == i) for i, s in sets.items()}


@pytest.mark.parametrize("block", [512, 8])
def test_near_duplicates(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    rows = corpus()
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == brute_groups(rows)


def test_near_duplicates_null_ids_and_repeats(spark):
    rows = [(None, "a b c d e f"), (None, "other words in this text"), (3, "a b c d e f"), (3, "a b c d e f")]
    got = Counter((r.doc_id, r.component_id, r.kept) for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == {(None, 3, False): 1, (None, None, True): 1, (3, 3, True): 2}


def test_shared_counts():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 60, rng.integers(0, 40)).astype(np.uint32)) for _ in range(20)]
    got = minhash.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(20) for j in range(20) if i != j)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.id, r.comp) for r in graph.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


@pytest.mark.parametrize("block", [2 << 20, 200])
def test_repeats(spark, block, monkeypatch):
    monkeypatch.setattr(lpf, "BLOCK_BYTES", block)
    rows, seen, want = corpus(), set(), {}
    for i, t in sorted(rows):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 99):
            if b[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(b[p : p + 100])
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        want[i] = (len(b), int(gone.sum()), int((np.diff(gone.view(np.int8), prepend=0) == 1).sum()), hashlib.sha256(left).hexdigest())
    assert {r.doc_id: tuple(r)[1:] for r in lpf.remove_repeats(frame(spark, rows)).collect()} == want
    assert want[13][1] > 0 and want[12][1] > 0


def test_repeated_rows_do_not_cover_themselves(spark):
    rows = [(1, PASSAGE), (1, PASSAGE), (2, PASSAGE)]
    got = sorted((r.doc_id, r.n_removed) for r in lpf.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, 0), (1, 0), (2, len(PASSAGE))]


def test_longest_previous_factors():
    """The arrays against every pair of starts, on texts of few letters and on runs."""
    for seed in range(40):
        rng = np.random.default_rng(seed)
        limit, n = int(rng.integers(8, 40)), int(rng.integers(1, 260))
        text = rng.integers(97, 98 + seed % 4, n).astype(np.uint8)
        raw, starts = text.tobytes(), (np.arange(n) + limit <= n) & (rng.random(n) < 0.9)
        share = lambda i, j: next((k for k in range(limit) if raw[i + k] != raw[j + k]), limit)
        places = np.flatnonzero(starts).tolist()
        want = [max((share(i, j) for j in places if j < i), default=0) if starts[i] else 0 for i in range(n)]
        assert lpf.longest_previous_factors(text, limit, starts).tolist() == want


def test_previous_smaller_places():
    rng = np.random.default_rng(0)
    runs = [rng.permutation(500), np.arange(300), np.arange(300)[::-1], np.concatenate([np.arange(0, 400, 2), np.arange(1, 400, 2)])]
    for x in runs:
        want = [next((j for j in range(i - 1, -1, -1) if x[j] < x[i]), -1) for i in range(len(x))]
        assert lpf.previous_smaller(x).tolist() == lpf.previous_smaller(x, rounds=2).tolist() == want


def test_spans_that_touch_are_joined():
    import pyarrow as pa

    rows = [(1, 0, 0, 100), (1, 0, 50, 120), (1, 0, 120, 130), (1, 0, 140, 240), (1, 1, 0, 10), (2, 0, 5, 6)]
    batch = lambda part: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int32()), strict=True)], ["doc", "tie", "a", "b"])
    for cut in range(1, 6):
        got = [(r["doc"], r["tie"], [(x["a"], x["b"]) for x in r["spans"]]) for b in lpf._merge_spans(iter([batch(rows[:cut]), batch(rows[cut:])])) for r in b.to_pylist()]
        assert got == [(1, 0, [(0, 130), (140, 240)]), (1, 1, [(0, 10)]), (2, 0, [(5, 6)])]


@pytest.mark.parametrize("pass_bytes", [16 << 20, 100])
def test_decontamination(spark, pass_bytes, monkeypatch):
    """In one pass and in several; with a repeated row, a repeated item id and an item without an id."""
    monkeypatch.setattr(decontam, "PASS_BYTES", pass_bytes)
    rows = corpus()
    items = [("b1", PASSAGE), ("b2", "one two"), ("b3", None), ("b4", ""), ("b5", PASSAGE.upper().replace(" ", ", ")), ("b6", "words that stand nowhere " * 4), ("b2", "ONE-two"), (None, "x" * 99)]
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    windows = defaultdict(set)
    for name, t in items:
        w = words(t)
        for i in range(max(1, len(w) - 12) if w else 0):
            windows[tuple(w[i : i + 13])].add(name)
    want = {}
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for a in range(len(w)):
            for n in {len(k) for k in windows}:
                k = tuple(w[a : a + n])
                if len(k) == n and k in windows:
                    hit |= set(range(a, a + n))
                    names |= windows[k] - {None}
        want[i] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w))
    bench = spark.createDataFrame(items, "item_id string, text string")
    got = decontam.decontaminate(frame(spark, rows + rows[10:12]), bench, clean_text=True).collect()
    assert Counter((r.doc_id, tuple(r)[1:6]) for r in got) == Counter((i, want[i]) for i, _ in rows + rows[10:12])
    assert want[16] == (1, 1, 0, hashlib.sha256(b"").hexdigest(), True)
    assert want[11][4] and PASSAGE not in next(r.clean_text for r in got if r.doc_id == 11)
    left = {r.doc_id for r in decontam.drop_contaminated(frame(spark, rows), bench).collect()}
    assert left == {i for i, x in want.items() if not x[4]}
    assert decontam.decontaminate(frame(spark, rows), bench.limit(0)).where("contaminated OR n_items > 0").count() == 0


def test_mixture(spark):
    rows = corpus()
    docs = frame(spark, rows)
    got = mixing.mix_sources(docs, [5, 2, 1]).collect()
    assert len(got) == len(rows) and all(r.taken in (0, r.size, 2 * r.size) for r in got)
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
    for part in by.values():
        assert sum(r.size for r in part) == part[0].source_size
        largest = max(r.size for r in part)  # beside a document of most of the words a source can't come nearer
        assert abs(sum(r.taken for r in part) - part[0].target) <= (2 if largest < 1000 else largest / 2)
    assert abs(sum(p[0].target for p in by.values()) - 1.5 * sum(r.size for r in got)) < 1e-6
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_sources(docs.repartition(2), [5, 2, 1]).collect()))


def test_water_fill():
    assert mixing.water_fill([10, 100, 1000], [5, 2, 1], 1.5, 2.0) == pytest.approx([20, 200, 1445])
    assert mixing.water_fill([0, 0], [1, 1], 1.5, 2.0) == [0, 0]


def reachable(lengths, counts):
    sums = {0}
    for x, c in zip(lengths, counts, strict=True):
        sums = {s + x * n for s in sums for n in range(c + 1)}
    return sums


@pytest.mark.parametrize("window", [60_000, 20])
def test_fit_is_the_best_sum(window, monkeypatch):
    """Against every sum that the lengths can give; with a small window too, as it grows until it hits or all is open."""
    monkeypatch.setattr(mixing, "DP_WORDS", window)
    rng = np.random.default_rng(1)
    cases = [([1, 2, 4, 5, 38], [2, 1, 2, 2, 1], 35), ([0, 7], [3, 9], 30), ([6, 9], [4, 4], 31), ([0], [4], 0), ([3], [5], 99), ([], [], 5)]
    for _ in range(600):
        lengths = sorted(set(rng.integers(0, 40, rng.integers(1, 6)).tolist()))
        counts = rng.integers(1, 5, len(lengths)).tolist()
        cases.append((lengths, counts, int(rng.integers(0, sum(x * c for x, c in zip(lengths, counts, strict=True)) + 5))))
    for lengths, counts, budget in cases:
        take = mixing.fit(lengths, counts, budget)
        assert all(0 <= t <= c for t, c in zip(take, counts, strict=True))
        got = sum(x * t for x, t in zip(lengths, take, strict=True))
        assert abs(got - budget) == min(abs(s - budget) for s in reachable(lengths, counts))


def test_fit_of_large_budgets_hits_them():
    rng = np.random.default_rng(3)
    lengths = sorted(set(rng.integers(1, 3000, 60).tolist()))
    counts = rng.integers(1, 5000, len(lengths)).tolist()
    whole = sum(x * c for x, c in zip(lengths, counts, strict=True))
    for budget in (1, whole // 3, whole // 2 + 17, whole - 1):
        take = mixing.fit(lengths, counts, budget)
        assert sum(x * t for x, t in zip(lengths, take, strict=True)) == budget or budget < min(lengths) or whole - budget < min(lengths)
        assert all(abs(t - c * budget / whole) <= max(60_000 / x, 1) + 1 for x, t, c in zip(lengths, take, counts, strict=True))


def brute_mixture(rows, weights, share=1.5, most=2.0, seed="mix"):
    """(source, target, taken words) of each source, and how often each id is taken, straight from the contract; without ties."""
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    by = defaultdict(list)
    for i, t, s in rows:
        by[s].append((hashlib.md5(f"{seed}:{'' if i is None else i}".encode()).hexdigest(), i, words(t)))
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    size = {s: sum(n for *_, n in by[s]) for s in order}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, free, left = dict.fromkeys(order, 0.0), [s for s in order if size[s]], share * sum(size.values())
    while free:
        over = [s for s in free if left * weight[s] / sum(weight[x] for x in free) > most * size[s]]
        for s in over or free:
            target[s] = most * size[s] if over else left * weight[s] / sum(weight[x] for x in free)
        left, free = left - sum(target[s] for s in over), [s for s in free if s not in over] if over else []
    copies = Counter()
    for s in order:
        passes = int(target[s] // size[s]) if size[s] else 0
        lengths = Counter(n for *_, n in by[s])
        extra = dict(zip(sorted(lengths), mixing.fit(sorted(lengths), [lengths[n] for n in sorted(lengths)], round(target[s] - passes * size[s])), strict=True))
        for n in lengths:
            for at, (_, i, _) in enumerate(sorted((x for x in by[s] if x[2] == n), key=lambda x: (x[0], x[1] or 0))):
                copies[i] += passes + (at < extra[n])
    return size, target, copies


def test_mixture_against_brute_force(spark):
    """Null ids, null and empty texts, ties of length, repeated rows, sources of one document and of none."""
    rng = np.random.default_rng(8)
    rows = [(i, " ".join(["w"] * int(rng.integers(0, 30))), ["a", "b", "\U0001F600", "\uffee", None][int(rng.integers(0, 5))]) for i in range(300)]
    rows += [(1000, None, "a"), (1001, "", "b"), (1002, "w " * 500, "one"), (1003, None, "none"), (None, "w w w", "a"), (7000, "w w", "a"), (7000, "w w", "a")]
    size, target, copies = brute_mixture(rows, [5, 2, 1])
    got = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("row", F.lit(1)).repartition(4), [5, 2, 1]).collect()
    assert len(got) == len(rows)
    assert all(r.source_size == size[r.source] and abs(r.target - target[r.source]) < 1e-6 and r.taken == r.copies * r["size"] for r in got)
    seen = Counter()
    for r in got:
        seen[r.doc_id] += r.copies
    assert seen == copies


def test_shards(spark):
    rows = corpus() + [(i, f"t{i}") for i in range(200, 500)] + [(200, "t200")]
    got = sharding.interleave(frame(spark, rows), 8).collect()
    assert len(got) == len(rows)
    per = defaultdict(list)
    for r in got:
        per[r.shard].append(r)
    sizes = [len(v) for v in per.values()]
    assert len(per) == 8 and max(sizes) - min(sizes) <= 1
    assert all(sorted(r.slot for r in v) == list(range(len(v))) for v in per.values())
    source = {i: None if i % 7 == 0 else f"s{i % 3}" if i % 2 else "s0" for i, _ in rows}
    whole = Counter(source[i] for i, _ in rows)
    for v in per.values():
        for s, n in Counter(source[r.doc_id] for r in v).items():
            assert abs(n - whole[s] / 8) <= 2
    text = dict(rows)
    assert all(r.text_crc32 == zlib.crc32((text[r.doc_id] or "").encode()) and r.size == len((text[r.doc_id] or "").encode()) + 16 for r in got)


def brute_top_k(rows, k=5, every=50):
    v = [(i, [math.floor(256 * float(np.float32(y))) for y in x]) for i, x in rows if i is not None and x is not None and all(y is not None and math.isfinite(y) for y in x)]
    out = Counter()
    for q, a in v:
        if q % every == 0:
            best = sorted(((sum(x * y for x, y in zip(a, b, strict=True)), j) for j, b in v if j != q and len(a) == len(b)), key=lambda t: (-t[0], t[1]))[:k]
            out.update((q, n + 1, j, s) for n, (s, j) in enumerate(best))
    return out


@pytest.mark.parametrize("cell_rows", [32_768, 40])
def test_top_k(spark, cell_rows, monkeypatch):
    monkeypatch.setattr(topk, "LEAST_ROWS", min(cell_rows, 1_024))
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(0, 0.2, 16).astype(np.float32).tolist()) for i in rng.permutation(400)]
    rows += [(1000, rows[0][1]), (1001, rows[0][1]), (1050, None), (1100, [1.0, None] * 8), (1150, [math.inf] * 16), (1200, [math.nan] * 16), (1250, [0.0] * 16), (None, rows[0][1])]
    rows += [(2000, []), (2001, []), (2050, []), (3000, [0.5, 1.0]), (3001, [-0.5, 1.0]), (4000, [1.0] * 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("id", F.lit("x")).withColumn("w", F.lit(1)).withColumn("uid", F.lit(2))
    assert Counter(tuple(r) for r in topk.exact_top_k(df).collect()) == brute_top_k(rows)


def test_top_k_of_repeated_ids(spark):
    """Each query row of a shared id has its own ranking; none finds a row with its id."""
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (50, [0.0, 1.0]), (7, [2.0, 3.0]), (7, [2.0, 3.0]), (8, [3.0, 1.0])]
    got = Counter(tuple(r) for r in topk.exact_top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == brute_top_k(rows) and got[50, 1, 7, 3 * 256 * 256] == 2


@pytest.mark.parametrize("size", [1 << 20, 1 << 30, 1 << 45])
def test_a_cell_of_large_components(size):
    """Near ties between sums of large products: the proof's slack grows with the lengths."""
    rng = np.random.default_rng(size % 97)
    x = rng.integers(-size, size, (300, 8))
    x[100:200] = x[:100] + rng.integers(-1, 2, (100, 8))
    q, ids = np.concatenate([x[:5] + 1, rng.integers(-size, size, (5, 8))]), rng.permutation(300)
    cell = topk.Cell(topk.build_index(ids, x))
    whole = x.astype(object) @ q.astype(object).T
    for known in (np.full(10, -np.inf), np.sort(whole, axis=0)[-3].astype(np.float64)):
        for i, names, scores in cell.search(np.full(10, -1), q, known, 3):
            best = sorted(range(300), key=lambda j: (-whole[j, i], ids[j]))[:3]
            assert names == [ids[j] for j in best]
            assert scores == [max(-(1 << 63), min((1 << 63) - 1, whole[j, i])) for j in best]


def test_segments_are_ordered_by_impact():
    x = np.array([[3, 0, -5], [1, 300, 4]])
    index = topk.build_index(np.array([9, 4]), x)
    assert index["ids"].tolist() == [4, 9]
    assert index["heads"].tolist() == [[9, 1, 0], [3, 2, 1], [2, 0, 3], [1, 0, 4]]
    assert index["vals"].tolist() == [300, 4, -5, 3, 1] and index["rows"].tolist() == [0, 0, 1, 1, 0]


def test_url_filter(spark):
    rules = [url_filter.host_path_rule(*r) for r in [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]] + url_filter.GENERAL
    urls = {
        1: ("http://a.example.NET/en/x", "example.net/en/", "allow"), 2: ("http://net/", "net/", "block"), 3: ("http://net", None, "allow"), 4: ("http://xnet/", None, "allow"), 5: (None, None, "allow"),
        6: ("no scheme/ads/", None, "allow"), 7: ("https://b.example.com/de/?q=1", "example.com/de/", "block"), 8: ("https://b.example.com/DE/", None, "allow"), 9: ("ftp://x.org/fr/#t", "org/fr/", "allow"),
        10: ("http://shop.com/ads/1", None, "block"), 11: ("http://my-casino.com", None, "block"), 12: ("http://badcasino.com", None, "allow"), 13: ("http://a.net/en/", "net/", "block"), 14: ("http://example.net?x/en/", None, "allow"),
    }
    df = spark.createDataFrame([(i, u[0]) for i, u in urls.items()], "page_id long, url string").withColumn("host", F.lit(1))
    got = {r.page_id: r for r in url_filter.filter_urls(df, rules).collect()}
    assert {i: (r.rule, r.verdict) for i, r in got.items()} == {i: u[1:] for i, u in urls.items()}
    assert got[7].host == "b.example.com" and got[7].path == "/de/" and got[5].host == ""


def test_classifiers_on_held_out_rows(spark):
    rng = np.random.default_rng(2)
    prose = lambda: [("w%d" % x) for x in rng.integers(0, 300, 40)]
    rows, labels = [], []
    for i in range(1200):
        w, bad, toxic = prose(), i % 5 == 0, i % 7 == 0
        w = w[:2] * 20 if bad else w
        rows.append((i, " ".join(w + (["idiotic", "group"] if toxic else []))))
        labels.append((i, 0 if bad else 1, int(toxic)))
    rows += [(5000, None), (5001, ""), (None, "w1 w2")]
    docs, marks = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for f, at, mod, rest in ((quality.classify_quality, 1, 5, 0), (toxicity.classify_toxicity, 2, 4, 2)):
        got = f(docs, marks).collect()
        assert len(got) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
        truth = {x[0]: x[at] for x in labels}
        assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % mod == rest) for r in got if r.doc_id is not None)
        held = [r for r in got if r.held_out and r.doc_id in truth]
        assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert quality.classify_quality(docs, marks.limit(0)).where("score <> 0.5").count() == 0
    assert quality.keep_good(docs, marks).columns == docs.columns


def test_empty_tables(spark):
    e = empty(spark)
    bench = spark.createDataFrame([("a", "x y")], "item_id string, text string")
    for df in (line_dedup.line_dedup(e), minhash.near_duplicates(e), lpf.remove_repeats(e), decontam.decontaminate(e, bench), mixing.mix_sources(e, [5, 2, 1]), sharding.interleave(e, 40)):
        assert df.count() == 0
    assert topk.exact_top_k(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_span_hashes_do_not_depend_on_place():
    buf = np.frombuffer(b"ab cd ab cd", np.uint8)
    h = tk.span_hash(tk.prefix(buf), np.array([0, 6, 3]), np.array([5, 11, 5]))
    assert h[0] == h[1] != h[2]


def test_sliding_minimum():
    x = np.random.default_rng(0).integers(0, 50, 101).astype(np.uint64)
    assert lpf.sliding_min(x, 7).tolist() == [x[i : i + 7].min() for i in range(95)]
