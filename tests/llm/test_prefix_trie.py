"""The conversation prefix trie against brute force: odd rows, long conversations, chains in blocks, missing bases."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest

from docuquarry.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, depth string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text, _ in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(v)] for c, v in own.items()}
    nodes = defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        path = tuple(own.get(base, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].append((c, d == len(path)))
    children = defaultdict(list)
    for p in nodes:
        if p:
            children[p[:-1]].append(p)
    sums = {}
    for p in sorted(nodes, key=len, reverse=True):
        words = len(re.findall(rb"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        below = [sums[x] for x in children[p]]
        sums[p] = (sum(x[0] for x in below) or 1, sum(x[1] for x in below) + (len(nodes[p]) - 1) * words)
    out = []
    for p, members in nodes.items():
        ends = ",".join(str(c) for c, e in sorted(members) if e)
        parent = min(nodes[p[:-1]])[0] if p else None
        out.append((min(members)[0], len(p), parent, len(members), len(children[p]), *sums[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out)


def result(df):
    return sorted(tuple(r) for r in df.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect())


def rows_of(seed, n_convs=90):
    r = random.Random(seed)
    said = ["hi there", "hi  there", "", None, "é \x0b z", "tell me more of it", "x" * 30_000]
    out = []
    for c in [*range(n_convs), *range(-25, -15), 5_000_000_017, 2**62]:
        n = r.choice([1, 1, 2, 3, 4, 6]) if c % 30 else 41
        for i in range(n):
            out.append((c, r.choice([i, i, i, 0, None]), r.choice(["user", "user", None, ""]), said[r.randrange(7 if i < 4 else 3)] if c % 7 else said[i % 3], "clash"))
    out += out[:5] + [(None, 1, "user", "lost", None), (13, 7, "user", "again", None), (13, 7, "user", "again", None)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("seed,block", [(1, 1024), (2, 4), (3, 1)])
def test_matches_brute_force(spark, seed, block):
    rows = rows_of(seed)
    assert result(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(7), block_turns=block)) == brute(rows)


def test_one_conversation_over_many_partitions(spark):
    rows = [(20, i, "user", f"turn {i % 3} {'w ' * (i % 5)}", None) for i in range(500)] + [(c, 0, "user", "turn 0 ", None) for c in range(21, 40)]
    assert result(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA).repartition(9), block_turns=16)) == brute(rows)


def test_many_conversations_end_at_one_node(spark, monkeypatch):
    from docuquarry.llm import runtime

    monkeypatch.setattr(runtime, "HOT_ROWS", 3)
    rows = [(c, t, "user", ("same", "words here")[t], None) for c in range(1_300) for t in (0, 1)]
    assert result(prefix_trie.prefix_trie(spark.createDataFrame(rows, SCHEMA))) == brute(rows)


def test_empty_table(spark):
    assert result(prefix_trie.prefix_trie(spark.createDataFrame([], SCHEMA))) == []
    assert result(prefix_trie.prefix_trie(spark.createDataFrame([(None, 0, "user", "x", None)], SCHEMA))) == []
