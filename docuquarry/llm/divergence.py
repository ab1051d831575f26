"""Source divergence audit: how far each source of a language stands from the language and from its other sources.

Two passes over whole texts. The first counts in how many documents of a language each term stands,
exactly; terms of enough documents are kept. The second searches the texts with automata (Aho-Corasick)
of the kept terms, each padded with delimiters so that only whole terms match, and counts occurrences
by language, source and term. What it leaves are sparse postings, from which pairs and ranks come.

An automaton holds at most VOCABULARY_BYTES of terms. A larger vocabulary takes several searches, each
with the terms of one range, so the broadcast is bounded and no term is left out. Counts are summed in
the tasks before they are shuffled, so a source with a third of all rows sends as much as another one.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import reduce
from operator import itemgetter

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.llm.runtime import forget, materialize, small_side

#: Bytes of terms in one automaton, and counts that a task holds before it hands them on.
VOCABULARY_BYTES, HELD_COUNTS = 8 << 20, 400_000
#: Sources that meet in one matrix, postings of a group of them, and terms of a slice.
BLOCK_SOURCES, BLOCK_POSTINGS, SLICE_TERMS = 128, 20_000, 4_096
#: Fixed values of the measure: parts of a billion, five occurrences added to each term's count.
SCALE, ADDED = 1_000_000_000, 5

#: Letters stay, A-Z lower-cased, bytes beyond ASCII too; anything else is a delimiter.
_TO_TERMS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
_automata: dict[str, dict] = {}


def _lines(batch: pa.RecordBatch) -> Iterator[tuple[str, str, bytes]]:
    """(lang, source, text of terms and delimiters) of each row of (lang, source, text)."""
    langs, sources, texts = (batch.column(i).to_pylist() if i < 2 else batch.column(i) for i in range(3))
    for lang, source, text in zip(langs, sources, texts, strict=True):
        yield lang, source, text.as_py().encode().translate(_TO_TERMS)


def _document_frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, term, n): documents of the task that hold the term, in parts that may repeat a term."""
    held: dict[str, Counter] = defaultdict(Counter)
    size = 0

    def out() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            terms = [t.decode() for t in counts]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(terms), pa.string()), pa.array(terms, pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "term", "n"])
        held.clear()

    for batch in batches:
        for lang, _, line in _lines(batch):
            counts = held[lang]
            size -= len(counts)
            counts.update(set(line.split()))
            size += len(counts)
            if size > HELD_COUNTS:
                yield from out()
                size = 0
    yield from out()


def _automaton(terms: list[str]) -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for i, term in enumerate(terms):
        found.add_word(f" {term} ", i)
    found.make_automaton()
    return found


def _automata_of(name: str, of: dict) -> dict[str, ahocorasick.Automaton]:
    """The automata of a range, built once in a worker, which holds one range at a time."""
    if name not in _automata:
        _automata.clear()
        _automata[name] = {lang: _automaton(terms) for lang, (terms, _) in of.items()}
    return _automata[name]


def _recount(vocabulary):
    """vocabulary: broadcast (name, {lang: (terms, numbers)}) of one range of the kept terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, of = vocabulary.value
        automata, held = _automata_of(name, of), defaultdict(Counter)

        def out() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in sorted(held.items()):
                at = np.fromiter(counts.keys(), np.int64, len(counts))
                n = np.fromiter(counts.values(), np.int64, len(counts))
                order = np.argsort(at)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array([source] * len(at), pa.string()), pa.array(of[lang][1][at[order]]), pa.array(n[order])], ["lang", "source", "tid", "n"])
            held.clear()

        size = 0
        for batch in batches:
            for lang, source, line in _lines(batch):
                if lang in automata:
                    counts = held[lang, source]
                    size -= len(counts)
                    # neighbouring terms share the delimiter between them, as an automaton finds matches that overlap
                    counts.update(map(itemgetter(1), automata[lang].iter(f" {line.decode()} ")))
                    size += len(counts)
                    if size > HELD_COUNTS:
                        yield from out()
                        size = 0
        yield from out()

    return run


def kept_terms(texts: DataFrame, least_docs: int) -> DataFrame:
    """(tid, lang, term, range): written; tid rises with (lang, term) in the order of UTF-8 bytes, ranges hold about VOCABULARY_BYTES of terms."""
    counted = texts.mapInArrow(_document_frequencies, "lang string, term string, n long").groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least_docs)
    some = materialize(counted.select("lang", "term"), "terms")
    size = some.agg(F.sum(F.octet_length("term") + F.lit(2))).first()[0] or 0
    out = materialize(
        some.repartitionByRange(max(1, min(64, size >> 18)), "lang", "term").sortWithinPartitions("lang", "term").withColumn("tid", F.monotonically_increasing_id())
        .withColumn("range", F.pmod(F.xxhash64("term"), F.lit(max(1, -(-size // VOCABULARY_BYTES)))).cast("int")),
        "vocabulary",
    )
    forget(some)
    return out


def postings(texts: DataFrame, vocabulary: DataFrame) -> list[DataFrame]:
    """(lang, source, tid, n) of each range of the vocabulary: occurrences of the kept terms, n above 0; written."""
    spark = texts.sparkSession
    parts = []
    for (k,) in sorted(vocabulary.select("range").distinct().collect()):
        of: dict[str, tuple[list[str], list[int]]] = defaultdict(lambda: ([], []))
        for lang, term, tid in vocabulary.filter(F.col("range") == k).select("lang", "term", "tid").collect():  # bounded by the range
            of[lang][0].append(term)
            of[lang][1].append(tid)
        shared = spark.sparkContext.broadcast((uuid.uuid4().hex, {lang: (terms, np.array(tids)) for lang, (terms, tids) in of.items()}))
        found = texts.mapInArrow(_recount(shared), "lang string, source string, tid long, n long")
        parts.append(materialize(found.groupBy("lang", "source", "tid").agg(F.sum("n").alias("n")), "postings"))
        shared.unpersist()
    return parts or [spark.createDataFrame([], "lang string, source string, tid long, n long")]


def share(count: str, total: str) -> Column:
    """1 + floor(SCALE * (count + ADDED) / total) of two SQL expressions, in whole numbers of 30 digits; null for a total of 0."""
    wide = f"cast({SCALE} as decimal(10,0)) * cast({count} + {ADDED} as decimal(19,0))"
    return F.expr(f"1 + cast(({wide}) div cast(nullif({total}, 0) as decimal(19,0)) as long)")


def _distances(frame: pd.DataFrame) -> pd.DataFrame:
    """(lang, a_at, b_at, total, met): for each source of block a and of block b the sum of |p - q| over the terms of the group.

    A term counts as met when any source of the two blocks holds it; where a source doesn't, its base share
    stands. The group's first rows (tid null) name the sources and their base shares.
    """
    base = frame[frame["tid"].isna()]
    rows = frame[frame["tid"].notna()]
    a, b = (base[base["block"] == x].sort_values("at") for x in (frame["a"].iat[0], frame["b"].iat[0]))
    place = {}
    both = a if frame["a"].iat[0] == frame["b"].iat[0] else pd.concat([a, b])
    for i, at in enumerate(both["at"]):
        place[at] = i
    fill = both["p"].to_numpy(np.int64)
    ia, ib = (np.array([place[x] for x in some["at"]], np.int64) for some in (a, b))
    tids, term = np.unique(rows["tid"].to_numpy(np.int64), return_inverse=True)
    source, p = rows["at"].map(place).to_numpy(np.int64), rows["p"].to_numpy(np.int64)
    order = np.argsort(term, kind="stable")
    term, source, p = term[order], source[order], p[order]
    total = np.zeros((len(ia), len(ib)), np.int64)
    for first in range(0, len(tids), SLICE_TERMS):
        lo, hi = np.searchsorted(term, [first, first + SLICE_TERMS])
        m = np.repeat(fill[:, None], min(SLICE_TERMS, len(tids) - first), axis=1)
        m[source[lo:hi], term[lo:hi] - first] = p[lo:hi]
        right = m[ib]
        for i, s in enumerate(ia):
            total[i] += np.abs(right - m[s]).sum(axis=1)
    at_a, at_b = np.repeat(a["at"].to_numpy(), len(ib)), np.tile(b["at"].to_numpy(), len(ia))
    return pd.DataFrame({"lang": frame["lang"].iat[0], "a_at": at_a, "b_at": at_b, "total": total.ravel(), "met": len(tids)})


def pair_distances(groups: DataFrame, posted: DataFrame, n_groups: int, n_postings: int) -> DataFrame:
    """(lang, source, other, value) of every ordered pair of sources of a language.

    groups: (lang, source, at, n, v, base); posted: (lang, source, at, tid, p). Sources are cut into blocks;
    each two blocks meet once over each part of the terms in a dense matrix of bounded size, and the terms
    that neither block holds add the distance of the base shares. Pairs are as many as the result has.
    """
    parts = max(1, -(-n_postings // BLOCK_POSTINGS))
    block = F.floor(F.col("at") / BLOCK_SOURCES)
    blocks = groups.groupBy("lang").agg(F.max(block).alias("last"))
    placed = posted.select("lang", "at", block.alias("block"), "tid", "p", F.pmod(F.xxhash64("tid"), F.lit(parts)).cast("int").alias("part"))
    bases = groups.filter("v > 0").select("lang", "at", block.alias("block"), F.lit(None).cast("long").alias("tid"), F.col("base").alias("p"), F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
    # a block meets itself and all others, the smaller number first
    meets = placed.unionByName(bases).join(small_side(blocks, n_groups), "lang").withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), F.col("last"))))
    meets = meets.select("lang", F.least("block", "_o").alias("a"), F.greatest("block", "_o").alias("b"), "part", "block", "at", "tid", "p")
    sums = meets.groupBy("lang", "a", "b", "part").applyInPandas(_distances, "lang string, a_at long, b_at long, total long, met long")
    sums = sums.groupBy("lang", "a_at", "b_at").agg(F.sum("total").alias("total"), F.sum("met").alias("met"))
    far = F.floor(F.col("a_at") / BLOCK_SOURCES) != F.floor(F.col("b_at") / BLOCK_SOURCES)
    sums = sums.unionByName(sums.filter(far).select("lang", F.col("b_at").alias("a_at"), F.col("a_at").alias("b_at"), "total", "met"))
    left = groups.select("lang", "source", F.col("at").alias("a_at"), F.col("base").alias("a_base"), "v")
    right = groups.select("lang", F.col("source").alias("other"), F.col("at").alias("b_at"), F.col("base").alias("b_base"))
    pairs = left.join(right, "lang").filter("a_at <> b_at").join(sums, ["lang", "a_at", "b_at"], "left")
    unmet = (F.col("v") - F.coalesce("met", F.lit(0))) * F.abs(F.col("a_base") - F.col("b_base"))
    return pairs.select("lang", "source", "other", F.coalesce(F.coalesce("total", F.lit(0)) + unmet, F.lit(0)).cast("long").alias("value"))


def divergence(docs: DataFrame, least_docs: int = 30, top: int = 50, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """(lang, source, part, item, value, rank): part pair compares each source of a language with each other one, part term lists its top terms above the language's share.

    Null texts, languages and sources are empty strings, and empty ones are values like others. Repeated
    rows count as often as they stand; ties go to the smaller item in the order of UTF-8 bytes. A language
    without kept terms has pairs of value 0; an empty table gives no rows. Other columns aren't read.
    """
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))])
    vocabulary = kept_terms(texts, least_docs)
    found = postings(texts, vocabulary)
    posted = reduce(DataFrame.unionByName, found)
    of_lang = vocabulary.groupBy("lang").agg(F.count("*").alias("v"))
    every = texts.select("lang", "source").distinct()
    counted = posted.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count("*").alias("rows"))
    at = F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1
    groups = every.join(counted, ["lang", "source"], "left").join(of_lang, "lang", "left").na.fill(0, ["n", "v", "rows"]).withColumn("at", at.cast("long"))
    groups = materialize(groups.withColumn("whole", F.sum("n").over(Window.partitionBy("lang"))).withColumn("base", share("0", "n + 5 * v")), "groups")
    n_groups, n_postings = groups.agg(F.count("*"), F.coalesce(F.sum("rows"), F.lit(0))).first()
    small = small_side(groups.select("lang", "source", "at", "n", "v", "whole"), n_groups)
    known = posted.withColumnRenamed("n", "uses").join(small, ["lang", "source"])
    known = known.withColumn("of_all", F.sum("uses").over(Window.partitionBy("tid")))
    known = materialize(known.select("lang", "source", "at", "tid", share("uses", "n + 5 * v").alias("p"), share("of_all", "whole + 5 * v").alias("q")), "shares")
    forget(*found)
    order = Window.partitionBy("lang", "source")
    above = known.filter("p > q").select("lang", "source", "tid", (F.col("p") - F.col("q")).alias("value"))
    first = above.withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "tid"))).filter(F.col("rank") <= top)
    terms = first.join(vocabulary.select("tid", "term"), "tid").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
    pairs = pair_distances(groups.select("lang", "source", "at", "n", "v", "base"), known, n_groups, n_postings)
    ranked = pairs.withColumn("rank", F.row_number().over(order.orderBy(F.desc("value"), "other")))
    return terms.unionByName(ranked.select("lang", "source", F.lit("pair").alias("part"), F.col("other").alias("item"), "value", "rank"))
