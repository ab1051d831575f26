"""Full-text search with phrases, alternatives and exclusions over a positional inverted index.

A question becomes rows: alternatives, each of clauses, each a phrase of one or more terms that has to
stand in a row or must not. Its tree is evaluated by joins and groupings over the postings of its terms
alone: steps (two terms at a distance) to phrases, phrases to alternatives, those to hits, the rarest first.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.functions.text import let
from docuquarry.operators.steps import settled
from docuquarry.plans.fulltext import STOP_WORDS, stem, words

#: A side of a join is broadcast only when it was counted and has at most so many narrow rows.
BROADCAST_ROWS = 400_000
#: One row of so many, by a hash of its key, tells which scores an alternative's first rows have at least.
SHARE = 16
#: Elements of an array that are tested one by one.
UNROLLED = 4
#: A quoted phrase or a run without white space, with or without a minus before it; a quote that isn't closed runs to the end.
_PART = r'(-?"[^"]*"?|[^\s"]+)'


def placed_terms(text: Column, plain: bool = False) -> Column:
    """Array of (term, pos) of a text: words in lower case by their place, stop words counted but left out; plain takes every word as it is."""
    numbered = F.transform(words(text), lambda w, i: F.struct(w.alias("term"), i.alias("pos")))
    if plain:
        return numbered
    return F.transform(F.filter(numbered, lambda x: ~x["term"].isin(STOP_WORDS)), lambda x: F.struct(stem(x["term"]).alias("term"), x["pos"].alias("pos")))


def index(rows: DataFrame, key: str, fields: dict[str, float], plain: bool = False, only: DataFrame | None = None) -> DataFrame:
    """(term, key, field, weight, positions): a row for each term, row and field, to be written once, bucketed or sorted by term.

    only (term) leaves other terms out before anything is shuffled, for an index that answers a few questions:
    each different word is stemmed once, and those that no question asks for fall away. A term of one row's
    field is one group, so a frequent term is dealt over the keys that hold it.
    """
    parts = [rows.select(F.lit(field).alias("field"), F.lit(float(weight)).alias("weight"), key, F.posexplode(words(F.col(field))).alias("pos", "word")) for field, weight in fields.items()]
    out = reduce(DataFrame.unionByName, parts)

    def stemmed(said: DataFrame) -> DataFrame:
        """With term, by compiled code, as words are rows by now."""
        return said.withColumn("term", F.col("word")) if plain else said.where(~F.col("word").isin(STOP_WORDS)).withColumn("term", stem(F.col("word")))

    if only is not None:
        asked = stemmed(out.select("word").distinct()).join(only.select("term").distinct(), "term", "left_semi")
        out = out.join(asked, "word").drop("word")
    else:
        out = stemmed(out).drop("word")
    return out.groupBy("term", key, "field", "weight").agg(F.sort_array(F.collect_list("pos")).alias("positions"))


def parsed(queries: DataFrame, query: str = "query", plain: bool = False) -> DataFrame:
    """(query_id, alternative, clause, negated, term, shift) of queries (query_id, query).

    Words and "quoted phrases" must all occur, `or` parts alternatives, - excludes the word or phrase behind
    it; a word with marks inside, as auto-renew, is a phrase. Stop words of a phrase count as a step. Clauses
    without a term fall away.
    """
    said = F.lower(F.coalesce(F.col(query), F.lit("")))

    def clauses(parts: Column) -> Column:
        place = lambda i: F.size(F.filter(F.slice(parts, 1, i), lambda x: x == "or"))
        numbered = F.transform(parts, lambda x, i: F.struct(place(i).alias("alternative"), i.alias("clause"), (F.startswith(x, F.lit("-"))).alias("negated"), placed_terms(x, plain).alias("terms"), (x == "or").alias("_or")))
        return F.filter(numbered, lambda c: ~c["_or"] & (F.size(c["terms"]) > 0))

    every = queries.select("query_id", F.inline(let(F.regexp_extract_all(said, F.lit(_PART), F.lit(1)), clauses))).drop("_or")
    shifted = let(F.array_min(F.transform("terms", lambda x: x["pos"])), lambda first: F.transform("terms", lambda x: F.struct(x["term"].alias("term"), (x["pos"] - first).alias("shift"))))
    return every.select("query_id", "alternative", "clause", "negated", F.inline(shifted))


def small(df: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint where it was counted to have few rows."""
    return F.broadcast(df) if df.count() <= most else df


def _asked(queries: DataFrame, query: str, plain: bool) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """What questions ask, each thing once: phrases (pid, terms), their steps (pid, first, second, gap, offset), parts (aid, pid, negated, times) of alternatives, and who asks those (query_id, aid)."""
    by = ["query_id", "alternative", "clause", "negated"]
    clauses = settled(parsed(queries, query, plain).groupBy(*by).agg(F.sort_array(F.collect_set(F.struct("shift", "term"))).alias("terms")))
    phrases = settled(clauses.select("terms").distinct().withColumn("pid", F.monotonically_increasing_id()))
    parts = clauses.join(phrases, "terms").groupBy("query_id", "alternative").agg(F.sort_array(F.collect_list(F.struct("pid", "negated"))).alias("parts")).where(F.exists("parts", lambda x: ~x["negated"]))
    kinds = settled(parts.select("parts").distinct().withColumn("aid", F.monotonically_increasing_id()))
    steps = phrases.where(F.size("terms") > 1).select("pid", F.explode(F.transform(F.sequence(F.lit(0), F.size("terms") - 2), lambda i: F.struct(F.get("terms", i).alias("a"), F.get("terms", i + 1).alias("b")))).alias("x"))
    steps = steps.select("pid", F.col("x.a.term").alias("first"), F.col("x.b.term").alias("second"), (F.col("x.b.shift") - F.col("x.a.shift")).alias("gap"), F.col("x.a.shift").alias("offset"))
    of = kinds.select("aid", F.inline("parts")).groupBy("aid", "pid", "negated").agg(F.count("*").alias("times"))
    return phrases, steps, of, parts.join(kinds, "parts").select("query_id", "aid").distinct()


def _phrase_hits(stood: DataFrame, steps: DataFrame, key: str) -> DataFrame:
    """(pid, key, weight) of phrases of several terms, from the places (step, key, field, weight, pos) of all steps: where a phrase's rarest step stands, its others are looked up."""
    often = stood.groupBy("first", "second", "gap").agg(F.count("*").alias("_n"))
    counted = steps.join(often, ["first", "second", "gap"])  # a phrase with a step that stands nowhere falls away below
    need = steps.groupBy("pid").agg(F.count("*").alias("_need"))
    rare = counted.groupBy("pid").agg(F.min_by(F.struct("first", "second", "gap", "offset"), F.struct("_n", "offset")).alias("_s"), F.count("*").alias("_have")).join(need, "pid").where("_have = _need")
    rare = settled(rare.select("pid", "_need", "_s.*"))
    at = stood.join(rare, ["first", "second", "gap"]).select("pid", "_need", key, "field", "weight", (F.col("pos") - F.col("offset")).alias("start"))
    short, long = at.where("_need = 1"), at.where("_need > 1")
    others = steps.join(rare.select("pid", F.col("offset").alias("_skip")), "pid").where("offset <> _skip").drop("_skip")
    wanted = long.join(others, "pid").withColumn("pos", F.col("start") + F.col("offset"))
    there = stood.select("first", "second", "gap", F.col(key).alias("_key"), F.col("field").alias("_field"), "pos").distinct()
    seen = wanted.alias("w").join(there.alias("t"), (F.col("w.first") == F.col("t.first")) & (F.col("w.second") == F.col("t.second")) & (F.col("w.gap") == F.col("t.gap")) & (F.col("w.pos") == F.col("t.pos")) & F.col(f"w.{key}").eqNullSafe(F.col("t._key")) & (F.col("w.field") == F.col("t._field"))).select("w.*")
    whole = seen.groupBy("pid", "_need", key, "field", "weight", "start").agg(F.count("*").alias("_c")).where("_c = _need - 1")
    uses = short.select("pid", key, "weight").unionByName(whole.select("pid", key, "weight")).groupBy("pid", key, "weight").agg(F.count("*").alias("_uses"))
    return uses.groupBy("pid", key).agg(F.sum(F.col("weight") * F.col("_uses")).alias("weight"))


def _met(rows: DataFrame, few: DataFrame, on: str | list[str]) -> DataFrame:
    """rows joined to few, which is broadcast in pieces of at most BROADCAST_ROWS: rows stay where they are."""
    pieces = max(1, -(-few.count() // BROADCAST_ROWS))
    at = F.pmod(F.xxhash64(*([on] if isinstance(on, str) else on)), F.lit(pieces))
    return reduce(DataFrame.unionByName, [rows.join(F.broadcast(few if pieces == 1 else few.where(at == i)), on) for i in range(pieces)])


def _all(array: str, most: int, met: Callable[[Column], Column]) -> Column:
    """Whether all of an array's elements, most at most, are met; the first few by plain expressions, as a lambda keeps a join above long rows from being compiled."""
    first = [(F.size(array) <= i) | met(F.get(array, F.lit(i))) for i in range(min(most, UNROLLED))]
    rest = [F.forall(F.slice(array, F.lit(UNROLLED + 1), F.size(array)), met)] if most > UNROLLED else []
    return reduce(lambda a, b: a & b, [*first, *rest], F.lit(True))


def _whole(held: DataFrame, kinds: DataFrame, key: str, most: int) -> DataFrame:
    """Rows (key, held) in which alternatives (aid, pid, times, rest) are met, with score. They begin at their rarest phrase; the rest, most at most, is looked up in the row's own map."""
    weight = lambda x: F.try_element_at("held", x["pid"])
    part = lambda x: F.when(~x["negated"], x["times"] * F.log1p(weight(x))).otherwise(0.0)
    at = _met(held.select(key, "held", F.explode("held").alias("pid", "weight")), kinds, "pid").where(_all("rest", most, lambda x: x["negated"] == weight(x).isNull()))
    parts = [F.when(F.size("rest") > i, part(F.get("rest", F.lit(i)))).otherwise(0.0) for i in range(min(most, UNROLLED))]
    if most > UNROLLED:
        parts.append(F.aggregate(F.slice("rest", F.lit(UNROLLED + 1), F.size("rest")), F.lit(0.0), lambda s, x: s + part(x)))
    return at.withColumn("score", F.round(reduce(lambda a, b: a + b, parts, F.col("times") * F.log1p("weight")), 6))


def _answers(hits_of: Callable[[DataFrame, DataFrame], DataFrame], queries: DataFrame, key: str, query: str, limit: int | None, plain: bool) -> DataFrame:
    """search, given what finds phrases (pid, terms) of steps (pid, first, second, gap, offset) -> (pid, key, weight), once each.

    What alternatives meet grows with questions times rows, so none of it is written: a row's phrases are one
    map, and of an alternative's rows only those pass that are no worse than its limit-th among a share of the rows.
    """
    phrases, steps, parts, asks = _asked(queries, query, plain)
    held = settled(hits_of(phrases, steps).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("pid", "weight"))).alias("held")))
    often = held.select(F.explode(F.map_keys("held")).alias("pid")).groupBy("pid").agg(F.count("*").alias("_n"))
    # what has to stand comes first, and of that the rarest; where one part stands nowhere, nothing is found
    each = parts.join(often, "pid", "left").groupBy("aid").agg(F.sort_array(F.collect_list(F.struct("negated", F.coalesce("_n", F.lit(0)).alias("_n"), "pid", "times"))).alias("_e")).where("_e[0]._n > 0")
    kinds = settled(each.select("aid", F.col("_e")[0]["pid"].alias("pid"), F.col("_e")[0]["times"].alias("times"), F.slice("_e", F.lit(2), F.size("_e")).alias("rest")))
    most = kinds.agg(F.max(F.size("rest"))).first()[0] or 0
    if limit is None:
        whole = _whole(held, kinds, key, most)
    else:
        first = Window.partitionBy("aid").orderBy(F.desc("score"), key)
        some = _whole(held.where(F.pmod(F.xxhash64(key), F.lit(SHARE)) == 0), kinds, key, most).select("aid", key, "score")
        last = some.withColumn("_r", F.row_number().over(first)).where(F.col("_r") == limit).select("aid", F.col("score").alias("_least"), F.col(key).alias("_last"))
        whole = _whole(held, settled(kinds.join(last, "aid", "left")), key, most)
        whole = whole.where(F.col("_least").isNull() | (F.col("score") > F.col("_least")) | ((F.col("score") == F.col("_least")) & F.coalesce(F.col(key) <= F.col("_last"), F.col(key).isNull())))
        # what isn't among an alternative's first isn't among its question's
        whole = whole.select("aid", key, "score").withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= limit)
    found = whole.select("aid", key, "score").join(asks, "aid").groupBy("query_id", key).agg(F.max("score").alias("score"))
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), key)))
    return ranked if limit is None else ranked.where(F.col("rank") <= limit)


def search(postings: DataFrame, queries: DataFrame, key: str, query: str = "query", limit: int | None = 25, plain: bool = False) -> DataFrame:
    """(query_id, key, score, rank): what each question finds, by the sum over its clauses of ln(1 + weighted occurrences), at the best alternative; ties by key.

    An alternative needs a clause that isn't excluded: one of exclusions alone finds nothing. Phrases and
    alternatives that several questions share are looked for once. A phrase is found by its steps, two terms at a
    distance, of which the rarest leads, and an alternative by its rarest phrase, so no frequent term meets all
    questions that name it.
    """

    def steps_at(steps: DataFrame) -> DataFrame:
        place = lambda term: postings.join(steps.select(F.col(term).alias("term")).distinct(), "term", "left_semi").select(F.col("term").alias(term), key, "field", "weight", F.explode("positions").alias("pos"))
        ahead = place("first").join(steps.select("first", "gap").distinct(), "first").withColumn("_to", F.col("pos") + F.col("gap"))
        behind = place("second").select("second", F.col(key).alias("_key"), F.col("field").alias("_field"), F.col("pos").alias("_pos"))
        met = ahead.join(behind, (F.col("_to") == F.col("_pos")) & (F.col("field") == F.col("_field")) & F.col(key).eqNullSafe(F.col("_key")))
        return met.join(steps, ["first", "second", "gap"]).select("first", "second", "gap", key, "field", "weight", "pos")

    def terms_in(terms: DataFrame) -> DataFrame:
        return postings.join(terms, "term", "left_semi").groupBy("term", key).agg(F.sum(F.col("weight") * F.size("positions")).alias("weight"))

    def hits_of(phrases: DataFrame, steps: DataFrame) -> DataFrame:
        several = _phrase_hits(settled(steps_at(small(steps.select("first", "second", "gap").distinct()))), steps, key)
        single = phrases.where(F.size("terms") == 1).select("pid", F.get("terms", F.lit(0))["term"].alias("term"))
        return several.unionByName(terms_in(small(single.select("term"))).join(small(single), "term").select("pid", key, "weight"))

    return _answers(hits_of, queries, key, query, limit, plain)


def _weighted(weight: float, pid: Column) -> Column:
    return F.struct(pid.alias("pid"), F.lit(weight).alias("weight"))


def search_texts(rows: DataFrame, queries: DataFrame, key: str, fields: dict[str, float], query: str = "query", limit: int | None = 25, plain: bool = False) -> DataFrame:
    """search over rows that have no written index: phrases are found where a text is read, and what stands in a row is all that is shuffled.

    Each different word is stemmed once. A phrase is looked up by the step of two terms whose rarer one is rarest; its
    other words are compared in place. A single term is a step from a word to itself.
    """
    said = reduce(DataFrame.unionByName, [rows.select(key, F.lit(float(w)).alias("weight"), words(F.col(f)).alias("words")) for f, w in fields.items()])
    asked = small(settled(parsed(queries, query, plain).select("term").distinct()))
    each_word = said.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("_n"))
    terms = each_word.withColumn("term", F.col("word")) if plain else each_word.where(~F.col("word").isin(STOP_WORDS)).withColumn("term", stem(F.col("word")))
    known = settled(terms.join(asked, "term", "left_semi").select("word", "term", "_n"))

    def leads_of(phrases: DataFrame, steps: DataFrame) -> DataFrame:
        """(first, second, gap, pid, offset, others): the step that finds a phrase, and its terms beside that."""
        often = known.groupBy("term").agg(F.sum("_n").alias("_n"))
        one = F.get("terms", F.lit(0))["term"]
        single = phrases.where(F.size("terms") == 1).select("pid", one.alias("first"), one.alias("second"), F.lit(0).alias("gap"), F.lit(0).alias("offset"))
        counted = steps.unionByName(single).join(often.select(F.col("term").alias("first"), F.col("_n").alias("_a")), "first").join(often.select(F.col("term").alias("second"), F.col("_n").alias("_b")), "second")
        rare = counted.groupBy("pid").agg(F.min_by(F.struct("first", "second", "gap", "offset"), F.struct(F.least("_a", "_b"), F.greatest("_a", "_b"), "offset")).alias("_s")).select("pid", "_s.*")
        beside = F.filter("terms", lambda x: (x["shift"] != F.col("offset")) & (x["shift"] != F.col("offset") + F.col("gap")))
        return settled(rare.join(phrases, "pid").select("first", "second", "gap", "pid", "offset", beside.alias("others")))

    def hits_of(phrases: DataFrame, steps: DataFrame) -> DataFrame:
        leads = leads_of(phrases, steps)
        begins = known.join(leads.select(F.col("first").alias("term"), "gap").distinct(), "term").select("word", F.col("term").alias("first"), "gap")
        each = said.select(key, "weight", "words", F.posexplode("words").alias("pos", "word"))
        pair = _met(each, begins, "word").withColumn("_b", F.get("words", F.col("pos") + F.col("gap"))).where("_b IS NOT NULL")
        at = _met(_met(pair, known.select(F.col("word").alias("_b"), F.col("term").alias("second")), "_b"), leads, ["first", "second", "gap"])

        def there(x: Column) -> Column:
            """Whether a term stands at its place; a stem begins as its word does."""
            word = F.get("words", F.col("pos") - F.col("offset") + x["shift"])
            return word == x["term"] if plain else (F.substring(word, 1, 1) == F.substring(x["term"], 1, 1)) & ~word.isin(STOP_WORDS) & (stem(word) == x["term"])

        at = at.where(_all("others", leads.agg(F.max(F.size("others"))).first()[0] or 0, there))
        # dealt by row alone, so that what is grouped by row and phrase stays where it is
        weights = sorted({float(w) for w in fields.values()})
        listed = at.groupBy(key).agg(*[F.collect_list(F.when(F.col("weight") == w, F.col("pid"))).alias(f"_{i}") for i, w in enumerate(weights)])
        dealt = listed.select(key, F.inline(F.concat(*[F.transform(f"_{i}", partial(_weighted, w)) for i, w in enumerate(weights)])))
        uses = dealt.groupBy(key, "pid", "weight").agg(F.count("*").alias("_uses"))
        return uses.groupBy(key, "pid").agg(F.sum(F.col("weight") * F.col("_uses")).alias("weight")).select("pid", key, "weight")

    return _answers(hits_of, queries, key, query, limit, plain)
