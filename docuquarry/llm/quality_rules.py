"""Quality rules: statistics of whole texts in built-in expressions, and a learnt decision list over them.

Sequential covering (Cohen's IREP): a conjunction of thresholds grows on part of the labelled statistics by
information gain, is pruned on the rest, and what it covers is set aside before the next one grows. The
list becomes ordered conditional expressions, so a verdict is read off, explained and pushed down like
any other column. No Python runs on the executors.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuquarry.llm.quality import held_out

#: Labelled rows of each class that a list is learnt from at most.
SAMPLE_ROWS = 4_000
#: Fixed values of the base rules: least words, most repeated words in a hundred, words of a window (a power of two), characters counted.
LEAST_WORDS, MOST_REPEATED, WINDOW = 20, 30, 8
COUNTED = {"n_symbols": "[#*$%&|<>]", "n_marks": r"[!?;:\"()\[\]{}]", "n_digits": "[0-9]", "n_upper": "[A-Z]"}
#: Statistics that rules may use, as SQL over the columns of statistics(); each is a share or a mean.
FEATURES = {
    "mean_word": "word_chars / greatest(n_words, 1)",
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "marks_per_word": "n_marks / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "digit_share": "n_digits / greatest(word_chars, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "log_words": "ln(1 + n_words)",
}


def _let(value: Column, body) -> Column:
    """body(value) with value computed once, wherever body uses it."""
    return F.transform(F.array(value), body)[0]


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _window_hashes(words: Column) -> Column:
    """A hash of every WINDOW consecutive words, from hashes of two, four and eight; of more than WINDOW words."""
    out, n = words, 1
    while n < WINDOW:
        out = _let(out, lambda x, n=n: F.zip_with(x, F.slice(x, n + 1, F.size(x)), lambda a, b: F.xxhash64(a, b)))
        n *= 2
    return F.slice(out, 1, F.size(words) - WINDOW + 1)


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that stand twice or more in the array.

    Equal windows have equal hashes, so an array without equal hashes has none; the others are sorted by the
    windows' words themselves (which hold no space), and neighbours are compared.
    """

    def exact(w: Column) -> Column:
        starts = F.sequence(F.lit(1), F.size(w) - WINDOW + 1)
        windows = F.sort_array(F.transform(starts, lambda i: F.struct(F.array_join(F.slice(w, i, WINDOW), " ").alias("x"), i.alias("i"))))

        def twice(s: Column) -> Column:
            same = lambda e, j: F.coalesce(F.get(s, j)["x"] == e["x"], F.lit(False))
            found = F.filter(s, lambda e, j: same(e, j - 1) | same(e, j + 1))
            return F.sort_array(F.transform(found, lambda e: e["i"]))

        def covered(at: Column) -> Column:
            steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda a, b: F.least(F.lit(WINDOW), F.coalesce(b - a, F.lit(WINDOW))))
            return F.aggregate(steps, F.lit(0), lambda s, x: s + x)

        return _let(_let(windows, twice), covered)

    all_differ = _let(_window_hashes(words), lambda h: F.size(F.array_distinct(h)) == F.size(h))
    return F.when(F.size(words) <= WINDOW, 0).when(all_differ, 0).otherwise(exact(words)).cast("long")


def statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the statistics of each whole text behind their own columns; a null text is empty.

    Columns of docs by the names of statistics are replaced.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(F.size(w).alias("n_words"), F.length(F.array_join(w, "")).alias("word_chars"), repeated_words(w).alias("n_repeat_words"))

    def of_lines(lines: Column) -> Column:
        return F.struct(F.size(lines).alias("n_lines"), (F.size(lines) - F.size(F.array_distinct(lines))).alias("n_dup_lines"))

    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    shown = docs.withColumns({"_words": _let(words, of_words), "_lines": _let(lines, of_lines)})
    named = {n: F.col(f"_words.{n}") for n in ("n_words", "word_chars", "n_repeat_words")} | {n: F.col(f"_lines.{n}") for n in ("n_lines", "n_dup_lines")}
    counts = {n: _count(text, p) for n, p in COUNTED.items()}
    return shown.withColumns({n: c.cast("long") for n, c in (named | counts).items()}).drop("_words", "_lines")


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold); rows for which it holds are rejected."""

    conditions: tuple[tuple[str, bool, float], ...]

    def sql(self) -> str:
        return " AND ".join(f"({FEATURES[f]}) {'>' if above else '<='} {t!r}D" for f, above, t in self.conditions)

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        names = list(FEATURES)
        for f, above, t in self.conditions:
            v = x[:, names.index(f)]
            out &= v > t if above else v <= t
        return out


def _grow(x: np.ndarray, bad: np.ndarray, weight: np.ndarray, most: int, cuts: int) -> Rule:
    """The conjunction that gains most information with each condition, until it covers no good row."""
    names, conditions, inside = list(FEATURES), [], np.ones(len(x), bool)
    while len(conditions) < most and not bad[inside].all():
        p, n = weight[inside & bad].sum(), weight[inside & ~bad].sum()
        before, best = np.log2(p / (p + n)), (1e-9, None)
        for j in range(x.shape[1]):
            values = x[inside, j]
            order = np.argsort(values, kind="stable")
            v, b, w = values[order], bad[inside][order], weight[inside][order]
            below_p, below_n = np.cumsum(w * b), np.cumsum(w * ~b)
            ends = np.flatnonzero(v[1:] > v[:-1])
            if len(ends) > cuts:
                ends = ends[np.linspace(0, len(ends) - 1, cuts).astype(int)]
            for above, ps, ns in ((False, below_p[ends], below_n[ends]), (True, p - below_p[ends], n - below_n[ends])):
                with np.errstate(divide="ignore", invalid="ignore"):
                    gain = np.where(ps > 1e-9, ps * (np.log2(ps / (ps + ns)) - before), 0)
                if len(gain) and gain.max() > best[0]:
                    k = ends[int(gain.argmax())]
                    best = (float(gain.max()), (names[j], above, float((v[k] + v[k + 1]) / 2)))
        if best[1] is None:
            break
        conditions.append(best[1])
        inside &= Rule((best[1],)).holds(x)
    return Rule(tuple(conditions))


def _prune(rule: Rule, x: np.ndarray, bad: np.ndarray, weight: np.ndarray) -> tuple[Rule, float]:
    """The beginning of the rule that is worth most on rows it wasn't grown on, and its precision there."""

    def worth(r: Rule) -> tuple[float, float]:
        inside = r.holds(x)
        p, n = weight[inside & bad].sum(), weight[inside & ~bad].sum()
        return (p - n) / max(p + n, 1e-9), p / max(p + n, 1e-9)

    options = [Rule(rule.conditions[: k + 1]) for k in range(len(rule.conditions))]
    best = max(options, key=lambda r: (worth(r)[0], -len(r.conditions)))
    return best, worth(best)[1]


def learn(x: np.ndarray, bad: np.ndarray, weight: np.ndarray, most_rules: int = 12, most_conditions: int = 4, precision: float = 0.9, cuts: int = 256, seed: int = 5) -> list[Rule]:
    """An ordered list of rejecting rules; rows that none covers are kept. Two thirds of the rows grow rules, one third prunes them."""
    order = np.random.default_rng(seed).permutation(len(x))
    grow, prune = np.sort(order[: 2 * len(x) // 3]), np.sort(order[2 * len(x) // 3 :])
    rules: list[Rule] = []
    while len(rules) < most_rules and bad[grow].any() and bad[prune].any():
        rule = _grow(x[grow], bad[grow], weight[grow], most_conditions, cuts)
        if not rule.conditions:
            break
        rule, sure = _prune(rule, x[prune], bad[prune], weight[prune])
        if sure < precision:
            break
        rules.append(rule)
        grow, prune = (part[~rule.holds(x[part])] for part in (grow, prune))
    return rules


def base_failed() -> str:
    return f"(n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)"


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", learn_from: str = f"NOT ({held_out(5, 0)})", sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text") -> list[Rule]:
    """Rules learnt from at most sample_rows labelled rows of each class, without those that fail the base rules.

    The sample is the first ids by a seeded hash. Ids with null or several different labels aren't used;
    rows that share an id are rows of their own, of which at most 2 * sample_rows are read. No rules
    without rows of both classes.
    """
    marked = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).filter("doc_id IS NOT NULL AND y IN (0, 1)").filter(learn_from)
    marked = marked.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("_most")).filter("y = _most").drop("_most")
    counts = dict(marked.groupBy("y").count().collect())
    if len(counts) < 2:
        return []
    chosen = [tuple(r) for y in (0, 1) for r in marked.filter(F.col("y") == y).orderBy(F.xxhash64(F.lit(17), "doc_id"), "doc_id").limit(sample_rows).collect()]
    sample = docs.sparkSession.createDataFrame(chosen, marked.schema)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).join(F.broadcast(sample), "doc_id")
    # what fails the base rules is left out here: a filter in the plan would be pushed below the join and read every text
    seen = statistics(rows).select(F.expr(base_failed()).alias("failed"), "y", *[F.expr(e).cast("double").alias(n) for n, e in FEATURES.items()])
    got = [tuple(r)[1:] for r in seen.orderBy(F.xxhash64("y", *FEATURES), *FEATURES).limit(2 * sample_rows).collect() if not r.failed]
    got = np.array(got, float).reshape(-1, 1 + len(FEATURES))
    got = got[np.lexsort(got.T[::-1])]
    bad = got[:, 0] == 0
    if bad.all() or not bad.any():
        return []
    share = np.where(bad, counts[0] / bad.sum(), counts[1] / (~bad).sum())
    return learn(got[:, 1:], bad, share / share.mean())


def verdict(rules: list[Rule]) -> Column:
    """Position of the first rule that holds, from 1, or null: one ordered conditional expression."""
    out = None
    for i, rule in enumerate(rules, 1):
        out = (F if out is None else out).when(F.expr(rule.sql()), i)
    return F.lit(None).cast("int") if out is None else out.cast("int")


def judge(docs: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, rule, kept.

    rule is the number of the first rule of the list that rejects a row which the base rules let pass.
    Null and empty texts have no words and fail the base rules; rows with equal texts are judged alike;
    ids aren't looked at. Words end at white space (space and U+0009 to U+000D), whatever their length.
    """
    stats = statistics(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    judged = stats.withColumn("base_failed", F.expr(base_failed())).withColumn("rule", F.when(~F.col("base_failed"), verdict(rules)))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "rule", (~F.col("base_failed") & F.col("rule").isNull()).alias("kept"))


def filter_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """judge by the rules that fit learns from labels; without labels of both classes the base rules alone decide."""
    return judge(docs, fit(docs, labels))
