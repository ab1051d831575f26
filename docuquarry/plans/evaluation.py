"""Judging retrieval runs: relevance grades, citations, plans, composites, sweeps and golden sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.functions.text import words_only
from docuquarry.operators.folds import fold

#: Weights of the composite, the gain that is noise, the length from which an answer must cite, and the grade from which a hit counts.
COMPOSITE = {"recall@10": 0.30, "mrr": 0.20, "ndcg@10": 0.15, "citation_precision": 0.15, "guardrail_accuracy": 0.15, "grounding_rate": 0.05}
NOISE, TRIVIAL_CHARS, RELEVANT = 0.005, 160, 1


def _some(c: str) -> Column:
    return F.size(F.coalesce(F.col(c), F.array().cast("array<string>"))) > 0


def grade(ref_id: Column, chunk_id: Column, contract_id: Column, heading: Column, number: Column, page_start: Column, page_end: Column) -> Column:
    """4 exact, 3 heading, 2 page, 1 contract, 0 none, against the case's arrays clauses, headings, contracts and pages."""
    exact = F.array_contains("clauses", ref_id) | F.coalesce(F.array_contains("clauses", chunk_id), F.lit(False))
    folded = F.transform("headings", words_only)
    by_heading = F.exists(F.array(words_only(heading), words_only(number)), lambda x: (x != "") & F.array_contains(folded, x))
    last = F.coalesce(page_end, page_start)
    by_page = F.coalesce(F.exists("pages", lambda p: (p >= page_start) & (p <= last)), F.lit(False))
    in_contract = F.coalesce(F.array_contains("contracts", contract_id), F.lit(False))
    closed = _some("clauses") & ~(_some("contracts") | _some("headings"))
    return (
        F.when(_some("clauses") & F.coalesce(exact, F.lit(False)), 4).when(closed, 0).when(_some("headings") & F.coalesce(by_heading, F.lit(False)), 3)
        .when(_some("contracts") & in_contract, F.when(_some("pages") & by_page, 2).otherwise(1)).otherwise(0)
    )


def total_relevant() -> Column:
    """How many units the case expects: clauses, else headings, else contracts."""
    return F.when(_some("clauses"), F.size("clauses")).when(_some("headings"), F.size("headings")).otherwise(F.coalesce(F.size("contracts"), F.lit(0)))


def means(per_case: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """Means over the cases that a metric can score (null: it can't)."""
    return per_case.groupBy(*(by or [])).agg(F.count("*").alias("cases"), *[F.round(F.avg(c), 6).alias(c) for c in columns])


def citation_outcomes(citations: DataFrame, retrieved: DataFrame, case: str = "case_id") -> DataFrame:
    """(case, total, correct, imprecise, broken, hallucinated, available, missed, precision, recall).

    citations (case, label, ref_id, resolved); retrieved (case, ref_id, grade, in_context, cited), a row a
    hit. Hallucinated: not offered; broken: not retrieved; precision is over what resolves, recall over
    relevant hits in the context.
    """
    # both sides meet as rows of one grouping by case and reference, so nothing is sorted for a join
    shown = F.coalesce(F.col("in_context") & (F.col("grade") >= RELEVANT), F.lit(False))
    found = retrieved.select(case, "ref_id", F.lit(0).alias("_lost"), F.lit(0).alias("_said"), "grade", shown.cast("int").alias("_a"), (shown & ~F.col("cited")).cast("int").alias("_m"))
    lost = F.coalesce(~F.col("resolved"), F.lit(False)).cast("int")
    named = citations.select(case, "ref_id", lost.alias("_lost"), (1 - lost).alias("_said"), F.lit(None).cast(dict(found.dtypes)["grade"]).alias("grade"), F.lit(0).alias("_a"), F.lit(0).alias("_m"))
    per = named.unionByName(found).groupBy(case, "ref_id").agg(F.max("grade").alias("_g"), *[F.sum(c).alias(c) for c in ("_lost", "_said", "_a", "_m")])
    graded = F.when(F.col("ref_id").isNotNull(), F.col("_g"))
    kind = F.when(graded.isNull(), "broken").when(graded >= RELEVANT, "correct").otherwise("imprecise")
    of = lambda k: F.coalesce(F.sum(F.when(kind == k, F.col("_said"))), F.lit(0))
    out = per.groupBy(case).agg(F.sum(F.col("_lost") + F.col("_said")).alias("total"), *[of(k).alias(k) for k in ("correct", "imprecise", "broken")], F.sum("_lost").alias("hallucinated"), F.sum("_a").alias("available"), F.sum(F.coalesce("_m", F.lit(0))).alias("missed")).na.fill(0)
    resolvable = F.col("total") - F.col("hallucinated") - F.col("broken")
    return out.withColumns({"precision": F.when(resolvable > 0, F.round(F.col("correct") / resolvable, 6)), "recall": F.when(F.col("available") > 0, F.round((F.col("available") - F.col("missed")) / F.col("available"), 6))})


def hallucination_rate(answers: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(answers, uncited, hallucinated, hallucination_rate) of answers (length, citations, hallucinated, honest): long ones without a citation that don't own up, and invented labels, over all."""
    uncited = (F.col("length") > TRIVIAL_CHARS) & (F.col("citations") == 0) & ~F.col("honest")
    rows = answers.groupBy(*(by or [])).agg(F.count("*").alias("answers"), F.count_if(uncited).alias("uncited"), F.sum("hallucinated").alias("hallucinated"))
    return rows.withColumn("hallucination_rate", F.round((F.col("uncited") + F.col("hallucinated")) / F.greatest("answers", F.lit(1)), 4))


def planner_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Accuracy of intents and types over labelled cases, and how often the type filter was right.

    results: intent, expected_intent, document_type, expected_type, applied_types, expected_types, relevant
    (whether a relevant hit came back). A filter is judged by the expected types where named, else by relevant.
    """
    same = lambda a, b: words_only(F.col(a)) == words_only(F.col(b))
    label = lambda c: F.coalesce(F.col(c), F.lit("")) != ""
    fold_all = lambda c: F.transform(c, words_only)
    named = _some("expected_types")
    right = F.when(named, F.arrays_overlap(fold_all("applied_types"), fold_all("expected_types"))).otherwise(F.col("relevant"))
    share = lambda good, of: F.when(F.count_if(of) > 0, F.round(F.count_if(of & good) / F.count_if(of), 6))
    return results.groupBy(*(by or [])).agg(
        F.count("*").alias("cases"), share(same("intent", "expected_intent"), label("expected_intent")).alias("intent_accuracy"), share(same("document_type", "expected_type"), label("expected_type")).alias("document_type_accuracy"),
        F.count_if(_some("applied_types") & right).alias("correct_filtering"), F.count_if(_some("applied_types") & ~right).alias("false_filtering"), F.count_if(~_some("applied_types") & label("document_type")).alias("filter_declined"),
    )


def confusion(results: DataFrame, expected: str, got: str) -> DataFrame:
    return results.where(F.col(expected).isNotNull()).groupBy(expected, got).agg(F.count("*").alias("cases"))


def guardrail_metrics(results: DataFrame, by: list[str] | None = None) -> DataFrame:
    """(accuracy, false_accepts, false_rejects, summary_would_pass) of results (answerable, answered, summary_similarity, floor)."""
    a, b = F.col("answerable"), F.col("answered")
    return results.groupBy(*(by or [])).agg(F.round(F.avg((a == b).cast("double")), 6).alias("accuracy"), F.count_if(b & ~a).alias("false_accepts"), F.count_if(a & ~b).alias("false_rejects"), F.count_if(~b & (F.col("summary_similarity") >= F.col("floor"))).alias("summary_would_pass"))


def composite(metrics: dict[str, Column]) -> Column:
    """Weighted mean of the metrics that are there."""
    have = {k: c for k, c in metrics.items() if k in COMPOSITE}
    total = reduce(lambda a, b: a + b, [F.coalesce(c * COMPOSITE[k], F.lit(0.0)) for k, c in have.items()])
    weight = reduce(lambda a, b: a + b, [F.when(c.isNotNull(), COMPOSITE[k]).otherwise(0.0) for k, c in have.items()])
    return F.when(weight > 0, F.round(total / weight, 6)).otherwise(0.0)


def flat_metrics(rows: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    """(keys, metric, value) from wide rows; absent values are 0."""
    return rows.select(*keys, F.inline(F.array(*[F.struct(F.lit(n).alias("metric"), F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias("value")) for n in names])))


def sweep_advice(points: DataFrame, parameter: str = "parameter") -> DataFrame:
    """(parameter, best_value, gain, advice) of points (parameter, value, composite, is_current): keep where the best point gains no more than noise, else consider; unswept without a current one."""
    rows = points.groupBy(parameter).agg(F.max_by("value", F.struct("composite", -F.col("value"))).alias("best_value"), F.max("composite").alias("_b"), F.max(F.when(F.col("is_current"), F.col("composite"))).alias("_c"))
    gain = F.round(F.col("_b") - F.col("_c"), 6)
    return rows.select(parameter, "best_value", gain.alias("gain"), F.when(gain.isNull(), "unswept").when(gain <= NOISE, "keep").otherwise("consider").alias("advice"))


def ablation_verdict(base: Column, treated: Column) -> Column:
    return F.when(treated - base <= NOISE, "no_material_gain").otherwise("gains")


def duplicate_rates(hits: DataFrame, case: str, order: str, shingles: str, threshold: float = 0.8) -> DataFrame:
    """(case, items, duplicates, rate): hits in order that repeat an earlier distinct one; a case's hits are a bounded list."""
    cols = hits.select(case, order, shingles)

    def run(rows: list[tuple]) -> list[tuple]:
        seen: list[frozenset] = []
        again = 0
        for r in rows:
            s = frozenset(r[2] or ())
            if s and any(len(s & o) / min(len(s), len(o)) >= threshold for o in seen):
                again += 1
            elif s:
                seen.append(s)
        return [(rows[0][0], len(rows), again, again / len(rows) if len(rows) > 1 else 0.0)]

    return fold(cols, [order], run, f"{case} {dict(cols.dtypes)[case]}, items long, duplicates long, rate double")


def golden_subset(cases: DataFrame, tags: list[str] | None = None, dataset_tags: list[str] | None = None, project_id=None) -> DataFrame:
    """Cases (tags, project_id) with any of the tags, in any case; the dataset's own tags count for each."""
    rows = cases if project_id is None else cases.where(F.col("project_id") == project_id)
    if not tags or {x.lower() for x in tags} & {x.lower() for x in dataset_tags or []}:
        return rows
    return rows.where(F.arrays_overlap(F.transform("tags", F.lower), F.array(*[F.lit(x.lower()) for x in tags])))


def golden_skeleton(clauses: DataFrame, contract: str, per_contract: int) -> DataFrame:
    """Of each contract's clauses (clause_type, page_start, clause_number) the first of every type, then the rest, up to a number."""
    order = [F.asc_nulls_last("page_start"), F.asc_nulls_last("clause_number")]
    rows = clauses.withColumn("_n", F.row_number().over(Window.partitionBy(contract, "clause_type").orderBy(*order)))
    w = Window.partitionBy(contract).orderBy((F.col("_n") > 1).asc(), *order, "clause_type")
    return rows.withColumn("pick", F.row_number().over(w)).where(F.col("pick") <= per_contract).drop("_n")


def diff_totals(rows: DataFrame, matched: str = "matched", total: str = "total", by: list[str] | None = None) -> DataFrame:
    """(matched, total, share): micro-averaged to four places; null share without rows."""
    out = rows.groupBy(*(by or [])).agg(F.coalesce(F.sum(matched), F.lit(0)).alias("matched"), F.coalesce(F.sum(total), F.lit(0)).alias("total"))
    return out.withColumn("share", F.when(F.col("total") > 0, F.round(F.col("matched") / F.col("total"), 4)))


def source_coverage(audits: DataFrame) -> DataFrame:
    """audits with coverage: citations of the evidence offered, to four places; null where none was."""
    return audits.withColumn("coverage", F.when(F.col("offered") > 0, F.round(F.col("cited") / F.col("offered"), 4)))


def case_results(retrieved: DataFrame, context: DataFrame, cited: DataFrame, case: str) -> DataFrame:
    """Retrieved passages (case, rank, ref_id, ...) with in_context, whether the prompt held them, and cited, whether the answer names them."""
    flag = lambda df, name: df.select(case, "ref_id").distinct().withColumn(name, F.lit(True))
    rows = retrieved.join(flag(context, "_in"), [case, "ref_id"], "left").join(flag(cited, "_cited"), [case, "ref_id"], "left")
    return rows.select(*retrieved.columns, F.col("_in").isNotNull().alias("in_context"), F.col("_cited").isNotNull().alias("cited"))


def citation_records(labels: DataFrame, offered: DataFrame, case: str) -> DataFrame:
    """(case, label, ref_id, resolved) of the labels in answers: fabricated ones stay, unresolved, so that they can be counted."""
    known = offered.select(case, "label", "ref_id").dropDuplicates([case, "label"])
    return labels.select(case, "label").distinct().join(known, [case, "label"], "left").withColumn("resolved", F.col("ref_id").isNotNull())


def metric_report(scores: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, value): one row for each number of wide scores, nulls left out, for JSON and CSV reports by sinks.write."""
    numbers = [c for c, kind in scores.dtypes if c not in keys and kind in ("double", "float", "bigint", "int")]
    return scores.unpivot(keys, [F.col(c).cast("double").alias(c) for c in numbers], "metric", "value").where("value IS NOT NULL")
