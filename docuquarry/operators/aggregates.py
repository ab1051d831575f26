"""Aggregates of dashboards, registers and reports, each over the caller's own columns; all combine before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuquarry.plans.rules import severity_rank


def kpi_counts(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: total, and how many rows each named condition holds for (null doesn't), in one scan."""
    return df.agg(F.count("*").alias("total"), *[F.count_if(c).alias(n) for n, c in conditions.items()])


def party_directory(mentions: DataFrame, name: Column, contract: str, primary: Column, role: Column, expiry: Column, sample: str, display: Column | None = None) -> DataFrame:
    """(party_key, name, contracts, is_primary, roles, last_expiry, sample) of mentions by their lower-cased, stripped name: distinct contracts, blank names and roles left out."""
    shown = name if display is None else F.coalesce(display, name)
    rows = mentions.where(F.trim(name) != "").groupBy(F.lower(F.trim(name)).alias("party_key"))
    roles = F.array_join(F.array_sort(F.filter(F.collect_set(role), lambda x: x != "")), ",")
    return rows.agg(F.max(shown).alias("name"), F.countDistinct(contract).alias("contracts"), F.bool_or(primary).alias("is_primary"), roles.alias("roles"), F.max(expiry).alias("last_expiry"), F.min(sample).alias("sample"))


def value_by_currency(rows: DataFrame, party: str, contract: str, value: Column, currency: Column) -> DataFrame:
    """(party, currency, value): a contract that names a party several times counts once; a null currency is unknown; null values don't count."""
    named = F.coalesce(currency, F.lit("unknown")).alias("currency")
    per = rows.where(value.isNotNull()).groupBy(party, named, contract).agg(F.max(value).alias("_v"))
    return per.groupBy(party, "currency").agg(F.sum("_v").cast("double").alias("value"))


def counterparties(mentions: DataFrame, name: Column, contract: str, limit: int = 100) -> DataFrame:
    """(party, contracts): the parties of most distinct contracts, ties by name."""
    return mentions.groupBy(name.alias("party")).agg(F.countDistinct(contract).alias("contracts")).orderBy(F.desc("contracts"), "party").limit(limit)


def frequency(rows: DataFrame, kind: Column, document: str, name: str = "clause_type") -> DataFrame:
    """(kind, n_rows, documents): rows and distinct documents of each kind, the most frequent first."""
    return rows.groupBy(kind.alias(name)).agg(F.count("*").alias("n_rows"), F.countDistinct(document).alias("documents")).orderBy(F.desc("n_rows"), name)


def queue_counts(messages: DataFrame, by: list[str], delayed: Column) -> DataFrame:
    """(by, n, delayed, waiting): messages of each group, those not due yet and the rest."""
    rows = messages.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(delayed).alias("delayed"))
    return rows.withColumn("waiting", F.col("n") - F.col("delayed"))


def mean_durations(runs: DataFrame, stage: str, seconds: str, counts: Column | None = None) -> DataFrame:
    """(stage, n, mean): mean duration to six places of the runs that count and have one."""
    rows = runs.where(F.col(seconds).isNotNull())
    rows = rows if counts is None else rows.where(counts)
    return rows.groupBy(stage).agg(F.count("*").alias("n"), F.round(F.avg(seconds), 6).alias("mean"))


def success_rate(jobs: DataFrame, succeeded: Column, failed: Column, by: list[str] | None = None) -> DataFrame:
    """success_rate to four places among ended jobs, 0.0 without any."""
    done, lost = F.count_if(succeeded), F.count_if(failed)
    rate = F.when(done + lost == 0, 0.0).otherwise(F.round(done / (done + lost), 4)).alias("success_rate")
    return jobs.groupBy(*by).agg(rate) if by else jobs.agg(rate)


def per_day(rows: DataFrame, time: str, after: str | None = None, before: str | None = None) -> DataFrame:
    """(day, n): rows of each day behind `after` and up to `before`; days without rows have none."""
    kept = rows
    day = F.to_date(time)
    for end, keep in ((after, lambda x: day > F.lit(x).cast("date")), (before, lambda x: day <= F.lit(x).cast("date"))):
        kept = kept if end is None else kept.where(keep(end))
    return kept.groupBy(day.alias("day")).agg(F.count("*").alias("n"))


def coverage(documents: DataFrame, document: str, found: DataFrame, of: str, kind: Column, expected: int) -> DataFrame:
    """(document, found, coverage): distinct kinds of each document's rows in found (its column `of`), 0 without any, as a share of those expected to three places."""
    seen = found.groupBy(F.col(of).alias("_d")).agg(F.countDistinct(kind).alias("_f"))
    rows = documents.select(document).join(seen, F.col(document) == F.col("_d"), "left").withColumn("found", F.coalesce("_f", F.lit(0)))
    return rows.select(document, "found", F.when(F.lit(expected) > 0, F.round(F.col("found") / float(max(expected, 1)), 3)).alias("coverage"))


def chunk_statistics(chunks: DataFrame, kind: Column, text: str, version: str) -> DataFrame:
    """(chunk_type, chunks, characters, next_version) by kind; without a version the next is 1."""
    return chunks.groupBy(kind.alias("chunk_type")).agg(F.count("*").alias("chunks"), F.sum(F.length(text)).cast("long").alias("characters"), next_number(version).alias("next_version"))


def next_number(column: str) -> Column:
    """The highest number and one; 1 without any."""
    return F.coalesce(F.max(column), F.lit(0)) + 1


def representative(rows: DataFrame, key: Column, pick: str, name: str = "key") -> DataFrame:
    """(key, pick): the smallest pick stands for all rows of a key."""
    return rows.groupBy(key.alias(name)).agg(F.min(pick).alias(pick))


def severity_breakdown(findings: DataFrame, by: str, counts: dict[str, Column], top: Column, rank: Column | None = None) -> DataFrame:
    """(by, counts..., top): how many findings each condition holds for, and the highest of top by rank (severity by default), ties to the greater value."""
    order = severity_rank(top) if rank is None else rank
    return findings.groupBy(by).agg(*[F.count_if(c).alias(n) for n, c in counts.items()], F.max_by(top, F.struct(order, top)).alias("top"))


def tag_slices(rows: DataFrame, case: str, tags: Column, least: int = 3) -> DataFrame:
    """(tag, cases) of tags that at least so many different cases have; tags of a case count once."""
    tagged = rows.select(case, F.explode(tags).alias("tag")).distinct()
    return tagged.groupBy("tag").agg(F.count("*").alias("cases")).where(F.col("cases") >= least)


def index_coverage(rows: DataFrame, by: Column, indexed: Column, deadline: Column, name: str = "stage") -> DataFrame:
    """(by, total, indexed, coverage, earliest): rows whose indexed value isn't null, their share to four places, and the earliest deadline."""
    some = F.count(indexed)
    return rows.groupBy(by.alias(name)).agg(F.count("*").alias("total"), some.alias("indexed"), F.round(some / F.count("*"), 4).alias("coverage"), F.min(deadline).alias("earliest"))


def percentiles(rows: DataFrame, by: str, value: str, **points: float) -> DataFrame:
    """(by, points...): exact interpolated percentiles to six places; null values don't count."""
    return rows.groupBy(by).agg(*[F.round(F.percentile(value, F.lit(p)), 6).alias(n) for n, p in points.items()])


def top_by_severity(rows: DataFrame, severity: Column, score: str, key: str, limit: int = 25) -> DataFrame:
    """The most severe rows, of equal ones those of the highest score, ties by key."""
    return rows.orderBy(severity_rank(severity).desc(), F.desc(score), key).limit(limit)


def expiring_first(rows: DataFrame, expiry: str, today, days: int, key: str, limit: int = 25) -> DataFrame:
    """The rows that expire within days, the soonest first, ties by key."""
    soon = rows.where(F.col(expiry).between(F.lit(today).cast("date"), F.date_add(F.lit(today).cast("date"), days)))
    return soon.orderBy(expiry, key).limit(limit)
