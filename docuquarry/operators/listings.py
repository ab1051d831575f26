"""Lists behind the administration screens: equality filters, existence, the audit trail, and the types a platform knows."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuquarry.operators import predicates as p


def matching(df: DataFrame, filters: dict[str, Any]) -> DataFrame:
    """Live rows whose columns equal the filters; null values are no filter, lists mean any of them, columns that df lacks are refused."""
    unknown = [c for c in filters if c not in df.columns]
    if unknown:
        raise ValueError(f"no columns {', '.join(unknown)}")
    rows = p.live(df)
    for column, value in filters.items():
        if value is not None:
            rows = rows.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple, set)) else F.col(column) == F.lit(value))
    return rows


def exists(df: DataFrame, filters: dict[str, Any]) -> bool:
    """Whether any live row matches; one row is fetched at most."""
    return not matching(df, filters).limit(1).isEmpty()


def counts(df: DataFrame, by: str, **wanted: dict[str, Any]) -> DataFrame:
    """(by, counts..., exists...) for each group: how many live rows match each named filter, and whether any does."""
    conditions = {n: p.all_of(F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == F.lit(v) for c, v in f.items() if v is not None) for n, f in wanted.items()}
    return p.live(df).groupBy(by).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()], *[F.coalesce(F.bool_or(c), F.lit(False)).alias(f"has_{n}") for n, c in conditions.items()])


def audit_trail(log: DataFrame, project_ids: list, number: int, size: int, time: str = "created_at", tie: str = "id", **filters: Any) -> DataFrame:
    """A page, counted from 1, of log rows in the projects or in none, newest first, ties by key; an empty scope sees nothing.

    Rows of the platform (null project) are part of every scope, as an investigation starts from them.
    """
    if not project_ids:
        return log.limit(0)
    rows = matching(log.where(p.scope_or_global("project_id", project_ids)), filters)
    return rows.orderBy(F.desc(time), F.desc(tie)).offset((max(1, number) - 1) * size).limit(size)


def known_types(profiles: DataFrame, fallback: str = "other") -> DataFrame:
    """(agreement_type, place): the distinct types of active, live profiles in order, the fallback behind them where it isn't one; nothing without any profile."""
    types = p.live(profiles).where(F.col("is_active") & F.col("agreement_type").isNotNull() & (F.col("agreement_type") != "")).agg(F.array_sort(F.collect_set("agreement_type")).alias("_t"))
    whole = F.when(F.size("_t") == 0, F.col("_t")).when(F.array_contains("_t", fallback), F.col("_t")).otherwise(F.concat("_t", F.array(F.lit(fallback))))
    return types.select(F.posexplode(whole).alias("place", "agreement_type")).select("agreement_type", "place")


def response(df: DataFrame, fields: dict[str, Column | str]) -> DataFrame:
    """Rows as an interface answers them: named fields from columns or expressions, dates as text, decimals as numbers, all else as it is."""
    out = df.select(*[(F.col(c) if isinstance(c, str) else c).alias(n) for n, c in fields.items()])
    shown = {n: F.date_format(n, "yyyy-MM-dd") if k == "date" else F.col(n).cast("double") if k.startswith("decimal") else F.date_format(n, "yyyy-MM-dd'T'HH:mm:ss") if k in ("timestamp", "timestamp_ntz") else F.col(n) for n, k in out.dtypes}
    return out.select(*[c.alias(n) for n, c in shown.items()])
