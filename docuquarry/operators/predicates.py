"""Composable predicates: an absent filter value is no filter, and null columns never match by accident."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def all_of(conditions: Iterable[Column | None]) -> Column:
    return reduce(lambda a, b: a & b, [c for c in conditions if c is not None], F.lit(True))


def any_of(conditions: Iterable[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)


def live(df: DataFrame) -> DataFrame:
    """Rows that aren't soft-deleted, where the table knows deletion."""
    return df.where(F.col("deleted_at").isNull()) if "deleted_at" in df.columns else df


def scoped(df: DataFrame, project_ids: list, column: str = "project_id") -> DataFrame:
    """Live rows of the given projects; an empty scope sees nothing."""
    return live(df).where(F.col(column).isin(list(project_ids))) if project_ids else df.where(F.lit(False))


def within_scope(requested, allowed: list) -> list:
    """The caller's projects, narrowed to one that must be among them."""
    if requested is None:
        return list(allowed)
    if requested not in allowed:
        raise PermissionError(f"{requested} is outside the scope")
    return [requested]


def contains_text(query: str | None, *columns: str) -> Column | None:
    """Case-insensitive substring in any column; null columns count as empty; LIKE wildcards are literal."""
    if not (query or "").strip():
        return None
    literal = query.strip().replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_")
    return any_of(F.coalesce(F.col(c), F.lit("")).ilike(f"%{literal}%") for c in columns)


def one_of(column: str, values: list | None) -> Column | None:
    return F.col(column).isin(list(values)) if values else None


def same_folded(column: str, value: str | None) -> Column | None:
    return F.lower(F.coalesce(F.col(column), F.lit(""))) == value.strip().lower() if value and value.strip() else None


def between(column: str, low=None, high=None) -> Column | None:
    """Inclusive range, either end open."""
    parts = [F.col(column) >= F.lit(low) if low is not None else None, F.col(column) <= F.lit(high) if high is not None else None]
    return all_of(parts) if any(p is not None for p in parts) else None


def within_days(column: str, today, days: int | None) -> Column | None:
    return None if days is None else F.col(column).between(F.lit(today), F.date_add(F.lit(today), days))


def flag(column: str, wanted: bool | None) -> Column | None:
    """IS TRUE or IS FALSE when asked for; null rows match neither."""
    return None if wanted is None else F.col(column).eqNullSafe(F.lit(wanted))


def is_missing(column: str, wanted: bool | None) -> Column | None:
    """Tri-state: null, not null, or any."""
    return None if wanted is None else (F.col(column).isNull() if wanted else F.col(column).isNotNull())


def has_all(column: str, values: list | None) -> Column | None:
    return F.size(F.array_except(F.array(*map(F.lit, values)), F.col(column))) == 0 if values else None


def has_any(column: str, values: list | None) -> Column | None:
    return F.arrays_overlap(F.col(column), F.array(*map(F.lit, values))) if values else None


def non_empty(column: str, wanted: bool | None) -> Column | None:
    """Array emptiness; a null array is neither empty nor filled."""
    size = F.when(F.col(column).isNotNull(), F.size(column))
    return None if wanted is None else (size > 0 if wanted else ~(size > 0))


def holds_object(column: str, wanted: dict) -> Column:
    """A JSON object column holds each pair of a flat or nested object."""

    def walk(path: str, value) -> list[Column]:
        if isinstance(value, dict):
            return [c for k, v in value.items() for c in walk(f"{path}.{k}", v)]
        text = str(value).lower() if isinstance(value, bool) else str(value)
        return [F.get_json_object(F.col(column), path).eqNullSafe(text)]

    return all_of(walk("$", wanted))


def scope_or_global(column: str, ids: list) -> Column:
    return F.col(column).isin(list(ids)) | F.col(column).isNull()


def stalled(now, minutes: int = 45) -> Column:
    """Running, and without a heartbeat since the cutoff; without any heartbeat the last update counts."""
    cutoff = F.lit(now).cast("timestamp") - F.make_interval(mins=F.lit(minutes))
    return (F.col("state") == "running") & ((F.col("heartbeat_at") < cutoff) | (F.col("heartbeat_at").isNull() & (F.col("updated_at") < cutoff)))
