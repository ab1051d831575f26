"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


#: White space as Unicode has it, for Java's expressions.
SPACE = r"[\s\x0b\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
#: The ASCII part of it, which a table of bits decides, and how the others begin in UTF-8.
ASCII_SPACE = r"[\t-\r\x1c-\x20]"
_WIDE = ["C285", "C2A0", "E19A80", "E280", "E2819F", "E38080"]
#: Words of company names that don't tell parties apart.
COMPANY_WORDS = ("private", "pvt", "limited", "ltd", "llc", "inc", "incorporated", "corp", "corporation", "plc", "gmbh", "llp", "company", "co", "sa", "bv", "nv", "ag", "pte")


def _may_hold_wide_space(text: Column) -> Column:
    """Whether a byte sequence that begins white space beyond ASCII occurs; a few comparisons of bytes, none for ASCII texts."""
    data = text.cast("binary")
    found = F.contains(data, F.unhex(F.lit(_WIDE[0])))
    for start in _WIDE[1:]:
        found = found | F.contains(data, F.unhex(F.lit(start)))
    return (F.length(text) != F.octet_length(text)) & found


def _without_space(text: Column, by: str, more: str = "") -> Column:
    """Every white space (with more behind it) replaced; the long expression runs only where the short one could miss some."""
    return F.when(_may_hold_wide_space(text), F.regexp_replace(text, SPACE + more, by)).otherwise(F.regexp_replace(text, ASCII_SPACE + more, by))


def squeeze(text: Column) -> Column:
    """White-space runs to one space, ends stripped."""
    return F.trim(_without_space(text, " ", "+"))


def words_only(text: Column) -> Column:
    """Lower case with single spaces for everything but a-z and 0-9; null is empty."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+", " "))


def clause_heading(text: Column) -> Column:
    """words_only behind a leading number, roman number or letter that ends with . ) or ] and a space."""
    number = r"^\s*(?:\d+(?:\.\d+)*|[ivxlc]+|[a-z])[.)\]]\s+"
    return words_only(F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), number, ""))


def party_name(text: Column) -> Column:
    """words_only without COMPANY_WORDS, for comparing names of parties."""
    bare = F.regexp_replace(words_only(text), rf"\b({'|'.join(COMPANY_WORDS)})\b", " ")
    return F.trim(F.regexp_replace(bare, " +", " "))


def content_hash(text: Column) -> Column:
    return F.sha2(squeeze(text), 256)


def token_estimate(text: Column) -> Column:
    """At least one token: characters by 3.6, or by 3.0 when a quarter of them is white space; empty: 0."""
    n = F.length(text)
    spaces = n - F.length(_without_space(text, ""))
    per = F.when(spaces >= 0.25 * n, 3.0).otherwise(3.6)
    return F.when(n == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(n / per).cast("int")))


def strict_date(text: Column) -> Column:
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))


def clause_number(title: Column) -> Column:
    found = F.regexp_extract(title, r"^\s*(\d+(?:\.\d+)*)", 1)
    return F.when(found != "", found)


def risk_band(score: Column) -> Column:
    """high from 67, medium from 34, else low, as without a score."""
    return F.when(score >= 67, "high").when(score >= 34, "medium").otherwise("low")


def confidence_band(value: Column) -> Column:
    """high from 0.8, medium from 0.55, else low, as without a value."""
    return F.when(value >= 0.8, "high").when(value >= 0.55, "medium").otherwise("low")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once however often body uses it, also inside its lambdas."""
    return F.transform(F.array(value), body)[0]


def shingles(text: Column, n: int = 8) -> Column:
    """Distinct n-word shingles; a shorter text is its own, one without words has none."""

    def of(w: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, F.array_distinct(runs)).otherwise(F.array(F.array_join(w, " ")))

    line = squeeze(F.lower(F.coalesce(text, F.lit(""))))
    return let(line, lambda x: F.when(x == "", F.array().cast("array<string>")).otherwise(let(F.split(x, " "), of)))


#: Weights of severities, the largest share one finding takes, and the bands' upper ends.
SEVERITY_WEIGHTS, MOST_WEIGHT, LOW_MAX, MEDIUM_MAX = {"critical": 40, "high": 25, "medium": 10, "low": 3}, 40, 33, 66


def severity_weight(severity: Column) -> Column:
    out = F.lit(0)
    for name, weight in SEVERITY_WEIGHTS.items():
        out = F.when(severity == name, min(weight, MOST_WEIGHT)).otherwise(out)
    return out


def saturating_score(weights: Column, cap: float = 40.0) -> Column:
    """100 minus what is left after each weight (at most cap) takes its share of the rest, half to even."""
    left = F.aggregate(weights, F.lit(100.0), lambda rest, w: rest - rest * (F.least(w.cast("double"), F.lit(cap)) / F.lit(100.0)))
    return F.bround(100 - left)


def risk_score(severities: Column, low_max: int = LOW_MAX, medium_max: int = MEDIUM_MAX) -> Column:
    """0 to 100 from an array of severities: each takes its weight as a share of what is left of 100, half to even.

    A critical finding lifts the score over the medium band, a high one over the low band.
    """
    # in falling order, as sums of doubles depend on it
    score = saturating_score(F.sort_array(F.transform(severities, severity_weight), asc=False), MOST_WEIGHT)
    floor = F.when(F.array_contains(severities, "critical"), medium_max + 1).when(F.array_contains(severities, "high"), low_max + 1).otherwise(0)
    return F.greatest(F.least(F.greatest(score, F.lit(0.0)), F.lit(100.0)).cast("int"), floor)


#: What sanitise takes out of evidence, and the mark that it leaves.
INVISIBLE, CONTROL = r"[\u00ad\u200b-\u200f\u202a-\u202e\u2060-\u2064\u2066-\u2069\ufeff]", r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\u009f]"
DELIMITER, REMOVED = r"(?i)</?\s*(?:untrusted_evidence|system|instructions?|prompt)\s*>", "[removed: markup]"


@F.pandas_udf(StringType())
def nfkc(text: pd.Series) -> pd.Series:
    """Compatibility composition, which no built-in function offers."""
    return text.str.normalize("NFKC")


def sanitise(text: Column) -> Column:
    """Evidence that is safe inside a delimited prompt: composed, without invisible and control characters, delimiters marked; null is empty."""
    seen = F.regexp_replace(nfkc(F.coalesce(text, F.lit(""))), INVISIBLE, "")
    marked = F.regexp_replace(F.regexp_replace(seen, CONTROL, " "), DELIMITER, REMOVED)
    return F.regexp_replace(marked, f"^{SPACE}+|{SPACE}+$", "")


def suspicious(text: Column) -> Column:
    """Whether text carries a delimiter, once composed, or an invisible character."""
    return F.coalesce(nfkc(text).rlike(DELIMITER) | text.rlike(INVISIBLE), F.lit(False))
