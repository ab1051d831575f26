"""URL filters: rules found by their rarest literal token, so that few regular expressions run.

Native: one projection of built-in functions over the URL column, no join and no shuffle.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The rule index is a literal of the plan, so its size is bounded.
MAX_RULES = 1_000
#: Ranks from here on are of host rules.
HOST_RULES = 1_000_000
_TOKEN = "[a-z0-9]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """name: what is reported; host and path: regular expressions that both must be found; literal: text whose tokens every match holds whole."""

    name: str
    verdict: str
    host: str
    path: str
    literal: str
    rank: int


def host_path_rule(verdict: str, host: str, path: str) -> Rule:
    """A rule for host and its subdomains where the path starts with path; longer rules outrank shorter ones."""
    whole = re.sub(f"{_TOKEN}$", "", path.lower())  # a url may go on with the last token
    return Rule(host + path, verdict, rf"(?s)^(?:.*\.)?{re.escape(host)}\z", f"^{re.escape(path)}", f"{host} {whole}", HOST_RULES + len(host + path))


def pattern_rule(name: str, verdict: str, literal: str, host: str = "", path: str = "") -> Rule:
    """A general rule below every host rule; its name isn't reported."""
    return Rule(name, verdict, host, path, literal, len(host + path))


#: General rules of the method, for urls that no host rule decides.
GENERAL = [
    pattern_rule("ads", "block", "ads", path=r"(?i)(?:^|/)ads/"),
    pattern_rule("banner", "block", "banner", path=r"(?i)(?:^|/)banner[/.-]"),
    pattern_rule("casino", "block", "casino", host=r"(?:^|[.-])casino(?:[.-]|\z)"),
    pattern_rule("login", "block", "login", path=r"(?i)/login(?:\.[a-z]+)?/?\z"),
    pattern_rule("cart", "block", "cart", path=r"(?i)/cart/?\z"),
]


def rule_index(rules: list[Rule]) -> dict[str, list[Rule]]:
    """Rules by the token of their literal that fewest rules have (of those, the longest)."""
    held = {r: sorted(set(re.findall(_TOKEN, r.literal))) for r in rules}
    if any(not t for t in held.values()):
        raise ValueError("a rule needs a literal token")
    seen = Counter(t for ts in held.values() for t in ts)
    out: dict[str, list[Rule]] = {}
    for r, ts in held.items():
        out.setdefault(min(ts, key=lambda t: (seen[t], -len(t), t)), []).append(r)
    return out


def url_host(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; empty without ://."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://([^/?#]*)", 1), F.lit("")), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """From the host's end up to ?, # or the end; empty without ://."""
    return F.coalesce(F.regexp_extract(url, r"^(?s:.*?)://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: list[Rule], default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """For each row: page_id, host, path, rule (of host rules, else null), verdict, n_candidates.

    The tokens of host and path (runs of a-z and 0-9, lower-cased) look up candidate rules; only those
    run their regular expression, and the highest rank of the matches decides (equal ranks: the greater
    name); default if none matches. Null urls and urls without :// have empty host and path. A rule's
    literal must stand in every match as whole tokens. Rows with equal urls or ids are judged alike.
    """
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; the literal index takes {MAX_RULES}")
    index = rule_index(rules)
    base = pages.select(F.col(id_col).alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    as_struct = lambda r: F.struct(F.lit(r.rank).alias("rank"), F.lit(r.name).alias("name"), F.lit(r.verdict).alias("verdict"), F.lit(r.host).alias("host"), F.lit(r.path).alias("path"))
    empty = F.expr("cast(array() as array<struct<rank:int,name:string,verdict:string,host:string,path:string>>)")
    known = F.create_map(*[x for t, rs in sorted(index.items()) for x in (F.lit(t), F.array(*[as_struct(r) for r in rs]))]) if index else None
    line = F.translate(F.concat_ws(" ", "host", "path"), _UPPER, _LOWER)
    if known is None:
        candidates = empty
    else:
        tokens = F.array_distinct(F.regexp_extract_all(line, F.lit(f"({_TOKEN})")))
        candidates = F.flatten(F.transform(tokens, lambda t: F.coalesce(F.try_element_at(known, t), empty)))
    found = base.withColumn("_candidates", candidates)
    # the order of a candidate's fields is that of rank, then of name
    hit = found.withColumn("_hit", F.expr("array_max(filter(_candidates, c -> host rlike c.host and path rlike c.path))"))
    return hit.select(
        "page_id", "host", "path",
        F.when(F.col("_hit.rank") >= HOST_RULES, F.col("_hit.name")).alias("rule"),
        F.coalesce(F.col("_hit.verdict"), F.lit(default)).alias("verdict"),
        F.size("_candidates").alias("n_candidates"),
    )
