"""Finding a document's clauses: headings first, then windows of pages in waves until nothing is pending.

All documents advance together. A wave reads a snapshot of what is pending when it begins and only windows
of documents with something pending, so the frontier shrinks; it ends as soon as it is empty.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docuquarry.operators.steps import settled
from docuquarry.plans.extraction import LEAST_CHARS, WAVE


@dataclass(frozen=True)
class Detection:
    """claims: (doc, clause, source, page, window); missing: (doc, clause) found nowhere; read and unread: (doc, page); skipped: (doc, window) with too little text."""

    claims: DataFrame
    missing: DataFrame
    read: DataFrame
    unread: DataFrame
    skipped: DataFrame
    waves: int

    def broken(self) -> DataFrame:
        """Documents (doc) that miss a clause though pages of theirs were never read: none, or detection is wrong."""
        return self.missing.select("doc").distinct().join(self.unread, "doc", "left_semi")


def page_windows(pages: DataFrame, size: int, overlap: int) -> DataFrame:
    """(doc, window, page, text): the windows of size pages that advance by size less overlap, to the one that holds the last page; pages (doc, page, text) count from 1."""
    step = max(1, size - min(overlap, size - 1))
    last = pages.groupBy("doc").agg(F.max("page").alias("_last"))
    # window w begins behind page w * step; the last one is the first that reaches the end
    most = F.greatest(F.lit(0), F.ceil((F.col("_last") - size) / step))
    first = F.greatest(F.lit(0), F.ceil((F.col("page") - size) / step))
    held = pages.join(last, "doc").withColumn("window", F.explode(F.sequence(first.cast("long"), F.least(F.floor((F.col("page") - 1) / step), most).cast("long"))))
    return held.select("doc", "window", "page", "text")


def heading_claims(headings: DataFrame, wanted: DataFrame, key: Callable[[Column], Column]) -> DataFrame:
    """(doc, clause, page) of headings (doc, page, heading) whose key is that of a wanted clause's name, the first page of each."""
    named = wanted.select("doc", "clause", key(F.col("clause")).alias("_k")).where("_k <> ''")
    return headings.select("doc", "page", key(F.col("heading")).alias("_k")).join(named, ["doc", "_k"]).groupBy("doc", "clause").agg(F.min("page").alias("page"))


def detect(pages: DataFrame, headings: DataFrame, wanted: DataFrame, search: Callable[[DataFrame], DataFrame], key: Callable[[Column], Column], size: int = 5, overlap: int = 1, wave: int = WAVE, early_stop: bool = True, least_chars: int = LEAST_CHARS) -> Detection:
    """Detection of wanted clauses (doc, clause) in pages (doc, page, text).

    search takes windows (doc, window, page, text, pending), pending an array of the clauses that the
    document lacked when the wave began, and returns answers (doc, window, page, clause); answers for other
    clauses don't count, and of several the first window and page does. Without early_stop every window is
    searched. Windows of fewer than least_chars characters are skipped, but count as read.
    """
    wanted = settled(wanted.select("doc", "clause").distinct())
    fields = ["doc", "clause", "source", "page", "window"]
    step = max(1, size - min(overlap, size - 1))
    parts = [settled(heading_claims(headings, wanted, key).withColumn("source", F.lit("heading")).withColumn("window", F.lit(None).cast("long")).select(fields))]
    # windows are numbered without texts; a wave reads those of its own pages alone
    numbers = pages.select("doc", "page", F.length(F.coalesce("text", F.lit(""))).alias("text"))
    windows = page_windows(numbers, size, overlap)
    sizes = settled(windows.groupBy("doc", "window").agg(F.sum("text").alias("_chars")).withColumn("_wave", F.floor(F.col("window") / wave)))
    pending, seen, number = settled(wanted.join(parts[0], ["doc", "clause"], "left_anti")), [], 0
    last = sizes.agg(F.max("_wave")).first()[0]
    while last is not None and number <= last and not (early_stop and pending.isEmpty()):
        snapshot = pending.groupBy("doc").agg(F.sort_array(F.collect_list("clause")).alias("pending"))
        if not early_stop:
            snapshot = wanted.select("doc").distinct().join(snapshot, "doc", "left").withColumn("pending", F.coalesce("pending", F.array().cast("array<string>")))
        reached = settled(sizes.where(F.col("_wave") == number).join(snapshot, "doc"))
        open_now = reached.where(F.col("_chars") >= least_chars).select("doc", "window", "pending")
        opening = open_now.withColumn("page", F.explode(F.sequence(F.col("window") * step + 1, F.col("window") * step + size)))
        first, behind = number * wave * step + 1, (number * wave + wave - 1) * step + size
        frontier = pages.where(F.col("page").between(first, behind)).join(opening, ["doc", "page"]).select("doc", "window", "page", "text", "pending")
        found = search(frontier).join(pending, ["doc", "clause"], "left_semi").groupBy("doc", "clause").agg(F.min(F.struct("window", "page")).alias("_f"))
        parts.append(settled(found.select("doc", "clause", F.lit("window").alias("source"), F.col("_f.page").alias("page"), F.col("_f.window").alias("window"))))
        pending = settled(pending.join(parts[-1], ["doc", "clause"], "left_anti"))
        seen.append(reached.select("doc", "window"))
        number += 1
    claims = reduce(DataFrame.unionByName, parts)
    # headings are looked at on every page, but a page is read only inside a window
    opened = windows.join(reduce(DataFrame.unionByName, seen), ["doc", "window"], "left_semi").select("doc", "page").distinct() if seen else windows.select("doc", "page").limit(0)
    unread = pages.select("doc", "page").distinct().join(opened, ["doc", "page"], "left_anti").join(wanted.select("doc").distinct(), "doc", "left_semi")
    return Detection(claims, pending, opened, unread, sizes.where(F.col("_chars") < least_chars).select("doc", "window"), number)
