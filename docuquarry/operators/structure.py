"""Document structure: section hierarchy, continuations over page breaks, owning sections, chunks, extents.

A document's sections and paragraphs are bounded lists, so folds that need their order run one document
a group; everything that a window can say stays in built-in expressions.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docuquarry.functions.text import clause_heading
from docuquarry.operators.folds import fold
from docuquarry.operators.layout import REFERENCE

#: A section's whole number, a full stop behind it apart.
_NUMBER = re.compile(r"^(\d+(?:\.\d+)*)\.?$")


def _outline(rows: list[tuple]) -> list[tuple]:
    """Parents and levels of one document's sections in their order."""
    ids = [r[1] for r in rows]
    known = set(ids)
    numbers = [m.group(1) if (m := _NUMBER.match((r[3] or "").strip())) else None for r in rows]
    holder = {n: i for n, i in zip(numbers, ids, strict=True) if n}
    parents: list[str | None] = []
    levels: list[int] = []
    for (_, me, _, _, parent, level), number in zip(rows, numbers, strict=True):
        if number:
            head = number.rpartition(".")[0]
            level = number.count(".") + 1
            above = holder.get(head)
            parent = None if not head else above if above and above != me else parent
        if parent not in known:
            parent = None
        if parent is None and (level or 1) > 1:
            parent = next((ids[i] for i in range(len(levels) - 1, -1, -1) if levels[i] < level), None)
        parents.append(None if parent == me else parent)
        levels.append(level or 1)
    up = dict(zip(ids, parents, strict=True))

    def loops(start: str) -> bool:
        seen, at = {start}, up[start]
        while at is not None and at not in seen:
            seen.add(at)
            at = up.get(at)
        return at is not None

    return [(*r[:4], None if loops(r[1]) else p, n) for r, p, n in zip(rows, parents, levels, strict=True)]


def repair_sections(sections: DataFrame) -> DataFrame:
    """Rows (doc_id, section_id, ord, number, parent_id, level) with a sound hierarchy.

    A number such as 11.2 (and nothing else) sets the level by its depth and the parent by its prefix; a
    number of one part has no parent. Parents that don't exist, that are the section itself or that lie on or lead into a
    cycle are cleared; a deeper section without a parent takes the nearest shallower one before it.
    """
    cols = sections.select("doc_id", F.col("section_id").cast("string"), F.col("ord").cast("long"), F.col("number").cast("string"), F.col("parent_id").cast("string"), F.col("level").cast("int"))
    return fold(cols, ["ord", "section_id"], _outline, f"doc_id {dict(cols.dtypes)['doc_id']}, section_id string, ord long, number string, parent_id string, level int")


#: Fixed values of a continuation: the end of a sentence, abbreviations that end none, how what runs on begins, and a numbered clause.
SENTENCE_END = re.compile(r"[.!?:;]['\")\]]?\s*$")
ABBREVIATIONS = ("inc.", "ltd.", "llc.", "co.", "corp.", "no.", "nos.", "art.", "sec.", "cf.", "e.g.", "i.e.", "etc.", "vs.", "v.")
RUNS_ON = re.compile(r"^(?:[a-z]|and\b|or\b|but\b|nor\b|that\b|which\b|to\b|of\b|in\b|for\b|with\b|shall\b)")
NUMBERED = re.compile(r"^\d+(\.\d+)*\.?\s+[A-Z]")
NAMED_PART = re.compile(REFERENCE)


def _runs_on(body: str, more: str) -> bool:
    """Whether a fragment reads on behind a text: that one is open, and this one begins neither a sentence nor a clause of its own."""
    closed = SENTENCE_END.search(body) and not body.lower().endswith(ABBREVIATIONS)
    return bool(body and more and not closed and RUNS_ON.match(more) and not NAMED_PART.match(more) and not NUMBERED.match(more))


def _joined(paragraphs: list[tuple]) -> list[list]:
    rows: list[list] = []
    pieces: list[list[str]] = []
    for doc, page, pos, text, section in paragraphs:
        text, section = text or "", section or None
        if rows:
            last, body = rows[-1], pieces[-1][-1].rstrip()
            apart = bool(last[4] and section and last[4] != section)
            if page == last[1] + 1 and not apart and _runs_on(body, text.strip()):
                pieces[-1][-1] = body
                pieces[-1].append(text.lstrip())
                last[5] += 1
                continue
        rows.append([doc, page, pos, text, section, 1])
        pieces.append([text])
    for row, parts in zip(rows, pieces, strict=True):
        row[3] = " ".join(parts)
    return rows


def merge_continuations(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, page, pos, text, section_id) split over a page break, joined, with their number of fragments.

    A paragraph joins the one before it if it lies on the page after that one's first page, the text
    before it doesn't end a sentence (an abbreviation ends none), it starts like a continuation and not
    with a reference or a numbered clause, and no two sections are named.
    """
    cols = paragraphs.select(F.col("doc_id").cast("long"), F.col("page").cast("long"), F.col("pos").cast("long"), F.col("text").cast("string"), F.col("section_id").cast("string"))
    return fold(cols, ["page", "pos"], _joined, "doc_id long, page long, pos long, text string, section_id string, fragments int")


def assign_sections(paragraphs: DataFrame, sections: DataFrame) -> DataFrame:
    """Paragraphs (doc_id, page, pos, section_id) with an owner: their own, else the last section to start at or before their page.

    An as-of match: both tables meet in one window a document, not in a range join.
    """
    starts = sections.select("doc_id", F.col("start_page").alias("page"), F.lit(0).alias("_kind"), F.col("ord").cast("long").alias("_o"), F.col("section_id").alias("_s"))
    rows = paragraphs.withColumn("_kind", F.lit(1)).withColumn("_o", F.col("pos").cast("long"))
    w = Window.partitionBy("doc_id").orderBy("page", "_kind", "_o").rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(starts, allowMissingColumns=True).withColumn("_owner", F.last("_s", ignorenulls=True).over(w))
    return both.where("_kind = 1").withColumn("section_id", F.coalesce("section_id", "_owner")).select(paragraphs.columns)


def extents(paragraphs: DataFrame, is_heading: Column, is_boundary: Column) -> DataFrame:
    """Paragraphs (doc_id, pos) from each heading up to the next boundary, with heading_pos; what follows a boundary that is no heading belongs to none."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    edge = is_heading | is_boundary
    last = F.last(F.when(edge, F.struct(F.col("pos").alias("at"), is_heading.alias("head"))), ignorenulls=True).over(w)
    return paragraphs.withColumn("_e", last).where("_e.head").withColumn("heading_pos", F.col("_e.at")).drop("_e")


def first_headings(paragraphs: DataFrame, names: DataFrame) -> DataFrame:
    """(doc_id, clause, pos): the first heading of a document whose folded text is a clause's name or synonym, of names (clause, name); leading numbers don't count."""
    fold = lambda c: clause_heading(F.col(c))
    wanted = names.select("clause", fold("name").alias("_f")).where("_f <> ''").distinct()
    return paragraphs.withColumn("_f", fold("text")).join(wanted, "_f").groupBy("doc_id", "clause").agg(F.min("pos").alias("pos"))


def _packed(limit: int):
    def run(paragraphs: list[tuple]) -> list[list]:
        out: list[list] = []
        for doc, section, pos, cost in paragraphs:
            last = out[-1] if out else None
            if last and last[1] == section and (not last[5] or last[5] + cost <= limit):
                last[3], last[4], last[5] = pos, last[4] + 1, last[5] + cost
            else:
                out.append([doc, section, pos, pos, 1, 0 if pos == section else cost])
        return out

    return run


def section_chunks(paragraphs: DataFrame, is_heading: Column, limit: int = 700) -> DataFrame:
    """(doc_id, heading_pos, first_pos, last_pos, paragraphs, tokens): sections of paragraphs (doc_id, pos, tokens) cut between paragraphs at the limit.

    A section runs from its heading to the next; what comes before the first one has heading_pos -1. Each
    chunk repeats its section's heading, whose tokens don't count. A paragraph over the limit is a chunk.
    """
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    opened = paragraphs.withColumn("heading_pos", F.coalesce(F.last(F.when(is_heading, F.col("pos")), ignorenulls=True).over(w), F.lit(-1)))
    cols = opened.select(*[F.col(c).cast("long") for c in ("doc_id", "heading_pos", "pos", "tokens")])
    return fold(cols, ["pos"], _packed(limit), "doc_id long, heading_pos long, first_pos long, last_pos long, paragraphs long, tokens long")


#: Fixed value: the most paragraphs that a clause cut off by its window gets beyond it.
REPAIR = 12


def repair_boundary(kept: DataFrame, paragraphs: DataFrame, is_boundary: Column) -> DataFrame:
    """(doc_id, clause, pos) that clauses gain whose last paragraph is the last of their window.

    kept (doc_id, clause, pos, window_end) are a clause's paragraphs and the last pos of its window; paragraphs
    (doc_id, pos, page) are the document's. It goes on to the next boundary, by REPAIR paragraphs at most and up to
    the page behind the last one. Pages don't fall along pos.
    """
    cut = kept.groupBy("doc_id", "clause").agg(F.max("pos").alias("_last"), F.max_by("window_end", "pos").alias("_end")).where("_last = _end")
    order = Window.partitionBy("doc_id").orderBy("pos")
    placed = paragraphs.withColumns({"_n": F.row_number().over(order), "_edges": F.sum(F.when(is_boundary, 1).otherwise(0)).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    placed = placed.select("doc_id", "pos", "page", "_n", "_edges")
    ends = cut.join(placed.withColumnsRenamed({"pos": "_last", "page": "_page", "_edges": "_before"}), ["doc_id", "_last"])
    ahead = ends.withColumn("_n", F.explode(F.sequence(F.col("_n") + 1, F.col("_n") + REPAIR)))
    return ahead.join(placed, ["doc_id", "_n"]).where("_edges = _before AND page <= _page + 1").select("doc_id", "clause", "pos")
