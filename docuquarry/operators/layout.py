"""Geometry, tables, reading order and references of documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed pattern of a reference to a numbered part, and its number.
REFERENCE = r"(?i)\b(?:section|clause|article|paragraph|schedule|exhibit|annex|appendix|attachment)s?\s+(\d+(?:\.\d+)*(?:\([a-z0-9]+\))?|[A-Z](?:\.\d+)*|[IVXLC]+)\b"


def merged_boxes(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, width, height): the rectangle around all boxes (x, y, width, height) of each key; with a page among the keys, one a page."""
    right, bottom = F.max(F.col("x") + F.col("width")), F.max(F.col("y") + F.col("height"))
    return boxes.groupBy(*keys).agg(F.min("x").alias("x"), F.min("y").alias("y"), (right - F.min("x")).alias("width"), (bottom - F.min("y")).alias("height"))


def polygon_union(polygons: DataFrame, keys: list[str], polygon: str = "polygon") -> DataFrame:
    """(keys, polygon): the eight corners, clockwise from the top left, of the rectangle around polygons of x, y pairs; empty ones don't count."""
    xs, ys = F.filter(F.col(polygon), lambda _, i: i % 2 == 0), F.filter(F.col(polygon), lambda _, i: i % 2 == 1)
    ends = polygons.where(F.size(polygon) > 0).groupBy(*keys).agg(F.min(F.array_min(xs)).alias("l"), F.max(F.array_max(xs)).alias("r"), F.min(F.array_min(ys)).alias("t"), F.max(F.array_max(ys)).alias("b"))
    return ends.select(*keys, F.array("l", "t", "r", "t", "r", "b", "l", "b").alias("polygon"))


def tables_as_markdown(cells: DataFrame, table: str) -> DataFrame:
    """(table, markdown) of cells (table, row, col, text): pipe rows, a rule under the first, gaps empty, pipes escaped."""
    said = F.trim(F.replace(F.coalesce("text", F.lit("")), F.lit("|"), F.lit("\\|")))
    width = F.max(F.col("col")).over(Window.partitionBy(table))
    rows = cells.withColumn("_w", width).withColumn("_t", said).groupBy(table, "row").agg(F.max("_w").alias("_w"), F.map_from_entries(F.collect_set(F.struct("col", "_t"))).alias("_m"))
    values = F.transform(F.sequence(F.lit(0), F.col("_w")), lambda c: F.coalesce(F.try_element_at("_m", c.cast("int")), F.lit("")))
    line = F.concat(F.lit("| "), F.array_join(values, " | "), F.lit(" |"))
    rule = F.concat(F.lit("|"), F.repeat(F.lit(" --- |"), F.col("_w") + 1))
    first = F.row_number().over(Window.partitionBy(table).orderBy("row")) == 1
    lines = rows.select(table, "row", F.when(first, F.concat(line, F.lit("\n"), rule)).otherwise(line).alias("_l"))
    return lines.groupBy(table).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "_l"))), lambda x: x["_l"]), "\n").alias("markdown"))


def reading_order(elements: DataFrame, doc: str) -> DataFrame:
    """elements (page, y, x, parser_order, element_id) with index: their 0-based place in the document from top to bottom."""
    w = Window.partitionBy(doc).orderBy(F.asc_nulls_last("page"), F.asc_nulls_last("y"), F.asc_nulls_last("x"), "parser_order", "element_id")
    return elements.withColumn("index", F.row_number().over(w) - 1)


def first_of_page(ordered: DataFrame, doc: str) -> DataFrame:
    """(doc, page, first_index) of elements in reading order."""
    return ordered.groupBy(doc, "page").agg(F.min("index").alias("first_index"))


def page_windows(pages: DataFrame, doc: str, size: int, overlap: int = 0) -> DataFrame:
    """(doc, window, page) of pages (doc, page): windows of size pages that share overlap of them, up to the first that reaches the end."""
    size, step = max(1, size), max(1, max(1, size) - max(0, overlap))
    w = Window.partitionBy(doc)
    rows = pages.withColumn("_i", F.row_number().over(w.orderBy("page")) - 1).withColumn("_n", F.count("*").over(w))
    last = F.greatest(F.lit(0), F.ceil((F.col("_n") - size) / F.lit(step)))
    low = F.greatest(F.lit(0), F.floor((F.col("_i") - size) / F.lit(step)) + 1)
    high = F.least(F.floor(F.col("_i") / F.lit(step)), last)
    return rows.where(low <= high).select(doc, F.explode(F.sequence(low, high)).alias("window"), "page")


def references(paragraphs: DataFrame, sections: DataFrame, doc: str) -> DataFrame:
    """(doc, para, number, section_id): each part that a paragraph (para, text) names, once, with the section (number, section_id) of that number, if there is one."""
    named = paragraphs.select(doc, "para", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit(REFERENCE), F.lit(1)))).alias("number"))
    held = sections.where("number IS NOT NULL").groupBy(doc, "number").agg(F.max("section_id").alias("section_id"))
    return named.join(held, [doc, "number"], "left").select(doc, "para", "number", "section_id")


def document_statistics(paragraphs: DataFrame, doc: str, sparse_words: int = 20) -> DataFrame:
    """(doc, paragraphs, words, characters, coordinate_coverage, is_sparse) of paragraphs (text, polygon); coverage to four places, 1 without paragraphs that have text."""
    words = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"\s+"), lambda x: x != ""))
    rows = paragraphs.groupBy(doc).agg(F.count("*").alias("paragraphs"), F.sum(words).alias("words"), F.sum(F.length(F.coalesce("text", F.lit("")))).alias("characters"), F.count_if(F.size("polygon") > 0).alias("_c"))
    return rows.withColumn("coordinate_coverage", F.round(F.col("_c") / F.greatest("paragraphs", F.lit(1)), 4)).withColumn("is_sparse", F.col("words") < sparse_words).drop("_c")


def attribute_lines(attributes: Column, most: int = 32_000) -> Column:
    """key: value lines of a map of JSON text: null as not specified, booleans as yes and no, lists joined, an empty one as none."""
    listed = lambda v: F.array_join(F.from_json(v, "array<string>"), ", ")
    shown = lambda v: F.when(v.isNull(), "not specified").when(v == "true", "yes").when(v == "false", "no").when(v == "[]", "none").when(v.startswith("["), listed(v)).otherwise(v)
    entries = F.map_entries(attributes)
    return F.coalesce(F.substring(F.array_join(F.transform(entries, lambda e: F.concat(F.replace(e["key"], F.lit("_"), F.lit(" ")), F.lit(": "), shown(e["value"]))), "\n"), 1, most), F.lit(""))
