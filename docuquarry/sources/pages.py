"""Reading page JSON, splitting payloads and loading evaluation datasets and run histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PARAGRAPH = "array<struct<content:string,role:string,boundingRegions:array<struct<pageNumber:int,polygon:array<double>>>>>"
PAGES = f"pages array<struct<pageNumber:int,width:double,height:double,unit:string>>, paragraphs {PARAGRAPH}"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Paragraphs of page_<n>.json files as rows (page, para, ref, content, role, polygon).

    Pages go by number; a file without pages takes its number from its name. Blank paragraphs are
    dropped before para counts from 1 within the page; missing geometry is an empty polygon.
    """
    raw = spark.read.schema(PAGES).option("multiLine", True).json(path).withColumn("_file", F.input_file_name())
    named = F.regexp_extract("_file", r"page_(\d+)\.json$", 1)
    number = F.coalesce(F.try_element_at("pages", F.lit(1))["pageNumber"], F.when(named != "", named.cast("int")))
    return paragraphs(raw.select(number.alias("page"), "paragraphs"))


def paragraphs(pages: DataFrame) -> DataFrame:
    """Rows (page, paragraphs) to one row per paragraph that isn't blank."""
    rows = pages.select("page", F.posexplode("paragraphs").alias("_at", "p")).where(F.trim(F.coalesce("p.content", F.lit(""))) != "")
    para = F.row_number().over(Window.partitionBy("page").orderBy("_at"))
    region = F.try_element_at(F.col("p.boundingRegions"), F.lit(1))
    polygon = F.coalesce(region["polygon"], F.expr("cast(array() as array<double>)"))
    rows = rows.select("page", para.alias("para"), F.col("p.content").alias("content"), F.col("p.role").alias("role"), polygon.alias("polygon"))
    return rows.withColumn("ref", F.concat_ws(".", "page", "para"))


def split_by_page(payload: DataFrame) -> DataFrame:
    """One multi-page payload (pages, paragraphs) to a row (page, paragraphs) for each page."""
    owned = payload.select(F.explode("paragraphs").alias("p")).withColumn("page", F.try_element_at(F.col("p.boundingRegions"), F.lit(1))["pageNumber"])
    per = owned.groupBy("page").agg(F.collect_list("p").alias("paragraphs"))
    return payload.select(F.explode("pages.pageNumber").alias("page")).join(per, "page", "left")


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases from JSON lines; repeated ids and cases that expect nothing are errors."""
    cases = spark.read.json(path)
    repeated = cases.groupBy("id").count().where("count > 1").limit(5).collect()
    if repeated:
        raise ValueError(f"repeated ids: {sorted(r['id'] for r in repeated)}")
    empty = cases.where("expected IS NULL").limit(5).collect()
    if empty:
        raise ValueError(f"cases without an expectation: {sorted(r['id'] for r in empty)}")
    return cases


def read_history(spark: SparkSession, path: str, schema: str, limit: int = 30) -> DataFrame:
    """The last runs by recorded_at; files that don't parse are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).orderBy(F.desc("recorded_at")).limit(limit)


def write_golden(cases: DataFrame, path: str) -> None:
    """Evaluation cases as JSON lines that read_golden reads again; null fields are left out."""
    cases.write.mode("overwrite").json(path)
