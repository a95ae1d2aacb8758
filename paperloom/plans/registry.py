"""Registration of queries, and the roles that the tables play in them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with DuckDB SQL for the same result."""

    def add(fn: Query) -> Query:
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLES[name or fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Roles.  Each has a DataFrame form and a SQL form; the latter are CTEs of the oracles.


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as papers: the first line's beginning is the title, the text the abstract."""
    day = F.date_add(F.lit("2022-01-01").cast("date"), (F.col("doc_id") % 1400).cast("int")).cast("string")
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").cast("string").alias("paper_id"),
        F.substring(F.split("text", "\n")[0], 1, 60).alias("title"),
        F.col("text").alias("abstract"),
        F.array("source", "lang").alias("authors"),
        F.when(F.col("doc_id") % 10 == 0, "Unknown").otherwise(day).alias("published_date"),
        F.array("lang").alias("categories"),
        F.concat(F.lit("https://example.org/abs/"), F.col("doc_id").cast("string")).alias("abs_url"),
    )


PAPERS = """papers AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, left(string_split(text, chr(10))[1], 60) AS title, text AS abstract, [source, lang] AS authors,
    CASE WHEN doc_id % 10 = 0 THEN 'Unknown' ELSE CAST(CAST(DATE '2022-01-01' + CAST(doc_id % 1400 AS INTEGER) AS DATE) AS VARCHAR) END AS published_date,
    [lang] AS categories, 'https://example.org/abs/' || doc_id AS abs_url FROM documents
)"""


def passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as the passages of one paper per source."""
    return table(spark, sf_dir, "documents").select(F.col("source").alias("paper_id"), F.col("doc_id").alias("chunk_id"), "text")


PASSAGES = "passages AS (SELECT source AS paper_id, doc_id AS chunk_id, text FROM documents)"


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark items as questions, dealt over the sources."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("question_id"), F.concat(F.lit("src"), (F.col("item_id") % 20).cast("string")).alias("paper_id"), F.col("text").alias("question"))


QUESTIONS = "questions AS (SELECT item_id AS question_id, 'src' || (item_id % 20) AS paper_id, text AS question FROM benchmark)"
