"""PDF files: recognising them, where to get them, and which of a cache are sound.

Decoding a PDF into layout spans is left to a decoder outside; see ``operators.layout``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MAGIC = b"%PDF-"


def is_pdf(content: Column) -> Column:
    """Error and rate-limit pages are HTML; a PDF begins with its magic."""
    return F.coalesce(F.substring(content, 1, len(MAGIC)) == F.lit(MAGIC), F.lit(False))


def cache_name(paper_id: Column) -> Column:
    return F.concat(F.replace(paper_id, F.lit("/"), F.lit("_")), F.lit(".pdf"))


def candidate_urls(papers: DataFrame) -> DataFrame:
    """paper_id, place and url of each address to try, in order."""
    base = F.concat(F.lit("https://arxiv.org/pdf/"), F.col("paper_id"))
    return papers.select("paper_id", F.posexplode(F.array(F.col("pdf_url"), base, F.concat(base, F.lit(".pdf")))).alias("place", "url"))


def read_cache(spark: SparkSession, folder: str) -> DataFrame:
    """file, length and whether it is a PDF, of every cached file."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "length", is_pdf(F.col("content")).alias("is_pdf"))


def to_download(papers: DataFrame, cache: DataFrame) -> DataFrame:
    """Papers without a sound cached file."""
    return papers.withColumn("file", cache_name(F.col("paper_id"))).join(cache.where("is_pdf").select("file"), "file", "left_anti")
