"""The registered queries of this subpackage: each applies its operator to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import langid, topk, url_filter
from paperloom.llm.jaccard import jaccard_components
from paperloom.llm.licenses import license_scan
from paperloom.llm.mixing import mix
from paperloom.llm.packing import pack_documents
from paperloom.llm.pii import personal_data
from paperloom.llm.quality import quality_rules
from paperloom.llm.tokens import section_tokens, token_counts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _table(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = langid.fit(documents, ~held_out & F.col("doc_id").isNotNull())
    return langid.identify(documents, model, ["doc_id", held_out.alias("held_out")])


def op2_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5).withColumnRenamed("id", "vec_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(_table(spark, sf_dir, "documents"), ["doc_id"])


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan(_table(spark, sf_dir, "documents"), ["doc_id"])


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"), url_filter.production_rules(spark), ["page_id"])


def op6_bestfit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(token_counts(_table(spark, sf_dir, "documents"), ["doc_id"]), ["doc_id"], "n_tokens")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return section_tokens(_table(spark, sf_dir, "documents"), ["doc_id"])


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(_table(spark, sf_dir, "documents"), ["doc_id"])


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_table(spark, sf_dir, "documents"), ["doc_id"])


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_table(spark, sf_dir, "documents"), ["doc_id"])


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_exact_topk": op2_exact_topk,
        "op3_quality_rules": op3_quality_rules,
        "op4_license_scans": op4_license_scans,
        "op5_url_filters": op5_url_filters,
        "op6_bestfit_packing": op6_bestfit_packing,
        "op7_token_counts": op7_token_counts,
        "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
        "op9_personal_data": op9_personal_data,
        "op10_source_mixing": op10_source_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_exact_topk": topk.ORACLE_SQL,
        "op5_url_filters": url_filter.ORACLE_SQL,
    }
