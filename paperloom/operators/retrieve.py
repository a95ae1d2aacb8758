"""Retrieval: lexical and dense scores, relevance gates, rank fusion, reranking, top k.

Questions are ``(question_id, paper_id, question)``; a question is asked of one
paper, so every join is on paper_id.  Ties go to the earlier passage of the paper: the
metadata passage, then by the numbers in the ids (s2_c1 before s10_c1).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paperloom.config import Settings
from paperloom.functions.scores import dot, unit
from paperloom.functions.text import tokens
from paperloom.operators.index import Index

ASKED = ["question_id", "paper_id"]
#: Scores are compared at this precision, so that the order of sums decides no tie.
DIGITS = 9


def passage_order(rows: DataFrame) -> list[Column]:
    """Sorts passages as they stand in their paper; ids that are numbers, by number."""
    if not isinstance(rows.schema["chunk_id"].dataType, T.StringType):
        return [F.col("chunk_id")]
    numbers = F.transform(F.regexp_extract_all("chunk_id", F.lit("-?[0-9]{1,18}"), F.lit(0)), lambda x: x.cast("long"))
    return [numbers, F.col("chunk_id")]


def query_vectors(questions: DataFrame, index: Index) -> DataFrame:
    """question_id, paper_id, term and weight of the terms that the paper knows; unit length."""
    asked = questions.select(*ASKED, F.explode(tokens(F.col("question"))).alias("term")).groupBy(*ASKED, "term").agg(F.count("*").alias("tf"))
    raw = asked.join(index.terms.select("paper_id", "term", "idf"), ["paper_id", "term"]).withColumn("raw", (F.log("tf") + 1) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(*ASKED)))  # a question's own terms only
    return raw.select(*ASKED, "term", (F.col("raw") / norm).alias("weight"))


def lexical_scores(questions: DataFrame, index: Index) -> DataFrame:
    """question_id, paper_id, chunk_id and cosine of the passages that share a term with the question."""
    asked = query_vectors(questions, index).withColumnRenamed("weight", "asked")
    both = index.postings.join(asked, ["paper_id", "term"])
    products = both.groupBy(*ASKED, "chunk_id").agg(F.sum(F.col("raw") * F.col("asked")).alias("product"))
    return products.join(index.norms, ["paper_id", "chunk_id"]).select(*ASKED, "chunk_id", F.round(F.col("product") / F.col("norm"), DIGITS).alias("lexical"))


def best(scores: DataFrame, score: str, k: int) -> DataFrame:
    """The k best rows of each question, with their rank from 1."""
    order = Window.partitionBy(*ASKED).orderBy(F.desc(score), *passage_order(scores))
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def lexical_search(questions: DataFrame, index: Index, settings: Settings = Settings()) -> DataFrame:
    """The top passages by cosine that reach the threshold."""
    scored = lexical_scores(questions, index)
    return best(scored, "lexical", settings.top_k).where(F.col("lexical") >= settings.lexical_threshold).select(*ASKED, "chunk_id", "rank", F.col("lexical").alias("score"))


def dense_scores(questions: DataFrame, vectors: DataFrame) -> DataFrame:
    """Cosine of each question's vector (``vector``) with every passage vector of its paper."""
    asked = questions.select(*ASKED, unit(F.col("vector")).alias("__q"))
    known = vectors.select("paper_id", "chunk_id", unit(F.col("vector")).alias("__v"))
    return known.join(asked, "paper_id").select(*ASKED, "chunk_id", F.round(dot(F.col("__q"), F.col("__v")), DIGITS).alias("dense"))


def needs_embedding(chunks: DataFrame) -> DataFrame:
    """Papers whose stored vectors (``vector``, nullable) can't be reused: some missing, or of several lengths."""
    sizes = F.countDistinct(F.size("vector"))
    missing = F.count_if(F.col("vector").isNull())
    return chunks.groupBy("paper_id").agg(missing.alias("missing"), sizes.alias("dimensions")).withColumn("reuse", (F.col("missing") == 0) & (F.col("dimensions") == 1))


def both_scores(questions: DataFrame, index: Index, vectors: DataFrame) -> DataFrame:
    """dense and lexical scores of every passage of each question's paper; 0 where no term is shared."""
    return dense_scores(questions, vectors).join(lexical_scores(questions, index), [*ASKED, "chunk_id"], "left").withColumn("lexical", F.coalesce("lexical", F.lit(0.0)))


def gate(scores: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """question_id, paper_id, the best scores over all passages, and whether the question passes."""
    top = scores.groupBy(*ASKED).agg(F.max("dense").alias("max_dense"), F.max("lexical").alias("max_lexical"))
    refused = (F.col("max_dense") < settings.dense_threshold) & (F.col("max_lexical") < settings.lexical_threshold)
    return top.withColumn("passed", ~refused)


def fuse(scores: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Adds ``fused``, the sum over signals of 1 / (k + rank), ranks from 0 over all passages."""
    def place(signal: str) -> Column:
        return F.row_number().over(Window.partitionBy(*ASKED).orderBy(F.desc(signal), *passage_order(scores))) - 1

    ranked = scores.withColumns({"dense_rank": place("dense"), "lexical_rank": place("lexical")})
    return ranked.withColumn("fused", F.round(1.0 / (settings.rrf_k + F.col("dense_rank")) + 1.0 / (settings.rrf_k + F.col("lexical_rank")), 12))


def pool(scores: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The best passages of each question that passes the gate, by fused score."""
    passed = gate(scores, settings).where("passed").select(*ASKED)
    order = Window.partitionBy(*ASKED).orderBy(F.desc("fused"), *passage_order(scores))
    return fuse(scores.join(passed, ASKED, "left_semi"), settings).withColumn("place", F.row_number().over(order)).where(F.col("place") <= settings.rerank_pool)


def hybrid_search(questions: DataFrame, index: Index, vectors: DataFrame, settings: Settings = Settings(), rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The top passages of the fused pool; ``rerank`` may add a column ``rescored`` that decides the order.

    The score that is reported is the dense cosine.
    """
    found = pool(both_scores(questions, index, vectors), settings)
    key = F.desc("rescored") if rerank else F.col("place")
    found = rerank(found) if rerank else found
    order = Window.partitionBy(*ASKED).orderBy(key, "place")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= settings.top_k).select(*ASKED, "chunk_id", "rank", F.col("dense").alias("score"))


def overlap_rerank(questions: DataFrame, chunks: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A reranker that needs no model: the share of a question's terms that the passage holds."""

    def rerank(found: DataFrame) -> DataFrame:
        asked = questions.select(*ASKED, F.array_distinct(tokens(F.col("question"))).alias("__asked"))
        texts = chunks.select("paper_id", "chunk_id", F.array_distinct(tokens(F.col("text"))).alias("__held"))
        # texts meet the pool only, not all passages
        both = found.join(asked, ASKED).join(texts, ["paper_id", "chunk_id"])
        share = F.size(F.array_intersect("__asked", "__held")) / F.greatest(F.size("__asked"), F.lit(1))
        return both.withColumn("rescored", F.round(share, DIGITS)).drop("__asked", "__held")

    return rerank
