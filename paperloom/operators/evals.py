"""Scoring retrieval and answers against labelled questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import contains_any, match_form

ANSWERABLE = ("lexical", "paraphrase")


def evidence_found(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """question_id of answerable questions whose evidence occurs in some passage of their paper."""
    asked = questions.where(F.col("kind").isin(*ANSWERABLE)).select("question_id", "paper_id", F.explode("evidence").alias("needle")).withColumn("needle", match_form(F.col("needle")))
    held = chunks.select("paper_id", match_form(F.col("text")).alias("hay"))
    return asked.join(held, "paper_id").where(F.contains("hay", F.col("needle"))).select("question_id").distinct()


def stale_evidence(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Answerable questions whose evidence no passage of their paper holds."""
    return questions.where(F.col("kind").isin(*ANSWERABLE)).join(evidence_found(questions, chunks), "question_id", "left_anti").select("question_id", "paper_id")


def judge(questions: DataFrame, found: DataFrame, chunks: DataFrame, answers: DataFrame | None = None) -> DataFrame:
    """A row for each question: kind, whether it was gated, a hit, and (with answers) correct or refused."""
    texts = found.select("question_id", "paper_id", "chunk_id").join(chunks.select("paper_id", "chunk_id", "text"), ["paper_id", "chunk_id"])
    hits = texts.join(questions.select("question_id", "evidence"), "question_id").groupBy("question_id").agg(F.bool_or(contains_any(F.col("text"), F.col("evidence"))).alias("hit"))
    rows = questions.join(hits, "question_id", "left").withColumn("gated", F.col("hit").isNull()).withColumn("hit", F.coalesce("hit", F.lit(False)) & F.col("kind").isin(*ANSWERABLE))
    if answers is None:
        return rows.select("question_id", "kind", "hit", "gated")
    both = rows.join(answers.select("question_id", "answer", "is_grounded"), "question_id", "left")
    grounded = F.coalesce("is_grounded", F.lit(False))
    right = F.col("kind").isin(*ANSWERABLE) & grounded & F.coalesce(contains_any(F.col("answer"), F.col("answer_any")), F.lit(False))
    return both.select("question_id", "kind", "hit", "gated", right.alias("answer_ok"), (~F.col("kind").isin(*ANSWERABLE) & ~grounded).alias("refused"))


def metrics(judged: DataFrame) -> DataFrame:
    """Counts by kind: n, hit, gated, and answer_ok and refused if judged."""
    counted = [c for c in ("hit", "gated", "answer_ok", "refused") if c in judged.columns]
    return judged.groupBy("kind").agg(F.count("*").alias("n"), *[F.count_if(F.col(c)).alias(c) for c in counted])
