"""Grounded answers: retrieve, gate, ask a model, detect refusals, cite."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.config import Settings
from paperloom.functions.text import is_refusal, refusal_reason, strip
from paperloom.operators.context import contexts
from paperloom.providers.base import LanguageModel
from paperloom.providers.models import generate

SYSTEM = (
    "Answer questions about one scientific paper from the numbered sources only, and cite the source of each statement like [Source 1]. "
    "If the sources do not hold the answer, begin with 'NOT IN PAPER:' and say in one sentence what is missing. "
    "Table rows are written as 'label | header: value'; quote a value only if its row and column are certain."
)
NO_SOURCE = "No passage of the paper is relevant to this question, so it cannot be answered from the paper."

_NO_CITATIONS = "array<struct<chunk_id:string,section:string,page:int,page_label:string,excerpt:string,relevance_score:double>>"


def prompts(questions: DataFrame, found: DataFrame, chunks: DataFrame, papers: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Questions with their context, citations and prompt; those without a retrieved passage have none."""
    asked = questions.select("question_id", "paper_id", "question").join(contexts(found, chunks, settings), ["question_id", "paper_id"], "left")
    titled = asked.join(papers.select("paper_id", "title"), "paper_id", "left")
    prompt = F.concat(F.lit("Paper: "), F.coalesce("title", F.lit("the paper")), F.lit("\n\nSources:\n"), "context", F.lit("\n\nQuestion:\n"), "question", F.lit("\n\nAnswer from the sources:"))
    return titled.withColumn("prompt", prompt)


def answers(asked: DataFrame, make: Callable[[], LanguageModel]) -> DataFrame:
    """question_id, paper_id, question, answer, is_grounded, confidence and citations of ``prompts`` rows.

    Only rows that passed the gate reach the model; a failed call is an answer that says so.
    """
    none = F.lit(None).cast(_NO_CITATIONS)
    gated = asked.where(F.col("prompt").isNull()).select("question_id", "paper_id", "question", F.lit(NO_SOURCE).alias("answer"), F.lit(False).alias("is_grounded"), F.lit(0.0).alias("confidence"), F.coalesce(none, F.array().cast(_NO_CITATIONS)).alias("citations"))
    replied = asked.where(F.col("prompt").isNotNull()).withColumn("reply", generate(make, F.col("prompt"), SYSTEM))
    text, error = F.col("reply.text"), F.col("reply.error")
    grounded = error.isNull() & ~is_refusal(text)
    answer = F.when(error.isNotNull(), F.concat(F.lit("The language model could not be reached: "), error)).otherwise(
        F.coalesce(F.concat(F.lit("These passages hold no answer: "), refusal_reason(text)), strip(text))
    )
    return gated.unionByName(
        replied.select(
            "question_id", "paper_id", "question", answer.alias("answer"), grounded.alias("is_grounded"), F.when(error.isNotNull(), 0.0).otherwise(F.round("top_score", 3)).alias("confidence"),
            F.when(grounded, F.col("citations").cast(_NO_CITATIONS)).otherwise(F.array().cast(_NO_CITATIONS)).alias("citations"),
        )
    )


def history(turns: DataFrame) -> DataFrame:
    """Question and answer pairs of saved conversations (conv_id, turn, role, text).

    A user turn is answered by the next turn if that is the assistant's; columns
    conv_id, turn, question, answer and is_refusal.  Sorting is within a
    conversation, by a join on the next turn, so a hot conversation stays spread.
    """
    asked = turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("question"))
    replied = turns.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("answer"))
    return asked.join(replied, ["conv_id", "turn"]).withColumn("is_refusal", is_refusal(F.col("answer")))
