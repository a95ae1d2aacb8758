"""Questions that arrive as a stream, against a library that stands still."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from paperloom.config import Settings
from paperloom.plans.research import Library, ask
from paperloom.providers.base import LanguageModel


def answer_stream(questions: DataFrame, library: Library, path: str, checkpoint: str, settings: Settings = Settings(), make: Callable[[], LanguageModel] | None = None) -> StreamingQuery:
    """Appends the answers of each micro-batch to ``path``; a batch that is tried again replaces its own part."""

    def answer(batch: DataFrame, batch_id: int) -> None:
        ask(batch, library, settings, make).withColumn("batch", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    return questions.writeStream.foreachBatch(answer).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def question_rates(questions: DataFrame, time: str = "asked_at", window: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Questions and papers by window of time; rows later than ``late`` are dropped by the watermark."""
    return questions.withWatermark(time, late).groupBy(F.window(time, window)).agg(F.count("*").alias("questions"), F.approx_count_distinct("paper_id").alias("papers")).select("window.start", "window.end", "questions", "papers")


def number_turns(questions: DataFrame) -> DataFrame:
    """question_id, session_id and the turn of each question within its saved session, kept as state."""

    def run(key: tuple[str], batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (turn,) = state.get if state.exists else (0,)
        for batch in batches:
            ordered = batch.sort_values("question_id")
            yield pd.DataFrame({"session_id": key[0], "question_id": ordered["question_id"], "turn": range(turn + 1, turn + len(ordered) + 1)})
            turn += len(ordered)
        state.update((turn,))

    return questions.groupBy("session_id").applyInPandasWithState(run, "session_id string, question_id long, turn long", "turn long", "append", GroupStateTimeout.NoTimeout)
