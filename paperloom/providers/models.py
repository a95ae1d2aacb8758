"""Models inside Spark plans: Arrow functions that build their client once per task."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.providers.base import Embedder, LanguageModel, Reranker


def generate(make: Callable[[], LanguageModel], prompt: Column, system_prompt: str | None = None, json_mode: bool = False) -> Column:
    """A struct of text and error; one of them is null.  Filter rows before, as every row is a call."""

    @F.pandas_udf("text string, error string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = make()
        for prompts in batches:
            rows: list[tuple[str | None, str | None]] = []
            for p in prompts:
                try:
                    rows.append((model.generate(p, system_prompt, json_mode), None))
                except Exception as e:  # one failed call must not lose the others
                    rows.append((None, (str(e).splitlines() or [type(e).__name__])[0]))
            yield pd.DataFrame(rows, columns=["text", "error"])

    return run.asNondeterministic()(prompt)  # a second call may answer otherwise, and costs again


def embed(make: Callable[[], Embedder], text: Column, query: bool = False) -> Column:
    @F.pandas_udf("array<float>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = make()
        for texts in batches:
            known = [t or "" for t in texts]
            yield pd.Series([model.embed_query(t) for t in known] if query else list(model.embed_documents(known)))

    return run(text)


def embed_missing(chunks: DataFrame, make: Callable[[], Embedder]) -> DataFrame:
    """Chunks (paper_id, chunk_id, text, vector) with vectors; a paper whose stored ones fit together keeps them."""
    from paperloom.operators.retrieve import needs_embedding

    state = needs_embedding(chunks).select("paper_id", "reuse")
    both = chunks.join(state, "paper_id")
    kept = both.where("reuse").drop("reuse")
    fresh = both.where("not reuse").drop("reuse").withColumn("vector", embed(make, F.col("text")))
    return kept.unionByName(fresh)


def rerank(make: Callable[[], Reranker], questions: DataFrame, chunks: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """A ``rerank`` argument for hybrid search that asks a model about the pool's rows only."""

    @F.pandas_udf("double")
    def score(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        model = make()
        for asked, texts in batches:
            found = pd.Series(0.0, index=texts.index)
            for question, rows in texts.groupby(asked.values):
                found[rows.index] = list(model.score(question, rows.tolist()))
            yield found

    def run(pool: DataFrame) -> DataFrame:
        both = pool.join(questions.select("question_id", "paper_id", "question"), ["question_id", "paper_id"]).join(chunks.select("paper_id", "chunk_id", "text"), ["paper_id", "chunk_id"])
        return both.withColumn("rescored", score("question", "text")).drop("question", "text")

    return run
