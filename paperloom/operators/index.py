"""The inverted index of passages: postings, passage norms, and term statistics.

An index is relational: ``postings(paper_id, chunk_id, term, tf, raw)``,
``norms(paper_id, chunk_id, norm)`` and ``terms(paper_id, term, df, n_chunks, idf)``.
Every paper is a corpus of its own.  A posting's weight is raw / norm; the division is
left to the scores, which are few: postings, joined with idf by (paper_id, term), meet
a question's terms in the same partitioning, and are not shuffled again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import tokens


@dataclass(frozen=True)
class Index:
    postings: DataFrame
    norms: DataFrame
    terms: DataFrame


def term_frequencies(chunks: DataFrame, text: str = "text") -> DataFrame:
    """paper_id, chunk_id, term and its count tf; rows without an id are in no index."""
    named = chunks.where(F.col("paper_id").isNotNull() & F.col("chunk_id").isNotNull())
    return named.select("paper_id", "chunk_id", F.explode(tokens(F.col(text))).alias("term")).where(F.col("term").isNotNull()).groupBy("paper_id", "chunk_id", "term").agg(F.count("*").alias("tf"))


def term_statistics(frequencies: DataFrame, chunks: DataFrame) -> DataFrame:
    """paper_id, term, df, n_chunks and idf = ln((n + 1) / (df + 1)) + 1."""
    # counted by tf, so that both uses of the frequencies are one plan: texts are scanned and exchanged once
    df = frequencies.groupBy("paper_id", "term").agg(F.count_if(F.col("tf") > 0).alias("df"))
    n = chunks.groupBy("paper_id").agg(F.count("*").alias("n_chunks"))  # one row a paper; Spark broadcasts it if it is small
    return df.join(n, "paper_id").withColumn("idf", F.log((F.col("n_chunks") + 1) / (F.col("df") + 1)) + 1)


def build_index(chunks: DataFrame, text: str = "text") -> Index:
    """The index of ``chunks`` (paper_id, chunk_id, text)."""
    frequencies = term_frequencies(chunks, text)
    terms = term_statistics(frequencies, chunks)
    postings = frequencies.join(terms.select("paper_id", "term", "idf"), ["paper_id", "term"]).select("paper_id", "chunk_id", "term", "tf", ((F.log("tf") + 1) * F.col("idf")).alias("raw"))
    # norms by an aggregate, not a window: a hot paper's rows stay spread over tasks
    norms = postings.groupBy("paper_id", "chunk_id").agg(F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return Index(postings, norms, terms)


def weights(index: Index) -> DataFrame:
    """paper_id, chunk_id, term and its weight in a passage vector of unit length."""
    return index.postings.join(index.norms, ["paper_id", "chunk_id"]).select("paper_id", "chunk_id", "term", (F.col("raw") / F.col("norm")).alias("weight"))


def vocabulary(index: Index) -> DataFrame:
    """paper_id and the size of its vocabulary."""
    return index.terms.groupBy("paper_id").agg(F.count("*").alias("n_terms"))
