"""From raw documents to packed training sequences, in stages written between each other.

All stages: a null in any column is a value as any other; very long texts are worked on
whole; repeated rows are rows each; columns beyond those of documents are not carried, so
clashing names do no harm; an empty table gives an empty result.  What a stage does with
null and empty texts, and with ties, stands in its docstring.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._bloom import build_bloom, may_contain
from paperloom.llm._shared import Scratch
from paperloom.llm.jaccard import jaccard_components
from paperloom.llm.mixing import mix
from paperloom.llm.packing import pack_documents
from paperloom.llm.pii import sanitise
from paperloom.llm.quality import quality_rules
from paperloom.llm.tokens import token_counts

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the quality rules keep; null and empty texts have too few words, and a figure at its limit is kept."""
    return quality_rules(docs, COLUMNS).where("kept").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of linked documents: the smallest doc_id's (rows without words are no group).

    Only rows that may have to go are shuffled: a bounded Bloom filter holds the
    hashes of rows that are not their group's first, or that occur twice; rows that
    it rejects stay where they are, the others are decided by an exact join.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("__row"))
    scratch = Scratch(spark, "near-copies")
    classed = scratch.keep(jaccard_components(keyed, ["doc_id", "__row"]).where(F.col("class_id").isNotNull()).select("doc_id", "__row", "class_id"), "classed", narrow=True)
    first = classed.groupBy("class_id").agg(F.count("*").alias("n"), F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "__row")).alias("first"))
    first = scratch.keep(first.where("n > 1").select("class_id", F.col("first.__row").alias("__first")), "first", narrow=True)
    grouped = scratch.keep(classed.join(first, "class_id").select("__row", "__first").distinct(), "grouped", narrow=True)
    bloom = spark.sparkContext.broadcast(build_bloom(grouped.select(F.col("__row").alias("id")), grouped.count()))
    alone = keyed.mapInArrow(partial(_by_bloom, shared=bloom, inside=False), keyed.schema)
    maybe = keyed.mapInArrow(partial(_by_bloom, shared=bloom, inside=True), keyed.schema)
    known = maybe.join(grouped.withColumn("__stays", F.col("__row") == F.col("__first")).drop("__first"), "__row", "left")
    firsts = known.where("__stays").dropDuplicates(["__row"])  # repeated rows are copies of each other
    return alone.select(*COLUMNS).unionByName(known.where(F.col("__stays").isNull()).select(*COLUMNS)).unionByName(firsts.select(*COLUMNS))


def _by_bloom(batches: Iterator[pa.RecordBatch], shared, inside: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit = may_contain(shared.value, batch.column("__row").to_numpy(zero_copy_only=False))
        yield batch.filter(pa.array(hit == inside))


def remove_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with personal data named by kind and disclosing terms generalised or removed."""
    return sanitise(docs.select(*COLUMNS)).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row as often as the mix takes it; rows without words are never taken, ties are settled by hash."""
    keyed = docs.select(*COLUMNS, F.xxhash64(*COLUMNS).alias("__row"))
    copies = mix(keyed, ["__row"]).groupBy("__row").agg(F.sum("copies").cast("int").alias("__n"), (F.count("*") > 1).alias("__repeated"))
    copies = Scratch(spark, "copies").keep(copies.where("__n > 0"), "copies", narrow=True)
    # merged at every size: which rows are taken is known only after the join, so texts meet their copies by a shuffle
    taken = keyed.join(copies.hint("merge"), "__row")
    # equal rows were counted together, so one of them stands for all; the texts' exchange is shared by both parts
    taken = taken.where("not __repeated").unionByName(taken.where("__repeated").dropDuplicates(["__row"]))
    return taken.withColumn("__copy", F.explode(F.sequence(F.lit(1), "__n"))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every document, or piece of one, in the training sequences; without tokens it has a row and no place."""
    return pack_documents(token_counts(docs, ["doc_id", "source"]), ["doc_id", "source"], "n_tokens")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", keep_quality),
    ("ngram_jaccard_join", drop_near_copies),
    ("personal_data", remove_personal_data),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_sequences),
]

#: Suffix arrays, set joins, random rounding and bin packing have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        mark = Scratch.mark()
        docs = scratch.keep(stage(spark, docs, sf_dir), f"{i}_{name}")
        Scratch.release(spark, mark)
        if i:
            scratch.drop(f"{i - 1}_{STAGES[i - 1][0]}")
    return docs
