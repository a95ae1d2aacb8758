"""Connected components of a link table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import Scratch


def components(links: DataFrame, scratch: Scratch, name: str, max_rounds: int = 60, few: int = 300_000) -> DataFrame:
    """(id, root) of every id in ``links`` (long a, long b); the root is the smallest reachable id.

    Each round hangs larger neighbours onto the smallest known one; a node with
    many neighbours is only ever grouped by aggregates that combine before the
    shuffle, and joined with written tables of one row a node, so that Spark can split
    its edges over tasks.  Rounds are written tables, so no lineage builds up.  A round
    at least halves what is left of a chain, so ``max_rounds`` is far beyond any table.
    With at most ``few`` edges the tables of one row a node are left to Spark, which broadcasts them.
    """
    spark = links.sparkSession
    edges = scratch.keep(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}0", narrow=True)
    state = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()

    def kept(df: DataFrame, table: str) -> DataFrame:
        return scratch.keep(df, table, narrow=True) if state[0] > few else df

    for n in range(1, max_rounds + 1):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = kept(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}{n}-near")
        large = kept(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}{n}-large")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}{n}-least")
        small = large.join(least, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        edges = scratch.keep(small.where("u <> v").distinct(), f"{name}{n}", narrow=True)
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        scratch.drop(f"{name}{n - 1}", *(f"{name}{n}-{x}" for x in ("near", "large", "least")))
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    if not state[0]:
        return spark.createDataFrame([], "id long, root long")
    roots = edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
    return scratch.keep(roots, f"{name}roots", narrow=True)
