"""Exact top-k by distributed histogram selection.

Every candidate is scored against every query.  Score histograms, summed over all
tasks, locate each query's k-th best score: a first histogram spans the range that
the vector norms allow, further ones refine the bin that holds the k-th score until
it is a single integer.  A last scan keeps the scores at or above it; ties at the
k-th score go to the smaller id.

Scores are inner products of integer vectors (components floor(scale * x)),
computed exactly: by float64 matrix products while they stay below 2^53, else with
Python integers; scores beyond 64 bits are cut to the 64-bit range.

Scale: queries are read in blocks of at most ``block`` rows, each broadcast (its
size is bounded), and each block scans the candidates; nothing grows with the
number of candidates on the driver.  A task sends for each query only bins at or
above its own k-th best (lower ones cannot hold the global k-th), and in the last
scan at most its k best rows, so a vector that is repeated a million times costs no
more than others.

Defined results: vectors that are null, empty, or hold a null or non-finite
component take no part, neither do rows with a null id.  Candidates are compared
with queries of the same dimension only.  A query's own row is left out by its id;
rows that repeat an id are separate candidates, and a query repeated with the same
id and vector is answered once.  A query with fewer than k candidates gets all.
Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm._shared import Scratch

_EXACT = float(1 << 53)
_LONG = (-(1 << 63), (1 << 63) - 1)


def integer_vectors(df: DataFrame, id_col: str, vector: str, scale: int = 256) -> DataFrame:
    """(id, vec array<double> of whole numbers) of the usable rows."""
    values = F.col(vector).cast("array<double>")
    usable = (F.size(values) > 0) & F.forall(values, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    # floor() of a double is a long in Spark; scaled whole numbers beyond 2^53 are whole already
    floored = F.transform(values, lambda x: F.when(F.abs(x * scale) < _EXACT, F.floor(x * scale).cast("double")).otherwise(x * scale))
    return df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(F.coalesce(usable, F.lit(False))).select(F.col(id_col).cast("long").alias("id"), floored.alias("vec"))


def _scores(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Exact integer inner products as int64: one row for each query."""
    bound = np.abs(vectors).max(initial=0.0) * np.abs(queries).max(initial=0.0) * max(1, vectors.shape[1])
    if bound < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    exact = [[min(max(sum(int(a) * int(b) for a, b in zip(q, v, strict=True)), _LONG[0]), _LONG[1]) for v in vectors] for q in queries]
    return np.array(exact, dtype=np.int64).reshape(len(queries), len(vectors))


def _matrices(batch: pa.RecordBatch, most: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, matrix) of the rows of each dimension, in runs of at most ``most`` rows."""
    ids = batch.column("id").to_numpy(zero_copy_only=False)
    lists = batch.column("vec")
    flat, sizes = lists.flatten().to_numpy(zero_copy_only=False), lists.value_lengths().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        for begin in range(0, len(rows), most):
            part = rows[begin : begin + most]
            yield ids[part], flat[starts[part][:, None] + np.arange(dim)[None, :]]


class _Block:
    """A bounded block of queries: ids, vectors by dimension, and what is known of each k-th score."""

    def __init__(self, rows: list[tuple[int, list[float]]]):
        self.ids = np.array([r[0] for r in rows], np.int64)
        self.by_dim: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        dims = np.array([len(r[1]) for r in rows])
        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            self.by_dim[int(dim)] = (at, np.array([rows[i][1] for i in at], dtype=np.float64))


def _histogram(candidates: DataFrame, shared, k: int) -> DataFrame:
    """(query, bin, n) over all candidates; of each task only the bins from its own k-th best up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low, width, bins = shared.value
        counts = np.zeros((len(block.ids), bins), np.int32)
        for batch in batches:
            for ids, matrix in _matrices(batch):
                if matrix.shape[1] not in block.by_dim:
                    continue
                at, queries = block.by_dim[matrix.shape[1]]
                scores = _scores(matrix, queries)
                # bin 0 is all below the range, the last bin all from its end up
                place = np.clip((scores - low[at, None]) // width[at, None] + 1, 0, bins - 1)
                own = ids[None, :] == block.ids[at, None]
                flat = (np.arange(len(at))[:, None] * bins + place)[~own]
                counts[at] += np.bincount(flat, minlength=len(at) * bins).reshape(len(at), bins).astype(np.int32)
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        rows, places = np.nonzero((counts > 0) & (above - counts < k))
        yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(places.astype(np.int32)), pa.array(counts[rows, places].astype(np.int64))], names=["query", "bin", "n"])

    return candidates.mapInArrow(run, "query int, bin int, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _best(candidates: DataFrame, shared, k: int) -> DataFrame:
    """(query, id, score) of the scores at or above each query's k-th; of each task at most k rows a query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, least = shared.value
        kept = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64))]

        def cut(parts):
            query, ids, scores = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((ids, -scores.astype(np.float64), query)) if np.abs(scores).max(initial=0) < 1 << 53 else np.array(sorted(range(len(ids)), key=lambda i: (query[i], -int(scores[i]), ids[i])), dtype=np.int64)
            query = query[order]
            place = np.arange(len(query)) - np.searchsorted(query, query)
            order = order[place < k]
            return (query[place < k], ids[order], scores[order])

        for batch in batches:
            for ids, matrix in _matrices(batch):
                if matrix.shape[1] not in block.by_dim:
                    continue
                at, queries = block.by_dim[matrix.shape[1]]
                scores = _scores(matrix, queries)
                row, place = np.nonzero((scores >= least[at, None]) & (ids[None, :] != block.ids[at, None]))
                kept.append((at[row], ids[place], scores[row, place]))
                if sum(len(x[0]) for x in kept) > 4 * k * max(1000, len(block.ids)):
                    kept = [cut(kept)]
        query, ids, scores = cut(kept)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(ids), pa.array(scores)], names=["query", "id", "score"])

    return candidates.mapInArrow(run, "query int, id long, score long")


def _select_block(candidates: DataFrame, block: _Block, k: int, largest: float, bins: int) -> DataFrame:
    """The k best candidates of each query of a block."""
    sc = candidates.sparkSession.sparkContext
    reach = np.array([0.0] * len(block.ids))
    for at, queries in block.by_dim.values():
        reach[at] = np.sqrt((queries * queries).sum(axis=1)) * largest
    edge = np.minimum(np.ceil(reach) + 2, float(1 << 61)).astype(np.int64)  # Cauchy-Schwarz
    low, high = -edge, edge  # the k-th score lies in [low, high)
    width = np.maximum((high - low + bins - 3) // (bins - 2), 1)
    rank = np.full(len(block.ids), k, np.int64)
    least = np.full(len(block.ids), _LONG[0], np.int64)
    open_ = np.ones(len(block.ids), bool)
    while open_.any():
        found = _histogram(candidates, sc.broadcast((block, low, width, bins)), k).toArrow()  # at most k bins a query and task, summed to bins
        counts = np.zeros((len(block.ids), bins), np.int64)
        counts[found["query"].to_numpy(), found["bin"].to_numpy()] = found["n"].to_numpy()
        above = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1]
        for q in np.flatnonzero(open_):
            reached = np.flatnonzero(above[q] >= rank[q])
            if not len(reached) or reached[-1] == 0 or reached[-1] == bins - 1:
                # fewer than k candidates: all of them; beyond the range (cut scores): from its end
                least[q] = _LONG[0] if not len(reached) or reached[-1] == 0 else low[q] + width[q] * (bins - 2)
                open_[q] = False
                continue
            place = int(reached[-1])
            low[q] += width[q] * (place - 1)
            if width[q] == 1:
                least[q] = low[q]
                open_[q] = False
            else:
                width[q] = max(-(-int(width[q]) // (bins - 2)), 1)
        if open_.any():
            width[~open_] = np.maximum(width[~open_], 1)
    return _best(candidates, sc.broadcast((block, least)), k)


def top_k(df: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector: str = "embedding", scale: int = 256, block: int = 2048, bins: int = 512) -> DataFrame:
    """query_id, rank (from 1), candidate id as ``id`` and score, for each row of ``df`` where ``is_query`` holds.

    ``block`` bounds the queries that are broadcast and scored at a time.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "topk")
    candidates = integer_vectors(df, id_col, vector, scale)
    largest = candidates.agg(F.max(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)))).first()[0] or 0.0
    queries = integer_vectors(df.where(F.coalesce(is_query, F.lit(False))), id_col, vector, scale).distinct()
    names: list[str] = []
    held: list[tuple[int, list[float]]] = []

    def answer() -> None:
        part = _Block(held)
        ids = spark.sparkContext.broadcast(part.ids)
        best = _select_block(candidates, part, k, float(largest), bins)
        order = Window.partitionBy("query").orderBy(F.desc("score"), "id")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

        def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield pa.RecordBatch.from_arrays([pa.array(ids.value[batch.column("query").to_numpy(zero_copy_only=False)]), batch.column("rank"), batch.column("id"), batch.column("score")], names=["query_id", "rank", "id", "score"])

        names.append(f"block{len(names)}")
        scratch.keep(ranked.select("query", "rank", "id", "score").mapInArrow(named, "query_id long, rank int, id long, score long"), names[-1])

    for row in queries.toLocalIterator():  # one partition at a time
        held.append((row[0], row[1]))
        if len(held) == block:
            answer()
            held = []
    if held:
        answer()
    schema = "query_id long, rank int, id long, score long"
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[scratch.path(n) for n in names])


ORACLE_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""
