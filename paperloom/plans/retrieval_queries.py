"""Queries of the index and of retrieval."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.config import Settings
from paperloom.functions.scores import unit
from paperloom.operators import index as I
from paperloom.operators import retrieve as R
from paperloom.plans.registry import PASSAGES, QUESTIONS, passages, query, questions, table
from paperloom.plans.text_queries import sql_tokens

S = Settings()

TF = f"""{PASSAGES}, tf AS (
  SELECT paper_id, chunk_id, term, count(*) AS tf FROM (SELECT paper_id, chunk_id, unnest({sql_tokens("text")}) AS term FROM passages) GROUP BY ALL
)"""
IDF = f"""{TF}, n AS (SELECT paper_id, count(*) AS n_chunks FROM passages GROUP BY 1), idf AS (
  SELECT d.paper_id, term, df, n_chunks, ln((n_chunks + 1) / (df + 1)) + 1 AS idf FROM (SELECT paper_id, term, count(*) AS df FROM tf GROUP BY ALL) d JOIN n ON d.paper_id = n.paper_id
)"""
POSTINGS = f"""{IDF}, raw AS (
  SELECT t.paper_id, t.chunk_id, t.term, (ln(tf) + 1) * idf AS w FROM tf t JOIN idf i ON t.paper_id = i.paper_id AND t.term = i.term
), norms AS (SELECT paper_id, chunk_id, sqrt(sum(w * w)) AS norm FROM raw GROUP BY ALL), postings AS (
  SELECT r.paper_id, r.chunk_id, term, w / norm AS weight FROM raw r JOIN norms n ON r.paper_id = n.paper_id AND r.chunk_id = n.chunk_id
)"""
ASKED = f"""{POSTINGS}, {QUESTIONS}, qtf AS (
  SELECT question_id, paper_id, term, count(*) AS tf FROM (SELECT question_id, paper_id, unnest({sql_tokens("question")}) AS term FROM questions) GROUP BY ALL
), qraw AS (SELECT q.question_id, q.paper_id, q.term, (ln(tf) + 1) * idf AS w FROM qtf q JOIN idf i ON q.paper_id = i.paper_id AND q.term = i.term), asked AS (
  SELECT question_id, paper_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY question_id, paper_id)) AS weight FROM qraw
)"""
LEXICAL = f"""{ASKED}, lexical AS (
  SELECT a.question_id, a.paper_id, p.chunk_id, round(sum(p.weight * a.weight), 9) AS lexical FROM postings p JOIN asked a ON p.paper_id = a.paper_id AND p.term = a.term GROUP BY ALL
)"""


@query(f"WITH {TF} SELECT paper_id, chunk_id, term, tf FROM tf")
def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.term_frequencies(passages(spark, sf_dir))


@query(f"WITH {IDF} SELECT paper_id, term, df, n_chunks, round(idf, 6) AS idf FROM idf")
def idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build_index(passages(spark, sf_dir)).terms.withColumn("idf", F.round("idf", 6))


@query(f"WITH {POSTINGS} SELECT paper_id, chunk_id, round(norm, 6) AS norm FROM norms")
def doc_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.build_index(passages(spark, sf_dir)).norms.withColumn("norm", F.round("norm", 6))


@query(f"WITH {IDF} SELECT paper_id, count(*) AS n_terms FROM idf GROUP BY 1")
def vocab_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return I.vocabulary(I.build_index(passages(spark, sf_dir)))


@query(f"WITH {ASKED} SELECT question_id, paper_id, term, round(weight, 6) AS weight FROM asked")
def query_vector(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.query_vectors(questions(spark, sf_dir), I.build_index(passages(spark, sf_dir))).withColumn("weight", F.round("weight", 6))


@query(f"WITH {LEXICAL} SELECT question_id, paper_id, chunk_id, round(lexical, 6) AS lexical FROM lexical")
def lexical_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_scores(questions(spark, sf_dir), I.build_index(passages(spark, sf_dir))).withColumn("lexical", F.round("lexical", 6))


TFIDF = f"""{LEXICAL}, found AS (
  SELECT question_id, paper_id, chunk_id, rank, lexical AS score FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY question_id, paper_id ORDER BY lexical DESC, chunk_id) AS INTEGER) AS rank FROM lexical
  ) WHERE rank <= {S.top_k} AND lexical >= {S.lexical_threshold}
)"""


@query(f"WITH {TFIDF} SELECT question_id, paper_id, chunk_id, rank, round(score, 6) AS score FROM found")
def tfidf_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.lexical_search(questions(spark, sf_dir), I.build_index(passages(spark, sf_dir))).withColumn("score", F.round("score", 6))


# --- vectors -----------------------------------------------------------------


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that have an embedding, as passages with vectors."""
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return passages(spark, sf_dir).join(known, "chunk_id")


def vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions with a vector of their own (that of the same number)."""
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("question_id"), F.col("embedding").alias("vector"))
    return questions(spark, sf_dir).join(known, "question_id")


def sql_unit(c: str) -> str:
    norm = f"sqrt(list_sum(list_transform({c}, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE))))"
    return f"list_transform({c}, lambda x: CAST(x AS DOUBLE) / CASE WHEN {norm} = 0 THEN 1 ELSE {norm} END)"


#: Retrieval over passages with vectors: the index is of those only.
DENSE = f"""dense AS (
  SELECT q.question_id, q.paper_id, v.chunk_id, round(list_sum(list_transform(list_zip(q.u, v.u), lambda p: p[1] * p[2])), 9) AS dense
  FROM (SELECT question_id, paper_id, {sql_unit("embedding")} AS u FROM questions JOIN embeddings ON vec_id = question_id) q
  JOIN (SELECT source AS paper_id, doc_id AS chunk_id, {sql_unit("embedding")} AS u FROM documents JOIN embeddings ON vec_id = doc_id) v ON q.paper_id = v.paper_id
)"""
BOTH = f"""{LEXICAL.replace("FROM documents)", "FROM documents WHERE doc_id IN (SELECT vec_id FROM embeddings))")}, {DENSE}, scores AS (
  SELECT d.*, coalesce(l.lexical, 0.0) AS lexical FROM dense d LEFT JOIN lexical l ON d.question_id = l.question_id AND d.paper_id = l.paper_id AND d.chunk_id = l.chunk_id
)"""
GATE = f"""{BOTH}, gate AS (
  SELECT question_id, paper_id, max(dense) AS max_dense, max(lexical) AS max_lexical, NOT (max(dense) < {S.dense_threshold} AND max(lexical) < {S.lexical_threshold}) AS passed FROM scores GROUP BY ALL
)"""
RRF = f"""{GATE}, ranked AS (
  SELECT *, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY dense DESC, chunk_id) - 1 AS dr, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY lexical DESC, chunk_id) - 1 AS lr
  FROM scores WHERE question_id IN (SELECT question_id FROM gate WHERE passed)
), fused AS (SELECT *, round(1.0 / ({S.rrf_k} + dr) + 1.0 / ({S.rrf_k} + lr), 12) AS fused FROM (SELECT question_id, paper_id, chunk_id, dense, lexical, CAST(dr AS DOUBLE) AS dr, CAST(lr AS DOUBLE) AS lr FROM ranked)), pool AS (
  SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY question_id, paper_id ORDER BY fused DESC, chunk_id) AS INTEGER) AS place FROM fused) WHERE place <= {S.rerank_pool}
)"""


def _hybrid(spark: SparkSession, sf_dir: str):
    known = vectors(spark, sf_dir)
    return vector_questions(spark, sf_dir), I.build_index(known.select("paper_id", "chunk_id", "text")), known


@query(f"SELECT vec_id, i AS dim, round(u[i], 6) AS value FROM (SELECT vec_id, {sql_unit('embedding')} AS u, unnest(generate_series(1, len(embedding))) AS i FROM embeddings)")
def vec_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(unit(F.col("embedding"))).alias("dim", "value"))
    return rows.select("vec_id", (F.col("dim") + 1).cast("long").alias("dim"), F.round("value", 6).alias("value"))


@query(f"WITH {QUESTIONS}, {DENSE} SELECT question_id, paper_id, chunk_id, round(dense, 6) AS dense FROM dense")
def dense_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.dense_scores(vector_questions(spark, sf_dir), vectors(spark, sf_dir)).withColumn("dense", F.round("dense", 6))


@query(f"WITH {GATE} SELECT question_id, paper_id, round(max_dense, 6) AS max_dense, round(max_lexical, 6) AS max_lexical, passed FROM gate")
def relevance_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, index, known = _hybrid(spark, sf_dir)
    return R.gate(R.both_scores(asked, index, known)).withColumns({c: F.round(c, 6) for c in ("max_dense", "max_lexical")})


@query(f"WITH {RRF} SELECT question_id, paper_id, chunk_id, place, round(fused, 9) AS fused FROM pool")
def rrf(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, index, known = _hybrid(spark, sf_dir)
    return R.pool(R.both_scores(asked, index, known)).select("question_id", "paper_id", "chunk_id", "place", F.round("fused", 9).alias("fused"))


RERANK = f"""{RRF}, held AS (
  SELECT p.question_id, p.paper_id, p.chunk_id, p.place, p.dense, list_distinct({sql_tokens("q.question")}) AS a, list_distinct({sql_tokens("d.text")}) AS h
  FROM pool p JOIN questions q ON p.question_id = q.question_id JOIN documents d ON p.chunk_id = d.doc_id
), rescored AS (SELECT *, round(len(list_intersect(a, h)) / greatest(len(a), 1), 9) AS rescored FROM held)"""


@query(f"WITH {RERANK} SELECT question_id, paper_id, chunk_id, place, round(rescored, 6) AS rescored FROM rescored")
def rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, index, known = _hybrid(spark, sf_dir)
    found = R.overlap_rerank(asked, known)(R.pool(R.both_scores(asked, index, known)))
    return found.select("question_id", "paper_id", "chunk_id", "place", F.round("rescored", 6).alias("rescored"))


@query(
    f"""WITH {RERANK} SELECT question_id, paper_id, chunk_id, rank, round(dense, 6) AS score FROM (
  SELECT *, CAST(row_number() OVER (PARTITION BY question_id, paper_id ORDER BY rescored DESC, place) AS INTEGER) AS rank FROM rescored) WHERE rank <= {S.top_k}"""
)
def hybrid_rerank_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, index, known = _hybrid(spark, sf_dir)
    return R.hybrid_search(asked, index, known, rerank=R.overlap_rerank(asked, known)).withColumn("score", F.round("score", 6))


@query(f"WITH {RRF} SELECT question_id, paper_id, chunk_id, place AS rank, round(dense, 6) AS score FROM pool WHERE place <= {S.top_k}")
def hybrid_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, index, known = _hybrid(spark, sf_dir)
    return R.hybrid_search(asked, index, known).withColumn("score", F.round("score", 6))


@query(
    """
SELECT source AS paper_id, count(*) FILTER (embedding IS NULL) AS missing, count(DISTINCT len(embedding)) AS dimensions, count(*) FILTER (embedding IS NULL) = 0 AND count(DISTINCT len(embedding)) = 1 AS reuse
FROM documents LEFT JOIN embeddings ON vec_id = doc_id GROUP BY 1
"""
)
def embedding_reuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"))
    return R.needs_embedding(passages(spark, sf_dir).join(known, "chunk_id", "left"))
