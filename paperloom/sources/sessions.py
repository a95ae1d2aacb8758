"""Sessions, indexes and evaluation sets on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.operators.index import Index

EVAL_SCHEMA = "papers map<string,string>, questions array<struct<paper:string,kind:string,question:string,evidence:array<string>,answer_any:array<string>>>"


def to_json_rows(rows: DataFrame, key: str) -> DataFrame:
    """key and the whole row as JSON, nulls included."""
    return rows.select(key, F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"}).alias("json"))


def from_json_rows(rows: DataFrame, schema: str) -> DataFrame:
    """The rows of ``to_json_rows``; those that can't be read are null rows with ``corrupt`` true."""
    parsed = rows.withColumn("__x", F.from_json("json", schema, {"mode": "PERMISSIVE"})).withColumn("corrupt", F.try_parse_json("json").isNull())
    return parsed.select("__x.*", "corrupt")


def save_sessions(rows: DataFrame, path: str, key: str = "session_id") -> None:
    to_json_rows(rows, key).write.mode("overwrite").parquet(path)


def load_sessions(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return from_json_rows(spark.read.parquet(path), schema)


def append_session(answers: DataFrame, path: str, turn: int | None = None) -> DataFrame:
    """Adds answers to a session's history, and reads them from there; a turn that is written again replaces itself.

    Without a turn, each answer's question_id numbers it.
    """
    numbered = answers.withColumn("turn", (F.col("question_id") if turn is None else F.lit(turn)).cast("long"))
    numbered.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("turn").parquet(f"{path}/history")
    history = answers.sparkSession.read.parquet(f"{path}/history")
    return history if turn is None else history.where(F.col("turn") == turn)


def save_briefing(briefing: DataFrame, path: str) -> DataFrame:
    """Writes the briefing that a session is about; it is read from there, so that no model is called twice."""
    briefing.write.mode("overwrite").parquet(f"{path}/briefing")
    return briefing.sparkSession.read.parquet(f"{path}/briefing")


def session_paper(spark: SparkSession, path: str) -> str | None:
    """The paper that a saved session's briefing is about."""
    row = spark.read.parquet(f"{path}/briefing").select("paper_id").first()
    return row[0] if row else None


def session_turns(spark: SparkSession, path: str) -> int:
    """How many answers a saved session holds; an unreadable one is an error."""
    return spark.read.parquet(f"{path}/history").count()


def save_index(index: Index, path: str, buckets: int = 16) -> None:
    """Postings, norms and term statistics, partitioned by a bucket of the paper, so that a paper's part can be read alone."""
    for name, table in (("postings", index.postings), ("norms", index.norms), ("terms", index.terms)):
        table.withColumn("bucket", F.pmod(F.xxhash64("paper_id"), F.lit(buckets)).cast("int")).write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{name}")


def load_index(spark: SparkSession, path: str) -> Index:
    """A saved index as it was; nothing is built again."""
    return Index(*[spark.read.parquet(f"{path}/{name}").drop("bucket") for name in ("postings", "norms", "terms")])


def read_eval_questions(spark: SparkSession, path: str) -> DataFrame:
    """question_id, paper_id, kind, question, evidence and answer_any of an evaluation file."""
    found = spark.read.schema(EVAL_SCHEMA).json(path, multiLine=True)
    return found.select(F.posexplode("questions").alias("question_id", "q")).select("question_id", F.col("q.paper").alias("paper_id"), "q.kind", "q.question", "q.evidence", "q.answer_any")


def write_records(judged: DataFrame, path: str) -> None:
    judged.write.mode("overwrite").json(path)
