"""Queries of the workflow, telemetry, and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.config import Settings
from paperloom.operators import index as I
from paperloom.operators import telemetry as TEL
from paperloom.operators.retrieve import best
from paperloom.plans import flow
from paperloom.plans.registry import passages, query, table
from paperloom.plans.research import research_flow
from paperloom.plans.text_queries import sql_tokens
from paperloom.sources import atom, pdf, sessions


def _logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as execution logs: users are sessions, types are steps."""
    status = F.when(F.col("event_type") == "error", "error").when(F.col("value") > 50, "warning").otherwise("success")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("session_id"), F.col("event_type").alias("node_name"), status.alias("status"), F.col("value").alias("duration_ms"), F.col("ts").alias("timestamp"))


LOGS = "logs AS (SELECT user_id AS session_id, event_type AS node_name, CASE WHEN event_type = 'error' THEN 'error' WHEN value > 50 THEN 'warning' ELSE 'success' END AS status, value AS duration_ms, ts FROM events)"


@query(f"WITH {LOGS} SELECT node_name, status, count(*) AS runs, round(sum(duration_ms), 4) AS total_ms, max(duration_ms) AS max_ms FROM logs GROUP BY ALL")
def telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TEL.step_summary(_logs(spark, sf_dir))


@query(f"WITH {LOGS} SELECT session_id, count(*) AS steps, count(*) FILTER (status = 'warning') AS warnings, count(*) FILTER (status = 'error') AS errors, epoch_us(max(ts)) AS last_step FROM logs GROUP BY 1")
def session_telemetry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TEL.session_summary(_logs(spark, sf_dir)).withColumn("last_step", F.unix_micros(F.col("last_step").cast("timestamp")))


# --- workflow ----------------------------------------------------------------

def _flow_tables(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    return research_flow().tables(spark)


#: The workflow's edges as SQL sees them.
_TOPOLOGY = [("understand", "find"), ("find", "rank"), ("find", "parse"), ("rank", "parse"), ("parse", "chunk"), ("chunk", "index"), ("index", "brief"), ("brief", "save"), ("answer", "save"), ("save", flow.END)]
_VALUES = "edges(source, target) AS (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in _TOPOLOGY) + ")"


@query(
    f"""
WITH RECURSIVE {_VALUES}, starts(entry, node) AS (VALUES ('analyze', 'understand'), ('ask', 'answer')), reach(entry, node) AS (
  SELECT entry, node FROM starts UNION SELECT r.entry, e.target FROM reach r JOIN edges e ON e.source = r.node
) SELECT entry, node FROM reach
"""
)
def reachability(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, edges, entries = _flow_tables(spark)
    return flow.reachability(edges, entries)


@query("SELECT * FROM (VALUES ('brief -> nowhere', 'unknown target'), ('ghost -> save', 'unknown source'), ('lonely', 'no way out'), ('rank', 'conditional ways out only'), ('resume', 'unknown entry step')) t(subject, problem)")
def graph_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The workflow with one fault of each kind put in."""
    nodes, edges, entries = _flow_tables(spark)
    nodes = nodes.unionByName(spark.createDataFrame([("lonely", "")], nodes.schema))
    edges = edges.withColumn("conditional", F.col("conditional") | (F.col("source") == "rank")).unionByName(spark.createDataFrame([(90, "ghost", "save", False, ""), (91, "brief", "nowhere", False, "")], edges.schema))
    entries = entries.unionByName(spark.createDataFrame([("resume", "gone")], entries.schema))
    return flow.find_problems(nodes, edges, entries)


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as sessions: some direct, some topics; every seventh meets an error while parsing."""
    return table(spark, sf_dir, "pages").select("page_id", F.when(F.col("page_id") % 3 == 0, "DIRECT_ID").when(F.col("page_id") % 3 == 1, "TOPIC_SEARCH").alias("intent"))


@query("SELECT page_id, CASE WHEN page_id % 3 = 1 THEN 'rank' ELSE 'parse' END AS next_step FROM pages")
def routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).select("page_id", research_flow().next_step("find").alias("next_step"))


@query(
    f"""
SELECT page_id, 'understand > find > ' || CASE WHEN page_id % 3 = 1 THEN 'rank > ' ELSE '' END || CASE WHEN page_id % 7 = 0 THEN 'parse' ELSE 'parse > chunk > index > brief > save' END AS path,
  CASE WHEN page_id % 7 = 0 THEN '{flow.FAILED}' ELSE '{flow.END}' END AS at FROM pages
"""
)
def visited_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    fail = lambda df: df.withColumn("errors", F.when(F.col("page_id") % 7 == 0, F.array_append("errors", F.lit("no text"))).otherwise(F.col("errors")))
    done = research_flow({"parse": fail}).run(_sessions(spark, sf_dir), "analyze")
    return done.select("page_id", F.array_join("path", " > ").alias("path"), "at")


# --- sources -----------------------------------------------------------------


@query(
    """
SELECT '24' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(page_id AS VARCHAR), 5, '0') AS paper_id, 'Title of ' || page_id AS title, CASE page_id % 2 WHEN 0 THEN 'A B|C D' ELSE 'E F' END AS authors, '2024-05-06' AS published_date,
  CASE WHEN page_id % 3 = 0 THEN replace(url, 'http://', 'https://') ELSE 'https://arxiv.org/pdf/24' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(page_id AS VARCHAR), 5, '0') || 'v3' END AS pdf_url, CASE page_id % 2 WHEN 0 THEN 'cs.LG' ELSE 'math.GT' END AS primary_category
FROM pages WHERE page_id % 5 <> 4
"""
)
def atom_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One feed for each page; every fifth entry is an error."""
    n = F.col("page_id")
    paper = F.concat(F.lit("24"), F.lpad((n % 100).cast("string"), 2, "0"), F.lit("."), F.lpad(n.cast("string"), 5, "0"), F.lit("v3"))
    escaped = F.replace("url", F.lit("&"), F.lit("&amp;"))
    feed = F.concat(
        F.lit("<feed><entry><id>"), F.when(n % 5 == 4, F.lit("http://arxiv.org/api/errors#x")).otherwise(F.concat(F.lit("http://arxiv.org/abs/"), paper)), F.lit("</id><title>Title\n  of "), n.cast("string"), F.lit("</title><summary> s </summary><published>2024-05-06T00:00:00Z</published>"),
        F.when(n % 2 == 0, "<author><name>A  B</name></author><author><name>C D</name></author>").otherwise("<author><name>E F</name></author>"),
        F.when(n % 3 == 0, F.concat(F.lit('<link title="pdf" href="'), escaped, F.lit('"/>'))).otherwise(""),
        F.when(n % 2 == 0, '<arxiv:primary_category term="cs.LG"/>').otherwise(""), F.lit('<category term="math.GT"/><category term="x"/></entry></feed>'),
    )
    found = atom.parse_entries(atom.entries_of_feeds(table(spark, sf_dir, "pages").select(feed.alias("feed"))))
    return found.select("paper_id", "title", F.array_join("authors", "|").alias("authors"), "published_date", "pdf_url", "primary_category")


@query("SELECT page_id, page_id % 2 = 0 AS is_pdf, page_id || '_x.pdf' AS file FROM pages")
def pdf_magic(spark: SparkSession, sf_dir: str) -> DataFrame:
    content = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit("%PDF-1.7 "), "html")).otherwise(F.col("html")).cast("binary")
    return table(spark, sf_dir, "pages").select("page_id", pdf.is_pdf(content).alias("is_pdf"), pdf.cache_name(F.concat(F.col("page_id").cast("string"), F.lit("/x"))).alias("file"))


@query("SELECT conv_id, turn, role, text, false AS corrupt FROM conversations")
def session_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    keyed = rows.select(F.struct("conv_id", "turn").alias("session_id"), "conv_id", "turn", "role", "text")
    return sessions.from_json_rows(sessions.to_json_rows(keyed, "session_id"), "conv_id long, turn long, role string, text string")


@query(f"SELECT source AS paper_id, count(*) AS chunks, count(*) FILTER (len({sql_tokens('text')}) > 0) AS known FROM documents GROUP BY 1")
def index_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of each paper, and how many its postings and norms hold; one without terms is in neither."""
    own = passages(spark, sf_dir)
    index = I.build_index(own)
    held = index.postings.select("paper_id", "chunk_id").distinct().join(index.norms.where("norm > 0"), ["paper_id", "chunk_id"]).groupBy("paper_id").agg(F.count("*").alias("known"))
    return own.groupBy("paper_id").agg(F.count("*").alias("chunks")).join(held, "paper_id", "left").withColumn("known", F.coalesce("known", F.lit(0).cast("long")))


@query(
    f"""
SELECT doc_id % 3 AS question_id, source AS paper_id, 's' || (doc_id % 40) || '_c' || doc_id AS chunk_id,
  CAST(row_number() OVER (PARTITION BY doc_id % 3, source ORDER BY n_chars % 2 DESC, doc_id % 40, doc_id) AS INTEGER) AS rank FROM documents
QUALIFY rank <= {Settings().top_k}
"""
)
def passage_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal scores go to the earlier passage: s2_c1 before s10_c1."""
    scores = table(spark, sf_dir, "documents").select((F.col("doc_id") % 3).alias("question_id"), F.col("source").alias("paper_id"), F.concat(F.lit("s"), F.col("doc_id") % 40, F.lit("_c"), "doc_id").alias("chunk_id"), (F.col("n_chars") % 2).alias("score"))
    return best(scores, "score", Settings().top_k).drop("score")
