"""Queries of chunking, briefings, answers, search and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.config import Settings
from paperloom.functions import scores, text as T
from paperloom.operators import briefing, chunking, context, evals, qa, search
from paperloom.operators import index as I
from paperloom.operators import retrieve as R
from paperloom.plans.registry import PAPERS, QUESTIONS, papers, passages, query, questions, table
from paperloom.plans.retrieval_queries import TFIDF
from paperloom.plans.text_queries import sql_list, sql_match_form, sql_prose, sql_refusal, sql_strip, sql_terms, sql_word_set, sql_words
from paperloom.providers import OfflineModel

S = Settings()
TODAY = "2026-01-01"


# --- chunking ----------------------------------------------------------------


def body(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as the one section of a paper; some are reference lists."""
    heading = F.when(F.col("doc_id") % 25 == 7, "References").otherwise(F.col("source"))
    last = (1 + F.floor(F.col("n_chars") / 3000)).cast("int")
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), (F.col("doc_id") % 7).cast("int").alias("section_index"), heading.alias("heading"), F.col("text").alias("content"), F.lit(1).alias("page_start"), last.alias("page_end"), F.lit(None).cast("array<int>").alias("paragraph_pages"))


CHUNKS = rf"""p AS (
  SELECT doc_id, doc_id % 7 AS section_index, source AS heading, 1 + n_chars // 3000 AS last, string_split(text, chr(10)) AS own FROM documents WHERE doc_id % 25 <> 7 AND {sql_strip("text")} <> ''
), q AS (
  SELECT doc_id, section_index, heading, last, len(own) AS n, unnest(generate_series(0, len(own) - 1)) AS k, unnest(own) AS par FROM p
), pieces AS (
  SELECT *, 1 + (k * (last - 1)) // n AS page, CASE WHEN contains({sql_strip("par")}, ' | ') THEN [{sql_strip("par")}]
    ELSE list_filter(list_transform(string_split(regexp_replace({sql_strip("par")}, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {sql_strip("x")}), lambda x: x <> '') END AS us FROM q
), flat AS (
  SELECT doc_id, section_index, heading, k, generate_subscripts(us, 1) AS j, unnest(us) AS t, page, contains({sql_strip("par")}, ' | ') AS r FROM pieces
), units AS (
  SELECT doc_id, section_index, heading, row_number() OVER (PARTITION BY doc_id ORDER BY k, j) AS i, t, page, r FROM flat
), fold AS (
  SELECT doc_id, section_index, heading, i, [{{'t': t, 'p': page, 'r': r}}] AS cur, CAST(NULL AS STRUCT(t VARCHAR, p BIGINT, r BOOLEAN)[]) AS done FROM units WHERE i = 1
  UNION ALL
  SELECT f.doc_id, f.section_index, f.heading, u.i,
    list_append(CASE WHEN list_sum(list_transform(cur, lambda x: length(x.t) + 1)) + length(u.t) > {S.chunk_size}
      THEN list_filter(cur, lambda x, k: coalesce(list_sum(list_transform(cur[k + 1:], lambda y: length(y.t) + 1)), 0) + length(x.t) < {S.chunk_overlap}) ELSE cur END, {{'t': u.t, 'p': u.page, 'r': u.r}}),
    CASE WHEN list_sum(list_transform(cur, lambda x: length(x.t) + 1)) + length(u.t) > {S.chunk_size} THEN cur END
  FROM fold f JOIN units u ON u.doc_id = f.doc_id AND u.i = f.i + 1
), closed AS (
  SELECT doc_id, section_index, heading, i, done AS c FROM fold WHERE done IS NOT NULL
  UNION ALL SELECT doc_id, section_index, heading, i + 1, cur FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i DESC) AS z FROM fold) WHERE z = 1
), chunked AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, 's' || section_index || '_c' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS chunk_id, heading AS section_heading,
    c[1].t || array_to_string(list_transform(c[2:], lambda x: CASE WHEN x.r THEN chr(10) ELSE ' ' END || x.t), '') AS text, CAST(c[1].p AS INTEGER) AS page_number, CAST(c[-1].p AS INTEGER) AS page_end FROM closed
)"""


@query(f"WITH RECURSIVE {CHUNKS} SELECT *, CAST(len({sql_words('text')}) AS INTEGER) AS token_count, length(text) > {S.chunk_size} AS over_size FROM chunked")
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.section_chunks(body(spark, sf_dir), S, "\n").drop("section_index", "chunk_index")


_META = """concat_ws(chr(10), 'Title of the paper: ' || title, 'Authors who wrote it: ' || array_to_string(authors, ', '), 'Publication date (published): ' || left(published_date, 10),
  'Paper ID: ' || paper_id, 'Subject categories: ' || array_to_string(categories, ', '), 'Link: ' || abs_url)"""


@query(f"WITH {PAPERS} SELECT paper_id, {_META} AS text, CAST(len({sql_words(_META)}) AS INTEGER) AS token_count FROM papers")
def metadata_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunking.metadata_chunks(papers(spark, sf_dir)).select("paper_id", "text", "token_count")


@query(f"WITH {PAPERS} SELECT paper_id, 'abstract_1' AS chunk_id, abstract AS text FROM papers WHERE CAST(paper_id AS BIGINT) % 25 = 7 AND abstract <> ''")
def abstract_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = papers(spark, sf_dir)
    found = chunking.all_chunks(own, body(spark, sf_dir), S, "\n")
    return found.where("chunk_id = 'abstract_1'").select("paper_id", "chunk_id", "text")


# --- sections and context ----------------------------------------------------

_HEADINGS = ("Introduction", "Related", "B.1 Extra Results", "Methods", "Notes", "Results")


def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every four lines of a document as a section; papers whose number divides by 3 have no wanted heading."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    index = F.floor(F.col("pos") / 4).cast("int")
    named = F.element_at(F.array(*[F.lit(h) for h in _HEADINGS]), F.col("section_index") % len(_HEADINGS) + 1)
    own = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n")  # four lines
    grouped = lines.withColumn("section_index", index).groupBy("doc_id", "section_index").agg(own.alias("content"))
    heading = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("C Part "), F.col("section_index").cast("string"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("Part "), F.col("section_index").cast("string"))).otherwise(named)
    return grouped.select(F.col("doc_id").cast("string").alias("paper_id"), "section_index", heading.alias("heading"), "content", (F.col("section_index") + 1).alias("page_start"), (F.col("section_index") + 1).alias("page_end"))


SECTIONS = f"""lines AS (SELECT doc_id, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos, unnest(string_split(text, chr(10))) AS line FROM documents), sections AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, CAST(pos // 4 AS INTEGER) AS section_index,
    CASE doc_id % 3 WHEN 0 THEN 'C Part ' || (pos // 4) WHEN 1 THEN 'Part ' || (pos // 4) ELSE {sql_list(_HEADINGS)}[(pos // 4) % {len(_HEADINGS)} + 1] END AS heading, string_agg(line, chr(10) ORDER BY pos) AS content
  FROM lines GROUP BY doc_id, pos // 4
), marked AS (
  SELECT *, NOT regexp_matches(heading, '{T.APPENDIX}') AS main, {" OR ".join(f"contains(lower(heading), '{s}')" for s in context.PRIORITY)} AS wanted FROM sections
), leveled AS (SELECT *, CASE WHEN main AND wanted THEN 0 WHEN main THEN 1 ELSE 2 END AS level FROM marked), placed AS (
  SELECT *, min(level) OVER (PARTITION BY paper_id) AS best, row_number() OVER (PARTITION BY paper_id ORDER BY section_index) AS nth,
    row_number() OVER (PARTITION BY paper_id, main ORDER BY section_index) AS nth_main FROM leveled
), chosen AS (SELECT paper_id, section_index, heading, content FROM placed WHERE CASE best WHEN 0 THEN level = 0 WHEN 1 THEN main AND nth_main <= 4 ELSE nth <= 4 END)"""


@query(f"WITH {SECTIONS} SELECT paper_id, section_index, heading FROM chosen")
def priority_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.priority_sections(line_sections(spark, sf_dir)).select("paper_id", "section_index", "heading")


@query(
    f"""
WITH RECURSIVE {PAPERS}, {SECTIONS}, own AS (
  SELECT paper_id, section_index, {sql_prose("content")} AS prose, row_number() OVER (PARTITION BY paper_id ORDER BY section_index) AS i, count(*) OVER (PARTITION BY paper_id) AS n FROM chosen
), start AS (
  SELECT paper_id, {S.context_chars} - {len("Title: Authors: arXiv ID: Published: Abstract:") + 2} - length(title) - length(array_to_string(authors, ', ')) - length(paper_id) - length(published_date) - length(abstract) AS budget FROM papers
), fold(paper_id, i, section_index, share, excerpt, rest) AS (
  SELECT s.paper_id, CAST(0 AS BIGINT), CAST(NULL AS INTEGER), CAST(NULL AS BIGINT), '', CAST(budget AS BIGINT) FROM start s
  UNION ALL
  SELECT f.paper_id, o.i, o.section_index, CAST(floor(f.rest / (o.n - o.i + 1)) AS BIGINT), {sql_strip("left(o.prose, CAST(floor(f.rest / (o.n - o.i + 1)) AS BIGINT))")},
    f.rest - length({sql_strip("left(o.prose, CAST(floor(f.rest / (o.n - o.i + 1)) AS BIGINT))")})
  FROM fold f JOIN own o ON o.paper_id = f.paper_id AND o.i = f.i + 1 WHERE floor(f.rest / (o.n - o.i + 1)) >= {S.least_share}
)
SELECT paper_id, section_index, share, excerpt FROM fold WHERE i > 0
"""
)
def context_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return context.section_budgets(papers(spark, sf_dir), line_sections(spark, sf_dir), S, "\n")


# --- search ------------------------------------------------------------------


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User turns as search requests."""
    return table(spark, sf_dir, "conversations").where("role = 'user'").select((F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"), F.col("text").alias("request"))


SEARCH = rf"""requests AS (SELECT conv_id * 1000 + turn AS request_id, text AS request FROM conversations WHERE role = 'user'), terms AS (
  SELECT request_id, {sql_terms("request")} AS own FROM requests
), asked AS (
  SELECT request_id, len(own) AS n_all, generate_subscripts(list_slice(own, 1, 5), 1) - 1 AS pos, lower(unnest(list_slice(own, 1, 5))) AS term FROM terms
), used AS (SELECT request_id, max(n_all) AS n_all, count(*) AS n_used FROM asked GROUP BY 1), paper_terms AS (
  SELECT paper_id, unnest({sql_word_set("title || ' ' || abstract")}) AS term FROM papers
), hits AS (SELECT request_id, paper_id, count(*) AS matched, count(*) FILTER (pos < 2) AS first_two FROM asked JOIN paper_terms USING (term) GROUP BY ALL), scored AS (
  SELECT h.*, CASE WHEN matched = n_used THEN 0 WHEN n_all > 2 AND first_two = 2 THEN 1 WHEN n_all > 1 THEN 2 END AS level FROM hits h JOIN used USING (request_id)
), candidates AS (
  SELECT request_id, paper_id, level, matched, place FROM (
    SELECT *, CAST(row_number() OVER (PARTITION BY request_id ORDER BY matched DESC, paper_id) AS INTEGER) AS place FROM (SELECT *, min(level) OVER (PARTITION BY request_id) AS best FROM scored WHERE level IS NOT NULL) WHERE level = best
  ) WHERE place <= {S.max_candidates}
)"""


@query(f"WITH {PAPERS}, {SEARCH} SELECT * FROM candidates")
def relaxed_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.relaxed_search(requests(spark, sf_dir), search.paper_terms(papers(spark, sf_dir)))


@query(f"WITH {PAPERS} SELECT c.conv_id AS request_id, c.turn, p.paper_id, p.title FROM conversations c JOIN papers p ON CAST(c.conv_id * 3 AS VARCHAR) = p.paper_id")
def id_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.struct("conv_id", "turn").alias("request_id"), (F.col("conv_id") * 3).cast("string").alias("wanted"))
    return search.id_lookup(turns, papers(spark, sf_dir)).select(F.col("request_id.conv_id").alias("request_id"), "request_id.turn", "paper_id", "title")


_RECENCY = f"coalesce(greatest(0.0, 1.0 - greatest(0, date_diff('day', try_cast(left(published_date, 10) AS DATE), DATE '{TODAY}')) / {float(S.recency_days)}), 0.0)"


@query(f"WITH {PAPERS} SELECT paper_id, round(CASE WHEN try_cast(left(published_date, 10) AS DATE) IS NULL THEN 0.0 ELSE {_RECENCY} END, 6) AS recency FROM papers")
def recency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers(spark, sf_dir).select("paper_id", F.round(scores.recency(F.col("published_date"), F.lit(TODAY).cast("date")), 6).alias("recency"))


RANKED = rf"""ranked AS (
  SELECT request_id, paper_id, place, score, row_number() OVER (PARTITION BY request_id ORDER BY score DESC, place) = 1 AS chosen FROM (
    SELECT c.request_id, c.paper_id, c.place, round({S.title_weight} * len(list_intersect(q, {sql_word_set("title")})) / len(q) + {S.abstract_weight} * len(list_intersect(q, {sql_word_set("abstract")})) / len(q)
      + CASE WHEN regexp_matches(regexp_replace(request, '[^\x00-\x7F]', 'Q', 'g'), '(?i)\b(recent|latest|new|newest|current|state[- ]of[- ]the[- ]art|sota|20\d\d)\b') AND try_cast(left(published_date, 10) AS DATE) IS NOT NULL THEN {S.recency_weight} * {_RECENCY} ELSE 0 END, 6) AS score
    FROM candidates c JOIN (SELECT request_id, request, {sql_word_set("request")} AS q FROM requests) r ON r.request_id = c.request_id JOIN papers p ON p.paper_id = c.paper_id
  )
)"""


def _ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    own, asked = papers(spark, sf_dir), requests(spark, sf_dir)
    return search.rank_candidates(search.relaxed_search(asked, search.paper_terms(own)), asked, own, TODAY)


@query(f"WITH {PAPERS}, {SEARCH}, {RANKED} SELECT * FROM ranked")
def heuristic_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _ranked(spark, sf_dir)


@query(
    f"""
WITH {PAPERS}, {SEARCH}, {RANKED}, n AS (SELECT *, count(*) OVER (PARTITION BY request_id) AS n, CASE WHEN request_id % 2 = 0 THEN request_id % 7 END AS proposed FROM ranked)
SELECT request_id, paper_id, CASE WHEN n = 1 THEN 'sole' WHEN proposed < n THEN 'proposed' ELSE 'score' END AS reason FROM n
WHERE CASE WHEN n = 1 THEN true WHEN proposed < n THEN place - 1 = proposed ELSE chosen END
"""
)
def select_paper(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second request has a proposal, some of them beyond the candidates."""
    proposals = requests(spark, sf_dir).where("request_id % 2 = 0").select("request_id", (F.col("request_id") % 7).cast("int").alias("proposed"))
    return search.select_paper(_ranked(spark, sf_dir), proposals)


# --- answers -----------------------------------------------------------------


def _found(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    own, asked = passages(spark, sf_dir), questions(spark, sf_dir)
    found = R.lexical_search(asked, I.build_index(own)).withColumn("score", F.round("score", 6))
    page = (1 + F.col("chunk_id") % 9).cast("int")
    return asked, found, own.withColumns({"section_heading": F.col("paper_id"), "page_number": page, "page_end": (page + F.col("chunk_id") % 2).cast("int")})


CITED = rf"""{TFIDF}, cited AS (
  SELECT f.question_id, f.paper_id, f.rank, f.chunk_id, f.paper_id AS section, CAST(1 + f.chunk_id % 9 AS INTEGER) AS page, (1 + f.chunk_id % 9) || CASE WHEN f.chunk_id % 2 = 1 THEN '–' || (2 + f.chunk_id % 9) ELSE '' END AS page_label,
    replace({sql_strip(f"left(p.text, {S.excerpt_chars})")}, chr(10), ' ') || '...' AS excerpt, round(round(f.score, 6), 3) AS relevance_score, p.text, round(f.score, 6) AS score
  FROM found f JOIN passages p ON p.paper_id = f.paper_id AND p.chunk_id = f.chunk_id
)"""


@query(f"WITH {CITED} SELECT question_id, paper_id, rank, chunk_id, section, page, page_label, excerpt, relevance_score FROM cited")
def citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, own = _found(spark, sf_dir)
    return context.sources(found, own).drop("quoted", "score")


@query(
    f"""
WITH {CITED} SELECT question_id, paper_id, string_agg('[Source ' || rank || '] (Section: ' || section || ', Page: ' || page_label || ', Relevance: ' || format('{{:.2f}}', score) || '):' || chr(10) || text || chr(10), chr(10) ORDER BY rank) AS context
FROM cited GROUP BY ALL
"""
)
def context_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, own = _found(spark, sf_dir)
    return context.contexts(found, own).select("question_id", "paper_id", "context")


@query(
    f"""
WITH {CITED}, top AS (SELECT question_id, arg_min(text, rank) AS text, arg_min(score, rank) AS score, count(*) AS n FROM cited GROUP BY 1)
SELECT q.question_id, q.paper_id, n IS NOT NULL AS is_grounded, CASE WHEN n IS NULL THEN 0.0 ELSE round(score, 3) END AS confidence, coalesce(CAST(n AS INTEGER), 0) AS n_citations FROM questions q LEFT JOIN top t ON t.question_id = q.question_id
"""
)
def qa_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of the offline stand-in, which quotes its first source."""
    asked, found, own = _found(spark, sf_dir)
    titles = own.select("paper_id").distinct().withColumn("title", F.col("paper_id"))
    done = qa.answers(qa.prompts(asked, found, own, titles), OfflineModel)
    return done.select("question_id", "paper_id", "is_grounded", "confidence", F.size("citations").alias("n_citations"))


@query(f"SELECT a.conv_id, a.turn, a.text AS question, b.text AS answer, {sql_refusal('b.text')} AS is_refusal FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1 WHERE a.role = 'user' AND b.role = 'assistant'")
def qa_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qa.history(table(spark, sf_dir, "conversations"))


# --- briefings ---------------------------------------------------------------

_GOOD = '"problem_statement": "p", "method_approach": ["m", " "], "key_results_claims": ["k"], "suggested_followup_questions": ["q"]'


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replies of a model: sound, fenced, surrounded by words, of wrong types, incomplete, or no JSON."""
    n = F.col("doc_id") % 7
    lead = F.concat(F.lit('{"summary_plain_english": "'), F.regexp_extract("text", r"[A-Za-z ]+", 0), F.lit('", '))
    reply = (
        F.when(n == 0, F.concat(lead, F.lit(_GOOD + ', "limitations": ["l"]}')))
        .when(n == 1, F.concat(F.lit("```json\n"), lead, F.lit(_GOOD + ', "limitations": []}\n```')))
        .when(n == 2, F.concat(F.lit("Here it is: "), lead, F.lit(_GOOD + ', "limitations": ["l"]} Done.')))
        .when(n == 3, F.concat(lead, F.lit(_GOOD + ', "limitations": [["nested"]]}')))
        .when(n == 4, F.concat(lead, F.lit(_GOOD + "}")))
        .when(n == 5, F.concat(lead, F.lit('"problem_statement": 5}')))
        .otherwise("no JSON at all")
    )
    return table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("paper_id"), reply.alias("reply"))


_BRIEF = rf"""brief AS (
  SELECT CAST(doc_id AS VARCHAR) AS paper_id, doc_id % 7 AS n, regexp_extract(text, '[A-Za-z ]+', 0) AS summary, text FROM documents
), parsed AS (
  SELECT paper_id, n, text, CASE n WHEN 3 THEN 'limitations is not a list of texts' WHEN 4 THEN 'limitations is not a list of texts' WHEN 5 THEN 'problem_statement is not a text' WHEN 6 THEN 'no JSON object' END AS problem,
    CASE WHEN n < 3 THEN summary END AS summary, CASE WHEN n < 3 THEN 'm' END AS methods, CASE WHEN n = 1 THEN '{briefing.NO_LIMITATIONS.replace("'", "''")}' WHEN n < 3 THEN 'l' END AS limitations FROM brief
)"""


@query(f"WITH {_BRIEF} SELECT paper_id, problem, summary, methods, limitations FROM parsed")
def briefing_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = briefing.parse(_replies(spark, sf_dir))
    return found.select("paper_id", "problem", F.col("parsed.summary_plain_english").alias("summary"), F.array_join("parsed.method_approach", "|").alias("methods"), F.array_join("parsed.limitations", "|").alias("limitations"))


@query(
    f"""
WITH {_BRIEF} SELECT paper_id, problem IS NOT NULL AS is_degraded, CASE WHEN problem IS NULL THEN summary WHEN text <> '' THEN text ELSE 'Not available: ' || problem || '. See the abstract, or ask questions.' END AS summary,
  CASE WHEN problem IS NULL THEN 'p' ELSE 'Not available: ' || problem || '. See the abstract, or ask questions.' END AS problem_statement, CASE WHEN problem IS NULL THEN 1 ELSE 3 END AS n_questions FROM parsed
"""
)
def degraded_briefing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = briefing.complete(briefing.parse(_replies(spark, sf_dir)), papers(spark, sf_dir))
    return done.select("paper_id", "is_degraded", F.col("summary_plain_english").alias("summary"), "problem_statement", F.size("suggested_followup_questions").alias("n_questions"))


@query(
    f"""
WITH {PAPERS}, {_BRIEF}, full_ AS (
  SELECT p.*, b.problem, b.summary, b.limitations, 'Not available: ' || b.problem || '. See the abstract, or ask questions.' AS missing FROM papers p JOIN parsed b ON b.paper_id = p.paper_id
)
SELECT paper_id, '# Briefing: ' || title || chr(10) || chr(10) || '**Authors:** ' || array_to_string(authors, ', ') || '  ' || chr(10) || '**ID:** [' || paper_id || '](' || abs_url || ') | **Published:** ' || published_date || chr(10) || chr(10) || '---' || chr(10)
  || chr(10) || '## 1. Why it matters' || chr(10) || CASE WHEN problem IS NULL THEN summary WHEN abstract <> '' THEN abstract ELSE missing END || chr(10)
  || chr(10) || '## 2. Problem' || chr(10) || coalesce(missing, 'p') || chr(10) || chr(10) || '## 3. Method' || chr(10) || '- ' || coalesce(missing, 'm') || chr(10)
  || chr(10) || '## 4. Results and claims' || chr(10) || '- ' || coalesce(missing, 'k') || chr(10) || chr(10) || '## 5. Limitations' || chr(10) || '- ' || coalesce(missing, limitations) || chr(10)
  || chr(10) || '## 6. Questions to ask next' || chr(10) || CASE WHEN problem IS NULL THEN '- q' ELSE array_to_string(list_transform({sql_list(briefing.STOCK_QUESTIONS)}, lambda x: '- ' || x), chr(10)) END || chr(10) AS markdown FROM full_
"""
)
def briefing_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return briefing.markdown(briefing.complete(briefing.parse(_replies(spark, sf_dir)), papers(spark, sf_dir)))


# --- evaluation --------------------------------------------------------------


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions of four kinds; evidence is the item's third and fourth word, or words that no text has."""
    n = F.col("question_id") % 4
    kind = F.when(n == 0, "lexical").when(n == 1, "paraphrase").when(n == 2, "unanswerable").otherwise("out_of_scope")
    evidence = F.when(F.col("question_id") % 8 == 1, F.array(F.lit("zz zz zz"))).otherwise(F.array(F.array_join(F.slice(F.split("question", " "), 3, 2), " ‑")))
    return questions(spark, sf_dir).withColumns({"kind": kind, "evidence": evidence, "answer_any": evidence})


LABELLED = """labelled AS (
  SELECT *, ['lexical', 'paraphrase', 'unanswerable', 'out_of_scope'][question_id % 4 + 1] AS kind,
    CASE WHEN question_id % 8 = 1 THEN 'zz zz zz' ELSE array_to_string(list_slice(string_split(question, ' '), 3, 4), ' ‑') END AS needle FROM questions
)"""
JUDGED = f"""{TFIDF}, {LABELLED}, held AS (
  SELECT l.question_id, bool_or(contains({sql_match_form("p.text")}, {sql_match_form("l.needle")})) AS hit FROM labelled l JOIN found f ON f.question_id = l.question_id JOIN passages p ON p.paper_id = f.paper_id AND p.chunk_id = f.chunk_id GROUP BY 1
), judged AS (
  SELECT l.question_id, kind, coalesce(hit, false) AND question_id % 4 < 2 AS hit, h.hit IS NULL AS gated FROM labelled l LEFT JOIN held h USING (question_id)
)"""


@query(f"WITH {JUDGED} SELECT question_id, kind, hit, gated FROM judged")
def eval_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, own = _found(spark, sf_dir)
    return evals.judge(labelled(spark, sf_dir), found, own)


@query(f"WITH {JUDGED} SELECT kind, count(*) AS n, count(*) FILTER (hit) AS hit, count(*) FILTER (gated) AS gated FROM judged GROUP BY 1")
def eval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, found, own = _found(spark, sf_dir)
    return evals.metrics(evals.judge(labelled(spark, sf_dir), found, own))


@query(
    f"""
WITH {QUESTIONS}, {LABELLED} SELECT question_id, paper_id FROM labelled l WHERE question_id % 4 < 2
AND NOT EXISTS (SELECT 1 FROM documents d WHERE d.source = l.paper_id AND contains({sql_match_form("d.text")}, {sql_match_form("l.needle")}))
"""
)
def stale_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evals.stale_evidence(labelled(spark, sf_dir), passages(spark, sf_dir))
