"""Queries of the text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.functions import text as T
from paperloom.plans.registry import query, table

_ASCII = r"regexp_replace({c}, '[^\x00-\x7F]', 'Q', 'g')"


def sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sql_tokens(c: str) -> str:
    """Index terms in SQL.  RE2's word bounds are ASCII, so other letters first become one that is no term character."""
    lowered = _ASCII.format(c=f"lower({c})")
    return (
        rf"list_filter(flatten(list_transform(regexp_extract_all({lowered}, '\b[a-z0-9_\-\.]{{2,}}\b'), lambda t: CASE WHEN contains(t, '-') "
        rf"THEN list_concat([t], list_filter(string_split(t, '-'), lambda p: length(p) >= 2)) ELSE [t] END)), lambda t: NOT list_contains({sql_list(T.STOPWORDS)}, t))"
    )


def sql_words(c: str) -> str:
    return rf"list_filter(string_split_regex({c}, '\s+'), lambda w: w <> '')"


def sql_strip(c: str) -> str:
    return rf"regexp_replace({c}, '^\s+|\s+$', '', 'g')"


def sql_terms(c: str) -> str:
    """Search terms in SQL."""
    all_words = rf"regexp_extract_all({c}, '[a-zA-Z0-9_\-]+')"
    content = f"list_filter({all_words}, lambda t: length(t) > 2 AND NOT list_contains({sql_list(T.FILLER)}, lower(t)))"
    return f"CASE WHEN len({content}) > 0 THEN {content} ELSE list_filter({all_words}, lambda t: length(t) > 1) END"


def sql_word_set(c: str) -> str:
    return rf"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}\p{{M}}_]+'))"


def sql_match_form(c: str) -> str:
    return rf"lower(regexp_replace(translate({c}, '‐‑‒–−', '-----'), '[\s|  ]+', '', 'g'))"


def sql_is_table(c: str) -> str:
    numeric = rf"len(list_filter({sql_words(c)}, lambda t: regexp_matches(t, '{T.NUMERIC_TOKEN}')))"
    return f"(contains({c}, ' | ') OR (len({sql_words(c)}) >= 8 AND {numeric} >= 0.4 * len({sql_words(c)})))"


def sql_is_debris(c: str) -> str:
    own = sql_strip(c)
    return rf"(regexp_matches({own}, '{T.CAPTION}') OR (len({sql_words(own)}) < 12 AND NOT (contains({own}, '. ') OR regexp_matches({own}, '[.?!:\-]$'))))"


def sql_is_prose(c: str) -> str:
    return f"(len({sql_words(c)}) >= 4 AND NOT {sql_is_table(c)} AND NOT {sql_is_debris(c)})"


def sql_prose(c: str, separator: str = "chr(10)") -> str:
    kept = f"list_filter(string_split({c}, {separator}), lambda p: {sql_is_prose('p')})"
    return rf"replace(regexp_replace(array_to_string({kept}, chr(1)), '-\x01(\p{{Ll}})', '\1', 'g'), chr(1), {separator})"


def sql_refusal(c: str) -> str:
    phrases = " OR ".join(f"contains(lower({c}), '{p}')" for p in T.REFUSAL_PHRASES)
    return rf"(starts_with(upper(regexp_replace({sql_strip(c)}, '^[*_ ]+', '')), '{T.REFUSAL_MARKER}') OR {phrases})"


@query(r"SELECT doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) AS cleaned FROM documents")
def clean_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.clean_text(F.col("text")).alias("cleaned"))


@query(
    rf"""
WITH s AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+([A-Z0-9])', '\1' || chr(1) || '\2', 'g'), chr(1)), lambda x: {sql_strip("x")}), lambda x: x <> '') AS own FROM documents)
SELECT doc_id, CAST(unnest(generate_series(0, len(own) - 1)) AS INTEGER) AS pos, unnest(own) AS sentence FROM s WHERE len(own) > 0
"""
)
def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("pos", "sentence"))


@query(f"WITH s AS (SELECT doc_id, {sql_tokens('text')} AS own FROM documents) SELECT doc_id, CAST(unnest(generate_series(0, len(own) - 1)) AS INTEGER) AS pos, unnest(own) AS term FROM s WHERE len(own) > 0")
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(T.tokens(F.col("text"))).alias("pos", "term"))


@query(f"SELECT conv_id, turn, array_to_string({sql_terms('text')}, ' ') AS terms FROM conversations")
def search_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.array_join(T.search_terms(F.col("text")), " ").alias("terms"))


@query(
    f"""
WITH t AS (SELECT conv_id, turn, text, list_slice({sql_terms("text")}, 1, 5) AS terms FROM conversations)
SELECT conv_id, turn, CASE WHEN len(terms) > 0 THEN array_to_string(list_transform(terms, lambda x: 'all:' || x), ' AND ') ELSE 'all:' || {sql_strip("text")} END AS search_query FROM t
"""
)
def search_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.search_query(F.col("text")).alias("search_query"))


#: Requests of every form, made from pages.
REQUESTS = """requests AS (
  SELECT page_id, CASE page_id % 8
    WHEN 0 THEN 'arxiv:24' || lpad(CAST(page_id % 100 AS VARCHAR), 2, '0') || '.' || lpad(CAST(page_id % 100000 AS VARCHAR), 5, '0') || 'v2'
    WHEN 1 THEN 'https://www.arxiv.org/pdf/1706.0' || lpad(CAST(page_id % 10000 AS VARCHAR), 4, '0')
    WHEN 2 THEN '  math.GT/0309' || lpad(CAST(page_id % 1000 AS VARCHAR), 3, '0') || ' '
    WHEN 3 THEN 'what does 1706.03762 say, and who cites it? ' || url
    WHEN 4 THEN 'arxiv.org/abs/nothing'
    WHEN 5 THEN '   '
    ELSE url END AS request FROM pages
)"""


@query(
    rf"""
WITH {REQUESTS}, m AS (
  SELECT page_id, {sql_strip("request")} AS q, regexp_extract({sql_strip("request")}, '{T.PAPER_ID}', 0) AS whole, regexp_extract({sql_strip("request")}, '{T.PAPER_ID}', 1) AS id FROM requests
), d AS (
  SELECT *, length(whole) > 0 AND (length(whole) >= 0.7 * length(q) OR contains(lower(q), 'arxiv.org/') OR starts_with(lower(q), 'arxiv:')) AS direct FROM m
)
SELECT page_id, CASE WHEN q = '' THEN NULL WHEN direct THEN 'DIRECT_ID' ELSE 'TOPIC_SEARCH' END AS intent,
  CASE WHEN q <> '' AND direct THEN regexp_replace(id, 'v\d+$', '') END AS paper_id,
  CASE WHEN q <> '' AND NOT direct THEN {sql_strip(r"regexp_replace(q, '[^\p{L}\p{N}\p{M}_\s\-\+" + '"' + r"]', ' ', 'g')")} END AS topic FROM d
"""
)
def intent(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    pad = lambda c, k: F.lpad(c.cast("string"), k, "0")
    request = (
        F.when(n % 8 == 0, F.concat(F.lit("arxiv:24"), pad(n % 100, 2), F.lit("."), pad(n % 100000, 5), F.lit("v2")))
        .when(n % 8 == 1, F.concat(F.lit("https://www.arxiv.org/pdf/1706.0"), pad(n % 10000, 4)))
        .when(n % 8 == 2, F.concat(F.lit("  math.GT/0309"), pad(n % 1000, 3), F.lit(" ")))
        .when(n % 8 == 3, F.concat(F.lit("what does 1706.03762 say, and who cites it? "), "url"))
        .when(n % 8 == 4, "arxiv.org/abs/nothing")
        .when(n % 8 == 5, "   ")
        .otherwise(F.col("url"))
    )
    rows = table(spark, sf_dir, "pages").select("page_id", request.alias("request"))
    return rows.select("page_id", *[c.alias(name) for name, c in T.intent(F.col("request")).items()])


@query(rf"SELECT doc_id, regexp_matches({_ASCII.format(c='text')}, '(?i)\b(recent|latest|new|newest|current|state[- ]of[- ]the[- ]art|sota|20\d\d)\b') AS recent FROM documents")
def wants_recent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.wants_recent(F.col("text")).alias("recent"))


@query(
    f"""
WITH s AS (SELECT doc_id, string_split(text, chr(10)) AS own FROM documents), p AS (
  SELECT doc_id, CAST(unnest(generate_series(0, len(own) - 1)) AS INTEGER) AS pos, unnest(own) AS p FROM s)
SELECT doc_id, pos, {sql_is_table("p")} AS table_like, {sql_is_debris("p")} AS debris, {sql_is_prose("p")} AS prose FROM p
"""
)
def prose_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "p"))
    return rows.select("doc_id", "pos", T.is_table_like(p).alias("table_like"), T.is_float_debris(p).alias("debris"), T.is_prose(p).alias("prose"))


@query(f"SELECT doc_id, {sql_prose('text')} AS prose FROM documents")
def prose_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.prose_only(F.col("text"), "\n").alias("prose"))


#: Every fifth turn refuses in one of the known ways.
_ANSWER = "CASE turn % 5 WHEN 0 THEN '**NOT IN PAPER:** ' || text WHEN 1 THEN 'The context does not say. ' || text ELSE text END"


@query(f"WITH a AS (SELECT conv_id, turn, {_ANSWER} AS answer FROM conversations) SELECT conv_id, turn, {sql_refusal('answer')} AS refusal FROM a")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("turn") % 5
    answer = F.when(turn == 0, F.concat(F.lit("**NOT IN PAPER:** "), "text")).when(turn == 1, F.concat(F.lit("The context does not say. "), "text")).otherwise(F.col("text"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", T.is_refusal(answer).alias("refusal"))


@query(f"SELECT doc_id, {sql_match_form('text')} AS form FROM documents")
def eval_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.match_form(F.col("text")).alias("form"))
