"""Text predicates and transformations as Column expressions.

Patterns carry ``(?U)``: word and space classes follow Unicode, as texts are in many
languages.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: words that carry no topic in questions and passages
STOPWORDS = (
    "a about above after again all also am an and any are as at be been being before below"
    " between both but by can could did do does doing down during each few for from further had"
    " has have having he her here hers him his how i if in into is it its itself just me more most"
    " my no nor not now of off on once only or other our ours out over own same she should so some"
    " such than that the their theirs them then there these they this those through to too under"
    " until up very was we were what when where which while who whom why will with would you your"
    " yours tell describe explain paper"
).split()

# fixed values: filler of search requests
FILLER = (
    "recent latest new work works on for the a an in of and to with paper papers study studies using about research survey"
).split()

# fixed values: how an answer says that the sources don't hold it
REFUSAL_MARKER = "NOT IN PAPER:"
REFUSAL_PHRASES = (
    "does not mention",
    "not covered in the paper",
    "cannot answer this question based on the",
    "not contain sufficient information",
    "the provided sources do not",
    "the context does not",
    "excerpts do not",
    "does not specify",
    "does not address",
)

# fixed values: patterns
PAPER_ID = (
    r"(?i)(?:arxiv:)?(?:(?:https?://)?(?:www\.)?arxiv\.org/(?:abs|pdf)/)?"
    r"(\d{4}\.\d{4,5}(?:v\d+)?|[a-z\-]+(?:\.[A-Z]{2})?/\d{7}(?:v\d+)?)"
)
RECENT = r"(?i)(?U)\b(recent|latest|new|newest|current|state[- ]of[- ]the[- ]art|sota|20\d\d)\b"
TOKEN = r"(?U)\b[a-zA-Z0-9_\-\.]{2,}\b"
SENTENCE_GAP = r"(?U)(?<=[.!?])\s+(?=[A-Z0-9])"
CAPTION = r"(?i)^(Table|Figure|Fig\.)\s*\d+"
NUMERIC_TOKEN = r"^[\d.,%×x()↑↓+\-–/]+$"
APPENDIX = r"^[A-H](?:\.\d+)*\s"


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def words(c: Column) -> Column:
    """White-space separated words."""
    return F.filter(F.split(c, r"(?U)\s+"), lambda w: w != "")


def clean_text(c: Column) -> Column:
    """White space collapsed and trimmed; null becomes empty."""
    return F.coalesce(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")), F.lit(""))


def sentences(c: Column) -> Column:
    return F.filter(F.transform(F.split(c, SENTENCE_GAP), strip), lambda s: s != "")


def tokens(c: Column) -> Column:
    """Index terms: lower-case, hyphenated ones whole and in parts, no stopwords; repeats stay."""
    whole = F.regexp_extract_all(F.lower(c), F.lit(TOKEN), F.lit(0))
    parts = F.transform(whole, lambda t: F.when(F.contains(t, F.lit("-")), F.concat(F.array(t), F.filter(F.split(t, "-"), lambda p: F.length(p) >= 2))).otherwise(F.array(t)))
    return F.filter(F.flatten(parts), lambda t: ~t.isin(STOPWORDS))


def word_set(c: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))


def search_terms(c: Column) -> Column:
    """A request's content words in order; if none is left, its words of two letters and more."""
    all_words = F.regexp_extract_all(c, F.lit(r"[a-zA-Z0-9_\-]+"), F.lit(0))
    content = F.filter(all_words, lambda t: (F.length(t) > 2) & ~F.lower(t).isin(FILLER))
    return F.when(F.size(content) > 0, content).otherwise(F.filter(all_words, lambda t: F.length(t) > 1))


def search_query(c: Column) -> Column:
    """The search expression of a request: up to five terms, all required."""
    terms = F.slice(search_terms(c), 1, 5)
    return F.when(F.size(terms) > 0, F.array_join(F.transform(terms, lambda t: F.concat(F.lit("all:"), t)), " AND ")).otherwise(F.concat(F.lit("all:"), strip(c)))


def intent(c: Column) -> dict[str, Column]:
    """Columns intent (DIRECT_ID, TOPIC_SEARCH, or null for a blank request), paper_id and topic."""
    query = strip(c)
    match = F.regexp_extract(query, PAPER_ID, 0)
    lowered = F.lower(query)
    link = F.contains(lowered, F.lit("arxiv.org/")) | F.startswith(lowered, F.lit("arxiv:"))
    direct = (F.length(match) > 0) & ((F.length(match) >= 0.7 * F.length(query)) | link)
    blank = F.coalesce(query == "", F.lit(True))
    return {
        "intent": F.when(blank, None).when(direct, "DIRECT_ID").otherwise("TOPIC_SEARCH"),
        "paper_id": F.when(~blank & direct, strip_version(F.regexp_extract(query, PAPER_ID, 1))),
        "topic": F.when(~blank & ~direct, strip(F.regexp_replace(query, r'(?U)[^\w\s\-\+"]', " "))),
    }


def strip_version(c: Column) -> Column:
    return F.regexp_replace(c, r"v\d+$", "")


def wants_recent(c: Column) -> Column:
    return c.rlike(RECENT)


def is_table_like(c: Column) -> Column:
    """Rebuilt table rows, or text of at least 8 tokens of which two fifths are numeric."""
    own = words(c)
    numeric = F.size(F.filter(own, lambda t: t.rlike(NUMERIC_TOKEN)))
    return F.contains(c, F.lit(" | ")) | ((F.size(own) >= 8) & (numeric >= 0.4 * F.size(own)))


def is_float_debris(c: Column) -> Column:
    """Captions, and short labels that are no sentence."""
    text = strip(c)
    sentence = F.contains(text, F.lit(". ")) | text.rlike(r"[.?!:\-]$")
    return text.rlike(CAPTION) | ((F.size(words(text)) < 12) & ~sentence)


def is_prose(c: Column) -> Column:
    return (F.size(words(c)) >= 4) & ~is_table_like(c) & ~is_float_debris(c)


def prose_only(c: Column, separator: str = "\n\n") -> Column:
    """The prose paragraphs of a text; a word that a removed float had split is joined again."""
    kept = F.filter(F.split(c, separator), is_prose)
    glue = "\x01"
    # a paragraph that ends in a hyphen goes on in the next kept one if that begins in lower case
    return F.replace(F.regexp_replace(F.array_join(kept, glue), rf"(?U)-{glue}(?=\p{{Lower}})", ""), F.lit(glue), F.lit(separator))


def is_refusal(c: Column) -> Column:
    head = F.regexp_replace(strip(c), r"^[*_ ]+", "")
    lowered = F.lower(c)
    phrases = F.lit(False)
    for phrase in REFUSAL_PHRASES:
        phrases = phrases | F.contains(lowered, F.lit(phrase))
    return F.startswith(F.upper(head), F.lit(REFUSAL_MARKER)) | phrases


def refusal_reason(c: Column) -> Column:
    """What follows a leading refusal marker, else null."""
    head = F.regexp_replace(strip(c), r"^[*_ ]+", "")
    rest = strip(F.regexp_replace(head.substr(F.lit(len(REFUSAL_MARKER) + 1), F.length(head)), r"^[*_ ]+", ""))
    return F.when(F.startswith(F.upper(head), F.lit(REFUSAL_MARKER)), rest)


def match_form(c: Column) -> Column:
    """A text without white space, table bars and kinds of dashes, in lower case."""
    return F.lower(F.regexp_replace(F.translate(c, "‐‑‒–−", "-----"), r"(?U)[\s|  ]+", ""))


def contains_any(text: Column, needles: Column) -> Column:
    own = match_form(text)
    return F.exists(needles, lambda n: F.contains(own, match_form(n)))


def page_label(first: Column, last: Column) -> Column:
    return F.when(last.isNotNull() & (last != first), F.concat(first.cast("string"), F.lit("–"), last.cast("string"))).otherwise(first.cast("string"))
