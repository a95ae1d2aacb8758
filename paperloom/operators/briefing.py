"""Structured briefings: parse a model's JSON strictly, complete it from metadata, render it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.functions.text import strip
from paperloom.providers.base import LanguageModel
from paperloom.providers.models import generate

TEXTS = ("summary_plain_english", "problem_statement")
LISTS = ("method_approach", "key_results_claims", "limitations", "suggested_followup_questions")
NO_LIMITATIONS = "No limitations were reported; see the paper's own discussion of them."
STOCK_QUESTIONS = ("Which question do the authors set out to answer?", "What did their experiments show?", "Where does the approach fall short?")
SYSTEM = "You write accurate briefings of scientific papers. Reply with one JSON object and nothing else; state only what the text says."


def _json_text(reply: Column) -> Column:
    """The outermost braces of a reply, without a code fence."""
    inner = F.regexp_extract(reply, r"(?s)\{.*\}", 0)
    return F.when(F.length(inner) > 0, inner)


def _is_text(value: Column) -> Column:
    return F.schema_of_variant(value) == "STRING"



def parse(replies: DataFrame, reply: str = "reply") -> DataFrame:
    """Adds ``parsed`` (the briefing's fields, or null) and ``problem`` (or null).

    from_json would turn a nested list into text; the types are checked on the
    variant first.
    """
    doc = replies.withColumn("__json", _json_text(strip(F.col(reply)))).withColumn("__v", F.try_parse_json("__json"))
    problem = F.when(F.col("__v").isNull(), F.lit("no JSON object"))
    for name in TEXTS:
        value = F.try_variant_get("__v", f"$.{name}", "variant")
        problem = problem.when(~F.coalesce(_is_text(value), F.lit(False)), F.lit(f"{name} is not a text"))
    for name in LISTS:
        value = F.try_variant_get("__v", f"$.{name}", "variant")
        items = F.try_variant_get("__v", f"$.{name}", "array<string>")
        kind = F.schema_of_variant(value)
        texts = kind.isin("ARRAY<STRING>", "ARRAY<VOID>", "ARRAY") & ~F.exists(items, lambda x: x.isNull())
        problem = problem.when(~F.coalesce(texts, F.lit(False)), F.lit(f"{name} is not a list of texts"))
    schema = ", ".join([*(f"{n} string" for n in TEXTS), *(f"{n} array<string>" for n in LISTS)])
    fields = F.from_json("__json", schema)
    clean = [fields[n].alias(n) for n in TEXTS]
    for name in LISTS:
        items = F.filter(F.transform(fields[name], strip), lambda x: x != "")
        clean.append((F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(NO_LIMITATIONS))) if name == "limitations" else items).alias(name))
    checked = doc.withColumn("problem", problem)
    return checked.withColumn("parsed", F.when(F.col("problem").isNull(), F.struct(*clean))).drop("__json", "__v")


def degraded(abstract: Column, reason: Column) -> Column:
    """The fields of a briefing that a model could not write: the abstract, and notes that the rest is missing."""
    missing = F.concat(F.lit("Not available: "), reason, F.lit(". See the abstract, or ask questions."))
    has = F.coalesce(abstract, F.lit("")) != ""
    return F.struct(
        F.when(has, abstract).otherwise(missing).alias("summary_plain_english"),
        missing.alias("problem_statement"),
        *[F.array(missing).alias(n) for n in LISTS[:3]],
        F.array(*[F.lit(q) for q in STOCK_QUESTIONS]).alias("suggested_followup_questions"),
    )


def complete(parsed: DataFrame, papers: DataFrame) -> DataFrame:
    """Briefings (paper_id, identity from the paper's metadata, all fields, degraded) of parsed replies."""
    both = papers.select("paper_id", "title", "authors", "published_date", "abs_url", "abstract").join(parsed.select("paper_id", "parsed", "problem"), "paper_id", "left")
    fields = F.coalesce("parsed", degraded(F.col("abstract"), F.coalesce("problem", F.lit("no reply"))))
    return both.withColumn("__f", fields).select("paper_id", "title", "authors", F.col("published_date").alias("publish_date"), F.col("abs_url").alias("link"), *[F.col(f"__f.{n}").alias(n) for n in (*TEXTS, *LISTS)], F.col("parsed").isNull().alias("is_degraded"))


def prompt(context: Column, problem: Column | None = None) -> Column:
    wanted = ", ".join([*(f'"{n}": text' for n in TEXTS), *(f'"{n}": list of texts' for n in LISTS)])
    text = F.concat(F.lit(f"Write a briefing of this paper as one JSON object with the keys {{{wanted}}}.\n\n"), context)
    return text if problem is None else F.concat(text, F.lit("\n\nYour last reply could not be used ("), problem, F.lit("). Reply with the corrected JSON object only."))


def write(contexts: DataFrame, papers: DataFrame, make: Callable[[], LanguageModel]) -> DataFrame:
    """Briefings of papers with a context; a reply that can't be used is asked for once more, with the reason."""
    first = contexts.withColumn("__r", generate(make, prompt(F.col("context")), SYSTEM, True))
    first = parse(first.withColumns({"reply": F.col("__r.text"), "error": F.col("__r.error")}).drop("__r"))
    good = first.where(F.col("problem").isNull() | F.col("error").isNotNull())
    again = first.where(F.col("problem").isNotNull() & F.col("error").isNull()).withColumn("__r", generate(make, prompt(F.col("context"), F.col("problem")), SYSTEM, True))
    second = parse(again.select("paper_id", "context", F.col("__r.text").alias("reply"), F.col("__r.error").alias("error")))
    both = good.select("paper_id", "parsed", F.coalesce("error", "problem").alias("problem")).unionByName(second.select("paper_id", "parsed", F.coalesce("error", "problem").alias("problem")))
    return complete(both, papers)


def markdown(briefings: DataFrame) -> DataFrame:
    """paper_id and the briefing as Markdown."""
    bullets = lambda c: F.array_join(F.transform(c, lambda x: F.concat(F.lit("- "), x)), "\n")
    authors = F.when(F.size(F.coalesce("authors", F.array().cast("array<string>"))) > 0, F.array_join("authors", ", ")).otherwise("Unknown Authors")
    parts = [F.lit("# Briefing: "), F.col("title"), F.lit("\n\n**Authors:** "), authors, F.lit("  \n**ID:** ["), F.col("paper_id"), F.lit("]("), F.col("link"), F.lit(") | **Published:** "), F.col("publish_date"), F.lit("\n\n---\n")]
    headings = (("Why it matters", F.col(TEXTS[0])), ("Problem", F.col(TEXTS[1])), ("Method", bullets(LISTS[0])), ("Results and claims", bullets(LISTS[1])), ("Limitations", bullets(LISTS[2])), ("Questions to ask next", bullets(LISTS[3])))
    for i, (name, body) in enumerate(headings):
        parts += [F.lit(f"\n## {i + 1}. {name}\n"), body, F.lit("\n")]
    return briefings.select("paper_id", F.concat(*[F.coalesce(p, F.lit("")) for p in parts]).alias("markdown"))
