"""What a language model gets to read: sections under a budget, and quoted sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.config import Settings
from paperloom.functions.text import APPENDIX, page_label, prose_only, strip

# fixed values: stems of the headings that a briefing needs
PRIORITY = ("intro", "method", "approach", "architect", "design", "result", "experiment", "eval", "limit", "discuss", "conclu")
FALLBACK_SECTIONS = 4


def priority_sections(sections: DataFrame) -> DataFrame:
    """The main sections with a wanted heading; else the first four main ones; else the first four."""
    lowered = F.lower(F.coalesce("heading", F.lit("")))
    wanted = F.lit(False)
    for stem in PRIORITY:
        wanted = wanted | F.contains(lowered, F.lit(stem))
    marked = sections.withColumns({"__main": ~F.coalesce(F.col("heading"), F.lit("")).rlike(APPENDIX), "__wanted": wanted})
    level = F.when(F.col("__main") & F.col("__wanted"), 0).when(F.col("__main"), 1).otherwise(2)
    marked = marked.withColumn("__level", level)
    # of each paper: its best level, and the places of its first sections
    firsts = lambda c: F.slice(F.array_sort(F.collect_list(F.when(c, F.col("section_index")))), 1, FALLBACK_SECTIONS)
    best = marked.groupBy("paper_id").agg(F.min("__level").alias("__best"), firsts(F.col("__main")).alias("__main_first"), firsts(F.lit(True)).alias("__first"))
    kept = (
        F.when(F.col("__best") == 0, F.col("__level") == 0)
        .when(F.col("__best") == 1, F.array_contains("__main_first", F.col("section_index")))
        .otherwise(F.array_contains("__first", F.col("section_index")))
    )
    return marked.join(best, "paper_id").where(kept).select(*sections.columns)


def section_budgets(papers: DataFrame, sections: DataFrame, settings: Settings = Settings(), separator: str = "\n\n") -> DataFrame:
    """paper_id, section_index, share and excerpt: what each section may take of the paper's budget.

    A section's share is the rest divided by the sections that are left; what it
    leaves unused goes on to the later ones; shares under the least end the list.
    """
    header = sum((F.length(F.coalesce(c, F.lit(""))) for c in ("title", "authors_line", "paper_id", "published_date", "abstract")), F.lit(0))
    labels = len("Title: ") + len("Authors: ") + len("arXiv ID: ") + len("Published: ") + len("Abstract:\n\n")
    wanted = priority_sections(sections).withColumn("__prose", prose_only(F.col("content"), separator))
    own = wanted.groupBy("paper_id").agg(F.array_sort(F.collect_list(F.struct("section_index", "__prose"))).alias("own"))  # a paper's sections
    start = papers.withColumn("authors_line", F.array_join("authors", ", ")).select("paper_id", (F.lit(settings.context_chars - labels) - header).cast("long").alias("budget"))
    share_of = lambda acc: F.floor(acc["rest"] / acc["left"])
    zero = F.struct(F.col("budget").alias("rest"), F.size("own").cast("long").alias("left"), F.lit(True).alias("open"), F.expr("cast(array() as array<struct<section_index:int,share:bigint,excerpt:string>>)").alias("out"))

    def step(acc, section):
        share = share_of(acc)
        text = strip(F.substring(section["__prose"], F.lit(1), share.cast("int")))
        taken = F.transform(F.array(text), lambda t: F.struct((acc["rest"] - F.length(t)).alias("rest"), (acc["left"] - 1).alias("left"), F.lit(True).alias("open"), F.concat(acc["out"], F.array(F.struct(section["section_index"].cast("int").alias("section_index"), share.alias("share"), t.alias("excerpt")))).alias("out")))[0]
        closed = F.struct(acc["rest"].alias("rest"), acc["left"].alias("left"), F.lit(False).alias("open"), acc["out"].alias("out"))
        return F.when(acc["open"] & (share >= settings.least_share), taken).otherwise(closed)

    folded = own.join(start, "paper_id").select("paper_id", F.explode(F.aggregate("own", zero, step, lambda acc: acc["out"])).alias("x"))
    return folded.select("paper_id", "x.*")


def briefing_context(papers: DataFrame, sections: DataFrame, settings: Settings = Settings(), separator: str = "\n\n") -> DataFrame:
    """paper_id and the text that a briefing is written from."""
    parts = section_budgets(papers, sections, settings, separator).join(sections.select("paper_id", "section_index", "heading", "page_start", "page_end"), ["paper_id", "section_index"])
    shown = F.format_string("--- Section: %s (pp. %d-%d) ---\n%s\n", "heading", "page_start", "page_end", "excerpt")
    listed = F.array_sort(F.collect_list(F.struct("section_index", shown.alias("text"))))  # a paper's sections
    bodies = parts.groupBy("paper_id").agg(F.array_join(F.transform(listed, lambda x: x["text"]), "\n\n").alias("body"))
    record = F.concat_ws("\n\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Authors: "), F.array_join("authors", ", ")), F.concat(F.lit("arXiv ID: "), "paper_id"), F.concat(F.lit("Published: "), "published_date"), F.concat(F.lit("Abstract:\n"), F.coalesce("abstract", F.lit("")), F.lit("\n")), "body")
    return papers.join(bodies, "paper_id", "left").select("paper_id", record.alias("context"))


def sources(found: DataFrame, chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Retrieved rows (question_id, paper_id, chunk_id, rank, score) with their text, as quoted and as cited."""
    both = found.join(chunks.select("paper_id", "chunk_id", "section_heading", "text", "page_number", "page_end"), ["paper_id", "chunk_id"])
    label = page_label(F.col("page_number"), F.col("page_end"))
    quoted = F.concat(F.lit("[Source "), F.col("rank").cast("string"), F.lit("] (Section: "), "section_heading", F.lit(", Page: "), label, F.lit(", Relevance: "), F.format_string("%.2f", "score"), F.lit("):\n"), "text", F.lit("\n"))
    excerpt = F.concat(F.replace(strip(F.substring("text", 1, settings.excerpt_chars)), F.lit("\n"), F.lit(" ")), F.lit("..."))
    return both.select("question_id", "paper_id", "rank", "chunk_id", F.col("section_heading").alias("section"), F.col("page_number").alias("page"), label.alias("page_label"), excerpt.alias("excerpt"), F.round("score", 3).alias("relevance_score"), quoted.alias("quoted"), "score")


def contexts(found: DataFrame, chunks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """question_id, paper_id, the quoted sources as one text, citations, and the first source's score."""
    cited = F.struct("rank", "chunk_id", "section", "page", "page_label", "excerpt", "relevance_score", "quoted", "score")
    rows = sources(found, chunks, settings).groupBy("question_id", "paper_id").agg(F.array_sort(F.collect_list(cited)).alias("own"))  # top_k rows
    citations = F.transform("own", lambda x: F.struct(*[x[c].alias(c) for c in ("chunk_id", "section", "page", "page_label", "excerpt", "relevance_score")]))
    return rows.select("question_id", "paper_id", F.array_join(F.transform("own", lambda x: x["quoted"]), "\n").alias("context"), citations.alias("citations"), F.col("own")[0]["score"].alias("top_score"))
