"""The engine's two jobs on batches: analyze requests into briefings, and answer questions."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.config import Settings
from paperloom.functions.text import intent
from paperloom.operators import briefing, chunking, qa, search
from paperloom.operators.context import briefing_context
from paperloom.operators.index import Index, build_index
from paperloom.operators.retrieve import hybrid_search, lexical_search, overlap_rerank
from paperloom.plans.flow import END, Flow
from paperloom.providers import get_provider
from paperloom.providers.base import LanguageModel, Reranker
from paperloom.providers.models import rerank
from paperloom.sources.sessions import load_index, save_index


@dataclass
class Library:
    """Papers with their sections, passages, index, and (for hybrid retrieval) passage vectors."""

    papers: DataFrame
    sections: DataFrame
    chunks: DataFrame
    index: Index
    vectors: DataFrame | None = None


def save_library(library: Library, path: str) -> Library:
    """The library with its passages and index written under ``path``, and read from there: built once for all questions."""
    spark = library.papers.sparkSession
    library.chunks.write.mode("overwrite").parquet(f"{path}/chunks")
    chunks = spark.read.parquet(f"{path}/chunks")
    save_index(build_index(chunks), f"{path}/index")
    return replace(library, chunks=chunks, index=load_index(spark, f"{path}/index"))


def open_library(papers: DataFrame, sections: DataFrame, path: str, vectors: DataFrame | None = None) -> Library:
    """A library saved by ``save_library``; nothing is built again, unless saved passages lack a paper's record."""
    spark = papers.sparkSession
    saved = spark.read.parquet(f"{path}/chunks")
    lacking = saved.groupBy("paper_id").agg(F.max(F.col("chunk_id") == "metadata").alias("known")).where("not known")
    if lacking.isEmpty():
        return Library(papers, sections, saved, load_index(spark, f"{path}/index"), vectors)
    chunks = chunking.repair_metadata(saved, papers)
    return Library(papers, sections, chunks, build_index(chunks), vectors)


def build_library(papers: DataFrame, sections: DataFrame, settings: Settings = Settings(), separator: str = "\n\n", vectors: DataFrame | None = None) -> Library:
    chunks = chunking.all_chunks(papers, sections, settings, separator)
    return Library(papers, sections, chunks, build_index(chunks), vectors)


def choose_papers(requests: DataFrame, papers: DataFrame, today: str, settings: Settings = Settings()) -> DataFrame:
    """request_id, intent, paper_id and reason of each request; paper_id is null where nothing is found."""
    asked = requests.withColumns({k: v for k, v in intent(F.col("request")).items()})
    direct = search.id_lookup(asked.where("intent = 'DIRECT_ID'").select("request_id", F.col("paper_id").alias("wanted")), papers).select("request_id", "paper_id", F.lit("direct").alias("reason"))
    topics = asked.where("intent = 'TOPIC_SEARCH'").select("request_id", "request")
    candidates = search.relaxed_search(topics, search.paper_terms(papers), settings)
    chosen = search.select_paper(search.rank_candidates(candidates, topics, papers, today, settings))
    return asked.select("request_id", "intent").join(direct.unionByName(chosen), "request_id", "left")


def analyze(requests: DataFrame, library: Library, today: str, settings: Settings = Settings(), make: Callable[[], LanguageModel] | None = None, separator: str = "\n\n") -> DataFrame:
    """Briefings of the papers that the requests lead to, each paper once, with the requests' ids."""
    found = choose_papers(requests, library.papers, today, settings).where(F.col("paper_id").isNotNull())
    wanted = library.papers.join(found.select("paper_id").distinct(), "paper_id", "left_semi")
    contexts = briefing_context(wanted, library.sections.join(wanted.select("paper_id"), "paper_id", "left_semi"), settings, separator)
    written = briefing.write(contexts, wanted, make or (lambda: get_provider(settings)))
    return found.join(written, "paper_id")


def retrieve(questions: DataFrame, library: Library, settings: Settings = Settings(), reranker: Callable[[], Reranker] | None = None) -> DataFrame:
    """Hybrid where the library has vectors and the questions too, else lexical.

    In the mode hybrid+rerank, and in the mode auto where a ``reranker`` is given, it
    orders the fused pool; without one, the share of the question's terms does.
    """
    mode = settings.retrieval_mode
    able = library.vectors is not None and "vector" in questions.columns
    if mode.startswith("hybrid") and not able:
        raise ValueError("hybrid retrieval needs vectors of passages and questions")
    if mode != "tfidf" and able:
        order = None
        if mode == "hybrid+rerank" or (mode == "auto" and reranker):
            order = rerank(reranker, questions, library.chunks) if reranker else overlap_rerank(questions, library.chunks)
        return hybrid_search(questions, library.index, library.vectors, settings, order)
    return lexical_search(questions, library.index, settings)


def ask(questions: DataFrame, library: Library, settings: Settings = Settings(), make: Callable[[], LanguageModel] | None = None, reranker: Callable[[], Reranker] | None = None) -> DataFrame:
    """Answers to questions (question_id, paper_id, question).

    The result calls the model whenever it is evaluated: write it once, and read that.
    """
    found = retrieve(questions, library, settings, reranker)
    return qa.answers(qa.prompts(questions, found, library.chunks, library.papers, settings), make or (lambda: get_provider(settings)))


def research_flow(steps: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> Flow:
    """The workflow of both jobs; ``steps`` replaces what a named step does (default: nothing)."""
    steps = steps or {}
    about = {
        "understand": "direct id or topic",
        "find": "search or look up",
        "rank": "choose a candidate",
        "parse": "layout to sections",
        "chunk": "sections to passages",
        "index": "postings and vectors",
        "brief": "structured briefing",
        "answer": "grounded answer",
        "save": "write the session",
    }
    flow = Flow()
    for name, text in about.items():
        flow.step(name, steps.get(name, lambda df: df), text)
    flow.entry("analyze", "understand").entry("ask", "answer")
    flow.edge("understand", "find").edge("find", "rank", F.col("intent") == "TOPIC_SEARCH", "topic").edge("find", "parse", label="direct id")
    for a, b in (("rank", "parse"), ("parse", "chunk"), ("chunk", "index"), ("index", "brief"), ("brief", "save"), ("answer", "save"), ("save", END)):
        flow.edge(a, b)
    return flow.validate()
