"""Command line: ask questions of a saved library, or print the workflow."""

from __future__ import annotations

import argparse
import sys

from paperloom.config import load_settings


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="paperloom", description="Briefings of papers and answers from them, in batches.")
    p.add_argument("request", nargs="?", help="a topic or a paper's id")
    p.add_argument("--papers", help="Parquet table of papers")
    p.add_argument("--sections", help="Parquet table of sections")
    p.add_argument("--questions", help="Parquet table of questions to answer")
    p.add_argument("--provider", help="groq, gemini, ollama or mock")
    p.add_argument("--mock", action="store_true", help="the offline stand-in")
    p.add_argument("--out", help="where to write results (Parquet)")
    p.add_argument("--session", help="folder of a session: a request begins it, without one it goes on with its paper and answers")
    p.add_argument("--library", help="folder of saved passages and index; written if it isn't there")
    p.add_argument("--export-json", help="where to write results as JSON lines")
    p.add_argument("--export-md", help="where to write briefings as Markdown rows (Parquet)")
    p.add_argument("--paper", help="the paper that questions typed in are asked of")
    p.add_argument("--no-interactive", action="store_true", help="don't wait for questions")
    p.add_argument("--today", default="2026-01-01", help="the day that recency is counted from")
    p.add_argument("--graph", action="store_true", help="print the workflow as Mermaid")
    return p


def main(argv: list[str] | None = None) -> int:
    """0, or 1 for missing input, 2 for a provider that is not configured, 130 for an interrupt."""
    args = parser().parse_args(argv)
    try:
        return _run(args)
    except KeyboardInterrupt:
        return 130


def _run(args: argparse.Namespace) -> int:
    import os

    from paperloom.providers import ProviderConfigError, get_provider

    env = dict(os.environ) | ({"LLM_PROVIDER": args.provider} if args.provider else {}) | ({"MOCK_LLM": "1"} if args.mock else {})
    try:
        settings = load_settings(env)
        get_provider(settings)
    except (ProviderConfigError, ValueError) as e:
        print(e, file=sys.stderr)
        return 2
    if args.graph:
        from pyspark.sql import SparkSession

        SparkSession.builder.getOrCreate()
        from paperloom.plans.research import research_flow

        print(research_flow().mermaid())
        return 0
    if not (args.papers and args.sections and (args.request or args.questions or args.paper or args.session)):
        print("papers, sections, and a request, questions, a paper or a session are needed", file=sys.stderr)
        return 1
    from pyspark.sql import SparkSession

    from paperloom.operators.briefing import markdown
    from paperloom.plans.research import analyze, ask, build_library, open_library, save_library
    from paperloom.sources import sessions

    spark = SparkSession.builder.appName("paperloom").getOrCreate()
    try:
        papers, sections = spark.read.parquet(args.papers), spark.read.parquet(args.sections)
        if args.library and exists(spark, f"{args.library}/index"):
            library = open_library(papers, sections, args.library)
        else:
            library = build_library(papers, sections, settings)
            library = save_library(library, args.library) if args.library else library
        turn, paper = 0, args.paper
        if args.session and not args.request:  # a saved session goes on
            begun = exists(spark, f"{args.session}/briefing") and not exists(spark, f"{args.session}/history")
            turn = 0 if begun else sessions.session_turns(spark, args.session)
            paper = paper or sessions.session_paper(spark, args.session)
            print(f"turns so far: {turn}", file=sys.stderr)
        result = None
        if args.questions:
            result = ask(spark.read.parquet(args.questions), library, settings)
        elif args.request:
            result = analyze(spark.createDataFrame([(1, args.request)], "request_id int, request string"), library, args.today, settings)
        if result is not None:
            # models are called once: the result is written, and everything else reads that
            path = args.out or scratch(spark)
            result.write.mode("overwrite").parquet(path)
            result = spark.read.parquet(path)
            if args.request and args.session:
                sessions.save_briefing(result, args.session)
            if args.request and args.export_md:
                markdown(result).write.mode("overwrite").parquet(args.export_md)
            if args.export_json:
                result.write.mode("overwrite").json(args.export_json)
            if not (args.out or args.export_json):
                result.show(truncate=100)
            if args.request and not paper and (first := result.select("paper_id").first()):
                paper = first[0]
        if paper and not args.no_interactive and not args.questions:
            for question in typed_questions():
                turn += 1
                answered = ask(spark.createDataFrame([(turn, paper, question)], "question_id int, paper_id string, question string"), library, settings)
                if args.session:
                    answered = sessions.append_session(answered, args.session, turn)
                for row in answered.select("answer").collect():
                    print(row.answer)
    except Exception as e:  # unreadable input
        print(str(e).splitlines()[0], file=sys.stderr)
        return 1
    return 0


def scratch(spark) -> str:
    """A folder for a result that is not asked for by name; on a cluster the shared one."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder with --out, or set spark.checkpoint.dir")
    return f"{folder or tempfile.gettempdir()}/paperloom-{uuid.uuid4().hex}"


def exists(spark, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def typed_questions():
    """Lines until an empty input, exit, quit or q."""
    while True:
        try:
            line = input("> ").strip()
        except EOFError:
            return
        if line.lower() in ("exit", "quit", "q"):
            return
        if line:
            yield line


if __name__ == "__main__":
    sys.exit(main())
