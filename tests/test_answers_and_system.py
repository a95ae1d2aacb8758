import json

import pytest
from pyspark.sql import functions as F

from paperloom import cli
from paperloom.config import Settings, load_settings
from paperloom.operators import briefing, qa
from paperloom.plans import flow as W
from paperloom.plans import research
from paperloom.providers import Gemini, Groq, OfflineModel, Ollama, ProviderConfigError, ProviderError, describe_provider, get_provider
from paperloom.providers.base import post_json
from paperloom.sources import atom, pdf, sessions
from paperloom.streaming import ask as streaming


def papers(spark):
    rows = [("1706.1", "Attention models", "We use attention for translation.", ["Ann Lee"], "2024-01-02", ["cs"], "u1"), ("2401.2", "Graph learning", "Graphs have nodes.", [], "2023-01-02", [], "u2")]
    return spark.createDataFrame(rows, "paper_id string, title string, abstract string, authors array<string>, published_date string, categories array<string>, abs_url string")


def sections(spark):
    rows = [("1706.1", 0, "1 Introduction", "The encoder has six layers and eight heads. It was trained on eight GPUs for twelve hours.", 5, 5, [5]), ("2401.2", 0, "1 Introduction", "Message passing sums the features of neighbours.", 1, 1, [1])]
    return spark.createDataFrame(rows, "paper_id string, section_index int, heading string, content string, page_start int, page_end int, paragraph_pages array<int>")


class Refusing:
    name = "refusing"

    def generate(self, prompt, system_prompt=None, json_mode=False):
        return "**NOT IN PAPER:** the budget is not stated."


class Failing:
    name = "failing"

    def generate(self, prompt, system_prompt=None, json_mode=False):
        raise RuntimeError("down\nfor today")


def test_answers(spark):
    library = research.build_library(papers(spark), sections(spark))
    asked = spark.createDataFrame([(1, "1706.1", "How many layers and heads does the encoder have?"), (2, "1706.1", "What is the capital of France?"), (3, "1706.1", "Who is the author Ann Lee?")], "question_id int, paper_id string, question string")
    got = {r.question_id: r for r in research.ask(asked, library, make=OfflineModel).collect()}
    assert got[1].is_grounded and got[1].citations[0].page == 5 and got[1].citations[0].excerpt.endswith("...") and got[1].confidence > 0
    assert not got[2].is_grounded and got[2].citations == [] and got[2].confidence == 0
    assert got[3].citations[0].chunk_id == "metadata"
    refused = {r.question_id: r for r in research.ask(asked, library, make=Refusing).collect()}
    assert not refused[1].is_grounded and refused[1].answer == "These passages hold no answer: the budget is not stated." and refused[1].confidence > 0
    failed = {r.question_id: r for r in research.ask(asked, library, make=Failing).collect()}
    assert failed[1].answer.endswith("down") and failed[1].confidence == 0 and failed[2].answer == qa.NO_SOURCE


GOOD = {"summary_plain_english": "s", "problem_statement": "p", "method_approach": ["m", " "], "key_results_claims": ["k"], "limitations": [], "suggested_followup_questions": ["q"]}


def test_briefings_are_parsed_strictly(spark):
    bad = [{**GOOD, "limitations": [["nested"]]}, {**GOOD, "limitations": ["a", None]}, {**GOOD, "problem_statement": 5}, {k: v for k, v in GOOD.items() if k != "key_results_claims"}]
    replies = [json.dumps(GOOD), f"```json\n{json.dumps(GOOD)}\n```", f"Here: {json.dumps(GOOD)} done", *map(json.dumps, bad), "nothing", "{broken", None]
    df = spark.createDataFrame([(str(i), r) for i, r in enumerate(replies)], "paper_id string, reply string")
    got = {int(r.paper_id): r for r in briefing.parse(df).collect()}
    for i in range(3):
        assert got[i].problem is None and got[i].parsed.method_approach == ["m"] and got[i].parsed.limitations == [briefing.NO_LIMITATIONS]
    assert all(got[i].problem and got[i].parsed is None for i in range(3, len(replies)))


class Learning:
    """Replies wrongly at first, rightly when told why."""

    name = "learning"

    def generate(self, prompt, system_prompt=None, json_mode=False):
        return json.dumps(GOOD if "could not be used" in prompt else {**GOOD, "limitations": "none"})


def test_briefings_are_asked_for_once_more(spark):
    library = research.build_library(papers(spark), sections(spark))
    requests = spark.createDataFrame([(1, "attention for translation"), (2, "arxiv:2401.2"), (3, "no such matter")], "request_id int, request string")
    out = {r.request_id: r for r in research.analyze(requests.where("request_id = 1"), library, "2026-01-01", make=Learning).collect()}
    assert not out[1].is_degraded and out[1].title == "Attention models" and out[1].publish_date == "2024-01-02"
    down = research.analyze(requests.where("request_id = 1"), library, "2026-01-01", make=Failing).first()
    assert down.is_degraded and down.summary_plain_english.startswith("We use attention") and "down" in down.problem_statement
    text = briefing.markdown(research.analyze(requests.where("request_id = 1"), library, "2026-01-01", make=Learning)).first().markdown
    assert text.startswith("# Briefing: Attention models") and "**Authors:** Ann Lee" in text and "- q\n" in text


def test_choice_of_papers(spark):
    requests = spark.createDataFrame([(1, "1706.12345"), (2, "graph nodes"), (3, ""), (4, "https://arxiv.org/abs/2401.00002")], "request_id int, request string")
    own = papers(spark).withColumn("paper_id", F.when(F.col("paper_id") == "1706.1", "1706.12345").otherwise(F.col("paper_id")))
    got = {r.request_id: (r.intent, r.paper_id, r.reason) for r in research.choose_papers(requests, own, "2026-01-01").collect()}
    assert got == {1: ("DIRECT_ID", "1706.12345", "direct"), 2: ("TOPIC_SEARCH", "2401.2", "sole"), 3: (None, None, None), 4: ("DIRECT_ID", None, None)}


# --- workflow ----------------------------------------------------------------


def test_flow_is_validated(spark):
    same = lambda df: df
    for build in (
        lambda f: f.step("a", same).edge("a", "b"),
        lambda f: f.step("a", same),
        lambda f: f.step("a", same).edge("a", W.END, F.lit(True)),
        lambda f: f.step("a", same).edge("a", W.END).entry("x", "nowhere"),
        lambda f: f.step("a", same).step("a", same),
        lambda f: f.step(W.END, same),
    ):
        with pytest.raises(W.FlowError):
            build(W.Flow()).validate()
    with pytest.raises(W.FlowError):
        W.Flow().step("a", same).step("b", same).edge("a", "b").edge("b", "a").entry("x", "a").validate().order("x")


def test_sessions_take_their_ways(spark):
    seen = []
    flow = research.research_flow({"rank": lambda df: df.withColumn("errors", F.array_append("errors", F.lit("none fits")))})
    rows = spark.createDataFrame([(1, "DIRECT_ID"), (2, "TOPIC_SEARCH")], "id int, intent string")
    got = {r.id: r for r in flow.run(rows, "analyze", lambda n, about: seen.append(n)).collect()}
    assert got[1].path == ["understand", "find", "parse", "chunk", "index", "brief", "save"] and got[1]["at"] == W.END
    assert got[2].path == ["understand", "find", "rank"] and got[2]["at"] == W.FAILED and got[2].errors == ["none fits"]
    assert seen[0] == "understand" and flow.run(rows, "ask").first().path == ["answer", "save"]
    chart = flow.mermaid()
    assert "ask_entry([ask]) --> answer" in chart and "-- topic --> rank" in chart and chart == research.research_flow().mermaid()


def test_cycles_end_in_reachability(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "source string, target string")
    got = W.reachability(edges, spark.createDataFrame([("x", "a")], "entry string, node string"), 6)
    assert {r.node for r in got.collect()} == {"a", "b", "c"}


# --- providers and settings --------------------------------------------------


def transport(*replies):
    left, calls = list(replies), []

    def post(url, body, headers, timeout):
        calls.append((url, json.loads(body), headers))
        reply = left.pop(0)
        if isinstance(reply, Exception):
            raise reply
        return reply

    post.calls = calls
    return post


def test_retries():
    waits = []
    ok = (200, {}, '{"x": 1}')
    assert post_json("u", {}, transport=transport((503, {}, "busy"), OSError("reset"), ok), sleep=waits.append) == {"x": 1}
    assert waits == [2.0, 4.0]
    waits.clear()
    post_json("u", {}, transport=transport((429, {"retry-after": "7"}, ""), ok), sleep=waits.append)
    assert waits == [7.0]
    waits.clear()
    post_json("u", {}, transport=transport((429, {"retry-after": "Wed, 21 Oct 2015 07:28:00 GMT"}, ""), (429, {"retry-after": "soon"}, ""), ok), sleep=waits.append)
    assert waits == [2.0, 4.0]
    with pytest.raises(ProviderError, match="no JSON"):
        post_json("u", {}, transport=transport((200, {}, "<html>")))
    with pytest.raises(ProviderError, match="HTTP 400: bad key$"):
        post_json("u", {}, transport=transport((400, {}, '{"error": {"message": "bad key\\nmore"}}')), sleep=waits.append)
    with pytest.raises(ProviderError, match="3 attempts"):
        post_json("u", {}, transport=transport(*[(500, {}, "x")] * 3), sleep=lambda s: None)


def test_providers():
    chat = transport((200, {}, '{"choices": [{"message": {"content": "hi"}}]}'))
    assert Groq("k", transport=chat).generate("p", "s", True) == "hi"
    assert chat.calls[0][1]["response_format"] == {"type": "json_object"} and chat.calls[0][2]["Authorization"] == "Bearer k"
    answer = (200, {}, '{"candidates": [{"content": {"parts": [{"text": "a"}, {"text": "b"}]}}]}')
    model = Gemini("k", "m1", ("m2",), transport=transport((400, {}, "gone"), answer, answer))
    assert model.generate("p") == "ab" and model.failed == {"m1"} and model.generate("p") == "ab"
    thought = (200, {}, '{"candidates": [{"content": {"parts": [{"text": "hm", "thought": true}, {"text": "a"}]}}]}')
    blocked = (200, {}, '{"promptFeedback": {"blockReason": "SAFETY"}}')
    model = Gemini("k", "m1", ("m2",), transport=transport(blocked, thought, (503, {}, "busy"), thought))
    assert model.generate("p") == "a" and not model.failed  # a blocked answer says nothing about the model
    assert model.generate("p") == "a" and model.failed == {"m1"}  # one short attempt where another model stands by
    assert Ollama(transport=transport((200, {}, '{"response": "r"}'))).generate("p") == "r"
    with pytest.raises(ProviderError, match="1 attempts"):
        Ollama(transport=transport((503, {}, "x"))).generate("p")
    assert "placeholder" in OfflineModel().generate("[Source 1] x:\nText of it\n")


def test_settings(tmp_path):
    env = tmp_path / ".env"
    env.write_text('# note\nGROQ_API_KEY="filed" # mine\nGEMINI_API_KEY=your_key_here\nTOP_K=6\n')
    own = load_settings({}, str(env))
    assert (own.provider, own.api_key, own.top_k) == ("groq", "filed", 6)
    assert load_settings({"GROQ_API_KEY": "real"}, str(env)).api_key == "real"
    assert load_settings({"MOCK_LLM": "1", "LLM_PROVIDER": "groq"}, str(env)).provider == "mock"
    assert load_settings({}, "none").provider == "mock" and load_settings({"OLLAMA_BASE_URL": "http://x"}, "none").provider == "ollama"
    with pytest.raises(ProviderConfigError):
        get_provider(load_settings({"LLM_PROVIDER": "gemini"}, str(env)))
    with pytest.raises(ValueError):
        load_settings({"LLM_PROVIDER": "other"}, "none")
    assert "offline" in describe_provider(Settings())


def test_command_line(spark, tmp_path, monkeypatch, capsys):
    assert cli.main(["x", "--provider", "gemini"]) == 2
    assert cli.main(["topic", "--mock"]) == 1
    papers(spark).write.parquet(str(tmp_path / "p"))
    sections(spark).write.parquet(str(tmp_path / "s"))
    given = ["--mock", "--papers", str(tmp_path / "p"), "--sections", str(tmp_path / "s")]
    begin = ["graph learning", *given, "--session", str(tmp_path / "own"), "--library", str(tmp_path / "lib"), "--no-interactive"]
    assert cli.main([*begin, "--export-json", str(tmp_path / "out")]) == 0
    assert "Graph learning" in spark.read.json(str(tmp_path / "out")).first().title
    assert cli.main(["x", "--mock", "--papers", str(tmp_path / "none"), "--sections", str(tmp_path / "s")]) == 1
    assert cli.main([*given, "--paper", "1706.1", "--session", str(tmp_path / "lost")]) == 1  # no such session
    sessions.append_session(spark.createDataFrame([(0, "1706.1", "q", "a", True, 0.5)], "question_id int, paper_id string, question string, answer string, is_grounded boolean, confidence double"), str(tmp_path / "kept"))
    lines = iter(["", "how many layers and heads", "quit", "what does it learn", "q"])
    monkeypatch.setattr("builtins.input", lambda _: next(lines))
    assert cli.main([*given, "--paper", "1706.1", "--session", str(tmp_path / "kept")]) == 0
    assert "[Source 1]" in capsys.readouterr().out and sessions.session_turns(spark, str(tmp_path / "kept")) == 2
    # the session that the request began goes on with its paper, on the saved library
    assert cli.main([*given, "--session", str(tmp_path / "own"), "--library", str(tmp_path / "lib")]) == 0
    assert [(r.paper_id, r.turn) for r in spark.read.parquet(str(tmp_path / "own" / "history")).collect()] == [("2401.2", 1)]


def test_saved_libraries_answer_alike(spark, tmp_path):
    built = research.build_library(papers(spark), sections(spark))
    research.save_library(built, str(tmp_path / "lib"))
    asked = spark.createDataFrame([(1, "1706.1", "encoder layers"), (2, "2401.2", "features of neighbours")], "question_id int, paper_id string, question string")
    opened = research.open_library(papers(spark), sections(spark), str(tmp_path / "lib"))
    assert sorted(research.retrieve(asked, opened).collect()) == sorted(research.retrieve(asked, built).collect())
    # saved passages without a paper's record get it
    spark.read.parquet(str(tmp_path / "lib" / "chunks")).where("chunk_id <> 'metadata'").write.parquet(str(tmp_path / "old" / "chunks"))
    repaired = research.open_library(papers(spark), sections(spark), str(tmp_path / "old"))
    assert repaired.chunks.where("chunk_id = 'metadata'").count() == papers(spark).count()
    about = asked.where("question_id = 1").withColumn("question", F.lit("when was the paper published, and by which authors"))
    assert research.retrieve(about, repaired).orderBy("rank").first().chunk_id == "metadata"


# --- sources and streams -----------------------------------------------------

FEED = """<?xml version="1.0"?><feed xmlns="http://www.w3.org/2005/Atom" xmlns:arxiv="http://arxiv.org/schemas/atom">
<entry><id>http://arxiv.org/api/errors#bad</id><title>Error</title></entry>
<entry><id>http://arxiv.org/abs/1706.03762v5</id><published>2017-06-12T17:57:34Z</published><title>Error bounds
  of attention</title><summary> Two
 lines </summary><author><name>B C</name></author><author><name>A D</name></author>
<link href="http://arxiv.org/abs/1706.03762v5" rel="alternate"/><link title="pdf" href="http://arxiv.org/pdf/1706.03762v5" rel="related"/><arxiv:primary_category term="cs.CL"/><category term="cs.CL"/><category term="cs.LG"/></entry>
<entry><id>http://arxiv.org/abs/cs/0101001</id><title>Old</title><summary/></entry></feed>"""


def test_atom_files_and_feeds(spark, tmp_path):
    (tmp_path / "feed.xml").write_text(FEED)
    for entries in (atom.read_entries(spark, str(tmp_path / "feed.xml")), atom.entries_of_feeds(spark.createDataFrame([(FEED,)], "feed string"))):
        got = {r.paper_id: r for r in atom.parse_entries(entries).collect()}
        assert set(got) == {"1706.03762", "cs/0101001"}
        first, old = got["1706.03762"], got["cs/0101001"]
        assert (first.title, first.abstract, first.authors, first.published_date) == ("Error bounds of attention", "Two lines", ["B C", "A D"], "2017-06-12")
        assert (first.pdf_url, first.abs_url, first.primary_category, first.categories) == ("https://arxiv.org/pdf/1706.03762v5", "https://arxiv.org/abs/1706.03762v5", "cs.CL", ["cs.CL", "cs.LG"])
        assert (old.published_date, old.pdf_url, old.primary_category, old.updated_date) == ("Unknown", "https://arxiv.org/pdf/cs/0101001", None, None)
    assert "sortOrder=descending" in atom.request_url({"search_query": "all:x"}) and "id_list=1" in atom.request_url({"id_list": "1"})


def test_pdf_cache(spark, tmp_path):
    (tmp_path / "a_1.pdf").write_bytes(b"%PDF-1.5 x")
    (tmp_path / "b.pdf").write_bytes(b"<html>limit</html>")
    cache = pdf.read_cache(spark, str(tmp_path))
    assert {r.file: r.is_pdf for r in cache.collect()} == {"a_1.pdf": True, "b.pdf": False}
    own = spark.createDataFrame([("a/1", "u"), ("b", "v")], "paper_id string, pdf_url string")
    assert [r.paper_id for r in pdf.to_download(own, cache).collect()] == ["b"]
    assert [r.url for r in pdf.candidate_urls(own.where("paper_id = 'b'")).orderBy("place").collect()] == ["v", "https://arxiv.org/pdf/b", "https://arxiv.org/pdf/b.pdf"]


def test_sessions_and_questions(spark, tmp_path):
    rows = spark.createDataFrame([("s1", ["a", "b"], None), ("s2", [], 3.5)], "session_id string, path array<string>, score double")
    sessions.save_sessions(rows, str(tmp_path / "s"))
    again = sessions.load_sessions(spark, str(tmp_path / "s"), "session_id string, path array<string>, score double")
    assert sorted(map(tuple, again.drop("corrupt").collect())) == sorted(map(tuple, rows.collect())) and not again.where("corrupt").count()
    broken = sessions.from_json_rows(spark.createDataFrame([("x", "{oops")], "k string, json string"), "session_id string")
    assert broken.first().corrupt
    (tmp_path / "q.json").write_text(json.dumps({"papers": {"p": "t"}, "questions": [{"paper": "p", "kind": "lexical", "question": "q", "evidence": ["e"]}]}, indent=1))
    assert [(r.paper_id, r.evidence, r.answer_any) for r in sessions.read_eval_questions(spark, str(tmp_path / "q.json")).collect()] == [("p", ["e"], None)]


def test_question_streams(spark, tmp_path):
    library = research.build_library(papers(spark), sections(spark))
    asked = spark.createDataFrame([(1, "1706.1", "encoder layers", "s1"), (2, "2401.2", "features of neighbours", "s1"), (3, "1706.1", "GPUs", "s2")], "question_id long, paper_id string, question string, session_id string")
    asked.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(asked.schema).parquet(str(tmp_path / "in"))
    streaming.answer_stream(stream, library, str(tmp_path / "out"), str(tmp_path / "ck"), make=OfflineModel).awaitTermination(120)
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r.question_id: r.is_grounded for r in got.collect()} == {1: True, 2: True, 3: True}
    numbered = streaming.number_turns(stream).writeStream.format("memory").queryName("turns").option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start()
    numbered.awaitTermination(120)
    assert {(r.session_id, r.question_id): r.turn for r in spark.table("turns").collect()} == {("s1", 1): 1, ("s1", 2): 2, ("s2", 3): 1}


def test_question_rates(spark):
    import datetime as d

    rows = [(i, d.datetime(2024, 1, 1, 0, m), f"p{i % 2}") for i, m in enumerate((1, 2, 11))]
    got = streaming.question_rates(spark.createDataFrame(rows, "question_id int, asked_at timestamp, paper_id string")).orderBy("start").collect()
    assert [r.questions for r in got] == [2, 1]
