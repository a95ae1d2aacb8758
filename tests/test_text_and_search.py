import datetime
import re

import pytest
from pyspark.sql import functions as F

from paperloom.config import Settings
from paperloom.functions import scores
from paperloom.functions import text as T
from paperloom.operators import search


def one(spark, column, *values):
    df = spark.createDataFrame([(v,) for v in values], "t string")
    return [r[0] for r in df.select(column(F.col("t"))).collect()]


@pytest.mark.parametrize(
    ("query", "intent", "paper"),
    [
        ("1706.03762", "DIRECT_ID", "1706.03762"),
        ("1706.03762v2", "DIRECT_ID", "1706.03762"),
        ("arXiv:2401.12345", "DIRECT_ID", "2401.12345"),
        ("https://arxiv.org/abs/1706.03762v5", "DIRECT_ID", "1706.03762"),
        ("www.arxiv.org/pdf/1706.03762.pdf", "DIRECT_ID", "1706.03762"),
        ("cs/0101001", "DIRECT_ID", "cs/0101001"),
        ("math.GT/0309136", "DIRECT_ID", "math.GT/0309136"),
        ("efficient attention for long inputs", "TOPIC_SEARCH", None),
        ("how does 1706.03762 compare with later work on attention", "TOPIC_SEARCH", None),
        ("arxiv.org/abs/nothing", "TOPIC_SEARCH", None),
        ("   ", None, None),
        (None, None, None),
    ],
)
def test_intent(spark, query, intent, paper):
    df = spark.createDataFrame([(query,)], "q string").select(*[c.alias(n) for n, c in T.intent(F.col("q")).items()])
    row = df.first()
    assert (row.intent, row.paper_id) == (intent, paper)


def test_terms_of_requests(spark):
    assert one(spark, T.search_terms, "Recent work on KV-cache compression for LLMs", "the new", "of") == [["KV-cache", "compression", "LLMs"], ["the", "new"], ["of"]]
    assert one(spark, T.search_query, "one two three four five six", "a", " ! ") == ["all:one AND all:two AND all:three AND all:four AND all:five", "all:a", "all:!"]


def test_tokens(spark):
    assert one(spark, T.tokens, "The LLaMA-3-8B model, v1.5 and a_b", "") == [["llama-3-8b", "llama", "8b", "model", "v1.5", "a_b"], []]


def test_sentences(spark):
    text = "One is here. Two follows! 3 more? yes. Last"
    assert one(spark, T.sentences, text, "  ") == [["One is here.", "Two follows!", "3 more? yes.", "Last"], []]


def test_prose(spark):
    text = "\n\n".join([
        "We evalu-", "A label only", "Table 3: Scores of all the models that we have tried out here.", "ResNet | Top-1: 76.1 | Top-5: 93.0",
        "0.1 0.2 0.3 0.4 0.5 0.6 0.7 0.8", "This is the sentence that we evalu-", "ate under all of the settings.", "Llama, 16K context, ten per cent",
    ])
    assert one(spark, T.prose_only, text) == ["This is the sentence that we evaluate under all of the settings."]


def test_refusals(spark):
    got = one(spark, T.is_refusal, "NOT IN PAPER: no", "**not in paper:** nothing", "The context does not say so.", "It reaches 76.1 on top-1 [Source 1].", "")
    assert got == [True, True, True, False, False]
    assert one(spark, T.refusal_reason, "** NOT IN PAPER:** no numbers.", "fine") == ["no numbers.", None]


def test_match_form(spark):
    df = spark.createDataFrame([("a 1‑2 3 | B", ["1-23"]), ("none", ["some"]), ("x", [])], "t string, n array<string>")
    assert [r[0] for r in df.select(T.contains_any(F.col("t"), F.col("n"))).collect()] == [True, False, False]


def papers(spark):
    rows = [
        ("p1", "Sparse attention", "We study attention in long documents.", "2015-01-01"),
        ("p2", "Sparse attention", "We study attention in long documents.", "2025-12-01"),
        ("p3", "Graph learning", "Nodes and edges of graphs.", "someday"),
        ("p4", "Attention maps of graphs", "", "2030-01-01"),
    ]
    return spark.createDataFrame([(*r, ["A"], ["c"], "u") for r in rows], "paper_id string, title string, abstract string, published_date string, authors array<string>, categories array<string>, abs_url string")


def test_relaxation(spark):
    requests = spark.createDataFrame([(1, "sparse attention documents"), (2, "sparse attention unicorn"), (3, "unicorn graphs dragons"), (4, "unicorn"), (5, "")], "request_id int, request string")
    got = {(r.request_id, r.paper_id): r.level for r in search.relaxed_search(requests, search.paper_terms(papers(spark))).collect()}
    assert got == {(1, "p1"): 0, (1, "p2"): 0, (2, "p1"): 1, (2, "p2"): 1, (3, "p3"): 2, (3, "p4"): 2}


def test_relaxation_equals_all_pairs(spark, monkeypatch):
    """Blocks and levels give what all pairs give: terms asked twice, shared ids, papers without words, equal matches."""
    monkeypatch.setattr(search, "BLOCK", (100, 65536))
    words = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta2"]
    texts = [" ".join(w for j, w in enumerate(words) if (i * 37 + 11 * j * j + i // 7) % 5 < 2) for i in range(300)]
    index = spark.createDataFrame([(f"p{i}", t) for i, t in enumerate(texts)] + [("p3", "beta zeta"), ("p3", "alpha"), (None, "alpha beta"), ("none", None)], "paper_id string, words string")
    picks = [f"{words[i % 7]} {words[(i * 3 + 1) % 7]} {words[(i * 5 + 2) % 7]} {words[i // 3 % 7]} {'unicorn' if i % 2 else words[i // 5 % 7]}" for i in range(80)]
    asked = [(i, t) for i, t in enumerate([*picks, "alpha alpha beta", "alpha beta alpha unicorn", "unicorn", "zeta unicorn", "eta2 unicorn dragon", "unicorn eta2 epsilon dragon", "", None])] + [(5, "alpha delta"), (None, "alpha")]
    requests = spark.createDataFrame(asked, "request_id int, request string")
    got = {tuple(r) for r in search.relaxed_search(requests, index).collect()}
    own = [(k, r) for k, r in asked if k is not None and r]
    want = set()
    for key in {k for k, _ in own}:
        terms = [(p, t) for k, r in own if k == key for p, t in enumerate(r.split()[:5])]
        n_all, rows = max(len(r.split()) for k, r in own if k == key), {}
        for paper, text in [(r.paper_id, r.words) for r in index.collect()]:
            for p, t in terms:
                if text and t in text.split():
                    m, lead = rows.get(paper, (0, 0))
                    rows[paper] = (m + 1, lead + (p < 2))
        levels = {p: 0 if m == len(terms) else 1 if n_all > 2 and lead == 2 else 2 for p, (m, lead) in rows.items() if m == len(terms) or n_all > 1}
        best = sorted((p for p, x in levels.items() if x == min(levels.values())), key=lambda p: (-rows[p][0], p is None, p or ""))
        want |= {(key, p, levels[p], rows[p][0], i) for i, p in enumerate(best[:Settings().max_candidates], 1)}
    assert {x[2] for x in want} == {0, 1, 2}
    assert got == want


def test_common_words_make_no_rows(spark):
    """Pairs of a request and a paper with a word in common are counted in blocks, not as rows."""
    index = spark.range(2000).selectExpr("cast(id as string) paper_id", "'alpha beta gamma' words")
    requests = spark.range(500).selectExpr("cast(id as int) request_id", "'alpha beta gamma' request")
    found = search.relaxed_search(requests, index)
    assert found.count() == 500 * Settings().max_candidates
    text = found._jdf.queryExecution().executedPlan().toString()
    assert not re.search(r"keys=\[request_id#\d+L?, paper_id#", text)
    assert "ShuffledHashJoin" in text


def test_lists_stay_in_their_blocks(spark):
    """Terms are met in the blocks: no list is sent by its term.  They are sorted once, and held without nulls."""
    found = search.relaxed_search(spark.createDataFrame([(1, "sparse attention documents")], "request_id int, request string"), search.paper_terms(papers(spark)))
    text = found._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate(key=[term" in text and "collect_list(ord" in text
    assert not re.search(r"hashpartitioning\(term#\d+, \d+\), ENSURE_REQUIREMENTS[^\n]*\n[^\n]*collect_list\(ord", text)
    empty = spark.range(1).select(search._none().alias("x"))
    assert not empty.schema["x"].dataType.containsNull


def test_texts_are_taken_apart_before_they_meet_requests(spark):
    """Scores read sets of words: a text that is a candidate of many requests is tokenized once."""
    requests = spark.createDataFrame([(1, "sparse attention"), (2, "graphs")], "request_id int, request string")
    candidates = spark.createDataFrame([(1, "p1", 1), (2, "p3", 1)], "request_id int, paper_id string, place int")
    ranked = search.rank_candidates(candidates, requests, papers(spark), "2026-01-01")
    text = ranked._jdf.queryExecution().optimizedPlan().toString()
    above = text[: text.index("Join")]
    assert "array_intersect" in above and "regexp_extract_all" not in above


def test_recent_work_is_preferred_only_if_asked_for(spark):
    requests = spark.createDataFrame([(1, "sparse attention"), (2, "recent sparse attention")], "request_id int, request string")
    found = search.relaxed_search(requests, search.paper_terms(papers(spark)))
    ranked = search.rank_candidates(found, requests, papers(spark), "2026-01-01")
    chosen = {r.request_id: r.paper_id for r in ranked.where("chosen").collect()}
    assert chosen == {1: "p1", 2: "p2"}
    proposals = spark.createDataFrame([(1, 1), (2, 9)], "request_id int, proposed int")
    picked = {r.request_id: (r.paper_id, r.reason) for r in search.select_paper(ranked, proposals).collect()}
    assert picked == {1: ("p2", "proposed"), 2: ("p2", "score")}


def test_recency(spark):
    today = F.lit(datetime.date(2026, 1, 1))
    got = [r[0] for r in papers(spark).orderBy("paper_id").select(scores.recency(F.col("published_date"), today)).collect()]
    assert got[0] == 0 and 0.95 < got[1] < 1 and got[2] == 0 and got[3] == 1
