"""What the optimizer makes of the queries: pruned scans, no pair of everything, partial limits."""

import re

import pytest

from paperloom.plans import catalog

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalog.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_no_query_pairs_everything(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    # a workflow's few nodes and edges aside, joins have a key
    assert "BroadcastNestedLoopJoin" not in text or name in ("graph_validate", "reachability")


@pytest.mark.parametrize(
    ("name", "columns"),
    [("idf", {"text", "source", "doc_id"}), ("tfidf_search", {"text", "source", "doc_id", "item_id"}), ("dense_scores", {"source", "doc_id", "embedding", "vec_id", "item_id"}), ("refusals", {"conv_id", "turn", "text"}), ("telemetry", {"event_type", "value"})],
)
def test_scans_read_only_what_is_used(spark, name, columns):
    read = set(re.findall(r"(\w+):", " ".join(re.findall(r"ReadSchema: struct<([^>]*(?:<[^>]*>)?[^>]*)>", plan(spark, name)))))
    assert read <= columns | {"array", "element"}, read


def test_top_k_is_limited_before_the_shuffle(spark):
    assert len(re.findall("WindowGroupLimit", plan(spark, "tfidf_search"))) >= 2


def test_text_functions_stay_in_the_jvm(spark):
    for name in ("tokens", "sentences", "intent", "prose_only", "idf", "tfidf_search", "hybrid_search", "relaxed_search", "context_budget", "briefing_parse"):
        assert not re.search(r"ArrowEval|MapInArrow|MapInPandas|BatchEvalPython|FlatMapGroups", plan(spark, name)), name


def test_only_gated_rows_reach_the_model(spark):
    """The offline model runs on questions that have a prompt: the filter stands below the Python node."""
    text = plan(spark, "qa_answers")
    at = text.index("ArrowEvalPython")
    assert "isnotnull" in text[at:]


def test_texts_are_tokenized_once(spark):
    """Postings and document frequencies share the exchange of the term frequencies."""
    df = catalog.QUERIES["tfidf_search"](spark, SF)
    df.collect()
    final = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len(re.findall("Generate explode", final)) == 2  # passages and questions
