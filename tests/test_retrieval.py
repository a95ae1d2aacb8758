import pytest
from pyspark.sql import functions as F

from paperloom.config import Settings
from paperloom.operators import chunking, evals
from paperloom.operators import index as I
from paperloom.operators import retrieve as R
from paperloom.providers.models import embed, embed_missing, rerank
from paperloom.providers.offline import HashingEmbedder, OverlapReranker
from paperloom.sources.sessions import load_index, save_index

CHUNKS = [
    ("p", 1, "The encoder uses multi-head attention with eight heads.", [1.0, 0.0, 0.0]),
    ("p", 2, "Training ran on eight GPUs for twelve hours.", [0.0, 1.0, 0.0]),
    ("p", 3, "BLEU scores improve by two points on translation.", [0.0, 0.0, 1.0]),
    ("q", 1, "Attention is not used here at all.", [0.6, 0.8, 0.0]),
]


@pytest.fixture(scope="module")
def chunks(spark):
    return spark.createDataFrame(CHUNKS, "paper_id string, chunk_id int, text string, vector array<float>")


def questions(spark, *rows):
    return spark.createDataFrame([(i, p, q, v) for i, (p, q, v) in enumerate(rows)], "question_id int, paper_id string, question string, vector array<float>")


def test_lexical_search_and_gate(spark, chunks):
    asked = questions(spark, ("p", "how many attention heads?", None), ("p", "what is the capital of it", None), ("p", "unknownword", None), ("q", "attention", None))
    rows = R.lexical_search(asked, I.build_index(chunks)).collect()
    best = {r.question_id: (r.chunk_id, r.score) for r in rows if r["rank"] == 1}
    assert best[0][0] == 1 and best[0][1] > 0.3 and best[3][0] == 1
    assert {r.question_id for r in rows} == {0, 3}
    assert all(0 <= r.score <= 1 + 1e-9 for r in rows)


def test_postings_have_unit_length(spark, chunks):
    norms = I.weights(I.build_index(chunks)).groupBy("paper_id", "chunk_id").agg(F.sum(F.col("weight") ** 2).alias("n")).collect()
    assert all(abs(r.n - 1) < 1e-9 for r in norms)


def test_index_survives_storage(spark, chunks, tmp_path):
    index = I.build_index(chunks)
    save_index(index, str(tmp_path))
    again = load_index(spark, str(tmp_path))
    asked = questions(spark, ("p", "attention heads", None))
    assert R.lexical_search(asked, index).collect() == R.lexical_search(asked, again).collect()


def test_gate_passes_on_either_signal(spark, chunks):
    index = I.build_index(chunks)
    asked = questions(spark, ("p", "zzz", [0.9, 0.1, 0.0]), ("p", "BLEU", [0.5, 0.5, 0.5]), ("p", "zzz", [-1.0, 0.0, 0.0]))
    passed = {r.question_id: r.passed for r in R.gate(R.both_scores(asked, index, chunks)).collect()}
    assert passed == {0: True, 1: True, 2: False}
    found = R.hybrid_search(asked, index, chunks).collect()
    assert {r.question_id for r in found} == {0, 1}
    first = {r.question_id: (r.chunk_id, round(r.score, 3)) for r in found if r["rank"] == 1}
    assert first[0][0] == 1 and first[0][1] == 0.994  # the reported score is the cosine


def test_fusion_rewards_agreement(spark):
    rows = spark.createDataFrame([(1, "p", 1, 0.9, 0.8), (1, "p", 2, 0.8, 0.0), (1, "p", 3, 0.1, 0.7)], "question_id int, paper_id string, chunk_id int, dense double, lexical double")
    fused = {r.chunk_id: r.fused for r in R.fuse(rows).collect()}
    assert max(fused, key=fused.get) == 1
    assert fused[1] == pytest.approx(2 / 60, abs=1e-9) and fused[2] == pytest.approx(1 / 61 + 1 / 62, abs=1e-9)


def test_reranker_decides_the_order(spark, chunks):
    asked = questions(spark, ("p", "GPUs and hours of training", [0.9, 0.1, 0.0]))
    index = I.build_index(chunks)
    plain = R.hybrid_search(asked, index, chunks, Settings(top_k=3), rerank=R.overlap_rerank(asked, chunks)).collect()
    model = R.hybrid_search(asked, index, chunks, Settings(top_k=3), rerank=rerank(OverlapReranker, asked, chunks)).collect()
    assert [r.chunk_id for r in sorted(plain, key=lambda r: r["rank"])][0] == 2
    assert [r.chunk_id for r in sorted(model, key=lambda r: r["rank"])][0] == 2


def test_vectors_are_reused_if_they_fit(spark, chunks):
    mixed = chunks.withColumn("vector", F.when((F.col("paper_id") == "q"), F.lit(None)).otherwise(F.col("vector")))
    got = {(r.paper_id, r.chunk_id): len(r.vector) for r in embed_missing(mixed, HashingEmbedder).collect()}
    assert got == {("p", 1): 3, ("p", 2): 3, ("p", 3): 3, ("q", 1): 64}
    unit = chunks.select(embed(HashingEmbedder, F.col("text"), query=True).alias("v")).collect()
    assert all(abs(sum(x * x for x in r.v) - 1) < 1e-5 for r in unit)


# --- chunking ----------------------------------------------------------------


def section(spark, content, pages=None, heading="Method", last=6):
    return spark.createDataFrame([("p", 2, heading, content, 4, last, pages)], "paper_id string, section_index int, heading string, content string, page_start int, page_end int, paragraph_pages array<int>")


def test_pages_of_packed_sentences(spark):
    df = section(spark, "First sentence is here now okay.\n\nSecond one is longer than it.\n\nThird one ends it.", [4, 5, 6])
    rows = chunking.section_chunks(df, Settings(chunk_size=60, chunk_overlap=0)).orderBy("chunk_index").collect()
    assert [(r.page_number, r.page_end) for r in rows] == [(4, 4), (5, 6)] and [r.chunk_id for r in rows] == ["s2_c1", "s2_c2"]
    spread = chunking.section_chunks(section(spark, "A one.\n\nB two.\n\nC three."), Settings(chunk_size=7, chunk_overlap=0)).orderBy("chunk_index").collect()
    assert [r.page_number for r in spread] == [4, 4, 5]


def test_table_rows_stay_on_their_lines(spark):
    rows = chunking.section_chunks(section(spark, "Some prose.\n\nA | x: 1 | y: 2\nB | x: 3 | y: 4")).collect()
    assert [r.text for r in rows] == ["Some prose.\nA | x: 1 | y: 2\nB | x: 3 | y: 4"]


def test_overlap_and_long_sentences():
    units = [(f"Sentence {i} " + "x" * 20, 1, False) for i in range(10)] + [("y" * 500, 1, False)]
    runs = chunking.pack_units(units, 100, 40)
    assert [u for r in runs for u in r if u[0].startswith("y")] == [units[-1]]
    assert {u for r in runs for u in r} == set(units)
    for a, b in zip(runs, runs[1:]):
        assert b[0] == a[-1]
    assert chunking.pack_units([], 100, 40) == []


def test_reference_sections_are_left_out(spark):
    assert chunking.section_chunks(section(spark, "Text.", heading="7 Preference Optimization")).count() == 0
    assert chunking.section_chunks(section(spark, " \n ")).count() == 0


def test_metadata_and_abstract_passages(spark):
    papers = spark.createDataFrame([("a", "T", ["Ann Lee"], "2024-01-02T00:00:00Z", ["cs"], "u", "About."), ("b", "U", [], "Unknown", [], "v", "")], "paper_id string, title string, authors array<string>, published_date string, categories array<string>, abs_url string, abstract string")
    none = section(spark, "", heading="x")
    got = {(r.paper_id, r.chunk_id): r.text for r in chunking.all_chunks(papers, none).collect()}
    assert set(got) == {("a", "metadata"), ("a", "abstract_1"), ("b", "metadata")}
    assert "Ann Lee" in got[("a", "metadata")] and "2024-01-02\n" in got[("a", "metadata")] and "not listed" in got[("b", "metadata")]
    saved = chunking.all_chunks(papers, none).where("chunk_id = 'abstract_1'")
    fixed = chunking.repair_metadata(saved, papers).orderBy("chunk_ord").collect()
    assert [(r.paper_id, r.chunk_id) for r in fixed] == [("a", "metadata"), ("a", "abstract_1")]


# --- evaluation --------------------------------------------------------------


def test_metrics_by_kind(spark, chunks):
    rows = [(0, "p", "heads of attention", "lexical", ["eight heads"], ["eight"]), (1, "p", "hours", "paraphrase", ["nothing like it"], ["x"]), (2, "p", "zzz", "out_of_scope", [], [])]
    asked = spark.createDataFrame(rows, "question_id int, paper_id string, question string, kind string, evidence array<string>, answer_any array<string>")
    found = R.lexical_search(asked, I.build_index(chunks))
    answers = spark.createDataFrame([(0, "There are eight.", True), (1, "no", False), (2, "cannot say", False)], "question_id int, answer string, is_grounded boolean")
    got = {r.kind: r for r in evals.metrics(evals.judge(asked, found, chunks, answers)).collect()}
    assert (got["lexical"].hit, got["lexical"].answer_ok) == (1, 1)
    assert (got["paraphrase"].hit, got["paraphrase"].answer_ok) == (0, 0)
    assert (got["out_of_scope"].gated, got["out_of_scope"].refused) == (1, 1)
    assert [r.question_id for r in evals.stale_evidence(asked, chunks).collect()] == [1]


# --- modes and properties ----------------------------------------------------


def test_retrieval_modes(spark, chunks):
    from paperloom.plans.research import Library, retrieve

    papers = spark.createDataFrame([("p", "t")], "paper_id string, title string")
    plain = Library(papers, None, chunks.drop("vector"), I.build_index(chunks))
    dense = Library(papers, None, chunks, I.build_index(chunks), chunks)
    asked = questions(spark, ("p", "zzz", [0.9, 0.1, 0.0]))
    assert retrieve(asked, plain).count() == 0  # auto without vectors is lexical
    assert retrieve(asked, dense).count() == 3  # auto with vectors is hybrid
    assert retrieve(asked, dense, Settings(retrieval_mode="tfidf")).count() == 0
    for mode in ("hybrid", "hybrid+rerank"):
        with pytest.raises(ValueError):
            retrieve(asked, plain, Settings(retrieval_mode=mode))

    class Backwards:
        def score(self, query, texts):
            return [-len(t) for t in texts]

    ranked = {mode: [r.chunk_id for r in retrieve(asked, dense, Settings(retrieval_mode=mode), give).orderBy("rank").collect()] for mode, give in (("hybrid", None), ("hybrid+rerank", Backwards), ("auto", Backwards))}
    length = {r.chunk_id: len(r.text) for r in chunks.where("paper_id = 'p'").collect()}
    assert ranked["hybrid+rerank"] == ranked["auto"] == sorted(ranked["auto"], key=length.get) and set(ranked["auto"]) == set(ranked["hybrid"])
    assert retrieve(asked, dense, Settings(retrieval_mode="hybrid+rerank")).count() == 3


def test_ties_go_to_the_earlier_passage(spark):
    ids = ["s10_c1", "s2_c2", "metadata", "s2_c10", "s-1_c1", "s2_c9"]
    rows = spark.createDataFrame([(1, "p", i, 0.5) for i in ids], "question_id int, paper_id string, chunk_id string, lexical double")
    assert [r.chunk_id for r in R.best(rows, "lexical", 9).orderBy("rank").collect()] == ["metadata", "s-1_c1", "s2_c2", "s2_c9", "s2_c10", "s10_c1"]


@pytest.mark.parametrize("seed", range(8))
def test_packed_runs_hold_every_unit_in_order(seed):
    import random

    r = random.Random(seed)
    units = [("w" * r.randint(1, 200) + str(i), i // 5, False) for i in range(r.randint(0, 60))]
    size, overlap = r.choice([(800, 150), (100, 0), (50, 300), (10, 5)])
    runs = chunking.pack_units(units, size, overlap)
    first = [run[next((i for i, u in enumerate(run) if u not in seen), 0) :] for seen, run in zip([set().union(*[set(x) for x in runs[:i]]) for i in range(len(runs))], runs)]
    assert [u for run in first for u in run] == units
    for a, b in zip(runs, runs[1:]):
        carried = [u for u in b if u in a]
        assert a[len(a) - len(carried) :] == carried and sum(len(u[0]) + 1 for u in carried) <= max(overlap, 1) + 0
        assert sum(len(u[0]) + 1 for u in a) + len(b[len(carried)][0]) > size
