import random
import re

import pytest
from pyspark.sql import functions as F

from paperloom.llm import jaccard as J
from paperloom.llm import pii, queries
from paperloom.llm._shared import Scratch
from paperloom.llm.components import components
from tests.llm.helpers import awkward, awkward_rows, brute_components, empty, sentence

SF = "/root/testdata/sf0.001"


def found(df, **kw):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_components(df, ["doc_id"], **kw).collect()}


def corpus(seed: int) -> list[tuple[int, str]]:
    """Families of near copies around common bases, exact copies, shared passages, and short texts."""
    r = random.Random(seed)
    passage = sentence(r, 60)
    rows: list[str] = []
    for _ in range(6):
        base = sentence(r, r.randint(30, 140)).split()
        for _ in range(r.randint(3, 30)):
            own = list(base)
            for _ in range(r.randint(0, 6)):
                own[r.randrange(len(own))] = sentence(r, 1)
            rows.append(" ".join(own[: len(own) - r.randint(0, 3)]))
    rows += [f"{passage} {sentence(r, r.randint(1, 60))}" for _ in range(40)]
    rows += [sentence(r, r.randint(1, 9)) for _ in range(20)] + ["a b c d", "a b c d e", "a b c d e f", "b c d e f", ""]
    rows += [rows[0]] * 4 + [rows[3].upper()] * 2
    r.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "frequent", "most"), [(1, 16, 2_000_000), (2, 2, 2_000_000), (3, 3, 2_000_000), (4, 2, 50), (5, 10_000, 10)])
def test_components_by_brute_force(spark, seed, frequent, most):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(df, frequent=frequent, max_frequent=most) == brute_components(rows)


def test_test_tables_by_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op8_ngram_jaccard_join(spark, SF).collect()}
    assert got == brute_components(rows)


def test_other_thresholds(spark):
    rows = corpus(9)[:80]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, percent=60, frequent=3) == brute_components(rows, 60)
    assert found(df, percent=100, frequent=3) == brute_components(rows, 100)
    with pytest.raises(ValueError):
        found(df, percent=50)


def test_awkward_documents(spark):
    rows = awkward_rows()
    got = J.jaccard_components(awkward(spark), ["doc_id", "kept"]).collect()
    assert len(got) == len(rows)
    want = brute_components([(r[0], r[1]) for r in rows if r[0] is not None])
    by_id = {r.doc_id: (r.n_shingles, r.component_id) for r in got if r.doc_id is not None}
    assert by_id == want
    unnamed = sorted((r.n_shingles, -1 if r.component_id is None else r.component_id) for r in got if r.doc_id is None)
    assert unnamed == [(0, -1), (want[5][0], 5)]
    assert J.jaccard_components(empty(spark), ["doc_id"]).count() == 0


@pytest.mark.parametrize("percent", [51, 60, 66, 75, 80, 90])
def test_keys_keep_every_link(percent):
    """Two linked sets share a rare key or a combined key, whatever the frequencies and sizes."""
    import numpy as np

    r, tried = random.Random(percent), 0
    while tried < 400:
        n = r.randint(1, 90)
        a = set(r.sample(range(1, 10_000), n))
        b = set(a)
        for _ in range(r.randint(0, n * (100 - percent) // 100 + 1)):
            if b and r.random() < 0.6:
                b.discard(r.choice(sorted(b)))
            if r.random() < 0.6:
                b.add(r.randint(1, 10_000))
        if not b or a == b or 100 * len(a & b) < percent * len(a | b):
            continue
        tried += 1
        plain = r.random() < 0.5  # all tokens frequent: only combinations can tell
        df_of = {t: r.choice([16, 17, 40, 500]) if plain or r.random() < 0.8 else 0 for t in a | b}
        keys = []
        for s in (a, b):
            tokens = np.array(sorted(s), np.uint64)
            rare, combined, _ = J.index_keys(tokens, np.array([df_of[int(t)] for t in tokens]), percent)
            keys.append((set(rare.tolist()), set(combined.tolist())))
        assert keys[0][0] & keys[1][0] or keys[0][1] & keys[1][1]


def test_sizes_of_combinations():
    assert J.combination_sizes(80, 4) == ((1, 0), (2, 1), (3, 5), (4, 14))  # 13 + 14 tokens, 12 of them common, may have 4 runs of 3
    assert J.combination_sizes(60, 4)[0] == (1, 0) and len(J.combination_sizes(51, 4)) == 2


def test_shared_paragraphs_make_few_pairs(spark):
    """Texts that are put together from shared paragraphs, nearly none of them linked, share few combined keys."""
    import numpy as np

    r = random.Random(1)
    paragraphs = [sentence(r, 60) for _ in range(40)]
    sets = J.shingle_sets(["\n".join(r.sample(paragraphs, 6)) for _ in range(600)], 5)
    tokens, df = np.unique(np.concatenate(sets), return_counts=True)
    joined = {}
    for combine in (2, 4):
        keys = []
        for s in sets:
            own = df[np.searchsorted(tokens, s)]
            keys.append(np.unique(J.index_keys(s, np.where(own >= 16, own, 0), 80, combine)[1]))
        m = np.unique(np.concatenate(keys), return_counts=True)[1]
        joined[combine] = int((m * (m - 1) // 2).sum())
    assert joined[4] < joined[2] / 2 and joined[4] < 600 * 599


def test_packed_buckets_round_trip():
    import numpy as np

    values = np.sort(np.array([0, 0, 1, 5, 5, 5, 2**31, 2**32 - 1], np.uint64))
    assert J.unpack(J.pack(values), len(values)).tolist() == values.tolist()


@pytest.mark.parametrize("few", [0, 300_000])
def test_components_of_chains_and_stars(spark, few):
    links = [(i, i + 1) for i in range(40)] + [(100, x) for x in range(101, 140)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.id: r.root for r in components(spark.createDataFrame(links, "a long, b long"), Scratch(spark, "t"), "r", few=few).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 140)}, 200: 200, 201: 200}
    assert components(spark.createDataFrame([], "a long, b long"), Scratch(spark, "t"), "r").count() == 0


# --- personal data -----------------------------------------------------------

PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def brute_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".") if kind == "ip"), "card": 16 <= len(digits) <= 19 and pii.luhn(digits), "phone": 8 <= len(digits) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_spans_by_brute_force():
    r = random.Random(3)
    for letters in ("a1.@ -", "1.25 0+-()", "aZ@.-_%+ \n", "0123456789 -", "é1@.a"):
        for _ in range(4000):
            text = "".join(r.choice(letters) for _ in range(r.randint(0, 40)))
            assert pii.find_spans(text) == brute_spans(text)
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")


def test_long_runs_take_linear_time():
    for text in ("a" * 400_000, "1" * 400_000, "1." * 200_000, "a@" * 200_000, "+1" * 200_000, "1 " * 200_000):
        pii.find_spans(text)


def people(spark):
    """An address that the rare word quillon always stands near, in several texts; common words elsewhere."""
    r = random.Random(1)
    rows = [(i, f"{sentence(r, 30)} common quillon writes to j.doe@mail.example.com about common matters {sentence(r, 30)}") for i in range(6)]
    rows += [(10 + i, f"{sentence(r, 40)} common matters {sentence(r, 10)}") for i in range(200)]
    rows += [(300, "quillon is named here without an address")]
    rows += [(400 + i, "other@mail.example.org with solitary in one text only, copied") for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_disclosing_terms_are_found_near_their_entity(spark):
    df = people(spark)
    got = {r.doc_id: r for r in pii.personal_data(df, ["doc_id"]).collect()}
    texts = {r.doc_id: r.text for r in df.collect()}
    for i in range(6):
        terms = [texts[i][int(a) : int(b)] for k, a, b in (s.split(":") for s in got[i].spans.split(",")) if k == "term"]
        assert "quillon" in terms and "common" not in terms and "matters" not in terms
        assert got[i].n_email == 1 and got[i].n_term == len(terms)
    assert got[300].spans == "" and all(got[10 + i].spans == "" for i in range(200))
    assert all(got[400 + i].n_term == 0 for i in range(5))  # copies of one text support nothing


def test_one_text_is_enough_to_disclose(spark):
    df = people(spark)
    lone = spark.createDataFrame([(500, "common sentences by zebulon who answers at lone@mail.example.net on common matters")], df.schema)
    row = pii.personal_data(df.unionByName(lone), ["doc_id"]).where("doc_id = 500").first()
    text = lone.first().text
    terms = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in row.spans.split(",")) if k == "term"]
    assert "zebulon" in terms and "common" not in terms and "matters" not in terms


def test_query_marks_terms_on_a_given_table(spark):
    assert queries.op9_personal_data(spark, SF).agg(F.sum("n_term")).first()[0] > 0


def test_terms_are_marked_all_over_the_texts_of_their_entity(spark):
    df = people(spark)
    text = "zebulon writes. " + "common matters " * 200 + "lone@mail.example.net " + "common matters " * 200 + "signed Zebulon"
    row = pii.personal_data(df.unionByName(spark.createDataFrame([(500, text)], df.schema)), ["doc_id"]).where("doc_id = 500").first()
    terms = [text[int(a) : int(b)] for k, a, b in (s.split(":") for s in row.spans.split(",")) if k == "term"]
    assert "zebulon" in terms and "Zebulon" in terms and "common" not in terms


def test_words_inside_places_are_no_terms():
    text = "contacts " + " ".join(f"surname{i:02d}@mail.example-{i:02d}.com" for i in range(40)) + " follow " + "a" * 600 + "-inside@mail.example.com end"
    assert [t for t, _, _ in pii.context_terms(text, pii.find_spans(text))] == ["contacts", "follow", "end"]
    assert [t for t, _, _ in pii.context_terms("abc def ghi", [("ip", 0, 9), ("card", 1, 3)])] == []


def test_masking(spark):
    df = people(spark).withColumns({"n_email": F.lit(1), "terms": F.lit("clash"), "entity": F.lit("clash")})
    out = pii.sanitise(df)
    assert out.columns == df.columns and out.count() == df.count()
    texts = {r.doc_id: r.text for r in out.collect()}
    assert "<EMAIL>" in texts[0] and "@" not in texts[0] and "quillon" not in texts[0]
    assert "quillon" in texts[300] and all(not pii.find_spans(t) for t in texts.values())
    assert pii.mask("ab cd ef", [("ip", 3, 5), ("card", 4, 8)], [{"start": 0, "end": 2, "removed": True}]) == " <IP>"


def test_generalised_terms_keep_their_kind_of_word():
    terms = [{"start": a, "end": b, "removed": False} for a, b in ((0, 5), (6, 10), (11, 17))]
    assert pii.mask("Smith NASA quarks", [], terms) == "<NAME> <ACRONYM> <TERM>"


def test_term_ids_are_the_columns_hashes(spark):
    terms = ["alpha", "straße", "日本語", "x" * 100]
    rows = spark.createDataFrame([(t,) for t in terms], "term string").select("term", F.xxhash64("term").alias("id")).collect()
    assert all(pii._term_id(r.term) == r.id % (1 << 64) for r in rows)


def test_own_columns_clash_with_none(spark):
    df = people(spark).withColumns({"__key0": F.lit(1), "__terms0": F.lit("x"), "__KEY1": F.lit(2), "__key": F.lit(3), "__terms": F.lit(4)})
    out = pii.sanitise(df)
    assert out.columns == df.columns and {tuple(r) for r in out.select("__key0", "__terms0", "__KEY1", "__key", "__terms").collect()} == {(1, "x", 2, 3, 4)}


def brute_terms(rows: list[str | None], generalise: float = 0.8) -> dict[str, set[tuple[int, int]]]:
    """Places of each text's disclosing terms, from plain counts of all entities and terms."""
    import math

    found = {t: pii.find_spans(t) for t in rows if t}
    n_e, n_t, n_te = {}, {}, {}
    words = {t: {w.lower() for w in re.findall(r"[^\W\d_]{3,}", t)} for t in found}
    terms = {t: list(pii.context_terms(t, s)) for t, s in found.items() if s}
    entities = {t: {pii.entity_of(k, t[a:b]) for k, a, b in s} for t, s in found.items() if s}
    for t in rows:
        for e in entities.get(t, ()):
            n_e[e] = n_e.get(e, 0) + 1
        for w in words.get(t, ()):
            n_t[w] = n_t.get(w, 0) + 1
    for t, own in entities.items():
        for e in own:
            for w in {w for w, _, _ in terms[t]}:
                n_te[w, e] = n_te.get((w, e), 0) + 1
    n = len(rows)
    strong = {(w, e) for (w, e), k in n_te.items() if n_e[e] < n and math.log(n * k / (n_t[w] * n_e[e])) / math.log(n / n_e[e]) >= generalise}
    return {t: {(a, b) for w, a, b in terms[t] if any((w, e) in strong for e in own)} for t, own in entities.items()}


def test_terms_by_brute_force(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(people(spark).withColumn("doc_id", F.col("doc_id") + 10_000))
    texts = {r.doc_id: r.text for r in df.collect()}
    want = brute_terms(list(texts.values()))
    marked = 0
    for r in pii.personal_data(df, ["doc_id"]).collect():
        got = {(int(a), int(b)) for k, a, b in (s.split(":") for s in r.spans.split(",") if s) if k == "term"}
        assert got == want.get(texts[r.doc_id], set())
        marked += len(got)
    assert marked > 50


def test_query_by_brute_force(spark):
    import hashlib

    got = {r.doc_id: r for r in queries.op9_personal_data(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        spans = brute_spans(d.text)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        r = got[d.doc_id]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for x, _, _ in spans) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(joined.encode()).hexdigest() and r.spans.startswith(joined)


def test_awkward_personal_data(spark):
    got = pii.personal_data(awkward(spark), ["doc_id"]).collect()
    assert len(got) == len(awkward_rows())
    by_id = {r.doc_id: r for r in got}
    assert by_id[13].n_email == 1 and by_id[13].n_phone == 1 and by_id[0].spans == ""
    assert pii.personal_data(empty(spark), ["doc_id"]).count() == 0
    assert pii.sanitise(awkward(spark)).count() == len(awkward_rows())
    assert pii.sanitise(empty(spark)).count() == 0
