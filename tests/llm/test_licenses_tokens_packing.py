import random
import re
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.llm import licenses as L
from paperloom.llm import packing as P
from paperloom.llm import queries
from paperloom.llm import tokens as T
from tests.llm.helpers import awkward, awkward_rows, empty

SF = "/root/testdata/sf0.001"


def brute_license(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
    at, labels = [], set()
    for phrase, label in L.PHRASES.items():
        p = phrase.split()
        hits = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        at += hits
        labels |= {label} if hits else set()
    return len(words), len(at), min(at, default=None), max(at, default=None), ",".join(sorted(labels))


def test_base_places_by_brute_force(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    texts += ["The MIT-License, mit license; MIT\nLICENSE", "mit mit license", "gnu general public license general public license v2", None, "", "mitlicense émit license"]
    found = L.scan(texts, L.PHRASES, [])
    got = list(zip(found["n_words"], found["n_base"], found["first_word"], found["last_word"], found["base_labels"]))
    assert got == [brute_license(t) for t in texts]


@pytest.fixture(scope="module")
def automata():
    return {k: L.compile_template(k, v) for k, v in L.TEMPLATES.items()}


def labels_of(text, automata):
    return L.scan([text], L.PHRASES, list(automata.values()))["labels"][0].split(",")


def plain(template):
    """A template's wording with its optional words and the first choices."""
    text = re.sub(r"<<one:([^|>]*)[^>]*>>", r"\1", template)
    return re.sub(r"<<any:\d+>>", "some other words", re.sub(r"<<optional>>|<<end>>", "", text))


def bare(template):
    """A template's wording without what may be missing."""
    text = re.sub(r"<<optional>>.*?<<end>>", "", re.sub(r"<<one:([^|>]*)[^>]*>>", r"\1", template))
    return re.sub(r"<<any:\d+>>", "", text)


@pytest.mark.parametrize("name", list(L.TEMPLATES))
def test_templates_accept_their_wordings_only(name, automata):
    template = L.TEMPLATES[name]
    for text in (plain(template), bare(template).upper().replace(" ", ",\n"), f"before it {plain(template)} and after"):
        assert name in labels_of(text, automata)
    mandatory = [w for w in bare(template).split()]
    for i in range(0, len(mandatory), 7):
        broken = [*mandatory[:i], "otherword", *mandatory[i + 1 :]]
        choice = re.search(r"<<one:([^>]*)>>", template)
        if mandatory[i] in (choice[1].split("|") if choice else ()):
            continue
        assert name not in labels_of(" ".join(broken), automata)


def test_replaceable_regions_are_bounded(automata):
    text = "released {} gnu general public license"
    assert "gpl-notice" in labels_of(text.format("x " * 12), automata)
    assert "gpl-notice" not in labels_of(text.format("x " * 13), automata)


def test_awkward_licenses(spark):
    got = L.license_scan(awkward(spark), ["doc_id"]).collect()
    assert len(got) == len(awkward_rows())
    assert all(r.n_words == 0 and r.labels == "" for r in got if r.doc_id in (0, 1, 2))
    assert L.license_scan(empty(spark), ["doc_id"]).count() == 0
    assert {r.labels for r in queries.op4_license_scans(spark, SF).collect()} >= {""}


# --- tokens ------------------------------------------------------------------


@pytest.fixture(scope="module")
def vocabulary():
    with open(T.VOCABULARY, "rb") as f:
        return f.read()


def test_tokens_round_trip(vocabulary):
    encoding, lengths = T._encoding(vocabulary)
    for text in ("plain words, twice.\nA line", "日本語 テキスト é", "\n\n", "x" * 2000):
        ids = encoding.encode_ordinary(text)
        assert b"".join(encoding.decode_single_token_bytes(i) for i in ids).decode() == text
        assert T.token_ends(text, vocabulary).tolist() == np.cumsum([len(encoding.decode_single_token_bytes(i)) for i in ids]).tolist()


def test_crossing_tokens_follow_the_rule():
    ends, bounds = np.array([2, 7, 9, 12]), np.array([0, 4, 8, 12])  # tokens 2-7 and 7-9 cross
    assert T.allocate(ends, bounds, "start")[0].tolist() == [2, 1, 1]
    assert T.allocate(ends, bounds, "majority")[0].tolist() == [1, 2, 1]  # a tie goes to the earlier section
    assert np.allclose(T.allocate(ends, bounds, "proportional")[0], [1.4, 1.1, 1.5])
    assert T.allocate(ends, bounds, "start")[1].tolist() == [1, 2, 1]
    wide = T.allocate(np.array([12]), bounds, "proportional")
    assert np.allclose(wide[0], [1 / 3] * 3)


def test_sections_cover_every_token(spark, vocabulary):
    encoding, _ = T._encoding(vocabulary)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    total, spans = {}, {}
    for r in queries.op7_token_counts(spark, SF).collect():
        total[r.doc_id] = total.get(r.doc_id, 0) + r.n_tokens
        spans.setdefault(r.doc_id, []).append((r.section, r.start, r.end))
    for d, text in docs.items():
        assert total[d] == len(encoding.encode_ordinary(text))
        assert "".join(text[a:b] for _, a, b in sorted(spans[d])) == text
        assert [text[a:b] for _, a, b in sorted(spans[d])] == re.findall(r"[^\n]*\n|[^\n]+$", text)


def test_awkward_tokens(spark):
    rows = T.section_tokens(awkward(spark), ["doc_id"], rule="proportional").collect()
    assert {(r.section, r.n_tokens) for r in rows if r.doc_id == 0} == {(None, 0.0)}
    assert {(r.section, r.start, r.end, r.n_tokens) for r in rows if r.doc_id == 1} == {(0, 0, 0, 0.0)}
    assert T.section_tokens(empty(spark), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        T.section_tokens(empty(spark), ["doc_id"], rule="other")


def test_long_words_are_encoded_in_time(vocabulary):
    began = time.time()
    assert T.token_ends("ab" * 50_000, vocabulary)[-1] == 100_000
    assert time.time() - began < 30


# --- packing -----------------------------------------------------------------


def test_packing_is_sound():
    r = random.Random(4)
    for lengths, overhead in (((8, 16, 32), 2), ((10,), 0), ((5, 50), 100)):
        sizes = sorted((r.randint(1, lengths[-1]) for _ in range(400)), reverse=True)
        of, offset, final = P.pack(sizes, lengths, overhead)
        filled = {}
        for s, b, o in zip(sizes, of, offset):
            assert o == filled.get(b, 0)
            filled[b] = o + s
        for b, f in filled.items():
            assert final[b] == min(n for n in lengths if n >= f)
        assert sum(final) < 1.25 * sum(sizes) + lengths[-1] * 2 + len(lengths) * 10


def test_items_go_into_the_fullest_bin_that_holds_them():
    of, _, final = P.pack([7, 6, 3, 2], (10,), 0)
    assert of == [0, 1, 0, 1] and final == [10, 10]
    assert P.pack([3], (4, 8), 0)[2] == [4]  # cut down to the contents


def test_lengths_are_weighed_against_each_other():
    # with dear sequences two items share a long one; with free sequences each gets its own
    assert P.pack([4, 4], (4, 8), 10)[2] == [8]
    assert P.pack([4, 4], (4, 8), 0)[2] == [4, 4]


def test_look_ahead_fills_the_whole_trial_bin():
    assert P.pack([16] * 512)[2] == [8192]
    r = random.Random(3)
    for _ in range(50):
        sizes = [r.randint(1, 40) for _ in range(400)]
        rest = P._Sizes()
        for x in sizes:
            rest.add(x)

        def cost(length, first=50, sizes=sizes):
            filled = first
            for x in sorted(sizes, reverse=True):
                filled += x * (filled + x <= length)
            return (length + P.OVERHEAD) / filled

        assert P.best_length(50, rest, P.LENGTHS, P.OVERHEAD) == min(P.LENGTHS, key=cost)


def test_documents_are_packed_whole(spark):
    sizes = [0, None, 1, 5, 512, 513, 8192, 8193, 30_000] + [100] * 300
    df = spark.createDataFrame([(i, s, "x") for i, s in enumerate(sizes)] + [(3, 5, "x")], "doc_id long, n int, bin_id string")
    rows = P.pack_documents(df, ["doc_id"], "n", group_rows=100).collect()
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r["size"]))
        if r.bin_id is None:
            assert not sizes[r.doc_id]
        else:
            bins.setdefault(r.bin_id, []).append((r.bin_offset, r["size"], r.bin_length))
    for d, s in enumerate(sizes):
        assert sum(x[2] for x in pieces[d]) == (s or 0) * (2 if d == 3 else 1)
    for items in bins.values():
        at = 0
        for offset, size, length in sorted(items):
            assert offset == at
            at += size
        assert length == min(n for n in P.LENGTHS if n >= at)
    assert P.pack_documents(df.limit(0), ["doc_id"], "n").count() == 0


def test_equal_rows_fall_into_bounded_groups(spark):
    same = spark.range(30_000).select(F.lit(7).alias("doc_id"), F.lit(300).alias("n"))
    rows = P.pack_documents(same, ["doc_id"], "n", group_rows=1000)
    groups = rows.groupBy((F.col("bin_id") / (1 << 32)).cast("long").alias("g")).count().collect()
    assert len(groups) == 30 and sum(g["count"] for g in groups) == 30_000 and max(g["count"] for g in groups) < 3_000


def plain_packing(sizes, lengths, overhead):
    """Best fit with look-ahead by plain loops over all bins and items."""
    rest, bins, of = list(sizes), [], []
    for turn, size in enumerate(sizes):
        rest.remove(size)
        fitting = [i for i, (length, filled, _) in enumerate(bins) if length - filled >= size]
        if fitting:
            b = min(fitting, key=lambda i: (bins[i][0] - bins[i][1], -bins[i][2]))  # of equal room the one last used
        else:
            costs = []
            for length in lengths:
                if length >= size:
                    filled = size
                    for x in sorted(rest, reverse=True):
                        filled += x * (filled + x <= length)
                    costs.append(((length + overhead) / filled, length))
            b = len(bins)
            bins.append([min(costs)[1], 0, turn])
        bins[b][1:] = [bins[b][1] + size, turn]
        of.append(b)
    return [bins[b][1] for b in of], sorted(min(n for n in lengths if n >= filled) for _, filled, _ in bins)


def test_packing_by_brute_force():
    r = random.Random(9)
    for _ in range(60):
        lengths, overhead = r.choice([((8, 16, 32), 2), ((10, 25), 1), ((512, 1024, 2048), 32)])
        sizes = sorted((r.randint(1, lengths[-1]) for _ in range(r.randint(1, 60))), reverse=True)
        of, _, final = P.pack(sizes, lengths, overhead)
        filled = {}
        for s, b in zip(sizes, of):
            filled[b] = filled.get(b, 0) + s
        want = plain_packing(sizes, lengths, overhead)
        assert sorted(final) == want[1] and sorted(filled[b] for b in of) == sorted(want[0])
