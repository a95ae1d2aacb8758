import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from paperloom.llm import queries
from paperloom.llm._words import ALNUM, SPACED, Words, window_hashes
from paperloom.llm.quality import RepetitionLimits, measure, quality_rules, repeat_lengths
from tests.llm.helpers import awkward, awkward_rows, empty

SF = "/root/testdata/sf0.001"


@given(st.lists(st.one_of(st.none(), st.text(max_size=40)), max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_match_their_pattern(texts):
    texts = [t if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    for alphabet, lower, pattern in ((SPACED, False, r"[^\x20\x09-\x0D]+"), (ALNUM, True, r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")):
        words = Words(texts, alphabet, lower)
        found = [words.word(i) for i in range(len(words.start))]
        want = [re.findall(pattern, "".join(chr(ord(c) + 32) if lower and "A" <= c <= "Z" else c for c in t or "")) for t in texts]
        assert found == [w for ws in want for w in ws]
        assert words.counts.tolist() == [len(w) for w in want]


def test_hashes_tell_words_apart():
    words = Words(["to be or not to be", "or to", None, ""])
    by_word = {}
    for i, h in enumerate(words.hashes().tolist()):
        assert by_word.setdefault(words.word(i), h) == h
    assert len(set(by_word.values())) == 4
    assert len(window_hashes(words.hashes(), 3)) == 6


def brute_repeats(words):
    n = len(words)
    out = [0] * n
    for i in range(n):
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            out[i] = max(out[i], k)
    return out


def test_repeat_lengths_by_brute_force():
    r = random.Random(2)
    texts = [" ".join(r.choice("ab cd"[: r.randint(1, 5)]) or "x" for _ in range(r.randint(0, 40))) for _ in range(80)] + [None, "", "a " * 33]
    words = Words(texts)
    want = [x for t in texts for x in brute_repeats((t or "").encode().split())]
    assert repeat_lengths(words.text_of, words.hashes()).tolist() == want


def brute_base(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 2):
        windows.setdefault(tuple(words[i : i + 3]), []).append(i)
    covered = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), failed


def test_base_counts_by_brute_force(spark):
    got = {r.doc_id: r for r in queries.op3_quality_rules(spark, SF).collect()}
    for d in spark.read.parquet(f"{SF}/documents.parquet").collect():
        r = got[d.doc_id]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == brute_base(d.text)
        assert not (r.kept and r.base_failed)


def test_awkward_rows(spark):
    rows = awkward_rows()
    found = quality_rules(awkward(spark), ["doc_id"]).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id is not None}
    for r in rows:
        if r[0] is not None:
            g = by_id[r[0]]
            assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words, g.base_failed) == brute_base(r[1])
    assert by_id[5].kept and by_id[16].kept and not by_id[11].kept and not by_id[0].kept
    assert quality_rules(empty(spark), ["doc_id"]).count() == 0


def test_method_rejects_long_repeats():
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(words[:160])
    found = measure([" ".join(words), f"{passage} {' '.join(words[160:])} {passage}"], RepetitionLimits())
    assert found["longest_repeat"].tolist() == [0, 160]
    assert found["covered_words"].tolist() == [0, 320]
    assert np.all(found["n_words"] == [300, 460])
