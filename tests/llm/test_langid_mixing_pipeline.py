import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as CP
from paperloom.llm import langid, mixing, pii, queries
from paperloom.llm._shared import dealt
from tests.llm.helpers import awkward, awkward_rows, brute_components, empty

SF = "/root/testdata/sf0.001"
SF2 = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    langs = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF2}/documents.parquet").select("doc_id", "lang").collect()}
    rows = queries.op1_language_id(spark, SF2).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == langs[r.doc_id] for r in held) / len(held) >= 0.97


def model(spark):
    df = spark.read.parquet(f"{SF2}/documents.parquet")
    return langid.fit(df, F.lit(True)), {r.lang: r.text for r in df.where("n_chars between 2000 and 4000").collect()}


def test_mixtures_are_found(spark):
    own, texts = model(spark)
    share = langid.mixtures([texts["en"][:1200] + " " + texts["de"][:600], texts["fr"], None, "123 ###", "", texts["es"][:40]], own)
    named = [dict(zip(own.languages, row.round(2))) for row in share]
    assert 0.5 < named[0]["en"] < 0.8 and 0.2 < named[0]["de"] < 0.5 and named[0]["fr"] < 0.05
    assert named[1]["fr"] > 0.97 and max(named[5], key=named[5].get) == "es"
    assert not share[2:5].any()


def test_proportions_maximise_the_likelihood(spark):
    """The fitted shares are as likely as the best of a grid, by a plain computation."""
    own, texts = model(spark)
    text = texts["en"][:900] + " " + texts["fr"][:900]
    owner, feature = langid.features([text], own.bits)
    p = own.likelihood[feature].astype(float)
    pick = [own.languages.index("en"), own.languages.index("fr")]
    grid = max(np.log(p[:, pick] @ np.array([w, 1 - w])).sum() for w in np.linspace(0.01, 0.99, 99))
    share = langid.mixtures([text], own)[0]
    assert np.log(p @ share).sum() > grid - 0.5


def plain_mixture(text, own):
    """One text's mixture by plain loops: trigrams, growth by the fastest rate, EM, penalised gain."""
    import math

    data = [b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in b" " + (text or "").lower().encode() + b" "]
    found = {}
    for a, b, c in zip(data, data[1:], data[2:]):
        if b != 0x20:
            f = ((a << 16 | b << 8 | c) * 0x9E3779B1 % 2**32) >> (32 - own.bits)
            found[f] = found.get(f, 0) + 1
    n = len(own.languages)
    p = {f: [float(x) for x in own.likelihood[f]] for f in found}
    total = sum(found.values())

    def log(share):
        return sum(k * math.log(sum(x * s for x, s in zip(p[f], share))) for f, k in found.items())

    share = [0.0] * n
    first = max(range(n), key=lambda i: log([float(i == j) for j in range(n)]))
    share[first], now, used = 1.0, None, {first}
    now = log(share)
    while len(used) < n:
        rate = {i: sum(k * p[f][i] / sum(x * s for x, s in zip(p[f], share)) for f, k in found.items()) / total - 1 for i in range(n) if i not in used}
        added = max(rate, key=rate.get)
        if rate[added] <= 1e-6:
            break
        new = [0.9 * s for s in share]
        new[added] = 0.1
        for _ in range(30):
            after = [sum(k * p[f][i] * new[i] / sum(x * s for x, s in zip(p[f], new)) for f, k in found.items()) / total for i in range(n)]
            moved = max(abs(a - b) for a, b in zip(after, new))
            new = after
            if moved < 1e-3:
                break
        if (log(new) - now) / 3 <= 0.5 * math.log(max(total / 3, 1)) + 3:
            break
        share, now = new, log(new)
        used.add(added)
    return share


def test_mixtures_by_brute_force(spark):
    own, texts = model(spark)
    r = random.Random(3)
    asked = [" ".join(texts[x][r.randrange(1000) :][: r.randint(3, 500)] for x in r.sample(sorted(texts), r.randint(1, 4))) for _ in range(25)]
    got = langid.mixtures(asked, own)
    assert all(np.allclose(row, plain_mixture(t, own), atol=1e-6) for row, t in zip(got, asked))
    assert sum((row > 0.02).sum() > 1 for row in got) > 5


def test_a_text_is_fitted_by_itself(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    own = langid.fit(df, F.lit(True))
    one, other = (sorted((r.doc_id, r.lang_pred, r.score, r.mixture) for r in langid.identify(df.repartition(n, "text"), own, ["doc_id"]).collect()) for n in (1, 9))
    assert one == other


def test_single_letters_are_letters(spark):
    own, _ = model(spark)
    assert langid.mixtures(["a", "7 x 9"], own).sum(axis=1).round(6).tolist() == [1, 1]


def test_many_languages_can_be_mixed():
    alphabet = "abcdefghijklmnopqrst"
    texts = [" ".join(c * 3 for _ in range(60)) for c in alphabet]
    counts = np.zeros((20, 1 << 12))
    for i, t in enumerate(texts):
        np.add.at(counts[i], langid.features([t], 12)[1], 1)
    likelihood = (counts + 0.01) / (counts + 0.01).sum(axis=1, keepdims=True)
    own = langid.Model(list(alphabet), likelihood.T.astype(np.float32), 12)
    assert (langid.mixtures([" ".join(texts)], own)[0] > 0.02).sum() == 20


def test_awkward_languages(spark):
    df = awkward(spark)
    got = langid.identify(df, langid.fit(df, F.lit(True)), ["doc_id"]).collect()
    assert len(got) == len(awkward_rows())
    assert {r.lang_pred for r in got if r.doc_id in (0, 1, 2)} == {"und"} and all(r.score == 0 for r in got if r.lang_pred == "und")
    nothing = langid.fit(df, F.lit(False))
    assert {r.lang_pred for r in langid.identify(df, nothing, ["doc_id"]).collect()} == {"und"}
    assert langid.identify(empty(spark), nothing, ["doc_id"]).count() == 0
    clash = df.withColumn("lang_pred", F.lit(1)).withColumn("score", F.lit("x"))
    assert langid.identify(clash, nothing, ["doc_id"]).columns == ["doc_id", "lang_pred", "score", "mixture"]


# --- mixing ------------------------------------------------------------------


def brute_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        free = [s for s in order if s not in capped]
        rest = total - sum(3 * sizes[s] for s in capped)
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 3 * sizes[s]}
        if not over:
            return {**{s: 3.0 * sizes[s] for s in capped}, **share}
        capped |= over


def test_targets_by_brute_force():
    r = random.Random(6)
    for _ in range(300):
        sizes = {s: r.choice([0, 1, 5, 1000, r.randint(0, 500)]) for s in [*"abcdefg"[: r.randint(1, 7)], None]}
        if sum(sizes.values()):
            got, want = mixing.targets(sizes), brute_targets(sizes)
            assert all(abs(got[s] - want[s]) < 1e-6 * (1 + want[s]) for s in sizes)
    assert mixing.targets({}) == {}


def test_pairs_keep_mass_and_expectation():
    r = np.random.default_rng(4)
    sizes, parts = [10 + k % 7 for k in range(200)], [0.37] * 200
    taken, held, rest = mixing.round_pairs(sizes, parts, r.random(200).tolist())
    left = sizes[held] * rest if held >= 0 else 0
    assert abs(sum(a * b for a, b in zip(sizes, taken)) + left - 0.37 * sum(sizes)) < 1e-6
    share = np.mean([mixing.round_pairs([10] * 40, [0.25] * 40, r.random(40).tolist())[0] for _ in range(60)])
    assert abs(share - 0.25) < 0.05
    # a text longer than its source's target keeps its probability, too
    assert abs(np.mean([mixing.round_pairs([1000, 10, 10], [0.01] * 3, r.random(3).tolist())[2] for _ in range(400)]) - 0.01) < 0.005
    assert mixing.round_pairs([0, 5, 5], [0.5, 0.0, 1.0], [0.1] * 3) == ([0, 0, 1], -1, 0.0)


def test_nearest_subset_by_brute_force():
    r = random.Random(8)
    for _ in range(200):
        values = [r.randint(-300, 300) for _ in range(r.randint(0, 9))]
        wanted = r.uniform(-500, 500)
        sums = {m: sum(v for i, v in enumerate(values) if m >> i & 1) for m in range(1 << len(values))}
        got = mixing.nearest_subset(wanted, values)
        assert abs(abs(wanted - sum(values[i] for i in got)) - min(abs(wanted - x) for x in sums.values())) < 1e-5


def test_small_sources_come_as_near_as_they_can(spark):
    r = random.Random(12)
    docs = [(i, f"s{i % 4}", " ".join("w" * r.choice([1, 40, 300, 2500]))) for i in range(36)]
    rows = mixing.mix(spark.createDataFrame(docs, "doc_id long, source string, text string"), ["doc_id", "source"]).collect()
    for source in sorted({x[1] for x in docs}):
        own = [x for x in rows if x.source == source]
        ratio = own[0].target / own[0].source_size
        sums = {0}
        for x in own:
            sums = {s + x["size"] * c for s in sums for c in {int(ratio), int(np.ceil(ratio))}}
        assert abs(sum(x.taken for x in own) - own[0].target) <= min(abs(s - own[0].target) for s in sums) + 0.5


def test_repeated_rows_are_dealt_over_buckets(spark):
    """30,000 equal rows fill 30 buckets of a thousand, and are rounded one by one."""
    same = spark.range(30_000).select(F.lit(1).alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("x").alias("source"))
    sized = mixing.with_sizes(same, ["doc_id"])
    groups = dealt(sized, "__key", F.lit(50), 30).groupBy("__group").agg(F.sum("__n").alias("n")).collect()
    assert len(groups) == 30 and sum(g.n for g in groups) == 30_000 and max(g.n for g in groups) < 3_000
    other = spark.range(30_000).select(F.lit(1).alias("doc_id"), F.lit("a b c d e").alias("text"), F.lit("y").alias("source"))
    got = mixing.mix(same.unionByName(other), ["doc_id", "source"], bucket_rows=1000).groupBy("source").agg(F.count("*").alias("n"), F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("copies").alias("most")).collect()
    assert {g.n for g in got} == {30_000} and all(abs(g.taken - g.target) <= 2.5 and g.most <= 2 for g in got)


def rows_of(df, **kw):
    return sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in mixing.mix(df, ["doc_id"], **kw).collect())


def test_sources_meet_their_targets(spark):
    df = spark.read.parquet(f"{SF2}/documents.parquet")
    rows = rows_of(df)
    for small in ({"bucket_rows": 20, "fan_in": 3}, {}):
        got = mixing.mix(df.repartition(7), ["doc_id", "source"], **small).collect()
        by = {}
        for r in got:
            d = by.setdefault(r.source, [0, 0, r.target, r.source_size])
            d[0] += r.taken
            d[1] = max(d[1], r["size"])
            assert 0 <= r.taken <= 3 * r["size"] and r.taken % max(1, r["size"]) == 0
        assert all(abs(t - target) <= 2 for t, _, target, _ in by.values())
    assert rows == rows_of(df.repartition(3))  # reruns agree, however the rows are dealt


def test_awkward_mixing(spark):
    rows = mixing.mix(awkward(spark), ["doc_id"]).collect()
    assert len(rows) == len(awkward_rows())
    assert all(r.taken == 0 for r in rows if r["size"] == 0)
    assert mixing.mix(empty(spark), ["doc_id"]).count() == 0
    assert mixing.mix(awkward(spark).where("text is null"), ["doc_id"]).count() == 2


# --- pipeline ----------------------------------------------------------------


def staged(spark, docs, tmp_path):
    for i, (name, stage) in enumerate(CP.STAGES):
        path = str(tmp_path / f"{i}")
        stage(spark, docs, SF).write.parquet(path)
        docs = spark.read.parquet(path)
        yield name, docs


def test_stages_on_the_test_table(spark, tmp_path):
    start = spark.read.parquet(f"{SF}/documents.parquet")
    tables = dict(staged(spark, start, tmp_path))
    assert [n for n, _ in CP.STAGES] == list(tables) and all(tables[n].columns == CP.COLUMNS for n in list(tables)[:-1])
    kept = {r.doc_id for r in queries.op3_quality_rules(spark, SF).where("kept").collect()}
    assert {r.doc_id for r in tables["quality_rules"].collect()} == kept
    first = brute_components([(r.doc_id, r.text) for r in tables["quality_rules"].collect()])
    unique = tables["ngram_jaccard_join"].collect()
    assert sorted(r.doc_id for r in unique) == sorted(d for d, (_, c) in first.items() if c == d)
    clean = tables["personal_data"].collect()
    assert sorted(r.doc_id for r in clean) == sorted(r.doc_id for r in unique)
    before = {r.doc_id: r.text for r in unique}
    for r in clean:
        assert not pii.find_spans(r.text) and r.n_chars == len(r.text)
        assert r.text == before[r.doc_id] or pii.find_spans(before[r.doc_id])
    mixed = tables["source_mixing"].groupBy("doc_id").count().collect()
    want = {r.doc_id: r.copies for r in mixing.mix(tables["personal_data"].withColumn("__row", F.xxhash64(*CP.COLUMNS)), ["doc_id", "__row"]).collect()}
    assert len({r.doc_id for r in mixed} - set(want)) == 0 and all(r["count"] <= 3 for r in mixed)
    packed = tables["best_fit_packing"]
    sizes = {r.doc_id: r.n for r in packed.groupBy("doc_id").agg(F.sum("size").alias("n")).collect()}
    assert set(sizes) == {r.doc_id for r in mixed}
    assert packed.groupBy("bin_id").agg((F.sum("size") - F.max("bin_length")).alias("over")).where("over > 0").count() == 0


def test_stages_on_awkward_rows(spark, tmp_path):
    for name, docs in staged(spark, awkward(spark), tmp_path / "a"):
        assert name == "best_fit_packing" or docs.columns == CP.COLUMNS
    for _, stage in CP.STAGES:
        assert stage(spark, empty(spark), SF).count() == 0
    # every stage alone, on rows that earlier ones would have dropped
    unique = CP.drop_near_copies(spark, awkward(spark), SF).collect()
    assert sorted(-1 if r.doc_id is None else r.doc_id for r in unique) == [-1, 0, 1, 2, 3, 4, 5, 9, 10, 11, 12, 13, 14, 15, 16]
    assert CP.remove_personal_data(spark, awkward(spark), SF).count() == len(awkward_rows())
    taken = CP.mix_sources(spark, awkward(spark), SF).count()
    assert taken == sum(r.copies for r in mixing.mix(awkward(spark).select(*CP.COLUMNS).withColumn("__row", F.xxhash64(*CP.COLUMNS)), ["__row"]).collect())


def test_run_is_the_stages_result(spark):
    rows = CP.run(spark, SF)
    assert set(rows.columns) == {"doc_id", "source", "piece", "start", "size", "bin_id", "bin_offset", "bin_length"}
    assert rows.count() > 0
