import math
import random

from pyspark.sql import functions as F

from paperloom.llm import topk, url_filter
from tests.llm.helpers import awkward


def brute_topk(rows, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], set()
    for q, v in usable:
        if q % 50 or (q, tuple(v)) in seen:
            continue
        seen.add((q, tuple(v)))
        scored = sorted((-sum(a * b for a, b in zip(v, w)), c) for c, w in usable if c != q and len(w) == len(v))[:k]
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scored)]
    return sorted(out)


def found(df, **kw):
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % 50 == 0, **kw).select("query_id", "rank", "id", "score").collect())


def test_topk_by_brute_force(spark):
    r = random.Random(7)
    rows = [(i, [round(r.uniform(-1, 1), 1) for _ in range(4)]) for i in range(400)]
    rows += [(400 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(100)]  # ties
    rows += [(1000, None), (1050, []), (1100, [1.0, None, 0.0, 0.0]), (1150, [float("nan")] * 4), (1200, [float("inf"), 0.0, 0.0, 0.0]), (None, [0.1] * 4), (1250, [0.1, 0.2]), (1251, [0.3, 0.4]), (1300, [0.1, 0.2, 0.3])]
    rows += [rows[3], rows[50]]  # repeated rows
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumns({"score": F.lit("clash"), "rank": F.lit(0)}).repartition(7)
    rows = [(x.vec_id, x.embedding) for x in df.collect()]
    assert found(df, k=5) == brute_topk(rows, 5)
    assert found(df, k=3, block=4, bins=8) == brute_topk(rows, 3)


def test_topk_of_large_components_and_few_rows(spark):
    rows = [(0, [1e12, 1e12]), (1, [1e12, -3.0]), (2, [-1e12, 5.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = found(df, k=5)
    assert [x[2] for x in got] == [1, 2] and got[0][3] == (1 << 63) - 1 and got[1][3] == -(1 << 63)
    assert found(df.limit(0)) == []
    assert found(df.where("vec_id > 0")) == []


RULES = [(v, h, p) for v, h, p in url_filter.RULES]


def brute_url(url, rules):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    end = min([path.find(c) for c in "?#" if c in path] or [len(path)])
    path = path[:end]
    fits = [(len(h + p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=None)
    return host, path, best[2] if best else None, best[3] if best else "allow"


URLS = [None, "", "no scheme", "http://NET/", "http://a.net", "http://a.net/", "https://x.example.net/en/1?q#f", "https://example.net/EN/", "http://m.example.com/de/x", "http://example.com/fr/", "ftp://o.org/fr/1", "http://org/fr/", "http://xorg/fr/",
        "http://a.net?x=/", "http://a.net#/", "://b.net/", "http://u@c.net:80/", "http://.net/", "http://a..net/en/", "http://example.net://x.net/"]


def test_rules_by_brute_force(spark):
    df = spark.createDataFrame([(i, u, "clash", "x") for i, u in enumerate(URLS)], "page_id long, url string, host string, hash string")
    rules = url_filter.production_rules(spark)
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(df, rules, ["page_id"]).collect()}
    assert got == {i: brute_url(u, RULES) for i, u in enumerate(URLS)}
    assert url_filter.filter_urls(df.limit(0), rules, ["page_id"]).count() == 0
    assert url_filter.filter_urls(df, rules.limit(0), ["page_id"]).where("verdict <> 'allow'").count() == 0


def test_many_rules_stay_exact(spark):
    r = random.Random(3)
    host = lambda: ".".join(r.choice(["a", "b", "c", "net", "org"]) for _ in range(r.randint(1, 4)))
    path = lambda: "/" + "".join(r.choice("xy/") for _ in range(r.randint(0, 3)))
    rules = sorted({(h, p): (r.choice(["block", "allow"]), h, p) for h, p in ((host(), path()) for _ in range(800))}.values())
    urls = [(i, f"http://{host()}{path()}") for i in range(1500)] + [(9000 + i, "http://a.b.net/xy") for i in range(500)]
    df = spark.createDataFrame(urls, "page_id long, url string").repartition(5)
    for shards in ({}, {"max_bits": 4000}):
        got = {x.page_id: (x.host, x.path, x.rule, x.verdict) for x in url_filter.filter_urls(df, spark.createDataFrame(rules, "verdict string, host string, path string"), ["page_id"], bits_per_key=4, **shards).collect()}
        want = {i: brute_url(u, rules) for i, u in urls}
        assert {i: g[2] for i, g in got.items()} == {i: w[2] for i, w in want.items()}
        assert got == want


def test_cascade_needs_levels(spark):
    universe = spark.range(20_000).select(F.xxhash64("id").alias("hash"), (F.col("id") % 50 == 0).alias("listed"))
    cascade = url_filter.build_cascade(universe, bits_per_key=3, hashes=2)
    assert len(cascade.levels) > 2
    rows = universe.toPandas()
    assert (cascade.listed(rows["hash"].to_numpy()) == rows["listed"].to_numpy()).all()


def test_awkward_documents_have_no_urls(spark):
    df = awkward(spark).withColumnRenamed("text", "url")
    assert url_filter.filter_urls(df, url_filter.production_rules(spark), ["doc_id"]).where("verdict = 'block'").count() == 0
