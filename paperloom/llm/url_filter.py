"""URL rules through Bloom filter cascades.

A rule is a host and the start of a path, with a verdict.  It fits its host, all
subdomains of it, and paths that begin with its own; of the rules that fit a URL
the longest (host and path together, then host) wins.  Each URL has candidate
keys: its host's suffixes at label bounds, joined to its path's prefixes of the
lengths that the rules have.  A rule fits exactly if it is one of these keys.

Which keys are listed is answered by a cascade of Bloom filters for each verdict.
The universe is every distinct candidate key of the whole corpus.  Level 1 holds
the listed keys; level 2 the universe's other keys that pass level 1; level 3 the
listed keys that pass level 2, and so on until a level lets no wrong key pass.
A key's first level that rejects it decides: over the universe the cascade is
exact, so URLs are judged in one scan, without a join.

Scale: the universe is aggregated (never collected, hot hosts are combined before
the shuffle); levels are bit arrays, built by distributed bitwise or.  A level has
``bits_per_key`` bits for each of its keys.  If a level would pass ``max_bits``,
keys are split by hash into shards with one cascade each, and rows are judged by
one broadcast of at most ``max_bits`` at a time.

Defined results: a null URL, or one without ``://``, has an empty host and path,
fits no rule and gets the default verdict.  Repeated rows are judged alike; an
empty table gives an empty result; columns other than ``keep`` are not carried.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import Scratch
from paperloom.llm._words import mix64

#: (verdict, host, path) of the production rules.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, url.substr(at + 3, F.length(url)))
    host = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)", 1), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1), F.lit(""))
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), path


def candidate_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """An array of the host-and-path keys that a rule of these label counts and path lengths can have."""
    parts = F.split(host, r"\.", -1)
    hosts = F.array(*[F.when(F.size(parts) >= n, F.concat_ws(".", F.slice(parts, -n, n))) for n in labels])
    paths = F.array(*[F.when(F.length(path) >= n, F.substring(path, 1, n)) for n in lengths])
    pairs = F.transform(hosts, lambda h: F.transform(paths, lambda p: F.when(h.isNotNull() & p.isNotNull(), F.struct(h.alias("host"), p.alias("path")))))
    return F.filter(F.flatten(pairs), lambda x: x.isNotNull())


def key_hash(host: Column, path: Column) -> Column:
    return F.xxhash64(host, F.lit("\x00"), path)


def positions(hashes: np.ndarray, level: int, bits: int, count: int) -> np.ndarray:
    """The bit places of each hash: one row of ``count`` for each."""
    a = mix64(hashes.view(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
    b = mix64(a) | np.uint64(1)
    return ((a[:, None] + b[:, None] * np.arange(count, dtype=np.uint64)[None, :]) % np.uint64(bits)).astype(np.int64)


@dataclass(frozen=True)
class Level:
    bits: int
    count: int
    words: np.ndarray  # uint64


class Cascade:
    """Levels of filters; odd numbers of passed levels mean that a key is listed."""

    def __init__(self, levels: list[Level]):
        self.levels = levels

    def listed(self, hashes: np.ndarray) -> np.ndarray:
        passed = np.zeros(len(hashes), np.int64)
        alive = np.arange(len(hashes))
        for number, level in enumerate(self.levels):
            at = positions(hashes[alive], number, level.bits, level.count)
            hit = ((level.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)
            alive = alive[hit]
            passed[alive] += 1
        return passed % 2 == 1


def _passing(keys: DataFrame, levels: list[Level]) -> DataFrame:
    """The keys that every level so far lets pass."""
    shared = keys.sparkSession.sparkContext.broadcast([(x.bits, x.count, x.words) for x in levels])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cascade = [Level(*x) for x in shared.value]
        for batch in batches:
            hashes = batch.column("hash").to_numpy(zero_copy_only=False)
            alive = np.arange(len(hashes))
            for number, level in enumerate(cascade):
                at = positions(hashes[alive], number, level.bits, level.count)
                alive = alive[((level.words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).all(axis=1)]
            yield batch.take(pa.array(alive))

    return keys.mapInArrow(run, keys.schema)


def _build(keys: DataFrame, level: int, bits: int, count: int) -> Level:
    """Sets the keys' bits by a distributed bitwise or; the bits come to the driver, at most ``bits`` of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros((bits + 63) // 64, np.uint64)
        for batch in batches:
            at = positions(batch.column("hash").to_numpy(zero_copy_only=False), level, bits, count).ravel()
            np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(words[used].view(np.int64))], names=["word", "value"])

    found = keys.mapInArrow(run, "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()
    words = np.zeros((bits + 63) // 64, np.uint64)
    words[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return Level(bits, count, words)


def build_cascade(universe: DataFrame, bits_per_key: int = 12, hashes: int = 6, max_levels: int = 64) -> Cascade:
    """A cascade that is exact on ``universe`` (distinct rows of ``hash`` long and ``listed`` boolean)."""
    levels: list[Level] = []
    inside = True
    remaining = universe.where("listed").select("hash")
    n = remaining.count()
    while n:
        if len(levels) >= max_levels:
            raise ValueError("the cascade does not end: listed and other keys share hashes")
        levels.append(_build(remaining, len(levels), max(64, n * bits_per_key), hashes))
        inside = not inside
        remaining = _passing(universe.where(F.col("listed") == inside).select("hash"), levels)
        n = remaining.count()
    return Cascade(levels)


def filter_urls(df: DataFrame, rules: DataFrame, keep: list[str], url: str = "url", default: str = "allow", bits_per_key: int = 12, max_bits: int = 1 << 29, max_shapes: int = 1_000) -> DataFrame:
    """The ``keep`` columns of every row with host, path, rule (like ``net/``, else null) and verdict.

    ``rules`` has string columns verdict, host and path; a host and path that two
    verdicts list count as ``block``.  ``max_shapes`` bounds the label counts and
    path lengths of the rules that are collected as the candidates' shape.
    """
    spark = df.sparkSession
    scratch = Scratch(spark, "urls")
    rules = rules.groupBy("host", "path").agg(F.min_by("verdict", F.when(F.col("verdict") == "block", 0).otherwise(1)).alias("verdict"))
    rules = rules.withColumn("hash", key_hash(F.col("host"), F.col("path")))
    shapes = rules.agg(F.collect_set(F.size(F.split("host", r"\.", -1))), F.collect_set(F.length("path")), F.collect_set("verdict"), F.count("*")).first()
    labels, lengths, verdicts, n_rules = sorted(shapes[0]), sorted(shapes[1]), sorted(shapes[2]), shapes[3]
    if len(labels) * len(lengths) > max_shapes:
        raise ValueError("the rules have too many label counts and path lengths")
    host, path = split_url(F.col(url))
    rows = df.select(*keep, host.alias("host"), path.alias("path"))
    if not n_rules:
        return rows.withColumns({"rule": F.lit(None).cast("string"), "verdict": F.lit(default)})

    candidates = rows.select(F.explode(candidate_keys(F.col("host"), F.col("path"), labels, lengths)).alias("key")).select(key_hash(F.col("key.host"), F.col("key.path")).alias("hash"))
    listed = rules.select("hash", "verdict")
    # the corpus's keys and the listed ones, each once; a group is one key, combined before the shuffle
    universe = scratch.keep(
        candidates.select("hash", F.lit(None).cast("string").alias("verdict")).unionByName(listed).groupBy("hash").agg(F.max("verdict").alias("verdict")), "universe"
    )
    shards = max(1, math.ceil(n_rules * bits_per_key / max_bits))
    judged = rows.withColumn("__keys", candidate_keys(F.col("host"), F.col("path"), labels, lengths)).withColumn("__hashes", F.transform("__keys", lambda k: key_hash(k["host"], k["path"])))
    for verdict in verdicts:
        judged = judged.withColumn(f"__{verdict}", F.transform("__hashes", lambda _: F.lit(False)))
        for shard in range(shards):
            part = universe.where(F.pmod("hash", F.lit(shards)) == shard).select("hash", F.coalesce(F.col("verdict") == verdict, F.lit(False)).alias("listed"))
            judged = _mark(judged, build_cascade(part, bits_per_key), f"__{verdict}", shards, shard)
    scratch.drop("universe")
    marks = F.arrays_zip("__keys", *[f"__{v}" for v in verdicts])
    fits = F.filter(marks, lambda m: F.greatest(*[m[f"__{v}"] for v in verdicts], F.lit(False)))
    ranked = F.transform(
        fits,
        lambda m: F.struct(
            (F.length(m["__keys"]["host"]) + F.length(m["__keys"]["path"])).alias("n"),
            F.length(m["__keys"]["host"]).alias("h"),
            F.concat(m["__keys"]["host"], m["__keys"]["path"]).alias("rule"),
            F.coalesce(*[F.when(m[f"__{v}"], F.lit(v)) for v in verdicts]).alias("verdict"),
        ),
    )
    best = F.array_max(ranked)
    return judged.select(*keep, "host", "path", best["rule"].alias("rule"), F.coalesce(best["verdict"], F.lit(default)).alias("verdict"))


def _mark(df: DataFrame, cascade: Cascade, column: str, shards: int, shard: int) -> DataFrame:
    """Sets ``column`` (an array of booleans beside ``__hashes``) where the cascade lists a key of this shard."""
    shared = df.sparkSession.sparkContext.broadcast([(x.bits, x.count, x.words) for x in cascade.levels])
    at = df.columns.index(column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Cascade([Level(*x) for x in shared.value])
        for batch in batches:
            keys = batch.column("__hashes")
            hashes = keys.flatten().to_numpy(zero_copy_only=False)
            marks = batch.column(column).flatten().to_numpy(zero_copy_only=False).copy()
            own = np.flatnonzero(hashes % shards == shard) if shards > 1 else np.arange(len(hashes))
            marks[own] |= levels.listed(hashes[own])
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(keys.value_lengths().to_numpy(zero_copy_only=False))]).astype(np.int32)), pa.array(marks.astype(bool)))
            columns = batch.columns
            columns[at] = lists
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return df.mapInArrow(run, df.schema)


def production_rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(RULES, "verdict string, host string, path string")


ORACLE_SQL = r"""
WITH split AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM split
), rules(verdict, rhost, rpath) AS (
  VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')
), fits AS (
  SELECT p.page_id, arg_max(r.rhost || r.rpath, length(r.rhost || r.rpath)) AS rule, arg_max(r.verdict, length(r.rhost || r.rpath)) AS verdict
  FROM parts p JOIN rules r ON (p.host = r.rhost OR ends_with(p.host, '.' || r.rhost)) AND starts_with(p.path, r.rpath)
  GROUP BY p.page_id
)
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON p.page_id = f.page_id
"""
