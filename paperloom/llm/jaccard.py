"""N-gram Jaccard join with token-combination prefixes.

A document's set holds the 64-bit hashes of its distinct word shingles; documents
link when their sets' Jaccard similarity reaches the threshold.

1. Texts are read once: every row's set size, a hash of the set and a 256-bit parity
   signature are written, and the set itself, once for the copies that a task meets.
   Everything below reads these sets.
2. Documents with equal sets become one entity (a hot group of copies is one entity
   everywhere below).
3. A global token order puts rare tokens first.  Token frequencies come from all
   documents: tasks send their tokens as sorted, delta-packed 40-bit buckets, a few
   bytes each.  Buckets of at least ``frequent`` documents make the frequent class;
   the list is broadcast, and its frequency floor is doubled until the list has at
   most ``max_frequent`` entries.  Frequent tokens follow by the power of two of their
   frequency and then by hash, so that tokens of one passage are not neighbours.  (Any
   order gives the same result; floor and order only steer the work.)
4. Rare class: each rare token of the plain prefix (n - ceil(t n) + 1 tokens) is an
   index key.  Two linked sets whose first common token is rare share that key, and
   fewer than the floor's number of sets can.
5. Frequent class: if all common tokens are frequent, prefixes are extended until
   linked sets must share k tokens that are neighbours in both, and each run of k
   neighbours of the extended prefix is an index key.  (With S = |x| + |y| and overlap
   o, at most d = S - 2 o tokens can part common ones into d + 1 runs; of
   (k - 1)(d + 1) + 1 common tokens, k therefore stand in one run.)  k is up to
   ``combine``, less for sets too small to hold that many common tokens; the smaller
   set of a pair decides, and a set is indexed for all the k that its partners' sizes
   call for.
6. Pairs pass filters on sizes, prefix positions and signatures, and are verified on
   the whole sets.  The sets of a key are first compared with one centre only: the set
   that has the key earliest in its prefix, or (frequent class) the set with the fewest
   rare tokens.  Linked sets form components, and only sets of one key in different
   components are then compared with each other.

No link is lost: a pair is skipped only if it is connected already or a filter
proves it too dissimilar.

Scale: keys and token buckets are dealt into groups whose number follows the token
total, and a task holds one group at a time.  Joins on keys and ids have a written table
on the small side, so that Spark can split a hot key on the other.  What still grows with
the square: sets that consist of shared passages only, that hold the same k tokens, and
that do not link.

Hash collisions (64 bits for shingles; 64 bits and the size for entities) are taken
as equality.

Defined results: a null text, or one without words, has an empty set, n_shingles 0,
and is its own component.  A text with fewer words than a shingle is one shingle.  A very
long text is one set as any other.  Repeated rows are copies: each returns its row.  A
null id takes part; if all ids of a component are null, component_id is null.  Empty
tables give an empty result.  Columns other than those asked for with ``keep`` are not
carried, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._bloom import build_bloom, may_contain
from paperloom.llm._shared import Scratch
from paperloom.llm._words import Words, mix64, slices, strings, window_hashes
from paperloom.llm.components import components

BUCKET_BITS = 40
_SHIFT = np.uint64(64 - BUCKET_BITS)


def shingle_sets(texts: list[str | None], size: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = Words(texts, lower=True)
    hashes = words.hashes()
    windows = window_hashes(hashes, size)
    found = []
    for begin, end in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True):
        if end - begin >= size:
            found.append(np.unique(windows[begin : end - size + 1]))
        else:
            found.append(window_hashes(hashes[begin:end], end - begin) if end > begin else np.empty(0, np.uint64))
    return found


def fingerprint(tokens: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    total = np.array([np.sum(mix64(tokens ^ np.uint64(0x5851F42D4C957F2D)), dtype=np.uint64) + np.uint64(len(tokens))])
    return int(mix64(total).view(np.int64)[0])


def signature(tokens: np.ndarray) -> np.ndarray:
    """256 parities of the set, as four signed longs."""
    parity = np.bincount((tokens & np.uint64(255)).astype(np.int64), minlength=256) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").view(np.int64)


def _least(n: int, percent: int) -> int:
    """ceil(percent n / 100)"""
    return -(-percent * n // 100)


def _document_rows(batches: Iterator[pa.RecordBatch], size: int, remembered: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Each row's set size, hash and signature; the set itself where the task has not just met a copy."""
    seen: set[int] = set()
    for batch in batches:
        for part in slices(batch, "__text"):
            sets = shingle_sets(strings(part, "__text"), size)
            marks = [fingerprint(s) if len(s) else None for s in sets]
            signs = np.array([signature(s) for s in sets], dtype=np.int64).reshape(len(sets), 4)
            stored: list[bytes | None] = []
            for tokens, mark in zip(sets, marks, strict=True):
                fresh = mark is not None and mark not in seen
                stored.append(tokens.tobytes() if fresh else None)
                if fresh:
                    if len(seen) >= remembered:
                        seen.clear()
                    seen.add(mark)
            columns = [pa.array([len(s) for s in sets], pa.int64()), pa.array(marks, pa.int64()), *(pa.array(signs[:, i]) for i in range(4)), pa.array(stored, pa.binary())]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], *columns], names=[*part.schema.names[:-1], "n_shingles", "__set", "__s0", "__s1", "__s2", "__s3", "__tokens"])


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, int]]:
    """(set, fingerprint) of the written sets."""
    for batch in batches:
        for mark, stored in zip(batch.column("id").to_pylist(), batch.column("tokens"), strict=True):
            yield np.frombuffer(stored.as_buffer(), np.uint64), mark


# --- token frequencies -------------------------------------------------------


def pack(values: np.ndarray) -> bytes:
    """Sorted values as compressed byte planes of their differences (each below 2^32)."""
    steps = np.diff(values, prepend=np.uint64(0)).astype(np.uint32)
    return pa.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes(), codec="zstd", asbytes=True)


def unpack(blob: bytes, n: int) -> np.ndarray:
    planes = np.frombuffer(pa.decompress(blob, decompressed_size=4 * n, codec="zstd", asbytes=True), np.uint8).reshape(4, n)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint32).ravel(), dtype=np.uint64)


def _packed_buckets(batches: Iterator[pa.RecordBatch], part_bits: int, flush: int = 500_000) -> Iterator[pa.RecordBatch]:
    low = np.uint64(BUCKET_BITS - part_bits)

    def packed(held: list[np.ndarray]) -> pa.RecordBatch:
        buckets = np.sort(np.concatenate(held))
        parts = (buckets >> low).astype(np.int64)
        cuts = np.flatnonzero(np.diff(parts, prepend=-1))
        ends = np.append(cuts[1:], len(parts))
        rest = buckets & ((np.uint64(1) << low) - np.uint64(1))
        return pa.RecordBatch.from_arrays(
            [pa.array(parts[cuts]), pa.array((ends - cuts).astype(np.int64)), pa.array([pack(rest[a:b]) for a, b in zip(cuts, ends, strict=True)], pa.binary())], names=["part", "n", "blob"]
        )

    held, total = [], 0
    for tokens, _ in _sets_of(batches):
        held.append(tokens >> _SHIFT)
        total += len(tokens)
        if total >= flush:
            yield packed(held)
            held, total = [], 0
    if held:
        yield packed(held)


def _frequent_buckets(part_bits: int, floor: int):
    def run(table: pa.Table) -> pa.Table:
        """The frequent buckets of one part."""
        values, counts = np.unique(np.concatenate([unpack(blob, n) for n, blob in zip(table["n"].to_pylist(), table["blob"].to_pylist(), strict=True)]), return_counts=True)
        often = counts >= floor
        buckets = values[often] + (np.uint64(table["part"][0].as_py()) << np.uint64(BUCKET_BITS - part_bits))
        return pa.table({"bucket": pa.array(buckets.astype(np.int64)), "df": pa.array(counts[often].astype(np.int64))})

    return run


def frequent_tokens(sets: DataFrame, total: int, floor: int, most: int, scratch: Scratch) -> tuple[np.ndarray, np.ndarray, int]:
    """(sorted buckets, their document counts, the floor), at most ``most`` of them."""
    # a part holds about two million tokens, and is counted by itself
    part_bits = min(30, max(8, math.ceil(math.log2(max(1, total / 2_000_000)))))
    packed = sets.mapInArrow(partial(_packed_buckets, part_bits=part_bits), "part long, n long, blob binary")
    counted = scratch.keep(packed.groupBy("part").applyInArrow(_frequent_buckets(part_bits, floor), "bucket long, df long"), "frequent", narrow=True)
    by_size = {r[0]: r[1] for r in counted.groupBy(F.floor(F.log2("df")).cast("long").alias("c")).count().collect()}  # 64 rows at most
    while sum(n for c, n in by_size.items() if (2 << c) > floor) > most:
        floor *= 2
    found = counted.where(F.col("df") >= floor).toArrow()  # at most ``most`` rows
    buckets, df = found["bucket"].to_numpy(), found["df"].to_numpy()
    order = np.argsort(buckets)
    scratch.drop("frequent")
    return buckets[order].astype(np.uint64), df[order], floor


# --- index keys --------------------------------------------------------------

#: Kinds of rows: a rare key (or a pair of one with its centre), a combined key, a rare key of many sets, and another
#: pair of a rare key of few sets (few enough to list: their pairs recur in most of their keys, and are told once a task).
RARE, COMBINED, SHARED, LATER = 0, 1, 2, 3
FEW = 32


@lru_cache(maxsize=64)
def combination_sizes(percent: int, combine: int) -> tuple[tuple[int, int], ...]:
    """(k, least set size) from which linked sets of frequent tokens must share k neighbours, by k."""
    found = [(1, 0)]
    for k in range(2, combine + 1):
        # (S - d) / 2 common tokens, at most S (100 - percent) / (100 + percent) = d others: enough if S reaches ``sure``
        spare = (100 + percent) - (100 - percent) * (2 * k - 1)
        if spare <= 0:
            break
        sure = -(-2 * k * (100 + percent) // spare) + 2
        unsafe = [s for s in range(2, sure) if any((s - d) % 2 == 0 and (s - d) // 2 < (k - 1) * (d + 1) + 1 for d in range(1, s * (100 - percent) // (100 + percent) + 1))]
        found.append((k, max(unsafe, default=1) // 2 + 1))
    return tuple(found)


def index_keys(tokens: np.ndarray, df: np.ndarray, percent: int, combine: int = 4) -> tuple[np.ndarray, np.ndarray, int]:
    """(rare keys in prefix order, combined keys, number of rare tokens) of a sorted set; df is 0 for rare tokens."""
    n = len(tokens)
    rare = tokens[df == 0]
    r = len(rare)
    apart = n - _least(n, percent)  # tokens that a partner may lack
    slack = (n + 100 * n // percent) * (100 - percent) // (100 + percent)  # of S - 2 o, at most
    combined = [np.empty(0, np.uint64)]
    if r < n and r <= slack:
        often = np.flatnonzero(df)
        ordered = tokens[often[np.lexsort((mix64(tokens[often]), np.frexp(df[often])[1]))]]
        sizes = combination_sizes(percent, combine)
        for (k, least), after in zip(sizes, [*(x for _, x in sizes[1:]), math.inf], strict=True):
            if least <= n and _least(n, percent) < after:  # the k of some partner's size, or of the set's own
                prefix = ordered[: max(0, (k - 1) * (slack - r + 1) + 1 + apart - r)]
                keys = np.full(max(0, len(prefix) - k + 1), k, np.uint64)
                for i in range(k if len(keys) else 0):
                    keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + prefix[i : len(prefix) - k + 1 + i])
                combined.append(keys)
    return rare[: apart + 1], np.concatenate(combined), r


def _key_rows(batches: Iterator[pa.RecordBatch], percent: int, combine: int, shared) -> Iterator[pa.RecordBatch]:
    buckets, counts = shared.value
    columns: list[list[np.ndarray]] = [[] for _ in range(5)]

    def rows() -> pa.RecordBatch:
        kind, key, entity, n, at = (np.concatenate(c) for c in columns)
        for c in columns:
            c.clear()
        return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key.view(np.int64)), pa.array(entity), pa.array(n), pa.array(at)], names=["kind", "key", "id", "n", "at"])

    total = 0
    for tokens, mark in _sets_of(batches):
        df = np.zeros(len(tokens), np.int64)
        if len(buckets):
            own = tokens >> _SHIFT
            place = np.minimum(np.searchsorted(buckets, own), len(buckets) - 1)
            hit = buckets[place] == own
            df[hit] = counts[place[hit]]
        rare, combined, r = index_keys(tokens, df, percent, combine)
        m = len(rare) + len(combined)
        columns[0].append(np.repeat(np.array([RARE, COMBINED], np.int8), [len(rare), len(combined)]))
        columns[1].append(np.concatenate([rare, combined]))
        columns[2].append(np.full(m, mark, np.int64))
        columns[3].append(np.full(m, len(tokens), np.int32))
        columns[4].append(np.concatenate([np.arange(len(rare)), np.full(len(combined), r)]).astype(np.int32))
        total += m
        if total > 200_000:
            yield rows()
            total = 0
    if columns[0]:
        yield rows()


def _rare_pairs(percent: int):
    def run(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(_pairs_of_keys(table.select(_KEY_NAMES), percent)), pa.schema(_KEY_TYPES))

    return run


_KEY_TYPES = [("kind", pa.int8()), ("key", pa.int64()), ("id", pa.int64()), ("n", pa.int32()), ("at", pa.int32())]
_KEY_NAMES = [n for n, _ in _KEY_TYPES]


def _pairs_of_keys(table: pa.Table, percent: int) -> Iterator[pa.RecordBatch]:
    """Of one group of keys: pairs of a rare key's centre and its other sets; rows of keys that need more than that pass."""
    names = _KEY_NAMES
    passed = table["kind"].to_numpy() == COMBINED
    yield from table.filter(pa.array(passed)).to_batches()
    key, entity, n, at = (table[c].to_numpy()[~passed] for c in names[1:])
    order = np.lexsort((entity, key))
    key, entity, n, at = key[order], entity[order], n[order].astype(np.int64), at[order].astype(np.int64)
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (entity[1:] != entity[:-1])
    key, entity, n, at = key[fresh], entity[fresh], n[fresh], at[fresh]
    if not len(key):
        return
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    sizes = np.diff(np.append(starts, len(key)))

    def fitting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pairs of rows that can link by size and place, smaller entity first."""
        need = -(-percent * (n[a] + n[b]) // (100 + percent))
        fit = (a != b) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b])) & (np.minimum(n[a] - at[a], n[b] - at[b]) >= need)
        return np.sort(np.stack([entity[a[fit]], entity[b[fit]]], axis=1), axis=1)

    first, later = [], []
    for m in np.unique(sizes[sizes > 1]):  # below the floor of the frequent class
        rows = starts[sizes == m][:, None] + np.arange(m)[None, :]
        centre = at[rows].argmin(axis=1)
        first.append(fitting(np.repeat(rows[np.arange(len(rows)), centre], m), rows.ravel()))
        if m > FEW:
            own = rows.ravel()
            yield _rows(names, np.full(len(own), SHARED, np.int8), key[own], entity[own], n[own], at[own])
        elif m > 2:
            i, j = np.triu_indices(m, 1)
            for begin in range(0, len(rows), step := max(1, 250_000 // len(i))):
                part = rows[begin : begin + step]
                other = (i[None, :] != centre[begin : begin + step, None]) & (j[None, :] != centre[begin : begin + step, None])
                later.append(np.unique(fitting(part[:, i][other], part[:, j][other]), axis=0))
    for kind, found in ((RARE, first), (LATER, later)):
        if found:
            pairs = np.unique(np.concatenate(found), axis=0)
            none = np.zeros(len(pairs))
            yield _rows(names, np.full(len(pairs), kind, np.int8), pairs[:, 0].copy(), pairs[:, 1].copy(), none, none)


def _rows(names: list[str], kind: np.ndarray, key: np.ndarray, entity: np.ndarray, n: np.ndarray, at: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(kind), pa.array(key), pa.array(entity), pa.array(n.astype(np.int32)), pa.array(at.astype(np.int32))], names=names)


# --- verification ------------------------------------------------------------


def _needed(n_a: Column, n_b: Column, percent: int) -> Column:
    """The least overlap of linked sets of these sizes."""
    return F.ceil((n_a + n_b) * percent / (100 + percent) - F.lit(1e-9))


def _sizes_fit(n_a: Column, n_b: Column, percent: int) -> Column:
    return 100 * F.least(n_a, n_b) >= percent * F.greatest(n_a, n_b)


def _signs_fit(a: str, b: str, n_a: Column, n_b: Column, percent: int) -> Column:
    apart = sum((F.bit_count(F.col(f"{a}{i}").bitwiseXOR(F.col(f"{b}{i}"))) for i in range(4)), F.lit(0))
    return apart <= n_a + n_b - 2 * _needed(n_a, n_b, percent)


def _wanted_sets(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield batch.filter(pa.array(may_contain(shared.value, batch.column("id").to_numpy(zero_copy_only=False))))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Written sets as lists of longs."""
    for batch in batches:
        stored = batch.column("tokens").cast(pa.large_binary())
        bounds = np.frombuffer(stored.buffers()[1], np.int64)[stored.offset : stored.offset + len(stored) + 1]
        values = np.frombuffer(stored.buffers()[2] or b"", np.int64)[bounds[0] // 8 : bounds[-1] // 8]
        lists = pa.ListArray.from_arrays(pa.array(((bounds - bounds[0]) // 8).astype(np.int32)), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch.column("id"), lists], names=["id", "tokens"])


def verified(pairs: DataFrame, sets: DataFrame, percent: int, scratch: Scratch, name: str, bloom_bytes: int) -> DataFrame:
    """The pairs (a, b) that link, by their whole sets.

    The sets of the pairs are found by an exact join on ids; while a Bloom filter of
    at most ``bloom_bytes`` tells them apart, it spares the others the exchange.
    """
    spark = pairs.sparkSession
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), f"{name}-ids", narrow=True)
    n_ids = ids.count()
    if not n_ids:
        return spark.createDataFrame([], "a long, b long")
    wanted = sets
    if 8 * n_ids <= 8 * bloom_bytes:  # a byte an id or more: one in twenty others passes at most
        shared = spark.sparkContext.broadcast(build_bloom(ids, n_ids, bloom_bytes))
        wanted = sets.mapInArrow(partial(_wanted_sets, shared=shared), sets.schema)
    wanted = wanted.join(ids, "id", "left_semi").groupBy("id").agg(F.first("tokens").alias("tokens"))
    own = scratch.keep(wanted.mapInArrow(_unpacked, "id long, tokens array<long>"), f"{name}-sets")
    found = pairs.join(own.select(F.col("id").alias("b"), F.col("tokens").alias("of_b")), "b").join(own.select(F.col("id").alias("a"), F.col("tokens").alias("of_a")), "a")
    overlap = F.size(F.array_intersect("of_a", "of_b"))
    linked = found.where(100 * overlap >= percent * (F.size("of_a") + F.size("of_b") - overlap)).select("a", "b")
    linked = scratch.keep(linked, name, narrow=True)
    scratch.drop(f"{name}-sets", f"{name}-ids")
    return linked


# --- the operator ------------------------------------------------------------


def jaccard_components(
    df: DataFrame,
    keep: list[str],
    id_col: str = "doc_id",
    text: str = "text",
    size: int = 5,
    percent: int = 80,
    frequent: int = 16,
    max_frequent: int = 2_000_000,
    combine: int = 4,
    bloom_bytes: int = 1 << 24,
) -> DataFrame:
    """The ``keep`` columns of every row with n_shingles, component_id (the smallest id reachable by links) and class_id.

    class_id names the component whatever its ids are; it is null for empty sets.
    ``combine`` is the largest number of frequent tokens in a key.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    spark = df.sparkSession
    scratch = Scratch(spark, "jaccard")
    rows = df.select(*keep, F.col(id_col).cast("long").alias("__id"), F.col(text).alias("__text"))
    schema = rows.drop("__text").schema
    for name in ("n_shingles", "__set", "__s0", "__s1", "__s2", "__s3"):
        schema = schema.add(name, "long")
    documents = scratch.keep(rows.mapInArrow(partial(_document_rows, size=size), schema.add("__tokens", "binary")), "documents")
    sets = documents.where(F.col("__tokens").isNotNull()).select(F.col("__set").alias("id"), F.col("__tokens").alias("tokens"))
    documents = documents.drop("__tokens")
    total = documents.agg(F.sum("n_shingles")).first()[0] or 0
    entities = documents.where(F.col("__set").isNotNull()).groupBy(F.col("__set").alias("id")).agg(F.first("n_shingles").alias("n"), *[F.first(f"__s{i}").alias(f"s{i}") for i in range(4)])
    entities = scratch.keep(entities, "entities", narrow=True)

    buckets, counts, _ = frequent_tokens(sets, total, frequent, max_frequent, scratch)
    shared = spark.sparkContext.broadcast((buckets, counts))  # at most max_frequent entries
    key_schema = "kind byte, key long, id long, n int, at int"
    keys = sets.mapInArrow(partial(_key_rows, percent=percent, combine=combine, shared=shared), key_schema)
    # a rare key's sets meet in one group; combined keys only pass, dealt by key and set
    place = F.when(F.col("kind") == COMBINED, F.xxhash64("key", "id")).otherwise(F.xxhash64("key"))
    grouped = keys.withColumn("group", F.pmod(place, F.lit(max(1, math.ceil(total / 500_000))))).groupBy("group").applyInArrow(_rare_pairs(percent), key_schema)
    found = scratch.keep(grouped, "keys", narrow=True)
    near = found.where(F.col("kind") == RARE).select(F.col("key").alias("a"), F.col("id").alias("b"))
    later = found.where(F.col("kind") == LATER).select(F.col("key").alias("a"), F.col("id").alias("b")).distinct()
    crowded = found.where(F.col("kind").isin(COMBINED, SHARED)).select("kind", "key", "id", F.col("n").cast("long").alias("n"), F.col("at").cast("long").alias("at")).distinct()
    combined = crowded.where(F.col("kind") == COMBINED).select("key", "id", "n", F.col("at").alias("r"))

    def rare_fit(n_a: Column, r_a: Column, n_b: Column, r_b: Column) -> Column:
        need = _needed(n_a, n_b, percent)
        return (F.least(n_a - r_a, n_b - r_b) >= need) & (n_a + n_b - 2 * need >= r_a + r_b)

    centres = combined.groupBy("key").agg(F.count("*").alias("m"), F.min(F.struct("r", "id", "n")).alias("c")).where("m > 1").select("key", F.col("c.r").alias("cr"), F.col("c.id").alias("cid"), F.col("c.n").alias("cn"))
    # written, so that Spark can split a large key on the other side of the join
    centres = scratch.keep(centres, "centres", narrow=True)
    c = F.col
    star = combined.join(centres, "key").where((c("id") != c("cid")) & _sizes_fit(c("n"), c("cn"), percent) & rare_fit(c("n"), c("r"), c("cn"), c("cr")))
    star = star.select(F.least("id", "cid").alias("a"), F.greatest("id", "cid").alias("b"))

    def signed(pairs: DataFrame) -> DataFrame:
        """Distinct pairs that the signatures allow."""
        for side in ("a", "b"):
            own = entities.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), *[F.col(f"s{i}").alias(f"{side}{i}") for i in range(4)])
            pairs = pairs.join(own, side)
        return pairs.where(_signs_fit("a", "b", F.col("n_a"), F.col("n_b"), percent)).select("a", "b")

    tested = scratch.keep(signed(near.unionByName(star).distinct()), "pairs1")
    links = verified(tested, sets, percent, scratch, "links1", bloom_bytes)
    roots = components(links, scratch, "roots1-")

    # sets of one key that its centre did not connect
    placed = crowded.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    split = placed.groupBy("kind", "key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("kind", "key")
    split = scratch.keep(split, "split", narrow=True)
    placed = placed.join(split, ["kind", "key"]).join(entities.drop("n"), "id")
    placed = scratch.keep(placed, "placed", narrow=True)
    other = placed.select("kind", "key", *[F.col(x).alias(f"o_{x}") for x in ("id", "n", "at", "root", "s0", "s1", "s2", "s3")])
    place_fit = F.least(c("n") - c("at"), c("o_n") - c("o_at")) >= _needed(c("n"), c("o_n"), percent)
    fit = F.when(c("kind") == COMBINED, rare_fit(c("n"), c("at"), c("o_n"), c("o_at"))).otherwise(place_fit)
    rest = placed.join(other, ["kind", "key"]).where((c("id") < c("o_id")) & (c("root") != c("o_root")) & _sizes_fit(c("n"), c("o_n"), percent) & fit & _signs_fit("s", "o_s", c("n"), c("o_n"), percent))
    for side in ("a", "b"):
        later = later.join(roots.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    later = later.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b")).select("a", "b")
    rest = rest.select(F.col("id").alias("a"), F.col("o_id").alias("b")).unionByName(signed(later)).distinct().join(tested, ["a", "b"], "left_anti")
    rest = scratch.keep(rest, "pairs2")
    more = verified(rest, sets, percent, scratch, "links2", bloom_bytes)
    if not more.isEmpty():
        roots = components(roots.select(F.col("id").alias("a"), F.col("root").alias("b")).unionByName(more), scratch, "roots2-")

    # components of entities first: each is there once, however many copies it has
    least = documents.where(F.col("__set").isNotNull()).groupBy("__set").agg(F.min("__id").alias("least"))
    least = scratch.keep(least, "least", narrow=True)
    classed = scratch.keep(least.join(roots.select(F.col("id").alias("__set"), "root"), "__set", "left").select("__set", "least", F.coalesce("root", "__set").alias("__class")), "classes", narrow=True)
    smallest = scratch.keep(classed.groupBy("__class").agg(F.min("least").alias("component")), "smallest", narrow=True)
    placed_in = classed.select("__set", "__class").join(smallest, "__class")
    out = documents.join(scratch.keep(placed_in, "placed_in", narrow=True), "__set", "left")
    scratch.drop("keys", "entities", "least", "centres", "pairs1", "pairs2", "split", "placed", "classes", "smallest")
    component = F.when(F.col("__class").isNull(), F.col("__id")).otherwise(F.col("component"))
    return out.select(*keep, "n_shingles", component.alias("component_id"), F.col("__class").alias("class_id"))
