"""Mixing sources to target weights by pivotal dependent rounding.

Each source gets a target number of words; every document's expected number of copies
is target / source size, whatever its length.  The integral part is taken at once.  The
fractional parts are rounded in pairs: two documents of a source exchange word mass, in
a random direction that keeps both expectations, until one of them is integral.  The
exchange keeps the pair's words constant, so that only a source's last fraction, which
is drawn, moves it off its target.  A repair then changes a few decided documents by one
copy: a few large steps, then the best subset of at most ``choices`` others, spread over
its sizes; of several such tries the one that ends nearest to the target (a source of no
more documents: the best subset of all).

Rows that are equal in everything are counted and dealt in chunks, so that neither a hot
source nor a row that is repeated a million times fills a bucket.  Buckets hold about
``bucket_rows`` rows (their number follows the table, not the cluster) and are rounded
one at a time.  A bucket leaves at most one fractional document per source; those
residuals are combined through a reduction tree of ``fan_in``, dealt by group and source.
Random draws are hashes of a seed and the documents' keys, so reruns agree.

Only one row per source (its size) reaches the driver: sources are the mix's
configuration, at most ``max_sources`` of them; more are refused.

Defined results: a null or blank text has size 0 and takes 0 words; null is a source of
its own, last in order; repeated rows are rounded each on its own; ties are settled by
64-bit hashes of the rows; a very long text is one document as any other; an empty table
gives an empty result.  Columns of the input other than those asked for with ``keep``
(which must be comparable) are not carried, so clashing names do no harm.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import Scratch, dealt
from paperloom.llm._words import Words, mix64, slices, strings

WEIGHTS = (5, 2, 1)
_SEED = 0x51ED2701
#: Fractions nearer to 0 or 1 are integral.
_ZERO = 1e-9
#: Equal rows that are dealt together.
_CHUNK = 500


def targets(sizes: dict[str | None, int], weights: tuple[int, ...] = WEIGHTS, most: int = 3) -> dict[str | None, float]:
    """The words each source shall give: shares of the total by weight, at most ``most`` times a source's size."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    found: dict[str | None, float] = {}
    rest, open_ = float(sum(sizes.values())), order
    while open_:
        unit = rest / sum(weight[s] for s in open_)
        above = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not above:
            found |= {s: unit * weight[s] for s in open_}
            break
        for s in above:
            found[s] = float(most * sizes[s])
            rest -= found[s]
        open_ = [s for s in open_ if s not in found]
    return found


def _draws(level: int, *parts: np.ndarray) -> np.ndarray:
    """A number from 0 to 1 for each item, by a hash of its key, chunk and place in the chunk."""
    x = np.full(len(parts[0]), _SEED + level, np.uint64)
    for part in parts:
        x = mix64(x ^ mix64(part.astype(np.int64).view(np.uint64) + np.uint64(0x9E3779B97F4A7C15)))
    return (x >> np.uint64(11)) / 2.0**53


def round_pairs(sizes: list[int], parts: list[float], draws: list[float]) -> tuple[list[int], int, float]:
    """Rounds the fractions of items, each with its word mass, one after another.

    Returns each item's decision (0 or 1), and the index and fraction of the item that
    is left undecided (-1 if none is).
    """
    taken = [0] * len(sizes)
    held, q = -1, 0.0
    for i, (size, p) in enumerate(zip(sizes, parts, strict=True)):
        if size == 0 or p < _ZERO or p > 1.0 - _ZERO:
            taken[i] = int(size > 0 and p > 0.5)
            continue
        if held < 0:
            held, q = i, p
            continue
        other = sizes[held]
        # words that i can gain and the held item give, and the reverse
        up, down = min((1.0 - p) * size, q * other), min(p * size, (1.0 - q) * other)
        words = up if draws[i] * (up + down) < down else -down
        p, q = p + words / size, q - words / other
        left = [(j, x) for j, x in ((i, p), (held, q)) if _ZERO <= x <= 1.0 - _ZERO]
        for j, x in ((i, p), (held, q)):
            taken[j] = int(x > 1.0 - _ZERO)
        held, q = left[0] if left else (-1, 0.0)
    return taken, held, q


def nearest_subset(wanted: float, values: list[int]) -> list[int]:
    """Indices of the values whose sum comes nearest to ``wanted``; the fewest of those that come equally near."""
    half = len(values) // 2

    def sums(part: list[int]) -> tuple[np.ndarray, np.ndarray]:
        total, used = np.zeros(1, np.int64), np.zeros(1, np.int64)
        for v in part:
            total, used = np.concatenate([total, total + v]), np.concatenate([used, used + 1])
        return total, used

    left, left_used = sums(values[:half])
    right, right_used = sums(values[half:])
    order = np.lexsort((right_used, right))
    order = order[np.concatenate([[True], np.diff(right[order]) != 0])]
    place = np.searchsorted(right[order], wanted - left)
    best = (np.inf, 0, 0, 0)
    for at in (np.clip(place - 1, 0, len(order) - 1), np.clip(place, 0, len(order) - 1)):
        apart = np.round(np.abs(wanted - left - right[order[at]]), 6)
        used = left_used + right_used[order[at]]
        i = int(np.lexsort((used, apart))[0])
        best = min(best, (float(apart[i]), int(used[i]), i, int(order[at[i]])))
    mask = best[2] | best[3] << half
    return [i for i in range(len(values)) if mask >> i & 1]


def with_sizes(df: DataFrame, keep: list[str], text: str = "text", source: str = "source") -> DataFrame:
    """The ``keep`` columns with ``__source``, ``size`` in words and a content ``__key``."""
    rows = df.select(*keep, F.col(source).alias("__source"), F.xxhash64(F.col(text), F.col(source), *keep).alias("__key"), F.col(text).alias("__text"))

    def sized(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                counts = Words(strings(part, "__text")).counts.astype(np.int64)
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts)], names=[*part.schema.names[:-1], "size"])

    return rows.mapInArrow(sized, rows.drop("__text").schema.add("size", "long", False))


def _round_group(table: pa.Table, level: int, fan_in: int, last: bool) -> pa.Table:
    """Rounds the fractions of one bucket, source by source; rows of several copies fall apart by their decisions."""
    n = table["__n"].to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    place = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    key, chunk, size, part = (table[c].to_numpy()[row] for c in ("__key", "__chunk", "size", "__part"))
    source = pc.dictionary_encode(table["__source"].combine_chunks(), null_encoding="encode").indices.to_numpy()[row]
    draws = _draws(level, key, chunk, place)
    order = np.lexsort((place, chunk, key, -size, source))  # large ones first, while there are partners with as many words
    up, open_ = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
    fraction = np.zeros(len(n))
    for own in np.split(order, np.flatnonzero(np.diff(source[order])) + 1):
        taken, held, rest = round_pairs(size[own].tolist(), part[own].tolist(), draws[own].tolist())
        np.add.at(up, row[own], taken)
        if held >= 0 and last:
            up[row[own[held]]] += draws[own[held]] < rest
        elif held >= 0:
            open_[row[own[held]]], fraction[row[own[held]]] = 1, rest
    whole, group, none = table["__whole"].to_numpy(), table["__group"].to_numpy(), np.full(len(n), -1)
    parts = []
    for count, copies, left, to in ((n - up - open_, whole, np.zeros(len(n)), none), (up, whole + 1, np.zeros(len(n)), none), (open_, whole, fraction, group // fan_in)):
        some = np.flatnonzero(count)
        new = {"__n": count, "__whole": copies, "__part": left, "__group": to, "__level": np.full(len(n), level)}
        rows = table.take(pa.array(some))
        for name, values in new.items():
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values[some].astype(values.dtype if name == "__part" else np.int64)))
        parts.append(rows)
    return pa.concat_tables(parts)


def _rounded(columns: list[str], level: int, fan_in: int, last: bool) -> Callable[[pa.Table], pa.Table]:
    def run(table: pa.Table) -> pa.Table:
        return _round_group(table.select(columns), level, fan_in, last)

    return run


def _repairs(table: pa.Table, choices: int) -> pa.Table:
    """Of one source's documents offered for repair, those whose change by one copy brings the source nearest to its target."""
    size, up = table["size"].to_numpy(), table["__up"].to_numpy(zero_copy_only=False)
    order = np.lexsort((table["__level"].to_numpy(), table["__chunk"].to_numpy(), table["__key"].to_numpy(), size))
    gain = np.where(up, -size, size)[order]  # words that the change of a document brings
    off = float(table["__off"][0].as_py())
    best: tuple[float, int, list[int]] | None = None
    # large steps of at least this share of what is left, then the best subset; without choice, the best subset of all
    for share in (1.5, 0.5, 0.125, 0.0) if len(order) > choices else (1.5,):
        found, rest = [], off
        for i in range(len(order) - 1, -1, -1):
            if gain[i] * rest > 0 and share * abs(rest) <= abs(gain[i]) <= abs(rest):
                found.append(i)
                rest -= gain[i]
        others = np.setdiff1d(np.arange(len(order)), found)
        if len(others) > choices:  # spread over the sizes, of both directions
            more, less = others[gain[others] > 0], others[gain[others] < 0]
            n = min(len(more), max(choices // 2, choices - len(less)))
            others = np.concatenate([part[np.arange(m) * len(part) // m] for part, m in ((more, n), (less, choices - n)) if m])
        found += others[nearest_subset(rest, gain[others].tolist())].tolist()
        tried = (round(abs(off - float(gain[np.array(found, np.int64)].sum())), 6), len(found), found)
        best = min(best, tried) if best else tried
    return table.take(pa.array(order[np.array(best[2], np.int64)], pa.int64())).select(["__key", "__chunk", "__level", "__whole", "__up"])


def mix(
    df: DataFrame, keep: list[str], text: str = "text", source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = 3, bucket_rows: int = 20_000, fan_in: int = 64, max_sources: int = 100_000, choices: int = 24
) -> DataFrame:
    """The ``keep`` columns of every row with size, source_size, target, copies and taken words."""
    spark = df.sparkSession
    scratch = Scratch(spark, "mix")
    sized = scratch.keep(with_sizes(df, keep, text, source), "sized", narrow=True)
    per_source = sized.groupBy("__source").agg(F.sum("size").alias("size"), F.count("*").alias("rows"))
    found = per_source.limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources")
    sizes = {r["__source"]: r["size"] for r in found}
    target = targets(sizes, weights, most)
    known = spark.createDataFrame([(s, int(n), float(target[s]), target[s] / n if n else 0.0) for s, n in sizes.items()], "s string, source_size long, target double, ratio double")
    same = F.col("__source").eqNullSafe(F.col("s"))
    groups = max(1, math.ceil(sum(r["rows"] for r in found) / bucket_rows))
    shards = max(1, math.ceil(len(found) / 256))

    near = F.rint("ratio")  # a ratio that is whole but for its last digits is whole
    ratio = F.when(F.abs(F.col("ratio") - near) < 1e-12, near).otherwise(F.col("ratio"))
    start = dealt(sized, "__key", F.lit(_CHUNK), groups).join(F.broadcast(known), same)  # bounded by max_sources
    start = start.withColumns({"__whole": F.floor(ratio).cast("long"), "__part": ratio - F.floor(ratio), "__level": F.lit(0).cast("long"), "__shard": F.lit(0).cast("long")})
    columns = [*keep, "__source", "__key", "size", "__chunk", "__n", "__level", "__whole", "__part", "__group"]
    schema = start.select(*columns).schema
    current, level, decided = start, 0, []
    while True:
        # a task holds one group at a time
        step = current.select(*columns, "__shard").groupBy("__group", "__shard").applyInArrow(_rounded(columns, level, fan_in, groups == 1), schema)
        step = scratch.keep(step, f"level{level}", narrow=True)
        decided.append(step.where(F.col("__group") < 0))
        if groups == 1:
            break
        current = step.where(F.col("__group") >= 0).withColumn("__shard", F.pmod(F.xxhash64("__source"), F.lit(shards)))
        groups, level = math.ceil(groups / fan_in), level + 1
    rounded = reduce(DataFrame.unionByName, decided).drop("__part", "__group").join(F.broadcast(known), same)
    rounded = rounded.withColumn("__up", F.col("__whole") > F.floor(ratio))
    scratch.drop("sized")

    # documents offered for repair: some of each source, decision and class of sizes, chosen by hash
    off = rounded.groupBy("s").agg((F.first("target") - F.sum(F.col("__n") * F.col("__whole") * F.col("size"))).alias("__off")).where(F.abs("__off") > 0.5)
    off = scratch.keep(off, "off", narrow=True)
    lane = F.pmod(F.xxhash64("__key", "__chunk", "__level"), F.lit(64))
    row = F.struct(F.xxhash64("__chunk", "__key").alias("h"), "__key", "__chunk", "__level", "__whole", "size")
    offered = rounded.where((F.col("size") > 0) & (ratio != F.floor(ratio))).groupBy("s", "__up", F.floor(F.log2("size")).alias("c"), lane.alias("l")).agg(F.min(row).alias("r"))
    offered = offered.select("s", "__up", "r.*").join(off.withColumnRenamed("s", "o"), F.col("s").eqNullSafe(F.col("o")))
    repairs = offered.groupBy("s").applyInArrow(lambda t: _repairs(t, choices), "__key long, __chunk long, __level long, __whole long, __up boolean")
    repairs = scratch.keep(repairs.withColumnRenamed("__up", "__down"), "repairs", narrow=True)  # at most the rows offered
    changed = rounded.join(repairs, ["__key", "__chunk", "__level", "__whole"], "left")
    one = F.when(F.col("__down"), F.col("__whole") - 1).otherwise(F.col("__whole") + 1)
    plain, fixed = F.col("__n").cast("int"), F.col("__down").isNotNull().cast("int")
    copies = F.explode(F.concat(F.array_repeat("__whole", plain - fixed), F.array_repeat(one, fixed)))
    return changed.select(*keep, "size", "source_size", "target", copies.alias("copies")).withColumn("taken", F.col("copies") * F.col("size"))
