"""Token counts by offset-mapped attribution.

A whole text is encoded once with a public byte-level vocabulary.  Tokens partition
the text's bytes, so running sums of token lengths give every token's span, and an
interval join with the text's sections (two sorted lists, met by binary search)
tells which sections a token touches.  A token that crosses a bound is allocated by
an explicit rule:

``majority``      to the section with the most of its bytes, the earlier one on ties
``start``         to the section of its first byte
``proportional``  to each section by its share of the bytes

Everything is local to a text: one scan, no shuffle.  The vocabulary (about a
megabyte) is read on the driver from ``vocabulary`` and broadcast.

Defined results: a null text has one row without a section and 0 tokens; an empty
text has one empty section.  Repeated rows are counted each; an empty table gives an
empty result; columns other than ``keep`` are not carried.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm._shared import small_batches
from paperloom.llm._words import slices, strings

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The vocabulary's rule for cutting a text into pieces before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
RULES = ("majority", "start", "proportional")


@lru_cache(maxsize=2)
def _encoding(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
    lengths = np.zeros(max(ranks.values()) + 1, np.int64)
    for piece, rank in ranks.items():
        lengths[rank] = len(piece)
    return tiktoken.Encoding("paperloom", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}), lengths


def load_vocabulary(spark: SparkSession, path: str = VOCABULARY):
    small_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


def token_ends(text: str, vocabulary: bytes) -> np.ndarray:
    """The byte at which each token of the text ends."""
    encoding, lengths = _encoding(vocabulary)
    return np.cumsum(lengths[np.array(encoding.encode_ordinary(text), dtype=np.int64)])


def line_bounds(data: np.ndarray) -> np.ndarray:
    """Byte bounds of the lines of a text, line feeds belonging to the line they end."""
    inner = np.flatnonzero(data[:-1] == 0x0A) + 1 if len(data) else np.empty(0, np.int64)
    return np.concatenate([[0], inner, [len(data)]])


def allocate(ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """(tokens, tokens that cross a bound) of each section between consecutive byte bounds."""
    sections = len(bounds) - 1
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    first = np.clip(np.searchsorted(bounds, starts, side="right") - 1, 0, sections - 1)
    last = np.clip(np.searchsorted(bounds, ends - 1, side="right") - 1, 0, sections - 1)
    cross = np.flatnonzero(last > first)
    counts = np.bincount(first[last == first], minlength=sections).astype(np.float64)
    crossing = np.zeros(sections)
    for t in cross:  # at most one for each bound
        touched = np.arange(first[t], last[t] + 1)
        share = np.minimum(ends[t], bounds[touched + 1]) - np.maximum(starts[t], bounds[touched])
        if rule == "proportional":
            counts[touched] += share / share.sum()
        else:
            counts[touched[0] if rule == "start" else touched[share.argmax()]] += 1
        crossing[touched] += 1
    return counts, crossing.astype(np.int64)


def _sections(batches: Iterator[pa.RecordBatch], shared, rule: str) -> Iterator[pa.RecordBatch]:
    names = ["section", "start", "end", "n_tokens", "n_crossing"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()]
    for batch in batches:
        for part in slices(batch, "__text"):
            source: list[int] = []
            columns: list[list] = [[] for _ in names]
            for i, text in enumerate(strings(part, "__text")):
                if text is None:
                    rows = [[None], [None], [None], [0.0], [0]]
                else:
                    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                    bounds = line_bounds(data)
                    counts, crossing = allocate(token_ends(text, shared.value), bounds, rule) if len(data) else (np.zeros(1), np.zeros(1, np.int64))
                    chars = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[bounds]
                    rows = [list(range(len(counts))), chars[:-1].tolist(), chars[1:].tolist(), counts.tolist(), crossing.tolist()]
                source += [i] * len(rows[0])
                for column, values in zip(columns, rows, strict=True):
                    column += values
            kept = part.select(part.schema.names[:-1]).take(pa.array(source, pa.int64()))
            yield pa.RecordBatch.from_arrays([*kept.columns, *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names=[*kept.schema.names, *names])


def section_tokens(df: DataFrame, keep: list[str], text: str = "text", rule: str = "majority", vocabulary: str = VOCABULARY) -> DataFrame:
    """A row for each line of each text: ``keep``, section (from 0), start and end in characters, n_tokens, n_crossing."""
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")
    shared = load_vocabulary(df.sparkSession, vocabulary)
    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = rows.drop("__text").schema
    for name in ("section", "start", "end"):
        schema = schema.add(name, "long")
    return rows.mapInArrow(partial(_sections, shared=shared, rule=rule), schema.add("n_tokens", "double", False).add("n_crossing", "long", False))


def _counts(batches: Iterator[pa.RecordBatch], shared) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "__text"):
            encoding, _ = _encoding(shared.value)
            counts = [len(encoding.encode_ordinary(t)) if t else 0 for t in strings(part, "__text")]
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(counts, pa.int64())], names=[*part.schema.names[:-1], "n_tokens"])


def token_counts(df: DataFrame, keep: list[str], text: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """The ``keep`` columns of every row with its number of tokens (null: 0)."""
    shared = load_vocabulary(df.sparkSession, vocabulary)
    rows = df.select(*keep, F.col(text).alias("__text"))
    return rows.mapInArrow(partial(_counts, shared=shared), rows.drop("__text").schema.add("n_tokens", "long", False))
