"""Quality rules with suffix-array repetition limits.

For every text the words are ranked by prefix doubling into a suffix array.
Longest common prefixes of neighbouring suffixes give, for each word position,
the longest substring starting there that occurs again in the same text.  The
spans of the maximal repeated substrings of at least ``min_repeat`` words are
united; a text is rejected when they cover too large a share of its words, or
when one repeated substring is too long.  Batches of texts share one suffix
array (a word's first rank holds its text, so that repeats never cross texts).

Words are compared by 64-bit hashes.  Everything is local to a text: one scan,
no shuffle, memory in proportion to a batch of about a million characters (a
longer single text is a batch of its own).

Defined results: a null or blank text has no words, all counts 0, and fails the
base rule.  Repeated rows are judged alike and all returned.  An empty table
gives an empty result.  Columns of the input other than those asked for with
``keep`` are not carried, so clashing names do no harm.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import small_batches
from paperloom.llm._words import Words, mix64, slices, strings

SYMBOLS = "#*$%&|<>"
_BLANK = " \t\n\x0b\x0c\r"


@dataclass(frozen=True)
class RepetitionLimits:
    """Production limits.

    ``min_words`` and ``max_window_share`` (percent of words in repeated windows
    of ``window`` words) are the base rule.  Repeats count from ``min_repeat``
    words; they may cover ``max_covered`` of the words and be ``max_longest``
    words long.
    """

    min_words: int = 50
    window: int = 3
    max_window_share: int = 50
    min_repeat: int = 8
    max_covered: float = 0.4
    max_longest: int = 150


def repeat_lengths(text_of: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """For each word, the length in words of the longest substring from there that occurs twice in its text."""
    n = len(hashes)
    longest = np.zeros(n, np.int64)
    if n < 2:
        return longest
    key = mix64(hashes + text_of.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1  # past the end: smaller than any word
    rank[order] = _group_starts(key[order])
    levels, step = [], 1
    while True:
        open_ = np.flatnonzero(np.bincount(rank[:n], minlength=n)[rank[:n]] > 1)
        if not len(open_):
            break
        levels.append(rank.astype(np.int32) if n < 2**31 - 1 else rank.copy())
        ahead = rank[np.minimum(open_ + step, n)] + 1
        pair = rank[open_] * (n + 2) + ahead
        order = np.argsort(pair, kind="stable")
        sorted_pair, sorted_rank = pair[order], rank[open_[order]]
        starts = _group_starts(sorted_pair)
        group = _group_starts(sorted_rank)  # index, within the open ones, of the old group's first
        rank[open_[order]] = sorted_rank + starts - group
        step *= 2
    suffixes = np.empty(n, np.int64)
    suffixes[rank[:n]] = np.arange(n)
    if not levels:
        return longest
    left, right = suffixes[:-1], suffixes[1:]
    near = np.flatnonzero(levels[0][left] == levels[0][right])
    i, j = left[near].copy(), right[near].copy()
    common = np.zeros(len(near), np.int64)
    for level in range(len(levels) - 1, -1, -1):
        ranks = levels[level]
        same = (ranks[i] == ranks[j]) & (i < n) & (j < n)
        grow = same * (1 << level)
        common += grow
        i = np.minimum(i + grow, n)
        j = np.minimum(j + grow, n)
    np.maximum.at(longest, left[near], common)
    np.maximum.at(longest, right[near], common)
    return longest


def _group_starts(ordered: np.ndarray) -> np.ndarray:
    """For each entry of a sorted array, the index of the first equal one."""
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    return np.maximum.accumulate(np.where(first, np.arange(len(ordered)), 0))


def _covered(start: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Which of n words the spans cover."""
    edge = np.bincount(start, minlength=n + 1) - np.bincount(start + length, minlength=n + 1)
    return np.cumsum(edge[:n]) > 0


def measure(texts: list[str | None], limits: RepetitionLimits) -> dict[str, np.ndarray]:
    """The base counts and the repetition figures of each text."""
    words = Words(texts)
    n = len(words.start)
    longest = repeat_lengths(words.text_of, words.hashes())
    sums = lambda mask: np.bincount(words.text_of[mask], minlength=len(texts)).astype(np.int64)
    window = np.flatnonzero(longest >= limits.window)
    spans = np.flatnonzero(longest >= limits.min_repeat)
    longest_of = np.zeros(len(texts), np.int64)
    np.maximum.at(longest_of, words.text_of, longest)
    chars, symbols, lines = [], [], []
    for text in texts:
        text = text or ""
        chars.append(len(text) - sum(map(text.count, _BLANK)))
        symbols.append(sum(map(text.count, SYMBOLS)))
        kept = [x for x in text.split("\n") if x.strip(_BLANK)]
        lines.append(len(kept) - len(set(kept)))
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": np.array(chars, np.int64),
        "n_symbols": np.array(symbols, np.int64),
        "n_dup_lines": np.array(lines, np.int64),
        "n_repeat_words": sums(_covered(window, np.full(len(window), limits.window), n)),
        "covered_words": sums(_covered(spans, longest[spans], n)),
        "longest_repeat": longest_of,
    }


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "covered_words", "longest_repeat")


def base_failed(limits: RepetitionLimits = RepetitionLimits()) -> Column:
    return (F.col("n_words") < limits.min_words) | (100 * F.col("n_repeat_words") > limits.max_window_share * F.col("n_words"))


def quality_rules(df: DataFrame, keep: list[str], text: str = "text", limits: RepetitionLimits = RepetitionLimits()) -> DataFrame:
    """The ``keep`` columns of every row with its counts, ``base_failed`` and the verdict ``kept``."""

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "__text"):
                found = measure(strings(part, "__text"), limits)
                yield pa.RecordBatch.from_arrays([part.column(i) for i in range(len(keep))] + [pa.array(found[c]) for c in COUNTS], names=[*keep, *COUNTS])

    small_batches(df.sparkSession)
    rows = df.select(*keep, F.col(text).alias("__text"))
    schema = rows.select(*keep).schema
    for name in COUNTS:
        schema = schema.add(name, "long", False)
    failed = base_failed(limits)
    repetitive = (F.col("covered_words") > limits.max_covered * F.col("n_words")) | (F.col("longest_repeat") > limits.max_longest)
    return rows.mapInArrow(judged, schema).withColumns({"base_failed": failed, "kept": ~failed & ~repetitive})
