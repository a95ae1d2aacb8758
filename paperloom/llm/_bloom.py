"""Bounded Bloom filters, built by distributed bitwise or.

They only thin out rows before an exact join or aggregate: beyond the size bound
more rows pass, none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._words import mix64

Bloom = tuple[np.ndarray, int]


def bloom_bits(ids: np.ndarray, bits: int) -> list[np.ndarray]:
    """Three bit places of each 64-bit id."""
    h = mix64(ids.view(np.uint64))
    return [(mix64(h + np.uint64(s)) % np.uint64(bits)).astype(np.int64) for s in range(3)]


def _words(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    held = np.zeros(bits // 64, np.uint64)
    for batch in batches:
        for at in bloom_bits(batch.column("id").to_numpy(zero_copy_only=False), bits):
            np.bitwise_or.at(held, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    used = np.flatnonzero(held)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(held[used].view(np.int64))], names=["word", "value"])


def build_bloom(ids: DataFrame, n: int, most_bytes: int = 1 << 24) -> Bloom:
    """The filter of about ``n`` rows of ``id`` (long), of at most ``most_bytes``."""
    bits = 1 << min((most_bytes * 8).bit_length() - 1, max(10, (16 * max(1, n)).bit_length()))
    found = ids.mapInArrow(partial(_words, bits=bits), "word long, value long").groupBy("word").agg(F.bit_or("value").alias("value")).toArrow()  # bits / 64 rows at most
    held = np.zeros(bits // 64, np.uint64)
    held[found["word"].to_numpy()] = found["value"].to_numpy().view(np.uint64)
    return held, bits


def may_contain(bloom: Bloom, ids: np.ndarray) -> np.ndarray:
    held, bits = bloom
    hit = np.ones(len(ids), bool)
    for at in bloom_bits(ids, bits):
        hit &= ((held[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)).astype(bool)
    return hit
