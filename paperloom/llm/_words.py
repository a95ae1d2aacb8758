"""Vectorised word splitting and hashing of text batches.

Texts of a batch are joined into one byte array, so that word bounds, word
hashes and per-text counts come from a few numpy passes instead of a Python
loop over words.  Two alphabets are known: ``SPACED`` words are runs of anything
but ASCII white space, ``ALNUM`` words are runs of digits, a-z and every
character beyond ASCII (A-Z is lower-cased first).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_BYTES = np.arange(256)
_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
SPACED = ~_SPACE
ALNUM = ((_BYTES >= 0x30) & (_BYTES <= 0x39)) | ((_BYTES >= 0x61) & (_BYTES <= 0x7A)) | (_BYTES >= 0x80)
LOWER = np.where((_BYTES >= 0x41) & (_BYTES <= 0x5A), _BYTES + 32, _BYTES).astype(np.uint8)

_MULT = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_MULT, -1, 1 << 64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser that spreads every input bit over 64 bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: One fixed odd-looking 64-bit value for each byte.
_VALUE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))
_powers = {"n": 0}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the multiplier and of its inverse, 0 to n - 1."""
    if _powers["n"] < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _MULT), ("down", _INVERSE)):
            steps = np.full(size, base, dtype=np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
        _powers["n"] = size
    return _powers["up"][:n], _powers["down"][:n]


class Words:
    """The words of a batch of texts, in order.

    ``bytes`` is the joined batch, ``start`` and ``end`` the byte bounds of each
    word, ``first`` the index of each text's first word (one entry more than
    texts), ``counts`` its number of words.  A null text has no words.
    """

    def __init__(self, texts: list[str | None], alphabet: np.ndarray = SPACED, lower: bool = False):
        parts = [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]
        lengths = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.offsets = np.concatenate([[0], np.cumsum(lengths)])
        data = np.frombuffer(b"\n".join([*parts, b""]), dtype=np.uint8)
        self.bytes = LOWER[data] if lower else data
        inside = alphabet[self.bytes]
        edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
        if len(inside) and inside[0]:
            edges = np.concatenate([[0], edges])
        self.start, self.end = edges[0::2], edges[1::2]  # every text ends in a separator
        self.first = np.searchsorted(self.start, self.offsets)
        self.counts = np.diff(self.first)
        self.text_of = np.repeat(np.arange(len(parts)), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word; equal words have equal hashes."""
        if not len(self.start):
            return np.empty(0, np.uint64)
        up, down = _power_tables(len(self.bytes))
        sums = np.cumsum(_VALUE[self.bytes] * up, dtype=np.uint64)
        before = np.where(self.start > 0, sums[self.start - 1], np.uint64(0))
        return mix64((sums[self.end - 1] - before) * down[self.start])

    def word(self, i: int) -> str:
        return self.bytes[self.start[i] : self.end[i]].tobytes().decode("utf-8", "surrogatepass")


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive words (over text bounds, too)."""
    n = len(words) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out *= np.uint64(0xC2B2AE3D27D4EB4F)
        out += words[i : i + n]
        out ^= out >> np.uint64(29)
    return mix64(out)


def slices(batch: pa.RecordBatch, column: str, most_chars: int = 400_000, most_rows: int = 2_000) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows of bounded text length (a single longer text stands alone)."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    begin, total = 0, 0
    for i, size in enumerate(sizes):
        if i > begin and (total + size > most_chars or i - begin >= most_rows):
            yield batch.slice(begin, i - begin)
            begin, total = i, 0
        total += int(size)
    yield batch.slice(begin)


def strings(batch: pa.RecordBatch, column: str) -> list[str | None]:
    return batch.column(column).to_pylist()
