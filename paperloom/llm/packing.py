"""Variable-capacity best-fit packing of documents into training sequences.

Items are packed largest first.  An item goes into the open bin that it fills best;
if none has room, a bin is opened, of the permitted length whose cost per token is
least when filled greedily from the items still to come (all permitted lengths are
weighed against each other each time).  Finally every bin is cut down to the
smallest permitted length that holds its contents.  A document longer than the
largest length is first cut into pieces of that length and a rest.

Scale: rows are dealt by hash into groups of about ``group_rows`` pieces (their number
follows the table, not the cluster); equal rows are counted first and dealt in chunks, so
that a row that is repeated a million times fills no group.  A task packs one group at a
time, which leaves a few bins partly filled, out of thousands.

Defined results: documents of size 0 (null or empty texts) need no bin and get none:
one row, piece 0, with a null bin.  Repeated rows are items each; ties of size are settled
by 64-bit hashes of the rows.  A very long text is cut into pieces; all pieces of one
document meet in one group (at most some 260,000, as Spark's strings end at 2 GB).  An
empty table gives an empty result.  Columns other than ``keep`` (which must be
comparable) are not carried, so clashing names do no harm.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paperloom.llm._shared import Scratch, dealt

LENGTHS = (512, 1024, 2048, 4096, 8192)
#: What a sequence costs beside its length.
OVERHEAD = 32


class _Sizes:
    """A multiset of whole numbers that finds the largest one up to, or the smallest one from, a bound."""

    def __init__(self):
        self.counts: dict[int, int] = {}
        self.bits = 0

    def add(self, size: int, n: int = 1) -> None:
        if not self.counts.get(size):
            self.bits |= 1 << size
        self.counts[size] = self.counts.get(size, 0) + n

    def remove(self, size: int) -> None:
        self.counts[size] -= 1
        if not self.counts[size]:
            self.bits ^= 1 << size

    def most(self, bound: int) -> int:
        """The largest member up to the bound, or 0."""
        return max(0, (self.bits & ((1 << (bound + 1)) - 1)).bit_length() - 1)

    def least(self, bound: int) -> int:
        """The smallest member from the bound on, or -1."""
        above = self.bits >> bound
        return bound + (above & -above).bit_length() - 1 if above else -1


def best_length(size: int, rest: _Sizes, lengths: tuple[int, ...], overhead: int) -> int:
    """The permitted length of the least cost per token, for a bin that begins with ``size``."""
    best, least = 0, math.inf
    for length in lengths:
        if length < size:
            continue
        room = bound = length - size
        # all copies of a size at once: the steps are as many as the distinct sizes taken, whose sum the length bounds
        while bound > 0 and (x := rest.most(bound)):
            room -= x * min(rest.counts[x], room // x)
            bound = min(room, x - 1)
        cost = (length + overhead) / (length - room)
        if cost < least:
            best, least = length, cost
    return best


def pack(sizes: list[int], lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD) -> tuple[list[int], list[int], list[int]]:
    """For sizes in descending order (1 to the largest length): each item's bin and offset, and each bin's final length."""
    rest, room = _Sizes(), _Sizes()
    for size in sizes:
        rest.add(size)
    bins_with: dict[int, list[int]] = {}
    lengths = tuple(sorted(lengths))
    capacity: list[int] = []
    filled: list[int] = []
    of, offset = [], []
    for size in sizes:
        rest.remove(size)
        space = room.least(size)
        if space >= 0:
            b = bins_with[space].pop()
            room.remove(space)
        else:
            b, space = len(capacity), best_length(size, rest, lengths, overhead)
            capacity.append(space)
            filled.append(0)
        of.append(b)
        offset.append(filled[b])
        filled[b] += size
        if space > size:
            room.add(space - size)
            bins_with.setdefault(space - size, []).append(b)
    return of, offset, [next(n for n in lengths if n >= f) for f in filled]


_OUT = "piece long, start long, size long, bin_id long, bin_offset long, bin_length long"


def _packed(table: pa.Table, keep: list[str], lengths: tuple[int, ...], overhead: int) -> pa.Table:
    """The pieces of one group."""
    size, key, chunk, n = (table[c].to_numpy() for c in ("__size", "__key", "__chunk", "__n"))
    group, largest = table["__group"][0].as_py(), lengths[-1]
    rows = np.lexsort((chunk, key, -size))
    rows = np.repeat(rows, n[rows])
    pieces = np.maximum(1, -(-size[rows] // largest))
    item_row = np.repeat(rows, pieces)
    piece = np.arange(len(item_row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    item_size = np.minimum(largest, size[item_row] - piece * largest)
    order = np.argsort(-item_size, kind="stable")
    item_row, piece, item_size = item_row[order], piece[order], item_size[order]
    filled = int((item_size > 0).sum())
    of, offset, final = pack(item_size[:filled].tolist(), lengths, overhead)
    none = np.arange(len(item_row)) >= filled
    of_all = np.concatenate([np.array(of, np.int64), np.zeros(len(item_row) - filled, np.int64)])
    columns = [
        pa.array(piece),
        pa.array(piece * largest),
        pa.array(item_size),
        pa.array((group << 32) + of_all, mask=none),
        pa.array(np.concatenate([np.array(offset, np.int64), np.zeros(len(item_row) - filled, np.int64)]), mask=none),
        pa.array(np.array(final, np.int64)[of_all] if final else of_all, mask=none),
    ]
    kept = table.select(keep).take(pa.array(item_row))
    return pa.Table.from_arrays([*kept.columns, *(pa.chunked_array([c]) for c in columns)], names=[*keep, "piece", "start", "size", "bin_id", "bin_offset", "bin_length"])


def pack_documents(df: DataFrame, keep: list[str], size: str, lengths: tuple[int, ...] = LENGTHS, overhead: int = OVERHEAD, group_rows: int = 20_000) -> DataFrame:
    """A row for each piece of each document: ``keep``, piece, start, size, bin_id, bin_offset and bin_length."""
    lengths = tuple(sorted(set(lengths)))
    scratch = Scratch(df.sparkSession, "packing")
    rows = df.select(*keep, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"), F.xxhash64(*keep, size).alias("__key"))
    rows = scratch.keep(rows, "sizes", narrow=True)  # sizes may come from a costly scan
    # groups are bounded by pieces, as one document can have very many
    pieces = F.greatest(F.lit(1), F.ceil(F.col("__size") / lengths[-1]))
    n = rows.agg(F.sum(pieces)).first()[0] or 0
    # chunks of equal rows are small beside a group
    grouped = dealt(rows, "__key", F.greatest(F.lit(1), F.floor(F.lit(group_rows / 20) / pieces)), max(1, math.ceil(n / group_rows)))
    schema = rows.select(*keep).schema
    for field in _OUT.split(", "):
        name, kind = field.split()
        schema = schema.add(name, kind)

    def packed(table: pa.Table) -> pa.Table:
        return _packed(table, keep, lengths, overhead)

    return grouped.groupBy("__group").applyInArrow(packed, schema)
