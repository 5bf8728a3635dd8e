"""Packing documents into sequences by minimum bin slack.

A document longer than the capacity is cut into full sequences and a remainder.  For the
remainders each window takes the longest one left and, by subset-sum dynamic programming
over a bit set of reachable sums, the multiset of other lengths that fills the window
closest to its capacity; the counts are found by walking back through the bit sets.  A
pattern is used as often as its lengths last.

Every task packs what it reads: no shuffle.  It holds a pool of at most ``pool``
remainders and packs half of it whenever it is full, so only the very last windows of a
task lack choice; what is left in the last one is cut at powers of two, which need no
padding.

Edge cases: null and empty texts have only the end id.  Repeated rows and equal or null
ids are pieces of their own.  Empty tables give an empty result.  Columns other than
``doc_id`` and ``text`` are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrina.llm.common import slices
from vitrina.llm.encoding import REMEMBERED, TextEncoder

CAPACITY = 2048
POOL = 4096


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths, at most ``counts`` of each, whose sum is closest to ``capacity`` from below.

    ``reach`` has bit ``s`` set if sum ``s`` can be made.  Counts are split into powers of
    two; bit sets before each part are kept to walk back.  Stops when the capacity is met.
    """
    full, reach = (1 << (capacity + 1)) - 1, 1
    steps: list[tuple[int, int, int]] = []
    for length in sorted(counts, reverse=True):
        left, part = min(counts[length], capacity // length), 1
        while left > 0:
            take = min(part, left)
            steps.append((length, take, reach))
            reach |= (reach << (length * take)) & full
            left, part = left - take, part * 2
        if reach >> capacity & 1:
            break
    total = reach.bit_length() - 1
    chosen: dict[int, int] = {}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def windows(counts: dict[int, int], capacity: int, leave: int = 0) -> Iterator[tuple[dict[int, int], int]]:
    """(multiset of lengths, how often) until at most ``leave`` lengths are left in ``counts``, which it empties."""
    left = sum(counts.values())
    while left > leave:
        longest = max(counts)
        counts[longest] -= 1
        rest = {k: n for k, n in counts.items() if n}
        chosen = fill(rest, capacity - longest) if longest < capacity else {}
        counts[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        used = sum(chosen.values())
        times = max(1, min(min(counts[k] // n for k, n in chosen.items()), (left - leave) // used))
        for k, n in chosen.items():
            counts[k] -= n * times
            if not counts[k]:
                del counts[k]
        left -= used * times
        yield chosen, times


class Packer:
    """Pieces in, placed pieces ``(piece, start, length, sequence, offset)`` out."""

    def __init__(self, capacity: int, pool: int, first_sequence: int):
        self.capacity, self.pool, self.sequence = capacity, pool, first_sequence
        self.waiting: dict[int, list] = {}
        self.held = 0

    def next_sequence(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def add(self, piece, start: int, length: int) -> Iterator[tuple]:
        """Let a remainder of ``length`` ids wait; place half of the pool when it is full."""
        self.waiting.setdefault(length, []).append((piece, start))
        self.held += 1
        if self.held >= self.pool:
            yield from self._pack(self.pool // 2)

    def _pack(self, leave: int) -> Iterator[tuple]:
        for chosen, times in windows({k: len(v) for k, v in self.waiting.items()}, self.capacity, leave):
            if leave == 0 and sum(k * n for k, n in chosen.items()) < self.capacity and len(self.waiting) == len(chosen) and all(
                    len(self.waiting[k]) == n * times for k, n in chosen.items()) and times == 1:
                yield from self._cut(chosen)
                return
            for _ in range(times):
                sequence, offset = self.next_sequence(), 0
                for length, n in chosen.items():
                    for _ in range(n):
                        piece, start = self._take(length)
                        yield piece, start, length, sequence, offset
                        offset += length

    def _take(self, length: int) -> tuple:
        piece = self.waiting[length].pop()
        if not self.waiting[length]:
            del self.waiting[length]
        self.held -= 1
        return piece

    def _cut(self, chosen: dict[int, int]) -> Iterator[tuple]:
        """The last window, cut so that each part fills a power of two."""
        pieces = [(*self._take(length), length) for length, n in chosen.items() for _ in range(n)]
        total = sum(p[2] for p in pieces)
        while pieces:
            room = 1 << (total.bit_length() - 1)
            total -= room
            sequence, offset = self.next_sequence(), 0
            while room:
                piece, start, length = pieces.pop(0)
                take = min(room, length)
                yield piece, start, take, sequence, offset
                offset, room = offset + take, room - take
                if take < length:
                    pieces.insert(0, (piece, start + take, length - take))

    def end(self) -> Iterator[tuple]:
        yield from self._pack(0)


SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def pack_documents(docs: DataFrame, vocabulary: str, end_id: int = 1, spaces_join: bool = False,
                   capacity: int = CAPACITY, pool: int = POOL, remembered: int = REMEMBERED, slice_bytes: int = 1 << 23) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids, doc_tokens, sequence_id, offset``.

    ``ids`` are little-endian unsigned 32-bit integers.  ``sequence_id`` is the partition
    times 2^40 plus a count.  A task holds at most ``pool * capacity`` ids and a slice of a batch, of ``slice_bytes``.
    Fewer ``remembered`` chunks and smaller slices take less memory and more time; the rows are the same.
    """
    out = pa.schema([
        ("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()),
        ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()),
    ])
    end = np.array([end_id], "<u4").tobytes()

    def rows(placed: Iterator[tuple]) -> Iterator[tuple]:
        for (doc_id, ids, first, tokens), start, length, sequence, offset in placed:
            at = 4 * (start - first)
            yield doc_id, start, length, ids[at:at + 4 * length], tokens, sequence, offset

    def batch_of(found: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), out.types, strict=True)], schema=out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = TextEncoder.of(vocabulary, spaces_join, remembered)
        packer = Packer(capacity, pool, TaskContext.get().partitionId() << 40)
        for batch in slices(batches, slice_bytes, keeps=TextEncoder.kept_as(vocabulary, spaces_join)):
            found: list[tuple] = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), encoder.encode_many(batch.column(1).to_pylist()), strict=True):
                ids += end
                tokens = len(ids) // 4
                last = tokens // capacity * capacity
                for start in range(0, last, capacity):
                    found.append((doc_id, start, capacity, ids[4 * start:4 * (start + capacity)], tokens, packer.next_sequence(), 0))
                if tokens > last:
                    found.extend(rows(packer.add((doc_id, ids[4 * last:], last, tokens), last, tokens - last)))
            if found:
                yield batch_of(found)
        found = list(rows(packer.end()))
        if found:
            yield batch_of(found)

    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, SCHEMA)
