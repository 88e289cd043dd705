"""Packing token sequences by minimum bin slack.

A document is its text's token ids and one closing id. What is longer than a
sequence is cut into whole sequences; the rest, shorter than one, joins a
window of at most ``WINDOW`` such pieces. Each next sequence is filled from
the window: the longest piece is set, and a subset-sum recurrence over the
multiset of the remaining lengths (one bit a reachable sum, whole counts in
powers of two) gives the sum closest to the room that is left. Backtracking
tells how many pieces of each length that sum takes, and the same multiset
fills further sequences as long as the counts allow. Where the closest sum
leaves a slack, the shortest remaining piece (it is longer than the slack, or
it would have been taken) is cut to fill it and its rest goes back into the
window. What is left at the end of a partition fills sequences of falling
powers of two in the same way, so that no sequence needs padding.

Windows are packed where their documents are read: no shuffle, and no table
of lengths or plan passes through the driver. A sequence's number is the
partition's number and its place there, so a lost task makes the same rows.

Defined results: a null text is an empty one, which has its closing id alone;
every row is a document of its own, whether its identifier is null or
repeated. Extra columns are ignored. No rows in, no rows out."""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import tokenizer_files
from .common import shipped, slices, texts

#: Tokens of a sequence; pieces of a window; output rows of a batch.
CAPACITY, WINDOW, ROWS = 4096, 4096, 1024
SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
#: Bytes of an id.
WIDE = 4


def closest_sum(counts: dict[int, int], room: int, lengths: list[int] | None = None) -> dict[int, int]:
    """How many of each length give the largest sum that is at most ``room``.
    ``lengths``: the lengths in order, where they are known so."""
    reach, within, steps = 1, (1 << room + 1) - 1, []
    lengths = sorted(counts) if lengths is None else lengths
    for at in range(bisect_right(lengths, room) - 1, -1, -1):
        length = lengths[at]
        left, some = min(counts[length], room // length), 1
        while left:
            some = min(some, left)
            more = (reach | reach << length * some) & within
            if more != reach:
                steps.append((length, some, reach))
                reach = more
            left, some = left - some, some * 2
        if reach >> room & 1:
            break
    used: dict[int, int] = {}
    total = reach.bit_length() - 1
    for length, some, before in reversed(steps):
        if not before >> total & 1:                       # reached by this step only
            used[length] = used.get(length, 0) + some
            total -= length * some
    return used


class Window:
    """Pieces that wait for a sequence, by length."""

    def __init__(self):
        self.pieces: dict[int, list[tuple]] = {}
        self.counts: dict[int, int] = {}
        self.lengths: list[int] = []
        self.n = self.tokens = 0

    def add(self, piece: tuple) -> None:
        length = len(piece[2]) // WIDE
        if length not in self.pieces:
            self.pieces[length], self.counts[length] = [], 0
            insort(self.lengths, length)
        self.pieces[length].append(piece)
        self.counts[length] += 1
        self.n, self.tokens = self.n + 1, self.tokens + length

    def take(self, length: int) -> tuple:
        own = self.pieces[length]
        piece = own.pop()
        self.counts[length] -= 1
        if not own:
            del self.pieces[length], self.counts[length], self.lengths[bisect_right(self.lengths, length) - 1]
        self.n, self.tokens = self.n - 1, self.tokens - length
        return piece

    def filled(self, size: int) -> Iterator[list[tuple]]:
        """Sequences of ``size`` tokens, at least one; the window holds as many tokens."""
        used: dict[int, int] = {}
        fitting = bisect_right(self.lengths, size)
        if fitting:
            longest = self.lengths[fitting - 1]
            self.counts[longest] -= 1
            used = closest_sum(self.counts, size - longest, self.lengths)
            self.counts[longest] += 1
            used[longest] = used.get(longest, 0) + 1
        slack = size - sum(k * v for k, v in used.items())
        for _ in range(1 if slack else min(len(self.pieces[k]) // v for k, v in used.items())):
            chosen = [self.take(k) for k, v in used.items() for _ in range(v)]
            if slack:
                doc, start, ids, whole = self.take(self.lengths[bisect_right(self.lengths, slack)])
                chosen.append((doc, start, ids[:slack * WIDE], whole))
                self.add((doc, start + slack, ids[slack * WIDE:], whole))
            yield chosen


def sequences(documents: Iterator[tuple[int | None, bytes]], capacity: int = CAPACITY, window: int = WINDOW) -> Iterator[list[tuple]]:
    """Lists of pieces (identifier, start, ids, the document's tokens), one list a sequence."""
    waiting = Window()
    for doc, ids in documents:
        n = len(ids) // WIDE
        whole = n // capacity * capacity
        for at in range(0, whole, capacity):
            yield [(doc, at, ids[at * WIDE:(at + capacity) * WIDE], n)]
        if whole < n:
            waiting.add((doc, whole, ids[whole * WIDE:], n))
        if waiting.n >= window:
            while waiting.n > window // 2 and waiting.tokens >= capacity:
                yield from waiting.filled(capacity)
    while waiting.tokens:
        yield from waiting.filled(min(capacity, 1 << waiting.tokens.bit_length() - 1))


def pack(docs: DataFrame, tokenizer: str, closing_id: int, capacity: int = CAPACITY, window: int = WINDOW) -> DataFrame:
    """One row a piece: ``doc_id``, ``start`` (its document's ids before it), ``length``, ``doc_tokens``,
    ``sequence_id``, ``offset`` (its place in the sequence) and ``ids`` (little-endian, 32 bits each).
    ``tokenizer``: path of a .json (tokenizers) file; ``capacity``: a power of two."""
    if capacity & capacity - 1:
        raise ValueError("capacity must be a power of two")
    file = shipped(docs.sparkSession, tokenizer_files.read(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, last = tokenizer_files.Ids(file()), np.array([closing_id], "<u4").tobytes()
        encoded = ((doc, encoder.of(text) + last) for batch in slices(batches)
                   for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()))
        rows: list[tuple] = []
        for number, pieces in enumerate(sequences(encoded, capacity, window), TaskContext.get().partitionId() << 33):
            offset = 0
            for doc, start, ids, whole in pieces:
                rows.append((doc, start, len(ids) // WIDE, whole, number, offset, ids))
                offset += len(ids) // WIDE
            if len(rows) >= ROWS:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return texts(docs).mapInArrow(run, SCHEMA)


def batch_of(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    kinds = [pa.int64()] * 6 + [pa.binary()]
    return pa.record_batch({n: pa.array(c, k) for n, k, c in zip(names, kinds, zip(*rows))})
