"""Hierarchical packing of documents into windows of several lengths.

Windows are powers of two.  A document longer than the longest window gives full
windows; what remains is routed to the smallest window that holds it.  The longest
remaining piece opens a window of its tier; the gap is filled with the longest
pieces of shorter tiers that fit, and its last places with a piece cut to size.  So
every window is full: no padding, and few cuts.  What a partition has left at its end
is laid end to end in windows of falling powers of two.

Steps.  Windows of one length are collected into steps of ``STEP_TOKENS`` tokens, so
all steps weigh the same whatever their window length; only the last step of each
length and partition can be lighter.

A partition packs for itself, in batches: nothing is shuffled, and a task holds one
batch and a small pool of pieces.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from switchyard.llm.records import Encoder

WINDOW = 2048
SHORTEST = 128
STEP_TOKENS = 1 << 15
#: Tokens kept back between batches, so that gaps find pieces that fit.
RESERVE = 64 * WINDOW
#: Distinct words kept encoded by a worker, which holds them between tasks and stages: some 170 bytes each.
KNOWN = 800_000
SCHEMA = (
    "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window long, step long"
)


class _Words(Encoder):
    """Texts -> ids, with at most ``KNOWN`` different words kept."""

    def __init__(self, tokenizer: Tokenizer):
        super().__init__(tokenizer, KNOWN // 2)

    @property
    def young(self) -> dict[str, bytes]:
        return self.store

    def ids(self, words: list[str]) -> bytes:
        """The ids of words that stand behind a space each."""
        return next(self._found([words]))


@cache
def _store(path: str) -> _Words:
    return _Words(Tokenizer.from_file(path))


def encode_texts(texts: list[str], path: str) -> Iterator[bytes]:
    """The ids of each text as little-endian unsigned 32-bit numbers; each different word is encoded once."""
    yield from _store(path).encode(texts)


class _Packer:
    """The pool of a partition and the pieces placed so far."""

    def __init__(self, partition: int, window: int, shortest: int):
        self.window, self.shortest = window, shortest
        self.sequence = self.next_step = partition << 33
        self.pool: dict[int, list[tuple]] = {}  # length -> pieces (doc_id, start, ids, doc_tokens)
        self.lengths = 0  # bit n is set if the pool has a piece of n tokens
        self.tokens = 0
        self.steps: dict[int, tuple[int, int]] = {}
        self.rows: list[tuple] = []

    def _put(self, doc_id, start: int, ids: bytes, total: int) -> None:
        n = len(ids) // 4
        if n:
            self.pool.setdefault(n, []).append((doc_id, start, ids, total))
            self.lengths |= 1 << n
            self.tokens += n

    def _take(self, n: int) -> tuple:
        piece = self.pool[n].pop()
        if not self.pool[n]:
            self.lengths ^= 1 << n
        self.tokens -= n
        return piece

    def _fit(self, gap: int) -> tuple:
        """The longest piece within ``gap``, or one cut to it."""
        fitting = self.lengths & ((2 << gap) - 1)
        if fitting:
            return self._take(fitting.bit_length() - 1)
        doc_id, start, ids, total = self._take((self.lengths & -self.lengths).bit_length() - 1)
        self._put(doc_id, start + gap, ids[4 * gap :], total)
        return doc_id, start, ids[: 4 * gap], total

    def _emit(self, window: int, pieces: list[tuple]) -> None:
        step, filled = self.steps.get(window, (None, STEP_TOKENS))
        if filled + window > STEP_TOKENS:
            step, filled = self.next_step, 0
            self.next_step += 1
        self.steps[window] = step, filled + window
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, total, self.sequence, offset, window, step))
            offset += n
        self.sequence += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, full = len(ids) // 4, 4 * self.window
        whole = len(ids) - len(ids) % full
        for at in range(0, whole, full):
            self._emit(self.window, [(doc_id, at // 4, ids[at : at + full], total)])
        self._put(doc_id, whole // 4, ids[whole:], total)

    def _fill(self, window: int) -> None:
        pieces, gap = [], window
        while gap:
            pieces.append(self._fit(gap))
            gap -= len(pieces[-1][2]) // 4
        self._emit(window, pieces)

    def pack(self, reserve: int) -> None:
        """Fill windows, longest pieces first, while more than ``reserve`` tokens are there."""
        while self.tokens > reserve:
            longest = self.lengths.bit_length() - 1
            window = max(self.shortest, 1 << (longest - 1).bit_length())
            if window > self.tokens:
                break
            self._fill(window)

    def finish(self) -> None:
        self.pack(0)
        while self.tokens:
            self._fill(1 << (self.tokens.bit_length() - 1))


def pack(docs: DataFrame, path: str, end: int = 1, window: int = WINDOW, shortest: int = SHORTEST) -> DataFrame:
    """One row per piece (``SCHEMA``): ``ids`` as bytes, its place in the document and in its sequence.

    Each document's ids are closed by the id ``end``; a null text is empty and has that
    id only.  ``window`` is the sequence's length, a power of two.  Rows without an id
    and repeated rows are packed like others; an empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(TaskContext.get().partitionId(), window, shortest)
        closing = np.array([end], "<u4").tobytes()
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode_texts(texts, path), strict=True):
                packer.add(doc_id, ids + closing)
                if len(packer.rows) >= 2000:
                    yield from _rows(packer)
            packer.pack(RESERVE)
            yield from _rows(packer)
        packer.finish()
        yield from _rows(packer)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def _rows(packer: _Packer) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    for at in range(0, len(packer.rows), 2000):
        columns = zip(*packer.rows[at : at + 2000], strict=True)
        kinds = (pa.binary() if n == "ids" else pa.int64() for n in names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)
    packer.rows = []
