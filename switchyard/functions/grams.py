"""Hashed character n-grams of whole texts, for one Arrow batch.

A task numbers the grams it meets: the number of an n-gram lies in a table, in the row of the
number of its first n-1 characters and the column of its last one.  So a window of texts takes
one look-up per character and length, done for all characters at once, and only a gram that
is new to the task is hashed."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd

# N-gram lengths of the hash embedding.
EMBED_NGRAMS = (3, 4, 5)
_LONGEST = max(EMBED_NGRAMS)

# Start positions handled together; bounds the memory of a task.
WINDOW = 1 << 17

# Cells of a table of numbers, grams of the greatest length that have one, and letters at most.
CELLS = 1 << 24
NUMBERED = 1 << 20
LETTERS = 255


def gram_entry(gram: str, dim: int) -> tuple[int, int]:
    """Dimension and weight (whole thousandths) of a gram."""
    digest = int.from_bytes(hashlib.md5(gram.encode("utf-8", "surrogatepass")).digest(), "big")
    return digest % dim, (digest >> 8) % 1000


class Known(dict):
    """What a function gives for grams, worked out once each, of the last ``size`` to twice
    ``size`` different grams asked for: a full table becomes the older one, and what is
    still asked for moves over from there."""

    def __init__(self, function: Callable[[str], int], size: int):
        super().__init__()
        self.function, self.size, self.older = function, size, {}

    def __missing__(self, gram: str) -> int:
        value = self.older.get(gram)
        if value is None:
            value = self.function(gram)
        self[gram] = value
        return value

    def rest(self) -> None:
        """To be called between texts: ages a full table."""
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()


def gram_code(dim: int) -> Callable[[str], int]:
    """Dimension and weight of a gram as one number."""

    def code(gram: str) -> int:
        idx, weight = gram_entry(gram, dim)
        return idx << 10 | weight

    return code


class Numbered:
    """The grams that a task has met, their numbers and what ``known`` gives for them.

    Number 0 is for grams without one: those with a letter beyond the most frequent ones, and
    those that no longer fit.  A full table begins anew with the window that filled it."""

    def __init__(self, known: Known, lengths: tuple[int, ...]):
        self.known, self.lengths = known, lengths
        self.begin(np.zeros(0, np.uint32))

    def begin(self, points: np.ndarray) -> None:
        letters, counts = np.unique(points, return_counts=True)
        letters = letters[np.argsort(-counts, kind="stable")[:LETTERS]]
        self.code = np.zeros(0x110000, np.uint8)
        self.code[letters] = np.arange(1, len(letters) + 1)
        self.free = len(letters) + 1
        self.width = next(w for w in (64, 128, 256) if w == 256 or 4 * len(letters) < 3 * w)
        # A 2-gram's number is made of its letters; a row of a table stands for a number of the table before.
        rows, longest = self.width**2, max(self.lengths)
        self.cells, self.values, self.used, self.most = {}, {}, {}, {}
        for n in range(3, longest + 1):
            self.cells[n] = np.zeros(rows * self.width, np.int32)
            rows = NUMBERED if n == longest else CELLS // self.width
            self.values[n], self.used[n], self.most[n] = np.full(1, -1), 1, rows

    def _spell(self, points: np.ndarray, fresh: bool) -> np.ndarray | None:
        """Codes of the characters, 0 for a letter without one; None if others should have one."""
        code = self.code[points]
        if code.all():
            return code
        missing = np.flatnonzero(code == 0)
        letters = np.unique(points[missing])
        if self.free + len(letters) <= self.width:
            self.code[letters] = np.arange(self.free, self.free + len(letters))
            self.free += len(letters)
            return self.code[points]
        return code if fresh or (self.width == 256 and len(missing) * 20 < len(points)) else None

    def _found(self, points: np.ndarray, joined: str, fresh: bool) -> dict[int, np.ndarray] | None:
        """Per length and start the value, -1 where the gram has no number; None if the tables are full."""
        code = self._spell(points, fresh)
        if code is None:
            return None
        whole, code = bool(code.all()), code.astype(np.int64)
        ids = code[:-1] * self.width + code[1:]
        if not whole:
            ids[(code[:-1] == 0) | (code[1:] == 0)] = 0
        out = {}
        for n in range(3, max(self.lengths) + 1):
            cell = ids[:-1] * self.width
            cell += code[n - 1 :]
            # All of these numbers lie in their tables; the mode saves a copy.
            ids = self.cells[n].take(cell, mode="clip")
            new = np.flatnonzero(ids == 0)
            if len(new):
                new = new[(cell[new] >= self.width) & (code[new + n - 1] != 0)]
            if len(new):
                cells, first = np.unique(cell[new], return_index=True)
                room = self.most[n] - self.used[n]
                if len(cells) > room and not fresh:
                    return None
                cells, first = cells[:room], first[:room]
                self.cells[n][cells] = np.arange(self.used[n], self.used[n] + len(cells))
                if n in self.lengths:
                    self._keep(n, [self.known.function(joined[p : p + n]) for p in new[first].tolist()])
                self.used[n] += len(cells)
                ids[new] = self.cells[n][cell[new]]
            ids = ids.astype(np.int64)
            if n in self.lengths:
                out[n] = self.values[n].take(ids, mode="clip")
        return out

    def _keep(self, n: int, values: list[int]) -> None:
        """The values of the next numbers; the room for them doubles where it is full."""
        upto = self.used[n] + len(values)
        if upto > len(self.values[n]):
            self.values[n] = np.append(self.values[n], np.full(max(upto, 1 << 10), -1))
        self.values[n][self.used[n] : upto] = values

    def windows(self, texts: list[str]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, characters, starts, text numbers, values) of the grams of windows of the texts.

        The value is -1 for grams without a number, which ``known`` has."""
        for n, joined, owner, values, beyond in self.starts(texts):
            at = np.delete(np.arange(len(values)), beyond)
            yield n, joined, at, owner[at], values[at]

    def starts(self, texts: list[str]) -> Iterator[tuple[int, str, np.ndarray, np.ndarray, np.ndarray]]:
        """(length, characters, text numbers, values, beyond) of all starts of windows of the texts.

        Starts in ``beyond`` are no gram's: there it would reach into the next text, or another window
        counts it.  There are few; to give them a value without effect costs less than to cut them out."""
        for group in _windows(texts):
            joined = "".join(part for _, part, _ in group)
            sizes = np.array([len(part) for _, part, _ in group])
            starts = np.array([starts for _, _, starts in group])
            first, owner = np.cumsum(sizes) - sizes, np.repeat([number for number, _, _ in group], sizes)
            points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
            found = self._found(points, joined, False)
            if found is None:
                self.begin(points)
                found = self._found(points, joined, True)
            for n, values in found.items():
                counted = np.clip(sizes - n + 1, 0, starts)
                rest = sizes - counted
                beyond = np.repeat(first + counted, rest) + np.arange(rest.sum()) - np.repeat(np.cumsum(rest) - rest, rest)
                yield n, joined, owner[: len(values)], values, beyond[beyond < len(values)]


def _windows(texts: list[str]) -> Iterator[list[tuple[int, str, int]]]:
    """Groups of (text number, characters, start positions): a long text is cut
    into windows that carry the few characters their last grams reach into."""
    group, filled = [], 0
    for number, text in enumerate(texts):
        for at in range(0, len(text), WINDOW):
            part = text[at : at + WINDOW + _LONGEST - 1]
            starts = min(WINDOW, len(text) - at)
            if filled + starts > WINDOW and group:
                yield group
                group, filled = [], 0
            group.append((number, part, starts))
            filled += starts
    if group:
        yield group


def gram_sums(texts: list[str], dim: int, known: Numbered | dict) -> np.ndarray:
    """Summed gram weights per text and dimension, in whole thousandths.

    Every 3-, 4- and 5-gram counts; a text shorter than n gives itself.  ``known``, of
    ``gram_code(dim)``, keeps grams between calls; a plain dictionary does not.
    """
    known = known if isinstance(known, Numbered) else Numbered(Known(gram_code(dim), WINDOW), EMBED_NGRAMS)
    sums = np.zeros((len(texts), dim))
    for number, text in enumerate(texts):
        for n in EMBED_NGRAMS:
            if 0 < len(text) < n:
                idx, weight = gram_entry(text, dim)
                sums[number, idx] += weight
    for n, joined, owner, values, beyond in known.starts(texts):
        values[beyond] = 0  # no weight
        slow = np.flatnonzero(values < 0)
        values[slow] = [known.known[joined[p : p + n]] for p in slow.tolist()]
        known.known.rest()
        if len(values):
            part = np.bincount((owner - owner[0]) * dim + (values >> 10), weights=(values & 1023).astype(float))
            begin = owner[0] * dim
            sums.reshape(-1)[begin : begin + len(part)] += part
    return sums
