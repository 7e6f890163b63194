"""Repair of conversations whose rows are lost, emptied, cut, doubled or mislabelled.

A conversation is sound when the initials of its roles read ``(s?(ua)+)?``: at most one
system row at the front, then user and assistant in turns.  Each row is kept, given
the role of user or assistant, or deleted, and rows without text can be put in.  The
edits with the least cost are wanted, and of those the ones whose initials (the audit:
D delete, I insert, K keep, R rerole) are least in ASCII order.

Both wishes are one integer.  Its high digits carry the cost; below them the letters
of the audit stand at fixed places, three bits each, the first letter highest, and
zero - less than any letter - where the audit has ended.  So the least integer is the
answer, and a dynamic program over rows and four states (nothing yet, after s, after u,
after a) takes plain minima of such integers.  It runs from the last row to the first:
an edit in front adds its cost and moves the letters behind it one place down.

Integers are as wide as a block of ``BLOCK`` rows.  Inside a block the program finds the
least integer from every state before it to every state after it; blocks are then
joined by their costs, letters deciding ties.  Two ways through a block from one state
differ in a letter of that block (a row's letter ends each step, so neither way's letters
can begin the other's), hence the letters of later blocks never decide.  Time is linear
in the rows of a conversation.

At most one row is put in at a place: taking two neighbours of "ua" out again leaves a
sound conversation and costs less, and where they are all that follows a system row,
deleting that row is cheaper.

Spark damages, compares and sorts.  The program sees two flags and an initial per row,
in a stream sorted by conversation; texts meet the audits in a second sorted stream that
feeds the digest, so no task holds the texts of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.llm.common import SPACES
from switchyard.session import materialise

# What edits cost, and what a cut row that stays adds.
DELETE, REROLE, INSERT, TRUNCATED = 4, 3, 3, 3
LETTERS = "\0DIKR"
_D, _I, _K, _R = 1, 2, 3, 4
_BITS = 3
BLOCK = 64
# States: nothing yet, after system, after user, after assistant.
_START, _S, _U, _A = range(4)
_STATES = range(4)
# Where a row of each role may follow, and the state that a row put in leads to.
_BEFORE = {_S: (_START,), _U: (_START, _S, _A), _A: (_U,)}
_PUT = {_START: _U, _S: _U, _U: _A, _A: _U}
_INITIAL = {"s": _S, "u": _U, "a": _A}
_LARGEST = (1 << 63) - 1

FOUND = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


# --- the dynamic program --------------------------------------------------------------------


def _steps() -> dict[tuple[str, bool, bool], dict[int, list[tuple[int, int, tuple[int, ...]]]]]:
    """(initial, must go, cut) -> state before -> (state after, cost, letters) of every step."""
    found = {}
    for initial in ("s", "u", "a", ""):
        for gone in (False, True):
            for cut in (False, True):
                more, steps = TRUNCATED * cut, {}
                for state in _STATES:
                    ways = []
                    for here, cost, letters in ((state, 0, ()), (_PUT[state], INSERT, (_I,))):
                        ways.append((here, cost + DELETE, (*letters, _D)))
                        if gone:
                            continue
                        own = _INITIAL.get(initial)
                        if own is not None and here in _BEFORE[own]:
                            ways.append((own, cost + more, (*letters, _K)))
                        new = _A if here == _U else _U
                        ways.append((new, cost + REROLE + more, (*letters, _R)))
                    steps[state] = ways
                found[initial, gone, cut] = steps
    return found


_STEPS = _steps()


def _block(rows: list[tuple[str, bool, bool]]) -> list[list[tuple[int, int] | None]]:
    """[state before][state after] -> (cost, letters) of the least way through ``rows``."""
    places = 2 * len(rows)
    top = _BITS * places
    low = (1 << top) - 1
    columns = []
    for last in _STATES:
        best: list[int | None] = [None] * 4
        best[last] = 0
        for row in reversed(rows):
            steps, now = _STEPS[row], []
            for state in _STATES:
                least = None
                for after, cost, letters in steps[state]:
                    if (rest := best[after]) is None:
                        continue
                    tail = rest & low
                    for letter in reversed(letters):
                        tail = letter << top - _BITS | tail >> _BITS
                    way = (cost + (rest >> top) << top) | tail
                    if least is None or way < least:
                        least = way
                now.append(least)
            best = now
        columns.append(best)
    return [[None if (w := columns[b][a]) is None else (w >> top, w & low) for b in _STATES] for a in _STATES]


def _spell(letters: int, places: int) -> str:
    text = "".join(LETTERS[letters >> _BITS * (places - 1 - p) & 7] for p in range(places))
    return text.rstrip("\0")


class Audit:
    """The audit of a conversation, fed row by row in order."""

    def __init__(self):
        self.rows: list[tuple[str, bool, bool]] = []
        self.blocks: list[tuple[int, list]] = []

    def add(self, initial: str, gone: bool, cut: bool) -> None:
        self.rows.append((initial if initial in _INITIAL else "", gone, cut and not gone))
        if len(self.rows) == BLOCK:
            self._close()

    def _close(self) -> None:
        if self.rows:
            self.blocks.append((2 * len(self.rows), _block(self.rows)))
            self.rows = []

    def least(self) -> tuple[int, str]:
        """(cost, audit)."""
        self._close()
        # What the end costs from each state, and the row put in there.
        ends = {_START: (0, ""), _A: (0, ""), _U: (INSERT, "I")}
        costs = [ends[s][0] if s in ends else None for s in _STATES]
        choices = []
        for _, table in reversed(self.blocks):
            now, chosen = [], []
            for state in _STATES:
                ways = [(w[0] + costs[b], w[1], b) for b, w in enumerate(table[state]) if w is not None and costs[b] is not None]
                cost, letters, after = min(ways, default=(None, 0, 0))
                now.append(cost)
                chosen.append((letters, after))
            costs = now
            choices.append(chosen)
        state, audit = _START, []
        for (places, _), chosen in zip(self.blocks, reversed(choices), strict=True):
            letters, state = chosen[state]
            audit.append(_spell(letters, places))
        return costs[_START], "".join(audit) + ends[state][1]


# --- damage ---------------------------------------------------------------------------------


def _text(column: str) -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def damage(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, copies) of the rows that are left.

    ``crc32("conv_id:turn") % 20`` decides, null written as a space: 0 drops the row, 1
    empties its text, 2 takes the marks ``.!?`` out of it, 3 repeats it (two copies), 4
    makes its role user.  A null role or text is one space.  Other columns are left out."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _text("role").alias("role"), _text("text").alias("text")
    )
    kind = F.crc32(F.concat(_text("conv_id"), F.lit(":"), _text("turn")).cast("binary")) % 20
    text = F.when(F.col("_kind") == 1, "").when(F.col("_kind") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("_kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("_kind") == 3, 2).otherwise(1)
    hit = rows.withColumn("_kind", kind).where("_kind != 0")
    return hit.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copies"))


def facts(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, blank, cut, copies, again), a row per different row.

    ``again`` says that an earlier turn of the conversation has this role and text.  The
    first turn of each is found by a grouping and joined back on all four columns, so a
    text that fills a conversation does not gather anywhere."""
    trimmed = F.rtrim("text", F.lit(SPACES))
    light = (
        rows.select(
            "conv_id",
            "turn",
            "role",
            F.sha2("text", 256).alias("digest"),
            (trimmed == "").alias("blank"),
            (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"),
            "copies",
        )
        .groupBy("conv_id", "turn", "role", "digest", "blank", "cut")
        .agg(F.sum("copies").alias("copies"))
    )
    # A null turn comes first: the order of structs puts null lowest.
    firsts = light.groupBy("conv_id", "role", "digest").agg(F.min(F.struct("turn")).alias("_first"))
    firsts = firsts.select(
        F.col("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("digest").alias("_digest"), F.col("_first.turn").alias("_turn")
    )
    same = (
        F.col("conv_id").eqNullSafe(F.col("_conv"))
        & F.col("turn").eqNullSafe(F.col("_turn"))
        & (F.col("role") == F.col("_role"))
        & (F.col("digest") == F.col("_digest"))
    )
    marked = light.join(firsts, same, "left").withColumn("again", F.col("_role").isNull())
    return marked.drop("_conv", "_turn", "_role", "_digest")


# --- the two streams ------------------------------------------------------------------------

_ORDER = ["conv_id", "turn", "role", "digest"]


class _Conversation:
    """What the first stream gathers of one conversation."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.audit = conv_id, Audit()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.low = self.high = self.turn = None
        self.before: str | None = None

    def add(self, turn, role, copies, blank, cut, again) -> None:
        if turn is not None and turn != self.turn:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.turn = self.high = turn
        initial = role[:1]
        for copy in range(copies):
            repeated = again or copy > 0
            self.blank += blank
            self.duplicate += not blank and repeated
            self.truncated += not blank and not repeated and cut
            if self.before is not None and self.before + initial not in ("su", "ua", "au"):
                self.illegal += 1
            self.before = initial
            self.audit.add(initial, blank or repeated, cut)

    def row(self) -> tuple:
        gaps = 0 if self.low is None else min(_LARGEST, self.high - self.low + 1 - self.turns)
        cost, audit = self.audit.least()
        return (self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, audit)


def audits(marked: DataFrame) -> DataFrame:
    """(conv_id and counts, cost, audit): a row of ``FOUND`` per conversation that has rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, done = None, []
        for batch in batches:
            for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or conv_id != now.conv_id:
                    if now is not None:
                        done.append(now.row())
                    now = _Conversation(conv_id)
                now.add(*row)
            if len(done) >= 2000:
                yield _batch(done)
                done = []
        if now is not None:
            done.append(now.row())
        yield _batch(done)

    placed = marked.repartition("conv_id").sortWithinPartitions(*_ORDER)
    return placed.select("conv_id", "turn", "role", "copies", "blank", "cut", "again").mapInArrow(run, FOUND)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [f.split()[0] for f in FOUND.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n == "audit" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)


class _Repairing:
    """Walks an audit along the rows and yields the repaired rows."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, _START

    def _put(self, state: int) -> str:
        self.state = state
        return "user" if state == _U else "assistant"

    def _inserted(self) -> Iterator[tuple[str, str]]:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.at += 1
            yield self._put(_PUT[self.state]), ""

    def row(self, role: str, text: str) -> Iterator[tuple[str, str]]:
        yield from self._inserted()
        letter = self.audit[self.at]
        self.at += 1
        if letter == "K":
            self.state = _INITIAL[role[:1]]
            yield role, text
        elif letter == "R":
            yield self._put(_A if self.state == _U else _U), text

    end = _inserted


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the repaired conversations, row by row.

    Audits and rows meet in a stream sorted by conversation, the audit first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for conv_id, pieces in _repairs(batches):
            out, size, place = [], 0, 0
            for role, text in pieces:
                out.append((conv_id, place, role, text))
                place, size = place + 1, size + len(text)
                if size > 1 << 22:
                    yield _texts(out)
                    out, size = [], 0
            yield _texts(out)

    return _meeting(rows, found).mapInArrow(run, "conv_id long, place long, role string, text string")


def _texts(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "place", "role", "text"])


def _meeting(rows: DataFrame, found: DataFrame) -> DataFrame:
    none = F.lit(None)
    heads = found.select(
        "conv_id", F.lit(0).alias("kind"), none.cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("digest"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("copies")
    )
    body = rows.select("conv_id", F.lit(1).alias("kind"), "turn", "role", F.sha2("text", 256).alias("digest"), "text", F.col("copies").cast("long").alias("copies"))
    placed = heads.union(body).repartition("conv_id").sortWithinPartitions("conv_id", "kind", "turn", "role", "digest")
    return placed.select("conv_id", "kind", "role", "text", "copies")


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple[str, str]]]]:
    """(conv_id, its repaired rows) one after another; each must be used up before the next."""

    def stream():
        for batch in batches:
            yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)

    lines = stream()
    ahead = next(lines, None)

    def pieces(walk: _Repairing) -> Iterator[tuple[str, str]]:
        nonlocal ahead
        while (ahead := next(lines, None)) is not None and ahead[1]:
            _, _, role, text, copies = ahead
            for _ in range(copies):
                yield from walk.row(role, text)
        yield from walk.end()

    while ahead is not None:
        yield ahead[0], pieces(_Repairing(ahead[3]))


def digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(conv_id, repaired_sha256) of ``role:text`` lines, joined by line ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, hashes = [], []
        for conv_id, pieces in _repairs(batches):
            digest, between = hashlib.sha256(), ""
            for role, text in pieces:
                digest.update(f"{between}{role}:{text}".encode())
                between = "\n"
            ids.append(conv_id)
            hashes.append(digest.hexdigest())
            if len(ids) >= 2000:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes)], ["conv_id", "repaired_sha256"])
                ids, hashes = [], []
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.string())], ["conv_id", "repaired_sha256"])

    return _meeting(rows, found).mapInArrow(run, "conv_id long, repaired_sha256 string")


def repair(conversations: DataFrame) -> DataFrame:
    """Damage (conv_id, turn, role, text) and repair it: a row per conversation, ``FOUND`` and
    ``repaired_sha256``.

    Rows are taken by turn, nulls first; equal turns by role, then by the SHA-256 of the
    text.  A row's first fault counts: blank, duplicate (role and text seen earlier),
    truncated (its last character that is no space is none of ``.!?``).  Rows of equal
    content are duplicates of each other.  A null conversation is one like any other; one
    that lost all its rows has zeros, an empty audit and the digest of nothing.  ``gaps``
    beyond 64 bits is the largest number.  An empty table gives no rows."""
    rows = damage(conversations)
    found = materialise(audits(facts(rows)), "audits")
    every = conversations.select(F.col("conv_id").cast("long").alias("_conv")).distinct()
    hashes = digests(rows, found).withColumnRenamed("conv_id", "_same")
    whole = every.join(found, F.col("_conv").eqNullSafe(F.col("conv_id")), "left").drop("conv_id")
    whole = whole.join(hashes, F.col("_conv").eqNullSafe(F.col("_same")), "left")
    counts = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return whole.select(
        F.col("_conv").alias("conv_id"),
        *counts,
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"),
    )
