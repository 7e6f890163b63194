"""Hard negatives from an inverted multi-index over the two halves of the vectors.

Each half space has a codebook; a row lies in the cell of its two nearest codewords.
With ``r`` the largest distance of a row of a codeword from it, no row of cell
``(i, j)`` scores above ``(a1.c_i + |a1| r_i) + (a2.d_j + |a2| r_j)`` with an anchor
``(a1, a2)``: the sum of two half scores.  A heap hands out an anchor's cells in falling
order of these sums (the multi-sequence walk over the two sorted lists), and the walk
stops as soon as no later cell can hold a row that is still wanted.  So answers are
exact, whatever the codebooks.

Two searches.  The first finds each anchor's positives.  Their scores give the windows
of the second, which finds the best rows of other labels below the upper end of each
window; a window is certified once it has its rows and the next cell's bound lies below
the last of them, or below its lower end.

On Spark: rows are dealt into shards of neighbouring cells, a cell that is larger than a
shard (many equal vectors) into several.  An anchor is sent to those shards that have a
cell within reach of its floor - what rows of the codebook sample, which are rows of
the table, already grant.  Shard rows and anchors meet in one sorted stream, rows
first, so a task holds one shard and a batch of anchors.

The codebooks are fitted on about ``SAMPLE`` rows chosen by their hash; the driver holds
these, the codebooks and a count per cell, all bounded by parameters.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchyard.session import materialise

#: Positives per anchor, negatives per positive, and the window of their scores in percent.
POSITIVES, NEGATIVES, LOWER, UPPER = 5, 3, 50, 95
#: Rows that the codebooks are fitted on (as expected, the choice is by hash), and codewords at most.
SAMPLE, CODES = 4096, 256
#: Rows of a cell that the number of codewords aims at; rows of a shard.
CELL_ROWS, SHARD_ROWS, SHARDS_AIMED, SHARD_MOST = 512, 4096, 4096, 1 << 18
ROUNDS = 8
_MOST = (1 << 63) - 1
#: Room for rounding in bounds, relative to the sizes that enter them.
_SLACK = 1e-9


# --- exact scores ---------------------------------------------------------------------------


def inner(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Integer inner products as 64-bit integers; beyond 64 bits the largest or smallest one."""
    if not len(rows):
        return np.zeros(0, np.int64)
    if np.abs(rows).max(initial=0) * np.abs(anchor).max(initial=0) * max(1, rows.shape[1]) < 2**53:
        return (rows @ anchor).astype(np.int64)  # every partial sum is a whole number below 2^53
    whole = np.array([[int(x) for x in row] for row in rows], object) @ np.array([int(x) for x in anchor], object)
    return np.array([max(-_MOST - 1, min(_MOST, int(x))) for x in whole], np.int64)


def window(score: int, lower: int = LOWER, upper: int = UPPER) -> tuple[int, int]:
    """Least and largest whole ``n`` with ``lower * score <= 100 * n <= upper * score``."""
    return -(-lower * score // 100), upper * score // 100


# --- the index ------------------------------------------------------------------------------


def _nearest(points: np.ndarray, codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(points), np.int32)
    for at in range(0, len(points), 4096):
        part = points[at : at + 4096]
        out[at : at + 4096] = ((codes**2).sum(axis=1) / 2 - part @ codes.T).argmin(axis=1)
    return out


def codebook(points: np.ndarray, k: int) -> np.ndarray:
    """Lloyd's iterations from evenly spread rows of the sorted sample; the same for the same points."""
    if not len(points):
        return np.zeros((1, points.shape[1]))
    order = np.lexsort(points.T[::-1]) if points.shape[1] else np.arange(len(points))
    codes = points[order[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)]].copy()
    for _ in range(ROUNDS):
        owner = _nearest(points, codes)
        for c in range(len(codes)):
            if (mine := owner == c).any():
                codes[c] = points[mine].mean(axis=0)
    return np.unique(codes, axis=0)


@dataclass
class Index:
    """What every task needs: bounded by CODES and SAMPLE, whatever the table."""

    width: int
    half: int
    codes: tuple[np.ndarray, np.ndarray]
    radii: tuple[np.ndarray, np.ndarray]
    #: [first code, second code] -> first shard and number of shards; none for an empty cell.
    first: np.ndarray
    shards: np.ndarray
    sample: np.ndarray
    sample_keys: list[tuple]
    sample_labels: np.ndarray
    sample_places: dict[tuple, int]

    def split(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vectors[:, : self.half], vectors[:, self.half :]

    def bounds(self, anchor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Half-score bounds of every codeword."""
        found = []
        for part, codes, radii in zip((anchor[: self.half], anchor[self.half :]), self.codes, self.radii, strict=True):
            size = float(np.sqrt((part**2).sum()))
            slack = _SLACK * (1 + size) * (1 + float(np.abs(codes).max(initial=0)) * (1 + codes.shape[1]) + radii)
            found.append(codes @ part + size * radii + slack)
        return found[0], found[1]


def walk(left: np.ndarray, right: np.ndarray) -> Iterator[tuple[float, int, int]]:
    """(sum, i, j) over all pairs in falling order of ``left[i] + right[j]``.

    A pair is put on the heap by the one pair before it: by its neighbour in the second
    list, or in the first list at the head of the second; so none comes twice."""
    if not len(left) or not len(right):
        return
    a, b = np.argsort(-left, kind="stable").tolist(), np.argsort(-right, kind="stable").tolist()
    one, two = left.tolist(), right.tolist()
    heap = [(-(one[a[0]] + two[b[0]]), 0, 0)]
    while heap:
        less, x, y = heapq.heappop(heap)
        yield -less, a[x], b[y]
        if y + 1 < len(b):
            heapq.heappush(heap, (-(one[a[x]] + two[b[y + 1]]), x, y + 1))
        if y == 0 and x + 1 < len(a):
            heapq.heappush(heap, (-(one[a[x + 1]] + two[b[0]]), x + 1, 0))


class Want:
    """The best ``count`` rows within [low, high] that an anchor still looks for."""

    def __init__(self, count: int, low: int, high: int):
        self.count, self.low, self.high = count, low, high
        self.rows: list[tuple] = []  # (-score, no id, id, key), best first

    @property
    def floor(self) -> int:
        """No row below this is wanted."""
        return max(self.low, -self.rows[-1][0]) if len(self.rows) == self.count else self.low

    def offer(self, scores: np.ndarray, keys: list[tuple], allowed: np.ndarray) -> None:
        fits = np.flatnonzero(allowed & (scores >= self.floor) & (scores <= self.high))
        if not len(fits):
            return
        if len(fits) > self.count:  # the best, and all that tie with the last of them
            last = np.partition(scores[fits], len(fits) - self.count)[len(fits) - self.count]
            fits = fits[scores[fits] >= last]
        self.rows = sorted(set(self.rows).union((-int(scores[f]), *keys[f]) for f in fits.tolist()))[: self.count]


# --- tables ---------------------------------------------------------------------------------

ROWS = "vec_id long, label long, key long, v array<double>"


def _order(vec_id: int | None, key: int) -> tuple:
    """Smaller ids first, rows without an id last."""
    return vec_id is None, vec_id or 0, key


def clean(embeddings: DataFrame) -> DataFrame:
    """(vec_id, label, key, v): rows that take part, equal rows once; ``key`` names a row.

    Left out: a null label, a null vector, a null or non-finite component.  Where vec_id is
    divisible by 7 the label becomes (label + 1) % 10."""
    label, vector = F.col("label"), F.col("embedding").cast("array<double>")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    moved = F.when(F.col("vec_id") % 7 == 0, F.pmod(label.cast("long") + 1, F.lit(10))).otherwise(label.cast("long"))
    return (
        embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), moved.alias("label"), vector.alias("v"))
        .where(F.col("label").isNotNull() & F.col("v").isNotNull() & fine)
        .withColumn("key", F.xxhash64("vec_id", "label", "v"))
        .dropDuplicates(["vec_id", "label", "key", "v"])
        .select("vec_id", "label", "key", "v")
    )


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    """``floor(256 * x)``; a shorter vector ends in zeros."""
    vectors = vectors.combine_chunks() if isinstance(vectors, pa.ChunkedArray) else vectors
    flat, sizes = vectors.flatten().to_numpy(zero_copy_only=False), np.diff(vectors.offsets.to_numpy())
    if (sizes == width).all():
        found = flat.reshape(len(sizes), width)
    else:
        found = np.zeros((len(sizes), width))
        found[np.arange(width) < sizes[:, None]] = flat
    return np.floor(256 * found)


def _cells(rows: DataFrame, index: Index) -> DataFrame:
    """Rows with their codes and their distances from the codewords."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, names = [], []
            for half, part in enumerate(index.split(_matrix(batch.column(3), index.width))):
                code = _nearest(part, index.codes[half])
                columns += [pa.array(code), pa.array(np.sqrt(((part - index.codes[half][code]) ** 2).sum(axis=1)))]
                names += [f"code{half}", f"far{half}"]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return rows.mapInArrow(run, f"{ROWS}, code0 int, far0 double, code1 int, far1 double")


def build(rows: DataFrame) -> tuple[Index, DataFrame]:
    """(index, rows with ``shard``) of stored rows from ``clean``.

    The number of codewords follows the number of rows, and so do the shards; neither
    changes an answer."""
    found = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("width")).first()
    n, width = found["n"], found["width"] or 0
    share = int(min(1.0, SAMPLE / max(1, n)) * (1 << 32))
    drawn = rows.where(F.pmod(F.xxhash64(F.lit("sample"), "key"), F.lit(1 << 32)) < share).select("vec_id", "label", "key", "v")
    sample = drawn.toArrow()
    points = _matrix(sample.column("v"), width) if sample.num_rows else np.zeros((0, width))
    keys = [_order(i, k) for i, k in zip(sample.column("vec_id").to_pylist(), sample.column("key").to_pylist(), strict=True)]
    half, k = width // 2, max(1, min(CODES, round((n / CELL_ROWS) ** 0.5)))
    index = Index(
        width=width,
        half=half,
        codes=(codebook(points[:, :half], k), codebook(points[:, half:], k)),
        radii=(np.zeros(0), np.zeros(0)),
        first=np.zeros((0, 0), int),
        shards=np.zeros((0, 0), int),
        sample=points,
        sample_keys=keys,
        sample_labels=sample.column("label").to_numpy(),
        sample_places={k: at for at, k in enumerate(keys)},
    )
    celled = materialise(_cells(rows, index), "cells")
    counted = celled.groupBy("code0", "code1").agg(F.count(F.lit(1)).alias("n"), F.max("far0").alias("far0"), F.max("far1").alias("far1")).collect()
    sizes = [len(c) for c in index.codes]
    radii, first, shards = [np.zeros(s) for s in sizes], np.full(sizes, -1), np.zeros(sizes, int)
    room, before = min(SHARD_MOST, max(SHARD_ROWS, n // SHARDS_AIMED)), 0
    for cell in sorted(counted, key=lambda r: (r["code0"], r["code1"])):
        at = cell["code0"], cell["code1"]
        for h, code in enumerate(at):
            radii[h][code] = max(radii[h][code], cell[f"far{h}"])
        # Cells are laid end to end and cut where a shard is full; a large one takes shards of its own.
        own = max(1, -(-cell["n"] // room))
        if own > 1:
            before = -(-before // room) * room
        first[at], shards[at] = before // room, own
        before += cell["n"] if own == 1 else own * room
    index.radii, index.first, index.shards = tuple(radii), first, shards
    taken = [(*map(int, at), int(first[at]), int(shards[at])) for at in zip(*np.nonzero(shards), strict=True)]
    # At most CODES * CODES cells.
    deals = F.broadcast(rows.sparkSession.createDataFrame(taken, "code0 int, code1 int, first long, shards long"))
    shard = F.col("first") + F.pmod(F.xxhash64(F.lit("shard"), "key"), F.col("shards"))
    placed = celled.join(deals, ["code0", "code1"]).withColumn("shard", shard)
    return index, placed.select("shard", "vec_id", "label", "key", "v", "code0", "code1")


# --- searches -------------------------------------------------------------------------------


def _wants(windows: list[int] | None) -> list[Want]:
    """What an anchor looks for: its positives, or the negatives of its windows."""
    if windows is None:
        return [Want(POSITIVES, -_MOST - 1, _MOST)]
    return [Want(NEGATIVES, *window(score)) for score in windows]


def _allowed(labels: np.ndarray, label: int, windows: list[int] | None) -> np.ndarray:
    return labels == label if windows is None else labels != label


ANCHORS = f"{ROWS}, windows array<long>"


def _route(anchors: DataFrame, index: Index) -> DataFrame:
    """A row per anchor and shard that can hold something it wants."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = _matrix(batch.column(3), index.width)
            which, shards = [], []
            ids, labels, keys, windows = (batch.column(c).to_pylist() for c in (0, 1, 2, 4))
            for at, anchor in enumerate(vectors):
                wants = _wants(windows[at])
                scores, me = inner(index.sample, anchor), _order(ids[at], keys[at])
                allowed = _allowed(index.sample_labels, labels[at], windows[at])
                if (place := index.sample_places.get(me)) is not None:
                    allowed[place] = False
                for want in wants:
                    want.offer(scores, index.sample_keys, allowed)
                floor = min((w.floor for w in wants if w.low <= w.high), default=None)
                if floor is None:
                    continue
                seen: set[int] = set()
                for bound, i, j in walk(*index.bounds(anchor)):
                    if bound < floor:
                        break
                    seen.update(range(index.first[i, j], index.first[i, j] + index.shards[i, j]))
                which += [at] * len(seen)
                shards += sorted(seen)
            found = batch.take(pa.array(which, pa.int64()))
            yield pa.RecordBatch.from_arrays([*found.columns, pa.array(shards, pa.int64())], [*batch.schema.names, "shard"])

    return anchors.mapInArrow(run, f"{ANCHORS}, shard long")


class _Shard:
    """The rows of one shard, by cell."""

    def __init__(self, index: Index, number: int):
        self.index, self.number, self.parts = index, number, []

    def add(self, batch: pa.Table) -> None:
        self.parts.append(batch.select(["vec_id", "label", "key", "v", "code0", "code1"]))

    def close(self) -> None:
        rows = pa.concat_tables(self.parts).combine_chunks() if self.parts else None
        self.parts = []
        if rows is None:
            self.cells, self.codes, self.places = {}, ([], []), {}
            return
        code = rows["code0"].to_numpy().astype(np.int64) * len(self.index.codes[1]) + rows["code1"].to_numpy()
        order = np.argsort(code, kind="stable")
        rows, code = rows.take(pa.array(order)), code[order]
        cuts = [0, *(np.flatnonzero(np.diff(code)) + 1).tolist(), len(code)]
        self.cells = {divmod(int(code[a]), len(self.index.codes[1])): (a, b) for a, b in zip(cuts, cuts[1:])}
        self.codes = [sorted({c[h] for c in self.cells}) for h in (0, 1)]
        self.rows, self.labels = _matrix(rows["v"], self.index.width), rows["label"].to_numpy()
        self.keys = [_order(i, k) for i, k in zip(rows["vec_id"].to_pylist(), rows["key"].to_pylist(), strict=True)]
        self.places = {k: at for at, k in enumerate(self.keys)}

    def search(self, anchor: np.ndarray, me: tuple, label: int, windows: list[int] | None) -> list[Want]:
        """Visit cells in falling order of their bounds until every window is certified."""
        wants, codes, own = _wants(windows), self.codes, self.places.get(me, -1)
        left, right = self.index.bounds(anchor)
        for bound, i, j in walk(left[codes[0]], right[codes[1]]):
            open_wants = [w for w in wants if w.low <= w.high and bound >= w.floor]
            if not open_wants:
                break
            if (place := self.cells.get((codes[0][i], codes[1][j]))) is None:
                continue
            a, b = place
            scores, keys = inner(self.rows[a:b], anchor), self.keys[a:b]
            allowed = _allowed(self.labels[a:b], label, windows)
            if a <= own < b:
                allowed[own - a] = False
            for want in open_wants:
                want.offer(scores, keys, allowed)
        return wants


FOUND = "anchor_id long, anchor_key long, window long, score long, found_id long, found_key long"


def _search(anchors: DataFrame, rows: DataFrame, index: Index) -> DataFrame:
    """(anchor, window, found row, score): what each shard has to offer; ``window`` is null for positives."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: _Shard | None = None
        ready = False
        for batch in batches:
            data = pa.Table.from_batches([batch])
            numbers, kinds = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            changes = np.flatnonzero((np.diff(numbers) != 0) | (np.diff(kinds) != 0)) + 1
            cuts = [0, *changes.tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                if shard is None or shard.number != numbers[a]:
                    shard, ready = _Shard(index, int(numbers[a])), False
                part = data.slice(a, b - a)
                if kinds[a] == 0:
                    shard.add(part)
                    continue
                if not ready:
                    shard.close()
                    ready = True
                yield _offers(shard, part)

    null = F.lit(None)
    body = rows.select("shard", F.lit(0).alias("kind"), "vec_id", "label", "key", "v", "code0", "code1", null.cast("array<long>").alias("windows"))
    heads = anchors.select("shard", F.lit(1).alias("kind"), "vec_id", "label", "key", "v", null.cast("int").alias("code0"), null.cast("int").alias("code1"), "windows")
    met = body.union(heads).repartition("shard").sortWithinPartitions("shard", "kind")
    return met.mapInArrow(run, FOUND)


def _offers(shard: _Shard, anchors: pa.Table) -> pa.RecordBatch:
    vectors = _matrix(anchors["v"], shard.index.width)
    out: list[tuple] = []
    columns = (anchors[c].to_pylist() for c in ("vec_id", "label", "key", "windows"))
    for vector, vec_id, label, key, windows in zip(vectors, *columns, strict=True):
        wants = shard.search(vector, _order(vec_id, key), label, windows)
        for score, want in zip(windows or [None], wants, strict=True):
            out += [(vec_id, key, score, -less, None if none else i, k) for less, none, i, k in want.rows]
    lists = zip(*out, strict=True) if out else [[]] * 6
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in lists], [f.split()[0] for f in FOUND.split(", ")])


def _first(offers: DataFrame, count: int) -> DataFrame:
    """The best ``count`` of what the shards offered, with ``rank``."""
    order = W.partitionBy("anchor_id", "anchor_key", "window").orderBy(F.desc("score"), F.asc_nulls_last("found_id"), F.asc("found_key"))
    return offers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)


def hard_negatives(embeddings: DataFrame, every: int = 50) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are the rows whose vec_id is divisible by ``every``; a row's score is its
    integer inner product with the anchor.  Per anchor the first POSITIVES other rows of its
    label, per positive the first NEGATIVES rows of other labels with a score from LOWER to
    UPPER percent of the positive's.  Ties go to the smaller vec_id; rows without an id come
    last and are no anchors.  Equal rows count once; different rows of one id all count.
    Shorter vectors end in zeros.  Scores beyond 64 bits are the largest number.  An anchor
    without positives, or a positive without such rows, has no row; an empty table has none."""
    rows = materialise(clean(embeddings), "vectors")
    index, placed = build(rows)
    anchors = rows.where(F.col("vec_id") % every == 0)
    first = _route(anchors.withColumn("windows", F.lit(None).cast("array<long>")), index)
    positives = materialise(_first(_search(first, placed, index), POSITIVES), "positives")
    windows = positives.groupBy(F.col("anchor_id").alias("vec_id"), F.col("anchor_key").alias("key")).agg(F.array_sort(F.collect_set("score")).alias("windows"))
    second = _route(anchors.join(windows, ["vec_id", "key"]).select("vec_id", "label", "key", "v", "windows"), index)
    found = _first(_search(second, placed, index), NEGATIVES)
    pairs = positives.select("anchor_id", "anchor_key", F.col("found_id").alias("positive_id"), F.col("score").alias("window"))
    return pairs.join(found, ["anchor_id", "anchor_key", "window"]).select(
        "anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), F.col("window").alias("positive_score"), F.col("score").alias("negative_score")
    )
