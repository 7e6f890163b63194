"""Document fingerprints by locally consistent parsing.

A text is a sequence of names, first its code points.  On each level runs of one name
become one name, and deterministic coin tossing labels every name by the lowest bit in
which it differs from its left neighbour; the same is done with the labels until there
are few.  Phrases begin at local maxima of the labels, so a cut depends on a handful of
neighbours only, and equal substrings are parsed alike in their inside wherever they
stand.  A phrase's name is a hash of its names, and the next level parses phrases.

A fingerprint is the ``KEPT`` smallest hashes of the phrases of levels ``LEVELS``; the
likeness of two is the part of the smallest hashes of both that both have, an estimate
of how many phrases the texts share.

Documents are arranged by id in ranges, in which each meets the next one: the ranges are
dealt with all their texts once, and the first document of a range goes to the range
before it too.  Whatever the number of ranges, the result is the same.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (2, 3)
KEPT = 32
#: Rounds after which labels of 64-bit names are below 6: 128, 14, 8, 6.
_ROUNDS = 4
_GROUP_CHARS = 1 << 20
_RANGES = 1000
# Odd multipliers for mixing, and the name that stands in front of every text.
_A, _B, _FRONT = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xA5A5A5A5A5A5A5A5))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _A
    x = (x ^ (x >> np.uint64(29))) * _B
    return x ^ (x >> np.uint64(32))


def _collapse(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of a name within a text become one name."""
    first = np.ones(len(names), bool)
    first[1:] = (names[1:] != names[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    if len(at) == len(names):
        return names, owner
    runs = np.diff(np.append(at, len(names)))
    names, owner = names[at], owner[at]
    long = runs > 1
    names[long] = _mix(names[long] + _A * runs[long].astype(np.uint64))
    return names, owner


def parse(names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names and the texts that they belong to, one level up."""
    names, owner = _collapse(names, owner)
    n = len(names)
    start = np.ones(n, bool)
    start[1:] = owner[1:] != owner[:-1]
    labels = names
    for turn in range(_ROUNDS):
        left = np.empty_like(labels)
        left[1:] = labels[:-1]
        # In front of a text stands a name of its own, later a label that none has.
        left[start] = _FRONT if turn == 0 else np.uint8(255)
        differ = labels ^ left
        low = np.bitwise_count((differ & (~differ + differ.dtype.type(1))) - differ.dtype.type(1))
        # Equal neighbours differ nowhere: only where a name is the front's; they get the largest label.
        bit = (labels >> np.minimum(low, labels.dtype.itemsize * 8 - 1).astype(labels.dtype)) & labels.dtype.type(1)
        labels = (2 * low + bit.astype(np.uint8)).astype(np.uint8)
    begin = start.copy()
    if n > 2:
        # A text's last name begins no phrase: what follows belongs to another text.
        peak = (labels[1:-1] > labels[:-2]) & (labels[1:-1] >= labels[2:]) & ~start[2:]
        begin[1:-1] |= peak
    at = np.flatnonzero(begin)
    lengths = np.diff(np.append(at, n))
    place = np.arange(n) - np.repeat(at, lengths)
    powers = np.empty(int(lengths.max()), np.uint64)
    powers[0] = 1
    for i in range(1, len(powers)):
        powers[i] = powers[i - 1] * _B
    joined = np.add.reduceat(_mix(names + _A) * powers[place], at)
    return _mix(joined + lengths.astype(np.uint64)), owner[at]


def sketches(texts: list[str]) -> list[np.ndarray]:
    """The sorted smallest hashes of each text, at most ``KEPT``; none for an empty text."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    kept: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(texts)
    if not sizes.any():
        return kept
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    names, owner = _mix(points.astype(np.uint64) + np.uint64(1)), np.repeat(np.arange(len(texts)), sizes)
    found = []
    with np.errstate(over="ignore"):
        for level in range(1, max(LEVELS) + 1):
            names, owner = parse(names, owner)
            if level in LEVELS:
                found.append((owner, (_mix(names + np.uint64(level)) >> np.uint64(32)).astype(np.uint64)))
    keys = np.unique(np.concatenate([(o.astype(np.uint64) << np.uint64(32)) | h for o, h in found]))
    owners = (keys >> np.uint64(32)).astype(np.int64)
    edges = np.searchsorted(owners, np.arange(len(texts) + 1))
    hashes = keys.astype(np.uint32)
    return [hashes[a : min(b, a + KEPT)] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """0 to 1; 1 for two fingerprints of nothing."""
    both = np.union1d(a, b)[:KEPT]
    if not len(both):
        return 1.0
    return float(np.isin(both, np.intersect1d(a, b)).sum() / len(both))


def written(sketch: np.ndarray) -> str:
    return sketch.astype(">u4").tobytes().hex()


def _range_of(edges: list[int]) -> Column:
    """How many edges are below doc_id, by halving."""
    if not edges:
        return F.lit(0)

    def search(low: int, high: int) -> str:
        if low == high:
            return str(low)
        mid = (low + high) // 2
        return f"CASE WHEN doc_id <= {edges[mid]}L THEN {search(low, mid)} ELSE {search(mid + 1, high)} END"

    return F.expr(search(0, len(edges)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in ranges of falling id: columns range, extra, doc_id, text, sorted.

    The rows with ``extra`` close a range: they are the first ones of the next."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    ids = rows.select("doc_id").where("doc_id is not null")
    parts = min(_RANGES, 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    shares = [F.lit(i / parts) for i in range(1, parts)]
    edges = ids.agg(F.percentile_approx("doc_id", F.array(*shares))).first()[0] if shares else None
    place = _range_of(sorted(set(edges or [])))
    # At most _RANGES rows.
    tops = {r[0]: r[1] for r in ids.groupBy(place.alias("range")).agg(F.max("doc_id")).collect()}
    order = sorted(tops, reverse=True)
    guests = {tops[r]: before for r, before in zip(order, [order[-1:], *([x] for x in order)], strict=False) for before in before}
    own = F.struct(place.alias("range"), F.lit(False).alias("extra"))
    copies = F.array(own)
    if guests:
        pairs = [x for k, v in sorted(guests.items()) for x in (F.lit(k), F.lit(v))]
        guest = F.struct(F.element_at(F.create_map(*pairs), F.col("doc_id")).alias("range"), F.lit(True).alias("extra"))
        copies = F.when(F.col("doc_id").isin(sorted(guests)), F.array(own, guest)).otherwise(copies)
    # Rows without an id are dealt by text; they have no neighbour.
    alone = F.array(F.struct((-1 - F.pmod(F.xxhash64("text"), F.lit(parts))).cast("int").alias("range"), F.lit(False).alias("extra")))
    dealt = rows.withColumn("c", F.explode(F.when(F.col("doc_id").isNull(), alone).otherwise(copies)))
    return (
        dealt.select("c.range", "c.extra", "doc_id", "text")
        .repartition("range")
        .sortWithinPartitions("range", "extra", F.desc("doc_id"), F.xxhash64("text"))
    )


SCHEMA = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double"
)


def _edit(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def _compare(rows: list[tuple[int | None, str]], following: str | None) -> pa.RecordBatch:
    """Result rows of neighbours; ``following`` comes behind the last, else each is its own."""
    texts = [t for _, t in rows]
    after = [*texts[1:], following] if following is not None else texts
    edited = [_edit(t, a) for t, a in zip(texts, after, strict=True)]
    made = sketches([*texts, *edited, *([following] if following is not None else [])])
    own, changed = made[: len(texts)], made[len(texts) : 2 * len(texts)]
    beyond = [*own[1:], made[-1]] if following is not None else own
    columns = [
        pa.array([i for i, _ in rows], pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]),
        pa.array([written(s) for s in own]),
        pa.array([written(s) for s in changed]),
        pa.array([likeness(a, b) for a, b in zip(own, changed, strict=True)], pa.float64()),
        pa.array([likeness(a, b) for a, b in zip(own, beyond, strict=True)], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])


def compare_with_next(docs: DataFrame) -> DataFrame:
    """One row per document (``SCHEMA``): its fingerprint, that of its edited text, and how
    alike they and the next document's are.

    Next is the document with the next smaller id, behind the smallest the largest; rows
    of one id follow each other.  A row without an id is its own next.  A null text is
    empty; an empty text has an empty fingerprint.  An empty table gives no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []
        place, size, closed = None, 0, False
        for batch in batches:
            columns = (batch.column(i).to_pylist() for i in range(4))
            for own, extra, doc_id, text in zip(*columns, strict=True):
                if own != place:
                    place, closed = own, False
                if extra:
                    if not closed and held:
                        yield _compare(held, text)
                    held, size, closed = [], 0, True
                    continue
                if place < 0:
                    yield _compare([(doc_id, text)], None)
                    continue
                if size > _GROUP_CHARS:
                    yield _compare(held, text)
                    held, size = [], 0
                held.append((doc_id, text))
                size += len(text)

    return with_next(docs).mapInArrow(run, SCHEMA)
