"""SimHash near-duplicates: fingerprints, BK-tree search, groups of linked documents.

A fingerprint is the bitwise majority of the hashes of all word shingles.  Two
documents are linked if their fingerprints differ in at most ``radius`` bits.

Search.  The 64 bits are cut into ``radius + a`` blocks; two fingerprints within
the radius agree on at least ``a`` of them, so every choice of ``a`` blocks is a
shard key and every link lies inside a shard.  A shard's fingerprints form a
BK-tree, whose children are keyed by their distance to the parent; a search
follows only edges within the radius of the distance found.  Subtrees that are
already connected with the searched fingerprint are skipped, as only
connectivity is asked for, so a dense group costs little more than one pass.
``a`` grows with the number of different fingerprints (shards hold about 64
each), which changes the cost and never the links.

Skew.  Copies collapse into one fingerprint before the search.  Shards above
``SHARD`` fingerprints are counted beforehand and dealt into cells: each cell is
a pair of parts, so that every two fingerprints still meet in one cell and no
task holds more than about twice ``SHARD``.  Trees travel with their shard, not
by broadcast: their number grows with the corpus.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.llm.common import sorted_groups
from switchyard.llm.components import components
from switchyard.session import materialise

SHARD = 4096
SEED = 42
_SLICE = 1 << 16
#: For documents that share ``SIMILAR`` or more of their shingles: bits that may differ, bytes
#: of a sketch, pairs of smallest hashes that name shards, and the estimate from which on two
#: documents are compared exactly (an estimate from ``BINS`` values is off by 0.035 in two of
#: three cases: 3 in 100,000 pairs at 0.8 lie below).
SIMILAR = 0.8
WIDE_RADIUS = 24
BINS = 128
TABLES = 10
ESTIMATE = 0.65
#: Hashes in a part of a group whose members are compared exactly.
HASHES = 1 << 20


def shingle_hashes(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, repeats included, in slices; none without words."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    width = min(shingle, len(words))
    first, last = (ends - lengths)[: len(words) - width + 1], ends[width - 1 :]
    hashed = xxhash.xxh64_intdigest
    for at in range(0, len(first), _SLICE):
        spans = zip(first[at : at + _SLICE].tolist(), last[at : at + _SLICE].tolist(), strict=True)
        yield np.fromiter((hashed(joined[a:b], SEED) for a, b in spans), np.uint64)


def majority(slices: list[np.ndarray]) -> int:
    """The fingerprint of hashes as an unsigned integer, 0 without any."""
    counts, n = np.zeros(64, np.int64), 0
    for h in slices:
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: str | None, shingle: int) -> int:
    return majority(list(shingle_hashes(text, shingle)))


def fingerprints(docs: DataFrame, shingle: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fingerprint long) per row; a text without words, or null, has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], ["doc_id", "fingerprint"])

    kind = docs.schema[doc_id].dataType.simpleString()
    return docs.select(doc_id, text).mapInArrow(run, f"doc_id {kind}, fingerprint long")


class _Tree:
    """A BK-tree over one shard with the connected parts found so far."""

    def __init__(self, radius: int, accept: Callable[[int, int], bool] | None = None):
        self.radius = radius
        self.accept = accept
        self.value: list[int] = []
        self.children: list[dict[int, int]] = []
        self.parent: list[int] = []  # towards the root of a connected part
        self.whole: list[int] = []  # a member if the subtree below is connected, else -1
        self.due = 64

    def part(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    def _survey(self) -> None:
        """Note which subtrees are connected; children have larger numbers than parents."""
        for i in range(len(self.value) - 1, -1, -1):
            own = self.part(i)
            same = all(self.whole[c] >= 0 and self.part(self.whole[c]) == own for c in self.children[i].values())
            self.whole[i] = i if same else -1

    def add(self, x: int) -> list[int]:
        """Insert ``x``; numbers of earlier members that connect it with all it is linked to."""
        new, found, radius, accept = len(self.value), [], self.radius, self.accept
        value, children = self.value, self.children
        self.parent.append(new)
        todo = [0] if value else []
        while todo:
            i = todo.pop()
            if self.whole[i] >= 0 and self.part(self.whole[i]) == self.part(new):
                continue
            d = (x ^ value[i]).bit_count()
            if d <= radius and self.part(i) != self.part(new) and (accept is None or accept(new, i)):
                self.parent[self.part(i)] = self.part(new)
                found.append(i)
            todo += [c for k, c in children[i].items() if d - radius <= k <= d + radius]
        at = 0 if value else -1
        value.append(x)
        children.append({})
        self.whole.append(-1)
        while at >= 0:
            if self.whole[at] >= 0 and self.part(self.whole[at]) != self.part(new):
                self.whole[at] = -1
            d = (x ^ value[at]).bit_count()
            if d not in children[at]:
                children[at][d] = new
            at = -1 if children[at][d] == new else children[at][d]
        if new + 1 >= self.due:
            self.due *= 2
            self._survey()
        return found


def _masks(blocks: int, agree: int) -> list[int]:
    """Signed 64-bit masks, one for each choice of ``agree`` of ``blocks`` blocks."""
    edge = [64 * i // blocks for i in range(blocks + 1)]
    block = [((1 << edge[i + 1]) - 1) ^ ((1 << edge[i]) - 1) for i in range(blocks)]
    masks = [sum(block[i] for i in chosen) for chosen in combinations(range(blocks), agree)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def fingerprint_links(prints: DataFrame, radius: int = 4) -> DataFrame:
    """(fingerprint, rep) rows, fingerprints different -> links (u, v) of their reps that
    connect all fingerprints within ``radius`` bits of each other."""
    total, agree = prints.count(), 1
    while total / 2 ** (64 * agree // (radius + agree)) > 64 and agree < 12:
        agree += 1
    keys = [
        F.struct(F.lit(i).alias("band"), F.col("fingerprint").bitwiseAND(F.lit(m)).alias("key"))
        for i, m in enumerate(_masks(radius + agree, agree))
    ]
    entries = prints.select(F.explode(F.array(*keys)).alias("k"), "fingerprint", "rep").select("k.*", "fingerprint", "rep")
    return shard_links(entries, radius)


def shard_links(entries: DataFrame, radius: int, similarity: float | None = None) -> DataFrame:
    """(band, key, fingerprint, rep) rows, with ``sketch`` if there is a ``similarity`` -> links (u, v)
    that connect what the trees of all shards (band, key) connect."""
    hot = (
        entries.groupBy("band", "key")
        .count()
        .where(F.col("count") > SHARD)
        .select("band", "key", F.ceil(F.col("count") / SHARD).cast("int").alias("parts"))
    )
    part = F.pmod(F.xxhash64("fingerprint", "rep"), F.col("parts")).cast("int")
    cells = F.when(
        F.col("parts").isNotNull(),
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda x: F.struct(F.least(x, part).alias("a"), F.greatest(x, part).alias("b")),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))))
    carried = ["fingerprint", "rep"] + ["sketch"] * (similarity is not None)
    shards = (
        entries.join(hot, ["band", "key"], "left")
        .withColumn("cell", F.explode(cells))
        .select("band", "key", "cell.a", "cell.b", *carried)
        .repartition("band", "key", "a", "b")
        .sortWithinPartitions("band", "key", "a", "b", "fingerprint")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = (1 << 64) - 1
        out: list[tuple[int, int]] = []
        for group in sorted_groups(batches, ["band", "key", "a", "b"]):
            if group.num_rows > 1:
                accept = None
                if similarity is not None:
                    accept = _agreement(group["sketch"].to_pylist(), similarity)
                reps, tree = group["rep"].to_pylist(), _Tree(radius, accept)
                for i, x in enumerate(group["fingerprint"].to_pylist()):
                    out += [(reps[i], reps[j]) for j in tree.add(x & mask)]
            if len(out) >= 50_000:
                yield _links(out)
                out = []
        yield _links(out)

    return shards.mapInArrow(run, "u long, v long")


def exact_links(docs: DataFrame, members: DataFrame, shingle: int) -> DataFrame:
    """(rep, sketch, digest, component) rows of ``docs`` -> links (u, v) that connect, in each
    component, all members that share ``SIMILAR`` or more of their different shingles.

    The shingles are hashed again, of members only, and each set travels once; a component
    of more than ``SHARD`` members or ``HASHES`` hashes is dealt into cells as a shard is."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t.as_py(), shingle).tobytes() for t in batch["text"]]
            # An id can have several texts.
            own = pa.array([_digest(h) == d for h, d in zip(sets, batch["digest"].to_pylist(), strict=True)], pa.bool_())
            columns = [*batch.columns[:4], pa.array(sets, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["component", "rep", "digest", "sketch", "hashes"]).filter(own)

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(members, F.col("doc_id") == F.col("rep"))
    sets = texts.select("component", "rep", "digest", "sketch", "text").mapInArrow(
        hashed, "component long, rep long, digest long, sketch binary, hashes binary"
    )
    sets = materialise(sets.dropDuplicates(["component", "rep", "digest"]), "sets")
    parts = F.greatest(F.ceil(F.count("*") / SHARD), F.ceil(F.sum(F.length("hashes")) / (8 * HASHES))).cast("int")
    hot = sets.groupBy("component").agg(parts.alias("parts")).where("parts > 1")
    part = F.pmod(F.xxhash64("rep", "digest"), F.col("parts")).cast("int")
    cells = F.when(
        F.col("parts").isNotNull(),
        F.transform(
            F.sequence(F.lit(0), F.col("parts") - 1),
            lambda x: F.struct(F.least(x, part).alias("a"), F.greatest(x, part).alias("b")),
        ),
    ).otherwise(F.array(F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"))))
    dealt = (
        sets.join(hot, "component", "left")
        .withColumn("cell", F.explode(cells))
        .select("component", "cell.a", "cell.b", "rep", "sketch", "hashes")
        .repartition("component", "a", "b")
        .sortWithinPartitions("component", "a", "b")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple[int, int]] = []
        for group in sorted_groups(batches, ["component", "a", "b"]):
            reps = group["rep"].to_pylist()
            pairs = similar_pairs(group["sketch"].to_pylist(), group["hashes"].to_pylist())
            out += [(reps[i], reps[j]) for i, j in pairs]
            if len(out) >= 50_000:
                yield _links(out)
                out = []
        yield _links(out)

    return dealt.mapInArrow(run, "u long, v long")


def similar_pairs(sketches: list[bytes], sets: list[bytes]) -> list[tuple[int, int]]:
    """Pairs that connect all members whose hashes have a Jaccard similarity of ``SIMILAR`` or
    more; members that are connected already, or whose sketches are far apart, are not compared."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), BINS)
    hashes = [np.frombuffer(h, np.uint64) for h in sets]
    part, found = np.arange(len(sketches)), []
    for i in range(1, len(rows)):
        used = np.count_nonzero(rows[:i] | rows[i], axis=1)
        agreed = np.count_nonzero((rows[:i] == rows[i]) & (rows[i] > 0), axis=1)
        near = np.flatnonzero(agreed >= ESTIMATE * used)
        # The most alike first: in a dense group the first comparison connects.
        for j in near[np.argsort(-agreed[near] / np.maximum(used[near], 1), kind="stable")].tolist():
            if part[i] != part[j] and _similar(hashes[i], hashes[j]):
                part[part == part[i]] = part[j]
                found.append((i, j))
    return found


def _similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets, sorted, have a Jaccard similarity of at least ``SIMILAR``."""
    if min(len(a), len(b)) < SIMILAR * max(len(a), len(b)):
        return False
    both = np.sort(np.concatenate([a, b]), kind="stable")
    shared = int(np.count_nonzero(both[1:] == both[:-1]))
    return shared / max(len(both) - shared, 1) >= SIMILAR


def _digest(hashes: bytes) -> int:
    """Signed 64-bit name of a set of hashes."""
    return xxhash.xxh64_intdigest(hashes, SEED) - (1 << 63)


def _agreement(sketches: list[bytes], similarity: float) -> Callable[[int, int], bool]:
    """Whether two members' sketches estimate a Jaccard similarity of at least ``similarity``."""
    rows = np.frombuffer(b"".join(sketches), np.uint8).reshape(len(sketches), BINS)

    def accept(i: int, j: int) -> bool:
        a, b = rows[i], rows[j]
        used = np.count_nonzero(a | b)
        return np.count_nonzero((a == b) & (a > 0)) >= similarity * used

    return accept


def _links(rows: list[tuple[int, int]]) -> pa.RecordBatch:
    u, v = zip(*rows, strict=True) if rows else ((), ())
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def near_groups(docs: DataFrame, shingle: int = 5, radius: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id, the
    smallest id reachable over links.

    Null texts and texts without words share fingerprint 0 and are linked like any
    other.  A row without an id takes no part: its component is null.  Repeated
    rows stay repeated.  ``doc_id`` must be a whole number."""
    own = materialise(
        fingerprints(docs.withColumn(doc_id, F.col(doc_id).cast("long")), shingle, doc_id, text), "fingerprints"
    )
    prints = materialise(
        own.where("doc_id is not null").groupBy("fingerprint").agg(F.min("doc_id").alias("rep")), "different"
    )
    found = components(fingerprint_links(prints, radius))
    named = prints.join(found, prints["rep"] == found["id"], "left").select(
        F.col("fingerprint").alias("print"), F.coalesce("component", "rep").alias("component_id")
    )
    joined = own.join(named, F.col("fingerprint") == F.col("print"), "left")
    return joined.select(
        "doc_id",
        F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"),
        F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"),
    )


def shingle_set(text: str | None, shingle: int) -> np.ndarray:
    """The different hashes of a text's shingles, sorted."""
    slices = list(shingle_hashes(text, shingle))
    return np.unique(np.concatenate(slices)) if slices else np.zeros(0, np.uint64)


def outline(text: str | None, shingle: int) -> tuple[int, bytes, int, list[int]]:
    """Fingerprint, sketch, digest of the different shingles, and shard keys of a text.

    The sketch has a byte for each of ``BINS`` ranges of hashes, made from the smallest
    hash there, 0 where there is none.  A key joins two smallest hashes under other
    orders; texts that share a part ``s`` of their shingles share it with chance s * s."""
    slices = list(shingle_hashes(text, shingle))
    if not slices:
        return 0, bytes(BINS), _digest(b""), []
    h = np.unique(np.concatenate(slices))
    bins = (h >> np.uint64(57)).astype(np.int64)
    at = np.flatnonzero(np.append(True, bins[1:] != bins[:-1]))
    sketch = np.zeros(BINS, np.uint8)
    sketch[bins[at]] = (h[at] >> np.uint64(20)).astype(np.uint64) % np.uint64(255) + np.uint64(1)
    least = []
    for turn in range(2 * TABLES):
        mixed = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15 + 2 * 0x1000193 * turn)
        least.append(int((mixed ^ (mixed >> np.uint64(29))).min()))
    keys = [(a * 0x100000001B3 ^ b) & ((1 << 63) - 1) for a, b in zip(least[::2], least[1::2], strict=True)]
    # Of different shingles, as the similarity is: a line that repeats must not outvote the rest.
    return majority([h[at : at + _SLICE] for at in range(0, len(h), _SLICE)]), sketch.tobytes(), _digest(h.tobytes()), keys


def outlines(docs: DataFrame, shingle: int) -> DataFrame:
    """(doc_id, fingerprint, sketch, digest, keys) of rows with an id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [outline(t.as_py(), shingle) for t in batch.column(1)]
            prints = np.array([r[0] for r in rows], np.uint64).view(np.int64)
            sketches, digests = pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.int64())
            columns = [pa.array(prints), sketches, digests, pa.array([r[3] for r in rows], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "fingerprint", "sketch", "digest", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null")
    return rows.mapInArrow(run, "doc_id long, fingerprint long, sketch binary, digest long, keys array<long>")


def similar_groups(docs: DataFrame, shingle: int = 5) -> DataFrame:
    """(doc_id, component_id) of documents that share 0.8 or more of their shingles, over links.

    64-bit fingerprints of such texts, of different shingles, differ in about ten bits, in
    more than ``WIDE_RADIUS`` with a chance of about 3 in a million at 0.8; no choice of
    blocks of so few bits tells that from chance.  So the shards are named by
    smallest hashes of shingles, ``TABLES`` pairs of them (two texts with 0.8 in common
    miss all of them with a chance of 4 in 100,000), a tree in each shard finds fingerprints
    within the radius, and sketches that estimate ``ESTIMATE`` or more connect loosely.  Inside
    these loose groups the different shingles themselves decide.  Texts without words are one
    group, as are those with the same shingles."""
    own = materialise(outlines(docs, shingle), "outlines")
    names = ["fingerprint", "sketch", "digest"]
    same = own.groupBy(*names).agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"))
    same = materialise(same, "different")
    entries = same.select(F.posexplode("keys").alias("band", "key"), "fingerprint", "rep", "sketch")
    loose = components(shard_links(entries, WIDE_RADIUS, ESTIMATE))
    members = same.join(loose, same["rep"] == loose["id"]).select("rep", "sketch", "digest", "component")
    found = components(exact_links(docs, members, shingle))
    named = same.join(found, same["rep"] == found["id"], "left").select(
        *[F.col(c).alias(f"same_{c}") for c in names], F.coalesce("component", "rep").alias("component_id")
    )
    equal = [F.col(c) == F.col(f"same_{c}") for c in names]
    return own.join(named, equal).select("doc_id", "component_id")


def one_per_group(docs: DataFrame, shingle: int = 4, radius: int = 4) -> DataFrame:
    """Of each group of documents that ``near_groups`` links one row, all columns unchanged.

    The smallest id stays; an id with several texts has a row for each of them to be
    grouped, and of those in one group the text with the smallest SHA-256 stays.  Of rows
    equal in id and text one stays.  Rows without an id stay; none of them is compared."""
    text = F.sha2(F.coalesce("text", F.lit("")), 256)
    row = F.struct(F.col("doc_id").cast("long").alias("id"), text.alias("text"))
    known = docs.where("doc_id is not null")
    own = materialise(fingerprints(known.select(row.alias("doc_id"), "text"), shingle), "fingerprints")
    prints = materialise(own.select("fingerprint", F.col("fingerprint").alias("rep")).distinct(), "different")
    found = components(fingerprint_links(prints, radius))
    group = F.coalesce("component", "fingerprint")
    first = own.join(found, own["fingerprint"] == found["id"], "left").groupBy(group.alias("_group")).agg(F.min("doc_id").alias("_row"))
    kept = first.select(F.col("_row.id").alias("_kept_id"), F.col("_row.text").alias("_kept_text"))
    same = (F.col("doc_id").cast("long") == F.col("_kept_id")) & (text == F.col("_kept_text"))
    chosen = known.join(kept, same, "left_semi").withColumn("_kept_text", text).dropDuplicates(["doc_id", "_kept_text"]).drop("_kept_text")
    return chosen.union(docs.where("doc_id is null"))
