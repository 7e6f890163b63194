"""Shards of nearly equal bytes by a k-d tree over document metadata.

Every document is a point of metadata dimensions scaled to 0 .. 1: position of its
id, language and source by checksum.  A node that must hold ``n`` shards is
split into ``n // 2`` and ``n - n // 2`` at the weighted quantile (weights are
bytes) of its widest dimension, until a node is one shard: its share is then the
target size.  Built-in functions only.

Quantiles are found by histograms.  A row's key in a dimension is its scaled value
followed by a hash of id and text, so that equal values can be split.  All nodes of
a level are searched together: a pass sums the bytes of ``1 << STEP`` bins per node,
picks the bin with the quantile, and the next pass looks inside that bin, until the
bins are light against the target or the key has no more bits.  The tree has fewer
splits than shards; it is all that the driver holds and goes into expressions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from switchyard.session import materialise

OVERHEAD = 16
#: Bits of a scaled value and of the hash behind it, and bits looked at in a pass.
VALUE_BITS, HASH_BITS, STEP = 20, 22, 14
#: A split may miss its share by this part of the target.
TOLERANCE = 0.002
#: Rows numbered together when slots are given.
SLOT_ROWS = 100_000
DIMENSIONS = ["position", "language", "source"]


def metadata(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, checksums of the metadata and ``tie``.

    A null text has no bytes, null language and source count as the empty string, and
    a null id as the smallest.  Ids are scaled by the table's range."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text).cast("long") + OVERHEAD).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *[F.crc32(F.coalesce(c, F.lit("")).cast("binary")).alias(f"{c}_crc") for c in ("lang", "source")],
    )
    return rows.withColumn("tie", F.shiftrightunsigned(F.xxhash64("doc_id", "text_crc32"), 64 - HASH_BITS))


def _scaled(rows: DataFrame) -> DataFrame:
    low, high = (float(v or 0) for v in rows.agg(F.min("doc_id"), F.max("doc_id")).first())
    top = (1 << VALUE_BITS) - 1
    place = (F.coalesce(F.col("doc_id").cast("double"), F.lit(low)) - low) / max(high - low, 1.0) * top
    return rows.select(
        "doc_id",
        "size",
        "text_crc32",
        "tie",
        F.floor(place).cast("long").alias("d0"),
        F.shiftrightunsigned("lang_crc", 32 - VALUE_BITS).alias("d1"),
        F.shiftrightunsigned("source_crc", 32 - VALUE_BITS).alias("d2"),
    )


@dataclass
class Node:
    """``shards`` shards from number ``first`` on; split below ``key < cut`` of ``dimension``."""

    first: int
    shards: int
    dimension: int = 0
    cut: int = 0
    below: list["Node"] = field(default_factory=list)


def _key(dimension: int) -> Column:
    return F.shiftleft(F.col(f"d{dimension}"), HASH_BITS) + F.col("tie")


def shard_of(node: Node) -> Column:
    """The shard of a scaled row as nested conditions, a few comparisons deep."""
    if not node.below:
        return F.lit(node.first)
    left, right = node.below
    return F.when(_key(node.dimension) < node.cut, shard_of(left)).otherwise(shard_of(right))


def _map(values: dict[int, object]) -> Column:
    """The value of a row's ``node``; null for other nodes."""
    return F.element_at(F.create_map(*[F.lit(x) for pair in sorted(values.items()) for x in pair]), F.col("node"))


def _split(rows: DataFrame, level: list[Node], target: float) -> None:
    """Split all nodes of a level; ``rows`` have their node's first shard as ``node``."""
    ids = [n.first for n in level]
    spans = [F.max(f"d{i}") - F.min(f"d{i}") for i in range(len(DIMENSIONS))]
    wide = {r[0]: r[1:] for r in rows.groupBy("node").agg(F.sum("size"), *spans).collect()}
    weight = {}
    for n in level:
        weight[n.first], *width = wide.get(n.first, (0, *[0] * len(DIMENSIONS)))
        n.dimension = max(range(len(DIMENSIONS)), key=lambda i: (width[i], -i))
    goal = {n.first: weight[n.first] * (n.shards // 2) / n.shards for n in level}
    low = {n.first: 0 for n in level}  # where the bin with the quantile begins
    done = {n.first: 0 for n in level}  # bytes below it
    values = F.array(*[F.col(f"d{i}") for i in range(len(DIMENSIONS))])
    bits, todo = VALUE_BITS + HASH_BITS, set(ids)
    while todo and bits:
        step = min(STEP, bits)
        bits -= step
        value = F.get(values, _map({n.first: n.dimension for n in level if n.first in todo}))
        key = F.shiftleft(value, HASH_BITS) + F.col("tie") - _map({i: low[i] for i in todo})
        bins = rows.withColumn("bin", F.shiftright(key, bits)).select(
            "node", F.when((F.col("bin") >= 0) & (F.col("bin") < 1 << step), F.col("bin")).alias("bin"), "size"
        )
        # A node has at most 1 << STEP bins, and one for the rows that are not in the bin under search.
        sums = bins.groupBy("node", "bin").agg(F.sum("size").alias("bytes"))
        sums = sums.withColumn("bytes", F.when(F.col("bin").isNull(), 0).otherwise(F.col("bytes")))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy(F.col("bin").asc_nulls_first()))
        left = _map({i: float(goal[i] - done[i]) for i in todo})
        crossed = F.when((upto >= left) & F.col("bin").isNotNull(), F.struct("bin", "bytes", upto.alias("upto")))
        first = sums.withColumn("b", crossed).groupBy("node").agg(F.min("b").alias("b"))
        found = {r["node"]: r["b"] for r in first.collect() if r["b"] is not None}
        for i in sorted(todo):
            if i not in found:  # an empty node
                todo.discard(i)
                continue
            bin_, bytes_, until = found[i]
            low[i] += bin_ << bits
            done[i] += until - bytes_
            if bytes_ <= TOLERANCE * target or not bits:
                # Cut on the side of the bin that is nearer to the share.
                if goal[i] - done[i] > bytes_ / 2:
                    low[i] += 1 << bits
                todo.discard(i)
    for n in level:
        n.cut = low[n.first]
        half = n.shards // 2
        n.below = [Node(n.first, half), Node(n.first + half, n.shards - half)]


def build(points: DataFrame, shards: int) -> Node:
    """The tree over stored, scaled rows."""
    total = points.agg(F.sum("size")).first()[0] or 0
    root = Node(0, shards)
    level = [root] if shards > 1 else []
    while level:
        assigned = points.withColumn("node", shard_of(root))
        _split(assigned, level, total / shards)
        level = [m for n in level for m in n.below if m.shards > 1]
    return root


def assign(docs: DataFrame, shards: int) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    ``law`` is always ``bytes``: shard sizes differ little, whatever number of copies
    a text has.  Slots number the rows of a shard from 0 without gaps, in order of a
    hash bucket, then id.  Rows equal in id and text stay in one shard."""
    points = materialise(_scaled(materialise(metadata(docs), "metadata")), "points")
    tree = build(points, shards)
    buckets = max(1, points.count() // (shards * SLOT_ROWS) + 1)
    placed = points.select(
        "doc_id", "size", "text_crc32", shard_of(tree).alias("shard"), F.pmod(F.xxhash64("tie", "doc_id"), F.lit(buckets)).alias("bucket")
    )
    sizes = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = materialise(sizes.withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n"), "offsets")
    inside = Window.partitionBy("shard", "bucket").orderBy("doc_id", "text_crc32", "size")
    return (
        placed.withColumn("place", F.row_number().over(inside) - 1)
        .join(offsets, ["shard", "bucket"])
        .select(
            "doc_id",
            "size",
            "text_crc32",
            F.lit("bytes").alias("law"),
            "shard",
            (F.col("offset") + F.col("place")).cast("long").alias("slot"),
            F.lit(None).cast("int").alias("grown_shard"),
        )
    )
