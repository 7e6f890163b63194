"""Ranking helpers shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchyard.session import materialise

_ROW_BITS = 33  # monotonically_increasing_id keeps the row number in the low 33 bits


def dense_index(df: DataFrame, order: list[str], name: str = "idx") -> DataFrame:
    """Number the rows 0, 1, ... in the given order without one global task.

    Rows are range-partitioned and sorted per partition; the position inside a
    partition comes from the row counter, and the offset of a partition from a
    running sum over partition sizes (as many rows as partitions).  The sorted
    rows are stored once so that both steps see the same partitioning.
    """
    placed = (
        df.repartitionByRange(*[F.col(c) for c in order])
        .sortWithinPartitions(*order)
        .withColumn("_place", F.monotonically_increasing_id())
    )
    placed = materialise(placed, "dense-index")
    part = F.shiftright("_place", _ROW_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("_part", before.alias("_offset"))
    # One row per partition: its size is the partition count, not the data.
    return (
        placed.withColumn("_part", part)
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, (F.col("_offset") + F.col("_place").bitwiseAND(F.lit((1 << _ROW_BITS) - 1))).cast("int"))
        .drop("_part", "_place", "_offset")
    )


def top_values(df: DataFrame, key: str, value: str, pos: str, k: int) -> DataFrame:
    """The k most common values per key, ties by first occurrence.

    Occurrences are counted before the ranking, so a key's window holds its
    distinct values only.
    """
    counted = df.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"), F.min(pos).alias("first_pos"))
    order = W.partitionBy(key).orderBy(F.desc("n"), F.asc("first_pos"))
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def top_k_salted(df: DataFrame, group: str, order: list[Column], k: int, salt: Column, salts: int = 64) -> DataFrame:
    """The first k rows per group; a group may hold a large part of all rows.

    The group is cut into salted parts, each keeps its own first k, and only
    those survivors meet in the group's final ranking - the result is exact.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(salts)))
    first = F.row_number().over(W.partitionBy(group, "_salt").orderBy(*order))
    survivors = salted.withColumn("_rn", first).where(F.col("_rn") <= k).drop("_salt", "_rn")
    final = F.row_number().over(W.partitionBy(group).orderBy(*order))
    return survivors.withColumn("_rn", final).where(F.col("_rn") <= k).drop("_rn")
