"""Seeded train / validation split, stable under repartitioning."""

from __future__ import annotations

import math
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchyard.functions.digest import digest_fraction

_PREFIX = 4  # hex digits of a histogram: at most 65,536 buckets
_FEW = 1000  # rows in which the cut is looked up directly


def _seeded_key(id_col: str, seed: int) -> Column:
    return F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string"))


def hash_split(df: DataFrame, id_col: str = "query_id", val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split``: train or validation, by a hash of the id against a
    threshold.  Row-local; the shares are met on average."""
    return df.withColumn(
        "split",
        F.when(digest_fraction(_seeded_key(id_col, seed)) < 1.0 - val_ratio, "train").otherwise("validation"),
    )


def _cut_bucket(counts: DataFrame, wanted: int) -> Row | None:
    """The histogram row (part, n, upto) in which the running sum reaches ``wanted``."""
    # The window runs over the histogram, whose size is fixed.
    running = F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, W.currentRow))
    found = counts.select("part", "n", running.alias("upto"))
    return found.where((F.col("upto") >= wanted) & (F.col("upto") - F.col("n") < wanted)).first()


def exact_split(df: DataFrame, id_col: str = "query_id", val_ratio: float = 0.2, seed: int = 42) -> DataFrame:
    """Add ``split`` with exactly int(n * (1 - val_ratio)) training rows.

    The training rows are those with the smallest hashes.  Nothing is sorted: a histogram
    over hash prefixes finds the bucket with the cut, the next one looks inside it with
    longer prefixes, until it holds few rows.  The cut then is one value and the split a
    row-local comparison.  Rows of one id fall on the same side.
    """
    digest = F.md5(_seeded_key(id_col, seed))
    inside = df.select(digest.alias("h"), F.col(id_col).alias("id"))
    rank = math.floor(inside.count() * (1.0 - val_ratio))
    prefix, size = "", None
    while rank > 0 and (size is None or size > _FEW) and len(prefix) < 32:
        part = F.substring("h", len(prefix) + 1, _PREFIX)
        bucket = _cut_bucket(inside.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")), rank)
        prefix, size, rank = prefix + bucket["part"], bucket["n"], int(rank - (bucket["upto"] - bucket["n"]))
        inside = inside.where(F.col("h").startswith(prefix))
    if rank <= 0:  # no training rows at all
        return df.withColumn("split", F.lit("validation"))
    # At most _FEW rows; one, if an id is repeated so often that its whole hash is the prefix.
    rest = sorted((r["h"], r["id"], r["n"]) for r in inside.groupBy("h", "id").agg(F.count(F.lit(1)).alias("n")).collect())
    last = next((h, i) for (h, i, _), upto in zip(rest, accumulate(n for *_, n in rest), strict=True) if upto >= rank)
    below = (digest < last[0]) | ((digest == last[0]) & (F.col(id_col) <= F.lit(last[1])))
    return df.withColumn("split", F.when(below, "train").otherwise("validation"))
