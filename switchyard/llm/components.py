"""Connected components of a link table by alternating star contraction.

Large stars hang a vertex's larger neighbours on its smallest neighbour, small
stars do so with the smaller ones (Kiveris et al., SoCC 2014).  Every step is a
group and a join on the link table; a vertex with very many links is summed up
before the shuffle and its join partition can be split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.session import materialise


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.where("u != v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """(u, v) links -> (id, component): the smallest id reachable, for every linked id.

    Links may repeat, point either way or join an id with itself; null ends are
    ignored.  No links give no rows."""
    edges = materialise(
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u != v")
        .distinct(),
        "links",
    )
    state = _state(edges)
    while state[0]:
        edges = materialise(_small(_large(edges)), "stars")
        before, state = state, _state(edges)
        if before == state:
            break
    ends = edges.select(F.col("u").alias("id"), F.col("v").alias("component"))
    return ends.union(edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
