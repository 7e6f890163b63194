"""Features taken from annotated tokens and entities (any tagger's output)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.operators.ranking import top_values

POS_TOP_K = 3
SHAPE_TOP_K = 2


def pos_top(tokens: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(id, key, value): pos_top1..3 from (id, pos, tag)."""
    named = tokens.withColumn("tag", F.upper(F.when(F.col("tag") != "", F.col("tag")).otherwise("UNK")))
    return top_values(named, id_col, "tag", "pos", POS_TOP_K).select(
        id_col, F.concat(F.lit("pos_top"), F.col("rank")).alias("key"), F.col("tag").alias("value")
    )


def shape_top(shapes: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(id, key, value): shape_top1..2 from (id, pos, shape)."""
    return top_values(shapes, id_col, "shape", "pos", SHAPE_TOP_K).select(
        id_col,
        F.concat(F.lit("shape_top"), F.col("rank")).alias("key"),
        F.col("shape").alias("value"),
    )


def entity_flags(queries: DataFrame, entities: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(id, key, value): has_ent_<LABEL> per label, has_ent_NONE without any.

    A query joins as one row with its few distinct labels, so neither a long
    text nor a frequent label makes the join uneven.
    """
    labels = entities.groupBy(id_col).agg(F.collect_set(F.upper("label")).alias("labels"))
    none = F.array(F.lit("NONE"))
    return queries.select(id_col).join(labels, id_col, "left").select(
        id_col,
        F.explode(F.coalesce("labels", none)).alias("label"),
    ).select(id_col, F.concat(F.lit("has_ent_"), F.col("label")).alias("key"), F.lit("1").alias("value"))


def as_map(long: DataFrame, id_col: str = "query_id", name: str = "features") -> DataFrame:
    """(id, key, value) rows -> (id, map), keys in sorted order."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "value")))
    return long.groupBy(id_col).agg(F.map_from_entries(pairs).alias(name))


def annotation_map(queries: DataFrame, tokens: DataFrame, entities: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(id, annotations): the tag and entity features of every query as one map."""
    return as_map(pos_top(tokens, id_col).unionByName(entity_flags(queries, entities, id_col)), id_col, "annotations")
