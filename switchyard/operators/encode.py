"""Vocabulary, one-hot and embedding vectors, scaling and fusion."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import VectorUDT
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions.grams import EMBED_NGRAMS, Known, Numbered, gram_code, gram_sums
from switchyard.operators.ranking import dense_index

# Different grams without a number a task keeps the hashes of, and texts it sums at a time.
GRAM_CACHE = 1 << 18
EMBED_ROWS = 512


def feature_pairs(df: DataFrame, id_col: str = "query_id", features: str = "features") -> DataFrame:
    """(id, key, value), one row per feature.

    The outer form, because a plain explode makes the optimizer add a
    "map is not empty" filter at the scan, which computes every feature twice.
    """
    return df.select(id_col, F.explode_outer(features).alias("key", "value")).where(F.col("key").isNotNull())


def fit_vocabulary(df: DataFrame, features: str = "features") -> DataFrame:
    """(key, value, idx): distinct pairs, numbered by key, then value."""
    pairs = df.select(F.explode_outer(features).alias("key", "value")).where(F.col("key").isNotNull()).distinct()
    return dense_index(pairs, ["key", "value"])


def one_hot(df: DataFrame, vocab: DataFrame, id_col: str = "query_id", features: str = "features") -> DataFrame:
    """(id, idx, value) with value 1/sqrt(known features), known features only.

    A join, for a vocabulary of any size.  Feature pairs repeat across rows (a flag may be
    set in a third of them), so the join is left to the engine's skew handling.
    """
    known = feature_pairs(df, id_col, features).join(vocab, ["key", "value"]).select(id_col, "idx")
    grouped = known.groupBy(id_col).agg(F.collect_list("idx").alias("ids"))
    return grouped.select(
        id_col, F.explode("ids").alias("idx"), (1.0 / F.sqrt(F.size("ids").cast("double"))).alias("value")
    )


def one_hot_vectors(df: DataFrame, vocab: DataFrame, id_col: str = "query_id", features: str = "features") -> DataFrame:
    """(id, indices, values): the sparse unit vector of every row, indices ascending.

    Put together from the joined index, for a vocabulary of any size: nothing of it is
    collected or sent whole.  A row without a known feature has an empty vector."""
    known = feature_pairs(df, id_col, features).join(vocab, ["key", "value"]).groupBy(id_col)
    lists = known.agg(F.array_sort(F.collect_list("idx")).alias("indices"))
    value = 1.0 / F.sqrt(F.size("indices").cast("double"))
    found = df.select(id_col).join(lists, id_col, "left")
    return found.select(
        id_col,
        F.coalesce("indices", F.array().cast("array<int>")).alias("indices"),
        F.coalesce(F.transform("indices", lambda _: value), F.array().cast("array<double>")).alias("values"),
    )


def hash_embedding_udf(dim: int):
    """text -> dense hash embedding, divided by its norm; no gram -> zeros.

    Every character 3-, 4- and 5-gram of the whole text (a shorter text gives
    itself) adds ((md5 >> 8) mod 1000)/1000 to dimension md5 mod dim.

    Arrow batches in Python: a task hashes each different gram once.  The same
    in built-in expressions hashes every occurrence and needs two shuffles to
    sum per text; it took several times as long on the test tables.
    """

    @F.pandas_udf("array<double>")
    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = Numbered(Known(gram_code(dim), GRAM_CACHE), EMBED_NGRAMS)
        for texts in batches:
            vectors = []
            for at in range(0, len(texts), EMBED_ROWS):
                part = texts.iloc[at : at + EMBED_ROWS]
                # Sums of whole thousandths: exact, whatever the order.
                sums = gram_sums([t or "" for t in part], dim, known)
                norms = np.sqrt((sums * sums).sum(axis=1, keepdims=True))
                vectors.extend(sums / np.where(norms > 0, norms, 1.0))
            yield pd.Series(vectors)

    return embed


def hash_embedding(
    df: DataFrame, dim: int = 384, text_col: str = "prompt", name: str = "embedding"
) -> DataFrame:
    """Add the dense hash embedding of a text column; row-local, no shuffle."""
    return df.withColumn(name, hash_embedding_udf(dim)(F.col(text_col)))


def embedding_or_hash(
    df: DataFrame, embeddings: DataFrame, dim: int, id_col: str = "query_id", text_col: str = "prompt"
) -> DataFrame:
    """(id, embedding): the given embedding, else the hash embedding.

    Ids decide which rows have one; only texts without are hashed.
    """
    given = embeddings.where(F.col("embedding").isNotNull()).select(
        id_col, F.col("embedding").cast("array<double>").alias("_given")
    )
    known = given.select(id_col).distinct()
    rest = df.select(id_col, text_col).join(known, id_col, "left_anti")
    hashed = rest.select(id_col, hash_embedding_udf(dim)(F.coalesce(F.col(text_col), F.lit(""))).alias("embedding"))
    kept = df.select(id_col).join(given, id_col).select(id_col, F.col("_given").alias("embedding"))
    return kept.union(hashed)


def min_max(df: DataFrame, column: str) -> tuple[list[float], list[float]]:
    """Smallest and largest value per dimension of an array or vector column.

    One aggregate whose state is one vector per task; no row per dimension is
    made.  Only the two result vectors reach the driver.
    """
    is_vector = isinstance(df.schema[column].dataType, VectorUDT)
    vector = F.col(column) if is_vector else array_to_vector(F.col(column).cast("array<double>"))
    # Grouped by a constant: an empty table then gives no row instead of an error.
    found = (
        df.select(F.lit(0).alias("all"), vector.alias("v"))
        .groupBy("all")
        .agg(Summarizer.min(F.col("v")).alias("low"), Summarizer.max(F.col("v")).alias("high"))
        .first()
    )
    if found is None:
        return [], []
    return [float(x) for x in found["low"]], [float(x) for x in found["high"]]


def scale_min_max(column: Column, low: list[float], high: list[float]) -> Column:
    """(x - min) / (max - min) with stored stats; a constant dimension is
    divided by 1; values outside the stored range are not clipped."""
    shift = F.array(*[F.lit(x) for x in low])
    span = F.array(*[F.lit(b - a if b != a else 1.0) for a, b in zip(low, high)])
    return F.transform(column, lambda x, i: (x - F.get(shift, i)) / F.get(span, i))


def fuse(left: Column, right: Column, beta: float) -> Column:
    """beta * left followed by (1 - beta) * right, beta clipped to [0, 1]."""
    beta = max(0.0, min(1.0, beta))
    return F.concat(F.transform(left, lambda x: x * beta), F.transform(right, lambda x: x * (1.0 - beta)))
