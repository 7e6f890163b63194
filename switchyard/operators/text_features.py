"""Categorical features of a prompt, as one map per query."""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions import text as T
from switchyard.functions.grams import Known, Numbered
from switchyard.functions.measures import COUNTS, measures_udf
from switchyard.functions.together import together

# N-gram lengths and buckets of the hash flags.
NGRAMS = (3, 4, 5)
SHAPE_TOP_K = 2
HASH_BUCKETS = 128
# Different grams without a number a task keeps the buckets of, and texts it marks at a time.
GRAM_CACHE = 1 << 18
FLAG_ROWS = 512
# Grams without a number, and characters of a text at first, between two looks whether all buckets have been found.
GRAM_STEP = 512
FLAG_CHARS = 2048


def _lists(features: dict[str, Column]) -> tuple[Column, Column]:
    return F.lit(list(features)), F.array(*features.values())


def surface_columns(df: DataFrame, text_col: str = "prompt", id_col: str = "query_id") -> DataFrame:
    """One column per surface feature."""
    counts = T.surface_counts(F.col(text_col))
    return (
        df
        .select(id_col, *[c.alias(n) for n, c in counts.items()])
        .select(id_col, *[c.alias(n) for n, c in T.surface_features().items()])
    )


def linguistic_columns(df: DataFrame, text_col: str = "prompt", id_col: str = "query_id") -> DataFrame:
    """One column per rule-based sentence / word feature."""
    counts = T.linguistic_counts(F.col(text_col))
    return (
        df
        .select(id_col, *[c.alias(n) for n, c in counts.items()])
        .select(id_col, *[c.alias(n) for n, c in T.linguistic_features().items()])
    )


def hash_buckets_udf(buckets: int):
    """lower-cased text -> a row of one array per gram length: the different buckets of all grams of the
    stripped text, sorted.

    Arrow batches in Python: a task hashes each different gram once.  Where every bucket there is
    has been found, the rest of a text cannot add one: it is not looked at."""

    def bucket(gram: str) -> int:
        return int.from_bytes(md5(gram.encode()).digest(), "big") % buckets

    def mark(texts: list[str], known: Numbered, marks: dict[int, np.ndarray]) -> None:
        """Set per length which buckets each text has; a column behind them is for starts without one."""
        for n, joined, owner, values, beyond in known.starts(texts):
            values[beyond] = buckets
            slow = np.flatnonzero(values < 0)
            owners = owner[slow]
            values[slow] = buckets
            marks[n].reshape(-1)[owner * (buckets + 1) + values] = True
            for begin in np.flatnonzero(np.diff(owners, prepend=-1)).tolist():
                own = marks[n][owners[begin], :buckets]
                upto = int(np.searchsorted(owners, owners[begin], "right"))
                for step in range(begin, upto, GRAM_STEP):
                    if own.all():
                        break
                    some = slow[step : min(step + GRAM_STEP, upto)].tolist()
                    own[[known.known[joined[p : p + n]] for p in some]] = True
            known.known.rest()

    def marked(texts: list[str], known: Numbered) -> dict[int, np.ndarray]:
        """Per length which buckets each text has: of a part of the text, and of the next one unless all are found."""
        out = {n: np.zeros((len(texts), buckets), bool) for n in NGRAMS}
        rest, begin, upto = np.arange(len(texts)), 0, FLAG_CHARS
        while len(rest):
            # The part begins with the grams that reach over from the one before.
            parts = [texts[i][max(0, begin - max(NGRAMS) + 1) : upto] for i in rest.tolist()]
            marks = {n: np.pad(out[n][rest], ((0, 0), (0, 1))) for n in NGRAMS}
            mark(parts, known, marks)
            for n in NGRAMS:
                out[n][rest] = marks[n][:, :buckets]
            lacking = ~np.all([marks[n][:, :buckets].all(axis=1) for n in NGRAMS], axis=0)
            rest = rest[lacking & np.array([len(texts[i]) > upto for i in rest.tolist()])]
            begin, upto = upto, 2 * upto
        return out

    @F.pandas_udf(", ".join(f"hash{n} array<int>" for n in NGRAMS))
    def found(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = Numbered(Known(bucket, GRAM_CACHE), NGRAMS)
        for texts in batches:
            out: dict[str, list] = {f"hash{n}": [] for n in NGRAMS}
            for first in range(0, len(texts), FLAG_ROWS):
                part = [(t or "").strip(T.BLANKS) for t in texts.iloc[first : first + FLAG_ROWS]]
                for n, rows in marked(part, known).items():
                    out[f"hash{n}"].extend(np.flatnonzero(row).tolist() for row in rows)
            yield pd.DataFrame(out)

    return found


def with_hash_buckets(df: DataFrame, text_col: str = "prompt", buckets: int = HASH_BUCKETS) -> DataFrame:
    """Add hash3, hash4, hash5: every gram bucket of the whole lower-cased, stripped text."""
    found = df.withColumn("_hashes", hash_buckets_udf(buckets)(F.lower(text_col)))
    return found.withColumns({f"hash{n}": F.col(f"_hashes.hash{n}") for n in NGRAMS}).drop("_hashes")


def hash_keys(buckets: int = HASH_BUCKETS) -> Column:
    """Feature keys ``hash{n}_{bucket}`` from the bucket arrays."""

    def keys(n: int) -> Column:
        names = F.lit([f"hash{n}_{b}" for b in range(buckets)])
        return F.transform(F.col(f"hash{n}"), lambda b: F.get(names, b))

    return F.concat(*[keys(n) for n in NGRAMS])


def shape_tokens(df: DataFrame, text_col: str = "prompt", id_col: str = "query_id") -> DataFrame:
    """(id, pos, shape): one row per word."""
    shapes = F.posexplode_outer(T.word_shapes(F.col(text_col))).alias("pos", "shape")
    return df.select(id_col, shapes).where(F.col("shape").isNotNull())


def _shape_key(i: Column) -> Column:
    return F.concat(F.lit("shape_top"), i + 1)


def shape_map(text: Column, k: int = SHAPE_TOP_K) -> Column:
    """shape_top1..k of a text: its most common word shapes, ties by first occurrence.

    Counted inside the row: a text has few different shapes."""
    shapes = F.coalesce(T.word_shapes(text), F.array().cast("array<string>"))

    def ranked(own: Column) -> Column:
        def entry(shape: Column) -> Column:
            n = F.size(F.filter(own, lambda x: x == shape))
            return F.struct((-n).alias("n"), F.array_position(own, shape).alias("first"), shape.alias("shape"))

        best = F.slice(F.array_sort(F.transform(F.array_distinct(own), entry)), 1, k)
        return F.transform(best, lambda b, i: F.struct(_shape_key(i).alias("key"), b["shape"].alias("value")))

    # The array is made once, as the only element that the outer function runs over.
    return F.map_from_entries(F.flatten(F.transform(F.array(shapes), ranked)))


def extract(
    df: DataFrame,
    text_col: str = "prompt",
    buckets: int = HASH_BUCKETS,
    hash_flags: bool = True,
    shapes: bool = True,
    name: str = "features",
    more: dict[str, tuple] | None = None,
    given: str | None = None,
) -> DataFrame:
    """Add one feature map: surface features, hash flags, sentence / word features, shapes.

    The groups have different keys, so the union needs no rule for
    duplicates.  Row-local; no shuffle.  ``more``, a column name with an Arrow function and its
    column each, adds columns that are worked out in the same pass.  With ``given``, a column
    of feature maps, the new map is its ``merge`` with these features.
    """
    more = more or {}
    text = F.col(text_col)
    wanted = {"measures": (measures_udf(df.sparkSession, SHAPE_TOP_K if shapes else 0), text)}
    names = [*COUNTS, "shapes"]
    parts = [_lists(T.surface_features()), _lists(T.linguistic_features())]
    if hash_flags:
        wanted["hashes"] = hash_buckets_udf(buckets), F.lower(text)
        names.extend(f"hash{n}" for n in NGRAMS)
        parts.insert(1, (hash_keys(buckets), F.array_repeat(F.lit("1"), sum(F.size(f"hash{n}") for n in NGRAMS))))
    if shapes:
        parts.append((F.transform("shapes", lambda _, i: _shape_key(i)), F.col("shapes")))
    wanted |= more
    every = together(**{n: f for n, (f, _) in wanted.items()})
    out = df.withColumn("_found", every(*[c for _, c in wanted.values()]))
    # Columns of these names that the table has itself stay as they are.
    own = [F.col(c).alias(f"_own_{i}") for i, c in enumerate(df.columns)]
    counted = out.select(*own, F.char_length(text).alias("n_chars"), *[F.col(f"_found.{n}").alias(n) for n in (*names, *more)])
    # Lists, so that only one map is made: every map looks for repeated keys.
    keys, values = (F.concat(*lists) for lists in zip(*parts, strict=True))
    listed = counted.select(*[f"_own_{i}" for i in range(len(own))], keys.alias("_keys"), values.alias("_values"), *more)
    before = empty_map() if given is None else F.col(f"_own_{df.columns.index(given)}")
    kept = [F.col(f"_own_{i}").alias(c) for i, c in enumerate(df.columns) if c not in more]
    return listed.select(*kept, _merged(before, F.col("_keys"), F.col("_values")).alias(name), *more)


def empty_map() -> Column:
    nothing = F.array().cast("array<string>")
    return F.map_from_arrays(nothing, nothing)


def merge(given: Column, derived: Column) -> Column:
    """Given features (null value -> "") with derived ones; a derived key wins."""
    given, derived = F.coalesce(given, empty_map()), F.coalesce(derived, empty_map())
    kept = F.map_filter(given, lambda k, _: ~F.map_contains_key(derived, k))
    return F.map_concat(F.transform_values(kept, lambda _, v: F.coalesce(v, F.lit(""))), derived)


def _merged(given: Column, keys: Column, values: Column) -> Column:
    """``merge`` with derived features in two lists."""
    kept = F.map_filter(F.coalesce(given, empty_map()), lambda k, _: ~F.array_contains(keys, k))
    own = F.transform(F.map_values(kept), lambda v: F.coalesce(v, F.lit("")))
    return F.map_from_arrays(F.concat(F.map_keys(kept), keys), F.concat(own, values))


def with_annotations(df: DataFrame, annotations: DataFrame, id_col: str = "query_id", name: str = "features") -> DataFrame:
    """Merge the maps of (id, annotations) into the feature maps; queries without one keep theirs."""
    joined = df.join(annotations.select(id_col, F.col("annotations").alias("_annotations")), id_col, "left")
    return joined.withColumn(name, merge(F.col(name), F.col("_annotations"))).drop("_annotations")


def attach_cluster(features: Column, k: int, cluster: Column) -> Column:
    """Add ``embed_cluster_{k}`` to a feature map; no cluster, no feature."""
    key = f"embed_cluster_{k}"
    others = F.map_filter(features, lambda name, _: name != key)
    return F.when(cluster.isNull(), others).otherwise(
        F.map_concat(others, F.create_map(F.lit(key), cluster.cast("int").cast("string")))
    )
