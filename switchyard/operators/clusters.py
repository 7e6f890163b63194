"""Two-stage clustering of categorical records.

A coarse stage (centres moved by mini-batches, nearest by divergence) cuts the table into
buckets; inside each bucket an information-bottleneck clustering (Andritsos et al., EDBT
2004) merges the records whose union loses least information,
``dI = (w1 + w2) * JS(p(V|c1), p(V|c2))``.

Every record counts before the first merge.  The heaviest and else seeded-random records of
a bucket begin a bounded number of summaries; each other record joins the summary to which it
loses least, and a summary is the weight and profile of all its records.  Their sums are
merged, so a record is represented by its summary's share and never left out.  With as
many summaries as different records the result is the plain agglomeration of all of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchyard.config import RouterConfig
from switchyard.operators import dcf
from switchyard.operators.ranking import top_k_salted
from switchyard.operators.text_features import empty_map
from switchyard.session import materialise


# --- input checks -----------------------------------------------------------------


def check_inputs(df: DataFrame, n_models: int) -> int:
    """Number of rows; raises unless there is one quality row per record with
    one entry per model."""
    found = df.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("quality").alias("with_quality"),
        F.count_if(F.size("quality") == n_models).alias("complete"),
        F.count_if(F.exists("quality", lambda q: q.isNull())).alias("holes"),
    ).first()
    if found["n"] == 0:
        raise ValueError("there is no record to cluster")
    if found["with_quality"] != found["n"]:
        raise ValueError("some records have no quality values")
    if found["complete"] != found["n"] or found["holes"]:
        raise ValueError("quality needs one value per model")
    return int(found["n"])


def check_matching(records: DataFrame, quality: DataFrame, id_col: str = "query_id") -> None:
    """Raises when records and quality rows do not pair up one to one."""
    ids = records.select(id_col, F.lit(1).alias("r"), F.lit(0).alias("q")).unionByName(
        quality.select(id_col, F.lit(0).alias("r"), F.lit(1).alias("q"))
    )
    unpaired = ids.groupBy(id_col).agg(F.sum("r").alias("r"), F.sum("q").alias("q")).where("r <> 1 or q <> 1")
    if not unpaired.isEmpty():
        raise ValueError("quality rows must match the records")


# --- coarse stage -------------------------------------------------------------------


KEYS = ("record_key", "terms")


def with_keys(df: DataFrame, features: str = "features") -> DataFrame:
    """Add ``record_key`` and ``terms`` to rows that have none; a caller that reads its rows
    several times stores them with these."""
    if "record_key" in df.columns:
        return df
    return df.withColumns({"record_key": record_key(F.col(features)), "terms": dcf.terms_of(F.col(features))})


def different(df: DataFrame, features: str = "features", id_col: str = "query_id") -> DataFrame:
    """(record_key, n, features, terms): each different record once.

    Only keys and ids are grouped; one row of each then gives the features."""
    rows = with_keys(df, features)
    counted = rows.groupBy("record_key").agg(F.count(F.lit(1)).alias("n"), F.min(id_col).alias(id_col))
    own = rows.select(id_col, F.col(features).alias("features"), "record_key", "terms")
    found = counted.join(own, [id_col, "record_key"])
    # An id may have several rows of the same record.
    return found.dropDuplicates(["record_key"]).select("record_key", "n", "features", "terms")


def fit_coarse(records: DataFrame, k: int, config: RouterConfig) -> DataFrame:
    """Stored centres (``dcf.PROFILES``, bucket 0) of (record_key, n, terms); k is clamped to the records."""
    n = records.count()
    centres = dcf.fit_centres(records, n, max(1, min(k, n)), config.seed, config.coarse_batch_size, config.coarse_max_iter)
    return materialise(centres, "coarse-centres")


def _one_bucket() -> Column:
    """0 for every record, as a computed value: a join on a literal would become a cross join."""
    return F.pmod(F.xxhash64("record_key"), F.lit(1)).cast("int")


def coarse_nearest(records: DataFrame, centres: DataFrame) -> DataFrame:
    """(record_key, terms) -> (record_key, coarse_id, divergence): the centre of least divergence."""
    found = dcf.nearest(records.select(_one_bucket().alias("bucket"), "record_key", "terms"), centres)
    # The loss of two sides of weight 1 is twice their divergence.
    return found.select("record_key", F.col("local").alias("coarse_id"), (F.col("loss") / 2).alias("divergence"))


def coarse_sizes(df: DataFrame) -> DataFrame:
    """(coarse_id, coarse_size)."""
    return df.groupBy("coarse_id").agg(F.count(F.lit(1)).alias("coarse_size"))


# --- different records ------------------------------------------------------------------


def record_key(features: Column) -> Column:
    """128-bit key of a record, independent of the order of its features."""
    entries = F.coalesce(F.map_entries(features), F.map_entries(empty_map()))
    return F.md5(F.to_json(F.sort_array(entries)).cast("binary"))


def key_of_terms(terms: Column) -> Column:
    """128-bit key of a record from its sorted terms, which stand for its features in the weights as well.

    Numbers are sorted and written faster than the features themselves; no draw depends on this key."""
    return F.md5(F.to_json(terms).cast("binary"))


def unique_records(df: DataFrame, features: str = "features", id_col: str = "query_id") -> DataFrame:
    """(coarse_id, record_key, n, first_id): identical records of a bucket once.

    Grouping on the fixed-size key combines repeats before the shuffle, so a
    record held by a third of all rows is one row per task.
    """
    return df.groupBy("coarse_id", record_key(F.col(features)).alias("record_key")).agg(
        F.count(F.lit(1)).alias("n"), F.min(id_col).alias("first_id")
    )


def bounded_sample(unique: DataFrame, cap: int, seed: int = 42) -> DataFrame:
    """At most ``cap`` different records per bucket, the ones with the smallest
    seeded hash.  A bucket may hold most of the records: see ``top_k_salted``."""
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.col("record_key")).cast("binary"))
    return top_k_salted(unique, "coarse_id", [order, F.col("record_key")], cap, F.col("record_key"))


def cluster_info(unique: DataFrame, local_counts: DataFrame) -> DataFrame:
    """(coarse_id, coarse_size, unique_records, local_clusters)."""
    per_bucket = unique.groupBy("coarse_id").agg(
        F.sum("n").alias("coarse_size"), F.count(F.lit(1)).alias("unique_records")
    )
    return per_bucket.join(local_counts.select("coarse_id", "local_clusters"), "coarse_id", "left")


def offsets(local_counts: DataFrame) -> DataFrame:
    """(coarse_id, local_clusters, offset): running sum over sorted bucket ids.

    The window runs over one row per bucket.
    """
    before = W.orderBy("coarse_id").rowsBetween(W.unboundedPreceding, -1)
    return local_counts.select(
        "coarse_id", "local_clusters", F.coalesce(F.sum("local_clusters").over(before), F.lit(0)).alias("offset")
    )


# --- summaries and their merging ----------------------------------------------------------


def first_summaries(placed: DataFrame, count: int, seed: int = 42) -> DataFrame:
    """(bucket, record_key, summary): the records that begin a bucket's summaries.

    A seeded draw without replacement by weight, so a record that holds much of a bucket
    begins one; all of them where a bucket has no more than ``count``."""
    chance = (F.pmod(F.xxhash64(F.lit(seed), "record_key"), F.lit(1 << 52)) + 0.5) / float(1 << 52)
    order = [-F.ln(chance) / F.col("n"), F.col("record_key")]
    drawn = top_k_salted(placed.select("bucket", "record_key", "n"), "bucket", order, count, F.col("record_key"))
    number = F.row_number().over(W.partitionBy("bucket").orderBy("record_key")) - 1
    return drawn.select("bucket", "record_key", number.alias("summary"))


def summarise(placed: DataFrame, count: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(masses, members) of (bucket, record_key, n, features, terms): per summary its weight, and
    per record its summary.

    masses: (bucket, summary, key, value, m) and a row without key for the weight w;
    the sums are made per task before anything is shuffled."""
    begun = materialise(first_summaries(placed, count, seed), "summary-seeds")
    seeds = placed.join(begun, ["bucket", "record_key"])
    size = F.size("terms")
    profiles = seeds.select(
        "bucket",
        F.col("summary").alias("local"),
        F.col("n").cast("double").alias("w"),
        "terms",
        F.transform("terms", lambda t: 1.0 / size).alias("p"),
    )
    rest = placed.join(begun, ["bucket", "record_key"], "left_anti").select("bucket", "record_key", "terms")
    joined = dcf.nearest(rest, profiles).select("bucket", "record_key", F.col("local").alias("summary"))
    members = materialise(begun.union(joined.select("bucket", "record_key", "summary")), "summary-members")
    whole = placed.join(members, ["bucket", "record_key"]).select(
        F.col("bucket").alias("coarse_id"), F.col("summary").alias("local"), "n", "features"
    )
    return whole, members


def merge_summaries(probs: DataFrame, weights: DataFrame, k: int, tau: float | None = None) -> DataFrame:
    """(bucket, summary, local) from the summaries' profiles.

    The one sequential step: a group holds a bucket's summaries, whose number is bounded,
    and buckets run in parallel."""

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("local", ignore_index=True)
        terms = np.unique(np.concatenate([np.asarray(t, np.int64) for t in group["terms"]]))
        shares = np.zeros((len(group), max(1, len(terms))))
        for row, (t, p) in enumerate(zip(group["terms"], group["p"], strict=True)):
            # Sums differ in their last bits with the order of their parts.
            shares[row, np.searchsorted(terms, np.asarray(t, np.int64))] = np.round(np.asarray(p, float), 13)
        local = dcf.merge_profiles(group["w"].to_numpy(), shares, k, tau)
        return pd.DataFrame({"bucket": group["bucket"], "summary": group["local"], "local": local.astype("int32")})

    return dcf.pack(probs, weights).groupBy("bucket").applyInPandas(merge, "bucket int, summary int, local int")


# --- assignment -----------------------------------------------------------------------------


def profile_table(records: DataFrame, features: str = "features") -> tuple[DataFrame, DataFrame]:
    """Profiles of given clusters, from (coarse_id, local, n, features):
    feature_probs (coarse_id, key, value, local, p) and weights (coarse_id, local, w)."""
    weights = records.groupBy("coarse_id", "local").agg(F.sum("n").cast("double").alias("w"))
    mass = (
        records.select(
            "coarse_id",
            "local",
            (F.col("n") / F.size(features)).alias("m"),
            F.explode_outer(features).alias("key", "value"),
        )
        .where(F.col("key").isNotNull())
        .groupBy("coarse_id", "local", "key", "value")
        .agg(F.sum("m").alias("m"))
    )
    probs = mass.join(weights, ["coarse_id", "local"]).select(
        "coarse_id", "key", "value", "local", (F.col("m") / F.col("w")).alias("p")
    )
    return probs, weights


def assign(
    df: DataFrame,
    feature_probs: DataFrame,
    weights: DataFrame,
    features: str = "features",
    id_col: str = "query_id",
) -> DataFrame:
    """(id, coarse_id, local, loss): the cluster of its bucket that loses least information, in
    records times bits, when the record joins it; local is null in a bucket never seen.

    Each different record is compared once, in a sparse product with its bucket's profiles;
    rows then take their record's answer."""
    rows = df.select(id_col, F.col("coarse_id").cast("int").alias("coarse_id"), record_key(F.col(features)).alias("record_key"), F.col(features).alias("_f"))
    records = rows.groupBy("coarse_id", "record_key").agg(F.first(dcf.terms_of(F.col("_f"))).alias("terms"))
    found = dcf.nearest(records.withColumnRenamed("coarse_id", "bucket"), dcf.pack(feature_probs, weights))
    found = found.select(F.col("bucket").alias("coarse_id"), "record_key", "local", "loss")
    return rows.drop("_f").join(found, ["coarse_id", "record_key"], "left").select(id_col, "coarse_id", "local", "loss")


def check_seen(assigned: DataFrame) -> None:
    """Raises when a record fell into a bucket that had no training rows."""
    unseen = assigned.where(F.col("local").isNull()).select("coarse_id").limit(1).collect()
    if unseen:
        raise ValueError(f"no training record fell into bucket {unseen[0]['coarse_id']}")


# --- the whole fit --------------------------------------------------------------------------


@dataclass
class FittedClusters:
    """What assignment needs; all tables are stored in the shared folder."""

    k: int
    centres: DataFrame
    feature_probs: DataFrame
    weights: DataFrame
    offsets: DataFrame
    info: DataFrame
    placed: DataFrame | None = None  # bucket, record_key, terms of the records of the fit

    def _records(self, df: DataFrame, features: str) -> tuple[DataFrame, DataFrame]:
        """Keys of all rows, and the different records with their bucket."""
        rows = df.withColumn("record_key", record_key(F.col(features)))
        records = rows.groupBy("record_key").agg(F.first(dcf.terms_of(F.col(features))).alias("terms"))
        return rows, dcf.nearest(records.withColumn("bucket", _one_bucket()), self.centres).select(
            F.col("local").alias("bucket"), "record_key", "terms"
        )

    def coarse_ids(self, df: DataFrame, features: str = "features") -> DataFrame:
        """Adds ``coarse_id``: the centre of least divergence."""
        rows, records = self._records(df, features)
        return rows.join(records.select("record_key", F.col("bucket").alias("coarse_id")), "record_key", "left").drop("record_key")

    def predict(self, df: DataFrame, features: str = "features", id_col: str = "query_id") -> DataFrame:
        """(id, coarse_id, local, cluster_id, loss)."""
        rows, records = self._records(df.select(id_col, features), features)
        return rows.select(id_col, "record_key").join(self.clusters_of(records), "record_key", "left").drop("record_key")

    def clusters_of(self, records: DataFrame) -> DataFrame:
        """(record_key, coarse_id, local, cluster_id, loss) of different (bucket, record_key, terms)."""
        found = dcf.nearest(records, dcf.pack(self.feature_probs, self.weights))
        return found.join(self.offsets.select(F.col("coarse_id").alias("bucket"), "offset"), "bucket", "left").select(
            "record_key",
            F.col("bucket").alias("coarse_id"),
            "local",
            (F.col("offset") + F.col("local")).cast("int").alias("cluster_id"),
            "loss",
        )


def fit_clusters(
    df: DataFrame, config: RouterConfig, n_rows: int, features: str = "features", id_col: str = "query_id"
) -> FittedClusters:
    """Cluster (id, features [, record_key, terms]); ``df`` should be stored, it is read several times."""
    records = materialise(different(df, features, id_col), "records")
    centres = fit_coarse(records, config.coarse_count(n_rows), config)
    near = coarse_nearest(records, centres).select("record_key", F.col("coarse_id").alias("bucket"))
    placed = materialise(records.join(near, "record_key"), "placed")

    k = max(1, config.num_clusters)
    whole, members = summarise(placed, max(k, config.cluster_fit_size), config.seed)
    probs, weights = (materialise(t, "summaries") for t in profile_table(whole))
    merged = materialise(merge_summaries(probs, weights, k, config.cluster_tau), "merged")
    # Sums of summaries are sums of all their records.
    part = merged.select(F.col("bucket").alias("coarse_id"), F.col("summary").alias("local"), F.col("local").alias("cluster"))
    joined = weights.join(part, ["coarse_id", "local"])
    cluster_weights = joined.groupBy("coarse_id", F.col("cluster").alias("local")).agg(F.sum("w").alias("w"))
    mass = probs.join(joined, ["coarse_id", "local"]).groupBy("coarse_id", "key", "value", F.col("cluster").alias("local"))
    mass = mass.agg(F.sum(F.col("p") * F.col("w")).alias("m"))
    cluster_weights = materialise(cluster_weights, "cluster-weights")
    cluster_probs = mass.join(cluster_weights, ["coarse_id", "local"]).select(
        "coarse_id", "key", "value", "local", (F.col("m") / F.col("w")).alias("p")
    )
    counts = cluster_weights.groupBy("coarse_id").agg((F.max("local") + 1).alias("local_clusters"))
    unique = placed.select(F.col("bucket").alias("coarse_id"), "n")
    # A merge stopped early by tau may leave more clusters than asked for.
    most = int(counts.agg(F.max("local_clusters")).first()[0])
    return FittedClusters(
        k=most,
        centres=centres,
        feature_probs=materialise(cluster_probs, "cluster-probs"),
        weights=cluster_weights,
        offsets=materialise(offsets(counts), "cluster-offsets"),
        info=materialise(cluster_info(unique, counts), "cluster-info"),
        placed=placed.select("bucket", "record_key", "terms"),
    )


# --- embedding clusters ---------------------------------------------------------------------


def fit_embedding_clusters(
    df: DataFrame, k: int, seed: int = 42, n_init: int = 10, column: str = "embedding"
) -> KMeansModel:
    """K-means on an array column, the best of ``n_init`` seeded starts."""
    vectors = df.select(array_to_vector(F.col(column).cast("array<double>")).alias("v"))
    vectors = vectors.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        fits = [
            KMeans(featuresCol="v", predictionCol="embed_cluster", k=k, seed=seed + i).fit(vectors)
            for i in range(n_init)
        ]
        return min(fits, key=lambda f: f.summary.trainingCost)
    finally:
        vectors.unpersist()


def predict_embedding_clusters(df: DataFrame, model: KMeansModel, column: str = "embedding") -> DataFrame:
    """Add ``embed_cluster``."""
    vectors = df.withColumn("v", array_to_vector(F.col(column).cast("array<double>")))
    return model.transform(vectors).drop("v")


def nearest_centre(vector: Column, centres: list[list[float]]) -> Column:
    """Index of the nearest of a few given centres, the first one on ties.

    One matrix product per Arrow batch; the centres travel with the function.
    """
    matrix = np.asarray(centres, dtype=float)

    @F.pandas_udf("int")
    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        half = (matrix**2).sum(axis=1) / 2
        for batch in batches:
            points = np.stack(batch.to_numpy()) if len(batch) else np.zeros((0, matrix.shape[1]))
            # Squared distance minus a term that is the same for all centres.
            yield pd.Series((half - points @ matrix.T).argmin(axis=1).astype("int32"))

    return nearest(vector)
