"""What a cluster looks like and which model suits it.

Per-cluster tables come from one grouped pass over the queries (partial sums
first, so a cluster with most of the rows costs no more than any other); what
follows works on one row per cluster.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchyard.functions import rows
from switchyard.models import Models
from switchyard.operators.targets import cheapest_passing
from switchyard.session import materialise


def sizes(labelled: DataFrame) -> DataFrame:
    """(cluster_id, size)."""
    return labelled.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def mean_quality(labelled: DataFrame, models: Models) -> DataFrame:
    """(cluster_id, size, quality): mean quality per model, as an array."""
    q = rows.entries("quality", len(models))
    means = labelled.groupBy("cluster_id").agg(
        F.count(F.lit(1)).alias("size"), *[F.avg(c).alias(f"q{i}") for i, c in enumerate(q)]
    )
    return means.select("cluster_id", "size", F.array(*[f"q{i}" for i in range(len(models))]).alias("quality"))


def utilities(models: Models, beta: float) -> list[Column]:
    """Mean quality minus beta times the model cost."""
    return [q - beta * c for q, c in zip(rows.entries("quality", len(models)), models.costs)]


def with_utility(profile: DataFrame, models: Models, beta: float) -> DataFrame:
    return profile.withColumn("utility", F.array(*utilities(models, beta)))


def utility_probs(profile: DataFrame, models: Models, beta: float, temperature: float = 1.0) -> DataFrame:
    """Add ``probs``: softmax of the utilities."""
    return profile.withColumn("probs", F.array(*rows.softmax(utilities(models, beta), temperature)))


def min_cost_probs(profile: DataFrame, models: Models, beta: float, threshold: float) -> DataFrame:
    """Add ``probs``: 1/cost over the passing models; none -> best utility."""
    m = len(models)
    best = rows.one_hot(rows.argmax(utilities(models, beta)), m)
    return profile.withColumn(
        "probs", F.array(*cheapest_passing(rows.entries("quality", m), models, threshold, best))
    )


def resolve_probs(
    profile: DataFrame, models: Models, *, objective: str, beta: float, threshold: float, temperature: float = 1.0
) -> DataFrame:
    """Add ``probs``, ``best_idx`` and ``best_model`` under an objective.

    The softmax of utilities is the default; ``min_cost`` replaces it for every
    cluster.  The mapping is the first largest probability.
    """
    if objective == "min_cost":
        found = min_cost_probs(profile, models, beta, threshold)
    else:
        found = utility_probs(profile, models, beta, temperature)
    best = rows.argmax(rows.entries("probs", len(models)))
    return found.withColumn("best_idx", best).withColumn("best_model", models.name_of(F.col("best_idx")))


def best_by_utility(profile: DataFrame, models: Models, beta: float) -> DataFrame:
    """(cluster_id, best_idx, best_model): first largest utility."""
    best = rows.argmax(utilities(models, beta))
    return profile.select("cluster_id", best.alias("best_idx")).withColumn(
        "best_model", models.name_of(F.col("best_idx"))
    )


def best_by_cost(profile: DataFrame, models: Models, threshold: float) -> DataFrame:
    """(cluster_id, best_idx, best_model): the cheapest passing model, else the
    best quality."""
    quality = rows.entries("quality", len(models))
    priced = [F.when(q >= threshold, F.lit(c)) for q, c in zip(quality, models.costs)]
    best = F.coalesce(rows.argmin(priced), rows.argmax(quality))
    return profile.select("cluster_id", best.alias("best_idx")).withColumn(
        "best_model", models.name_of(F.col("best_idx"))
    )


def fill_empty(mapping: DataFrame, models: Models) -> DataFrame:
    """Every id from 0 to the largest; an empty cluster gets the cheapest model."""
    ids = mapping.agg(F.max("cluster_id").alias("top")).select(
        F.explode(F.when(F.col("top").isNotNull(), F.sequence(F.lit(0), F.col("top").cast("int")))).alias("cluster_id")
    )
    best = F.coalesce("best_idx", F.lit(models.cheapest))
    return ids.join(mapping.select("cluster_id", "best_idx"), "cluster_id", "left").select(
        "cluster_id", best.alias("best_idx"), models.name_of(best).alias("best_model")
    )


def lookup(queries: DataFrame, mapping: DataFrame) -> DataFrame:
    """Add the mapped model of each query's cluster."""
    return queries.join(mapping.select("cluster_id", "best_idx", "best_model"), "cluster_id", "left")


def long_form(profile: DataFrame, models: Models, *arrays: str) -> DataFrame:
    """(cluster_id, model_idx, model, <arrays>)."""
    m = len(models)
    values = {"model": [F.lit(n) for n in models.names]} | {a: rows.entries(a, m) for a in arrays}
    return profile.select("cluster_id", rows.long_rows(values))


def summary(resolved: DataFrame, k: int = 5) -> DataFrame:
    """The k largest clusters with their model and probs, and the cluster count."""
    everything = W.partitionBy()  # one row per cluster
    return (
        resolved.withColumn("n_clusters", F.count(F.lit(1)).over(everything))
        .orderBy(F.desc("size"), F.asc("cluster_id"))
        .limit(k)
        .select("n_clusters", "cluster_id", F.col("size").alias("count"), "best_model", "probs")
    )


def cluster_features(labelled: DataFrame, features: str = "features") -> DataFrame:
    """Distributional profile: (cluster_id, key, value, n, mass).

    ``n`` counts the records with the feature; ``mass`` adds 1/(features of the
    record) per record, so a cluster's masses sum to its number of records.
    """
    pairs = labelled.select(
        "cluster_id",
        (1.0 / F.size(features)).alias("w"),
        F.explode_outer(features).alias("key", "value"),
    ).where(F.col("key").isNotNull())
    return pairs.groupBy("cluster_id", "key", "value").agg(
        F.count(F.lit(1)).alias("n"), F.sum("w").alias("mass")
    )


def entropy(profile: DataFrame) -> DataFrame:
    """(cluster_id, records, entropy) in bits, from a distributional profile.

    With p = mass / total, -sum(p log2 p) = log2(total) - sum(mass log2 mass) / total:
    one grouped pass, no join back of the total.
    """
    total = F.sum("mass")
    return profile.groupBy("cluster_id").agg(
        total.alias("records"),
        (F.log2(total) - F.sum(F.col("mass") * F.log2("mass")) / total).alias("entropy"),
    )


def top_features(profile: DataFrame, k: int = 10) -> DataFrame:
    """(cluster_id, rank, key, value, n): the k most frequent features."""
    order = W.partitionBy("cluster_id").orderBy(F.desc("n"), F.asc("key"), F.asc("value"))
    return (
        profile.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("cluster_id", "rank", "key", "value", "n")
    )


def separation(profile: DataFrame, parent: str | None = None) -> DataFrame:
    """How far apart the clusters of a parent are: (parent, separation) in bits.

    The weighted Jensen-Shannon divergence of all sibling clusters at once -
    the information a cluster id carries about the features:
    H(features of the parent) - sum of share * H(features of the cluster).
    It needs the two entropies only, no comparison of cluster pairs.
    """
    keys = [parent] if parent else []
    cluster_mass = profile.groupBy(*keys, "cluster_id").agg(
        F.sum("mass").alias("t"), F.sum(F.col("mass") * F.log2("mass")).alias("tl")
    )
    within = cluster_mass.groupBy(*keys).agg(
        F.sum("t").alias("total"), F.sum(F.col("t") * F.log2("t") - F.col("tl")).alias("inner")
    )
    merged = profile.groupBy(*keys, "key", "value").agg(F.sum("mass").alias("mass"))
    whole = merged.groupBy(*keys).agg(
        (F.log2(F.sum("mass")) - F.sum(F.col("mass") * F.log2("mass")) / F.sum("mass")).alias("whole")
    )
    # One row per parent on either side, brought together by a grouping.
    both = within.withColumn("whole", F.lit(None).cast("double")).unionByName(whole, allowMissingColumns=True)
    together = both.groupBy(*keys).agg(*[F.max(c).alias(c) for c in ("total", "inner", "whole")])
    value = F.greatest(F.lit(0.0), F.col("whole") - F.col("inner") / F.col("total"))
    return together.select(*keys, value.alias("separation"))


def cluster_details(placed: DataFrame, offsets: DataFrame, info: DataFrame, k: int = 10) -> tuple[DataFrame, DataFrame]:
    """(details, top features) of clusters, from rows with coarse_id, cluster_id and features.

    details: one row per cluster with its size, entropy, parent, offset and how far apart the
    clusters of its parent are; top features: the ``k`` most frequent of each."""
    profile = materialise(cluster_features(placed), "cluster-features")
    parents = placed.groupBy("cluster_id").agg(F.min("coarse_id").alias("coarse_id"), F.count(F.lit(1)).alias("size"))
    apart = separation(profile.join(parents.select("cluster_id", "coarse_id"), "cluster_id"), "coarse_id")
    details = (
        parents.join(entropy(profile).select("cluster_id", "entropy"), "cluster_id", "left")
        .join(apart, "coarse_id", "left")
        .join(offsets.select("coarse_id", "offset"), "coarse_id")
        .join(info, "coarse_id")
    )
    columns = ["cluster_id", "coarse_id", "offset", "size", "entropy", "separation", "coarse_size", "unique_records", "local_clusters"]
    return details.select(*columns), top_features(profile, k)
