"""Fit a classifier on soft targets and route queries with it."""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.ml.clustering import KMeansModel
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from switchyard.config import RouterConfig
from switchyard.functions import rows
from switchyard.models import Models
from switchyard.operators import clusters as C
from switchyard.operators import dcf
from switchyard.operators import encode as E
from switchyard.operators import network as N
from switchyard.operators import profiles as P
from switchyard.operators import softmax as X
from switchyard.operators import targets as S
from switchyard.operators import text_features as TF
from switchyard.session import materialise


@dataclass
class Router:
    """A fitted router: the weights of features as a table of any size, those of the embedding's
    dimensions as a short list, and the tables that describe its clusters.  One with hidden
    layers has a network instead of these weights."""

    models: Models
    config: RouterConfig
    coefficients: DataFrame
    dense: list[list[float]]
    low: list[float]
    high: list[float]
    embed_model: KMeansModel | None
    cluster_probs: DataFrame
    cluster_info: DataFrame
    cluster_details: DataFrame
    top_features: DataFrame
    network: N.Network | None = None

    def route(self, df: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
        """Add probs, pred, model and prob to (query_id, text, features, ...)."""
        return self.score(prepare(df, self.config, annotations))

    def score(self, prepared: DataFrame) -> DataFrame:
        """The same from already derived features and embedding, which are stored once, as
        different feature maps are joined with the weights on their own."""
        scored = with_dense(prepared, self.low, self.high)
        if self.embed_model is not None:
            scored = with_embed_cluster(scored, self.embed_model, self.config.embed_k)
        kept = [c for c in prepared.columns if c not in ("embedding", "features")]
        key = C.key_of_terms(dcf.terms_of(F.col("features")))
        scored = scored.select(*kept, "features", "embedding", key.alias("record_key"))
        if self.network is not None:
            terms = dcf.terms_of(F.col("features"))
            return self._answered(scored.withColumn("probs", self.network.probabilities(terms, F.col("embedding"))), kept)
        scored = materialise(scored, "scored")
        m, scale = len(self.models), (self.config.beta, 1.0 - self.config.beta)
        records = scored.select("record_key", "features").dropDuplicates(["record_key"])
        summed = X.sparse_sums(records, self.coefficients, m)
        joined = scored.join(summed, "record_key", "left")
        found = X.probabilities(F.col("embedding"), F.col("known"), F.col("sums"), self.dense, scale)
        return self._answered(joined.withColumn("probs", found), kept)

    def _answered(self, scored: DataFrame, kept: list[str]) -> DataFrame:
        probs = rows.entries("probs", len(self.models))
        return scored.withColumn("pred", rows.argmax(probs)).select(
            *kept,
            "features",
            "probs",
            "pred",
            self.models.name_of(F.col("pred")).alias("model"),
            rows.row_max(probs).alias("prob"),
        )

    def save(self, path: str) -> None:
        """Store all parts below a version of their own; the manifest, written last, makes it the
        one that counts.  Until then readers get the version before."""
        spark = self.coefficients.sparkSession
        version = f"{path}/versions/{uuid.uuid4().hex}"
        if self.embed_model is not None:
            self.embed_model.write().save(f"{version}/embed_clusters")
        tables = {
            "coefficients": self.coefficients,
            "dense": spark.createDataFrame([(i, w) for i, w in enumerate(self.dense)], "dim int, w array<double>"),
            "cluster_probs": self.cluster_probs,
            "cluster_info": self.cluster_info,
            "cluster_details": self.cluster_details,
            "top_features": self.top_features,
            "models": self.models.frame(spark),
            "embedding_range": spark.createDataFrame(
                [(i, a, b) for i, (a, b) in enumerate(zip(self.low, self.high))], "dim int, low double, high double"
            ),
            "config": spark.createDataFrame([(json.dumps(self.config.as_dict()),)], "config string"),
        }
        if self.network is not None:
            tables["network"] = self.network.frame(spark)
        for name, table in tables.items():
            table.write.parquet(f"{version}/{name}")
        newest = max((r["number"] for r in manifests(spark, path)), default=0) + 1
        entry = [(newest, version.rsplit("/", 1)[1])]
        spark.createDataFrame(entry, MANIFEST).coalesce(1).write.mode("append").parquet(f"{path}/manifest")

    @staticmethod
    def load(spark: SparkSession, path: str, number: int | None = None) -> "Router":
        """The newest complete version, or the one with a number."""
        found = [r for r in manifests(spark, path) if number is None or r["number"] == number]
        if not found:
            raise ValueError(f"no complete router below {path}")
        version = f"{path}/versions/{max(found, key=lambda r: (r['number'], r['version']))['version']}"

        def read(name: str) -> DataFrame:
            return spark.read.parquet(f"{version}/{name}")

        listed = sorted(read("models").collect(), key=lambda r: r["model_idx"])
        ranges = sorted(read("embedding_range").collect(), key=lambda r: r["dim"])
        config = RouterConfig(**json.loads(read("config").first()["config"]))
        return Router(
            models=Models(tuple(r["model"] for r in listed), tuple(r["model_cost"] for r in listed)),
            config=config,
            coefficients=read("coefficients"),
            dense=[list(r["w"]) for r in sorted(read("dense").collect(), key=lambda r: r["dim"])],
            low=[r["low"] for r in ranges],
            high=[r["high"] for r in ranges],
            embed_model=KMeansModel.load(f"{version}/embed_clusters") if config.embed_k else None,
            cluster_probs=read("cluster_probs"),
            cluster_info=read("cluster_info"),
            cluster_details=read("cluster_details"),
            top_features=read("top_features"),
            network=N.Network.read(read("network")) if config.hidden_units else None,
        )


MANIFEST = "number long, version string"


def manifests(spark: SparkSession, path: str) -> list[Row]:
    """One row per complete version; a folder without a manifest has none."""
    try:
        return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").collect()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return []


def prepare(df: DataFrame, config: RouterConfig, annotations: DataFrame | None = None) -> DataFrame:
    """Replace ``text`` by the merged feature map and the text embedding.

    A given ``embedding`` column is kept; rows without one are hashed.  ``annotations``,
    (query_id, annotations) of ``annotated.annotation_map``, adds features of tags and entities.
    """
    prepared = _prepare(df, config)
    return prepared if annotations is None else TF.with_annotations(prepared, annotations)


def _prepare(df: DataFrame, config: RouterConfig) -> DataFrame:
    given = "embedding" in df.columns
    missing = F.when(F.col("embedding").isNull(), F.coalesce("text", F.lit(""))) if given else F.col("text")
    hashed = E.hash_embedding_udf(config.embedding_dim)
    if config.use_query_features:
        df = TF.extract(df, "text", config.hash_buckets, name="_merged", more={"_hashed": (hashed, missing)}, given="features")
    else:
        df = df.withColumn("_merged", TF.merge(F.col("features"), TF.empty_map())).withColumn("_hashed", hashed(missing))
    merged = df.withColumn("features", F.col("_merged")).drop("_merged")
    embedding = F.coalesce(F.col("embedding").cast("array<double>"), "_hashed") if given else F.col("_hashed")
    return merged.withColumn("embedding", embedding).drop("_hashed", "text")


def with_dense(df: DataFrame, low: list[float], high: list[float]) -> DataFrame:
    """Scale the embedding to the training range and add it as a vector."""
    scaled = E.scale_min_max(F.col("embedding"), low, high)
    return df.withColumn("embedding", scaled).withColumn("dense", array_to_vector("embedding"))


def with_embed_cluster(df: DataFrame, model: KMeansModel, k: int) -> DataFrame:
    """Add the embedding cluster to the feature map."""
    found = model.transform(df.withColumn("v", F.col("dense")))
    label = F.col("embed_cluster")
    return found.withColumn("features", TF.attach_cluster(F.col("features"), k, label)).drop("v", "embed_cluster")


@dataclass
class Clustered:
    """Training rows with their clusters: what fits that differ in targets only can share."""

    rows: DataFrame  # query_id, features, terms, embedding, quality, coarse_id, cluster_id
    low: list[float]
    high: list[float]
    embed_model: KMeansModel | None
    info: DataFrame
    details: DataFrame
    top_features: DataFrame


def cluster_training(prepared: DataFrame, models: Models, config: RouterConfig) -> Clustered:
    """Scale the embeddings of stored ``prepared`` rows, cluster their features, describe the clusters.

    Rows that were stored with their keys are not stored again."""
    n_rows = C.check_inputs(prepared, len(models))
    low, high = E.min_max(prepared, "embedding")
    stored = config.embed_k is None and set(C.KEYS) <= set(prepared.columns)
    base = with_dense(prepared.select("query_id", "features", "embedding", "quality", *(C.KEYS if stored else ())), low, high)
    embed_model = None
    if config.embed_k is not None:
        embed_model = C.fit_embedding_clusters(base, config.embed_k, config.seed)
        base = with_embed_cluster(base, embed_model, config.embed_k)
    # Keys and terms are sorts of whole maps: made once, and the rows take the clusters of their records.
    keyed = base.drop("dense") if stored else materialise(C.with_keys(base.select("query_id", "features", "embedding", "quality")), "keyed")
    fitted = C.fit_clusters(keyed.select("query_id", "features", "record_key", "terms"), config, n_rows)
    placed = materialise(fitted.clusters_of(fitted.placed).select("record_key", "coarse_id", "cluster_id"), "record-clusters")
    labelled = materialise(keyed.join(placed, "record_key").drop("record_key"), "clustered")
    details, top = P.cluster_details(labelled, fitted.offsets, fitted.info)
    return Clustered(
        labelled, low, high, embed_model, fitted.info, materialise(details, "cluster-details"), materialise(top, "top-features")
    )


def fit_router(
    items: DataFrame,
    models: Models,
    config: RouterConfig,
    prepared: DataFrame | None = None,
    shared: dict[tuple, Clustered] | None = None,
) -> Router:
    """Fit on (query_id, text, features, quality [, embedding]).

    ``prepared`` may hand in stored output of ``prepare`` to be shared by several fits.  So may
    ``shared``, a dictionary that belongs to these rows: fits that agree in the settings of
    the clustering use one of them."""
    m = len(models)
    if prepared is None:
        ready = prepare(items, config).select("query_id", "features", "embedding", "quality")
        prepared = materialise(C.with_keys(ready), "prepared")
    shared = {} if shared is None else shared
    if config.clustering not in shared:
        shared[config.clustering] = cluster_training(prepared, models, config)
    clustered = shared[config.clustering]
    labelled, low, high = clustered.rows, clustered.low, clustered.high
    resolved = materialise(
        P.resolve_probs(
            P.mean_quality(labelled, models),
            models,
            objective=config.objective,
            beta=config.utility_beta,
            threshold=config.quality_threshold,
            temperature=config.prob_temp,
        ),
        "cluster-model-probs",
    )

    quality = rows.entries("quality", m)
    target = S.training_target(
        quality,
        rows.entries("soft", m),
        S.row_labels(quality, models, config.objective, config.quality_threshold),
        models,
        alpha=config.cost_weight,
        tau=config.softmax_temperature,
        gamma=config.blend_costaware,
        beta=config.beta,
    )
    rows_in = S.cluster_labels(labelled, resolved, models).withColumn("target", F.array(*target))

    training = rows_in.select(
        "query_id", "terms", F.col("embedding").alias("dense"), "target"
    )
    dims = len(low)
    scale, network = (config.beta, 1.0 - config.beta), None
    if config.hidden_units is not None:
        network = N.fit(training, dims, m, config.hidden_units, scale, seed=config.seed)
        weights = labelled.sparkSession.createDataFrame([], "term long, w array<double>")
    else:
        weights = X.fit(training, dims, m, config.fit_iterations, scale)
    dense = sorted(weights.where(F.col("term").between(0, dims)).collect(), key=lambda r: r["term"])  # dims + 1 rows
    pairs = labelled.select(F.explode_outer("features").alias("key", "value")).where("key is not null").distinct()
    return Router(
        models=models,
        config=config,
        coefficients=materialise(X.feature_weights(pairs, weights), "coefficients"),
        dense=[list(r["w"]) for r in dense],
        low=low,
        high=high,
        embed_model=clustered.embed_model,
        cluster_probs=resolved,
        cluster_info=clustered.info,
        cluster_details=clustered.details,
        top_features=clustered.top_features,
        network=network,
    )
