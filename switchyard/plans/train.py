"""Split, fit, route, evaluate and store - the training job."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.config import RouterConfig
from switchyard.models import Models
from switchyard.operators import profiles as P
from switchyard.operators.clusters import KEYS, with_keys
from switchyard.operators.routing import Router, fit_router, prepare
from switchyard.operators.split import exact_split
from switchyard.plans.report import evaluate, report
from switchyard.session import materialise
from switchyard.sources import runs


@dataclass
class Trained:
    router: Router
    predictions: DataFrame
    metrics: DataFrame
    tables: dict[str, DataFrame]


def prepare_items(items: DataFrame, config: RouterConfig, annotations: DataFrame | None = None) -> DataFrame:
    """Derive features and embeddings once and store them, with their keys, without the text.

    Keeps eval_name from the given features for the subgroups.
    """
    named = items.drop(*KEYS).withColumn("eval_name", F.col("features")["eval"])
    return materialise(with_keys(prepare(named, config, annotations)), "items")


def train_and_evaluate(
    items: DataFrame,
    models: Models,
    config: RouterConfig,
    val_ratio: float = 0.2,
    prepared: DataFrame | None = None,
    full_report: bool = True,
    shared: dict | None = None,
    annotations: DataFrame | None = None,
) -> Trained:
    """Fit on the training part, evaluate on the rest.

    ``items``: (query_id, text, features, label, quality, costs).  A stored
    ``prepared`` table and a dictionary ``shared`` of clusterings can be shared by the
    jobs of a grid; ``annotations`` are (query_id, annotations) for the feature maps.
    """
    if prepared is None:
        prepared = prepare_items(items, config, annotations)
    split = exact_split(prepared, "query_id", val_ratio, config.seed)
    train = split.where(F.col("split") == "train").drop("split")
    validation = split.where(F.col("split") == "validation").drop("split")
    router = fit_router(items, models, config, prepared=train, shared=shared)
    predictions = materialise(router.score(validation.drop(*KEYS).withColumnRenamed("costs", "cost")), "predictions")
    return Trained(
        router=router,
        predictions=predictions,
        metrics=evaluate(predictions, models),
        tables=report(predictions, models, config) if full_report else {},
    )


def log_run(trained: Trained, path: str, run_id: str) -> None:
    """Metrics with the settings, report tables and cluster tables of a run."""
    spark = trained.predictions.sparkSession
    router = trained.router
    rows = runs.metric_rows(trained.metrics, run_id).unionByName(
        runs.config_rows(spark, run_id, router.config.as_dict())
    )
    runs.log_metrics(rows, f"{path}/metrics")
    runs.write_tables(trained.tables, f"{path}/report", run_id)
    runs.write_tables(
        {
            "summary": P.summary(router.cluster_probs),
            "profiles": router.cluster_probs,
            "info": router.cluster_info,
            "details": router.cluster_details,
            "top_features": router.top_features,
        },
        f"{path}/clusters",
        run_id,
    )


def refit(
    items: DataFrame, models: Models, config: RouterConfig, path: str | None = None, prepared: DataFrame | None = None
) -> Router:
    """Fit on all rows, or on the stored ``prepared`` ones of all, and store the router."""
    router = fit_router(items, models, config, prepared)
    if path is not None:
        router.save(path)
    return router
