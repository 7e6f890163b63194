"""Soft labels and the cost-aware training target.

All of it is per query over one array entry per model, so every function maps
Columns to Columns and no step shuffles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.functions import rows
from switchyard.models import Models

MIN_COST = 1e-6
MIN_TEMPERATURE = 1e-6
MIN_MAX_COST = 1e-12


def cheapest_passing(quality: list[Column], models: Models, threshold: float | Column, fallback: list[Column]) -> list[Column]:
    """Weights 1/cost over the models reaching the threshold, else ``fallback``."""
    weights = [
        F.when(q >= threshold, 1.0 / max(c, MIN_COST)).otherwise(0.0) for q, c in zip(quality, models.costs)
    ]
    total = rows.total(weights)
    return [F.when(total > 0, w / total).otherwise(f) for w, f in zip(weights, fallback)]


def row_min_cost(quality: list[Column], models: Models, threshold: float | Column) -> list[Column]:
    """Soft label of a query: cheap models that are good enough; none -> the cheapest."""
    cheapest = [F.lit(1.0 if i == models.cheapest else 0.0) for i in range(len(models))]
    return cheapest_passing(quality, models, threshold, cheapest)


def row_utility(quality: list[Column]) -> list[Column]:
    """Soft label of a query: all on the best quality; all equal -> uniform."""
    same = rows.row_max(quality) == rows.row_min(quality)
    best = rows.argmax(quality)
    uniform = 1.0 / len(quality)
    return [F.when(same, F.lit(uniform)).otherwise(hot) for hot in rows.one_hot(best, len(quality))]


def row_labels(quality: list[Column], models: Models, objective: str, threshold: float | Column) -> list[Column]:
    return row_min_cost(quality, models, threshold) if objective == "min_cost" else row_utility(quality)


def cluster_labels(queries: DataFrame, cluster_probs: DataFrame, models: Models, name: str = "soft") -> DataFrame:
    """Add the soft label of the query's cluster; an unknown cluster -> model 0.

    ``cluster_probs`` is (cluster_id, probs array), one row per cluster; the
    engine broadcasts it when its size allows and shuffles otherwise.
    """
    first = F.array(*[F.lit(1.0 if i == 0 else 0.0) for i in range(len(models))])
    probs = cluster_probs.select("cluster_id", F.col("probs").alias("_probs"))
    return queries.join(probs, "cluster_id", "left").withColumn(name, F.coalesce("_probs", first)).drop("_probs")


def blend(left: list[Column], right: list[Column], weight: float | Column) -> list[Column]:
    """weight * left + (1 - weight) * right."""
    return [weight * a + (1.0 - weight) * b for a, b in zip(left, right)]


def normalised_costs(models: Models) -> list[float]:
    """Cost over the dearest model's cost."""
    top = max(MIN_MAX_COST, models.max_cost)
    return [c / top for c in models.costs]


def cost_aware(
    quality: list[Column], models: Models, alpha: float | Column = 0.5, tau: float | Column = 0.5
) -> list[Column]:
    """softmax((quality - alpha * normalised cost) / tau)."""
    floor = F.greatest(F.lit(MIN_TEMPERATURE), tau) if isinstance(tau, Column) else max(MIN_TEMPERATURE, tau)
    return rows.softmax([q - alpha * c for q, c in zip(quality, normalised_costs(models))], floor)


def training_target(
    quality: list[Column],
    cluster_soft: list[Column],
    row_soft: list[Column],
    models: Models,
    *,
    alpha: float | Column = 0.5,
    tau: float | Column = 0.5,
    gamma: float | Column = 0.5,
    beta: float | Column = 0.5,
) -> list[Column]:
    """gamma * cost-aware target + (1 - gamma) * blended branch labels."""
    return blend(cost_aware(quality, models, alpha, tau), blend(cluster_soft, row_soft, beta), gamma)


def kl_divergence(target: list[Column], log_probs: list[Column]) -> Column:
    """sum(y * (ln y - log p)) of one query, with 0 * ln 0 = 0."""
    return rows.total([F.when(y > 0, y * (F.log(y) - lp)).otherwise(0.0) for y, lp in zip(target, log_probs)])
