"""Evaluation of predictions: the flat metrics row and the full report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from switchyard.config import RouterConfig
from switchyard.functions import rows
from switchyard.models import Models
from switchyard.operators import calibrate as K
from switchyard.operators import evaluate as G
from switchyard.session import materialise


def evaluate(preds: DataFrame, models: Models) -> DataFrame:
    """One row: totals over all rows, route shares and baselines."""
    t = G.tally(G.cells(G.outcomes(preds, models), models), models)
    fixed = G.fixed_arrays(t, models)
    return fixed.select(*G.overall_columns(t, models), *G.baseline_columns(t, models))


def report(preds: DataFrame, models: Models, config: RouterConfig) -> dict[str, DataFrame]:
    """All report tables over the labelled rows of (query_id, eval_name, probs,
    label, quality, cost).

    The predictions are read once for the cells and once per confidence
    histogram; everything after that works on tables of at most a few hundred
    rows.  ``preds`` should be stored, it is read several times.
    """
    m = len(models)
    out = G.labelled(G.outcomes(preds, models))
    cell = materialise(G.cells(out, models), "cells")
    t = materialise(G.tally(cell, models), "tally")
    fixed = G.fixed_arrays(t, models)

    temperature = K.fit_temperature(out, models) if config.enable_calibration else 1.0
    scaled = out.withColumn("probs_t", F.array(*K.recalibrated(rows.entries("probs", m), temperature)))
    scaled = scaled.withColumn("conf_t", rows.row_max(rows.entries("probs_t", m)))
    # The recalibrated prediction is the same: softmax keeps the order.
    bins, bins_t = K.calibration_bins(out), K.calibration_bins(scaled, conf="conf_t")

    choice = G.fallback(t, models, config.fallback_strategy, config.fallback_model)
    fallback_idx = int(choice.first()["model_idx"] or 0)
    points = materialise(
        K.frontier(K.frontier_cells(scaled, models, conf="conf_t"), fallback_idx), "frontier"
    )
    return {
        "overall": fixed.select(*G.overall_columns(t, models)),
        "route_ratio": G.route_ratio(t, models, of_labelled=True),
        "per_model": G.per_model(t, models),
        "confusion_matrix": G.confusion(cell, models),
        "calibration": bins,
        "calibration_error": K.calibration_error(bins),
        "calibration_after_temperature": bins_t,
        "calibration_error_after_temperature": K.calibration_error(bins_t).withColumn(
            "temperature", F.lit(temperature)
        ),
        "baselines_fixed": G.fixed_baselines(t, models),
        "baselines_best_fixed": G.best_fixed(t, models),
        "baselines_oracle_cost": G.oracle_cost(t),
        "frontier_points": points,
        "frontier_best": K.best_point(points),
        "frontier_fallback": choice,
        "subgroups": G.subgroups(out, models),
    }
