"""Targets, metrics, calibration and frontier on small hand-made data."""

import math

import numpy as np
import pytest
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from switchyard.config import RouterConfig
from switchyard.functions import rows
from switchyard.models import Models
from switchyard.operators import calibrate as K
from switchyard.operators import evaluate as G
from switchyard.operators import targets as S
from switchyard.plans.grid import configs
from switchyard.plans.report import evaluate, report

THREE = Models(("a", "b", "c"), (1.0, 2.0, 4.0))
TWO = Models(("a", "b"), (1.0, 2.0))


def first_array(df, cols):
    return df.select(F.array(*cols)).first()[0]


def test_argmax_and_softmax(spark):
    df = spark.sql("select array(0.2d, 0.4d, 0.4d) as p, array(1000d, 0d, -1000d) as x")
    assert df.select(rows.argmax(rows.entries("p", 3))).first()[0] == 1
    assert first_array(df, rows.softmax(rows.entries("x", 3))) == [1.0, 0.0, 0.0]
    one = spark.sql("select array(3d) as p")
    assert first_array(one, rows.softmax(rows.entries("p", 1))) == [1.0]


def test_row_labels(spark):
    df = spark.sql("select array(1d,1d,1d) as same, array(0d,1d,1d) as some, array(0d,0d,0d) as none")
    assert np.allclose(first_array(df, S.row_utility(rows.entries("same", 3))), [1 / 3] * 3)
    assert first_array(df, S.row_utility(rows.entries("some", 3))) == [0, 1, 0]
    assert np.allclose(first_array(df, S.row_min_cost(rows.entries("some", 3), THREE, 0.5)), [0, 2 / 3, 1 / 3])
    odd = Models(("a", "b", "c"), (3.0, 1.0, 2.0))
    assert first_array(df, S.row_min_cost(rows.entries("none", 3), odd, 0.5)) == [0, 1, 0]
    free = Models(("a", "b", "c"), (0.0, 1.0, 2.0))
    assert math.isclose(sum(first_array(df, S.row_min_cost(rows.entries("same", 3), free, 0.5))), 1.0)


def test_kl(spark):
    df = spark.sql("select array(0.5d, 0.5d, 0d) as y, array(0.25d, 0.5d, 0.25d) as p")
    kl = S.kl_divergence(rows.entries("y", 3), [F.log(p) for p in rows.entries("p", 3)])
    assert math.isclose(df.select(kl).first()[0], 0.5 * math.log(2))


def log(spark, labels, preds, confs=None):
    confs = confs or [1.0] * len(labels)
    return spark.createDataFrame(list(zip(labels, preds, confs)), "label int, pred int, conf double")


def tally(spark, labels, preds, models):
    cell = G.cells(log(spark, labels, preds), models)
    return cell, G.tally(cell, models)


def test_confusion_and_mcc(spark):
    cell, t = tally(spark, [0, 0, 1], [0, 1, 1], TWO)
    per = {r.model_idx: r for r in G.per_model(t, TWO).collect()}
    assert (per[0].precision, per[0].recall, per[1].precision, per[1].recall) == (1.0, 0.5, 0.5, 1.0)
    assert math.isclose(t.select(G.matthews(2)).first()[0], 0.5)
    assert G.confusion(cell, THREE).count() == 9
    _, single = tally(spark, [0, 0], [0, 0], TWO)
    assert single.select(G.matthews(2)).first()[0] == 0.0


def test_against_spark_evaluator(spark):
    rng = np.random.default_rng(5)
    labels, preds = rng.integers(0, 3, 300).tolist(), rng.integers(0, 3, 300).tolist()
    _, t = tally(spark, labels, preds, THREE)
    df = log(spark, labels, preds).select(F.col("label").cast("double"), F.col("pred").cast("double").alias("prediction"))
    for metric, column in (("f1", G.weighted_f1(3)), ("accuracy", G.top1_accuracy(3))):
        want = MulticlassClassificationEvaluator(metricName=metric).evaluate(df)
        assert math.isclose(t.select(column).first()[0], want, rel_tol=1e-12)


def test_calibration(spark):
    bins = K.calibration_bins(log(spark, [1, 1], [1, 0], [0.95, 0.95]))
    error = K.calibration_error(bins).first()
    assert math.isclose(error.ece, 0.45) and math.isclose(error.mce, 0.45)
    edges = K.calibration_bins(log(spark, [0] * 5, [0] * 5, [0.0, 0.1, 0.3, 0.30000000000000004, 1.0]))
    assert {r.bin: r.n for r in edges.collect() if r.n} == {0: 1, 1: 1, 2: 1, 3: 1, 9: 1}


def predictions(spark, n=400, seed=1, unlabelled=7):
    rng = np.random.default_rng(seed)
    probs = rng.dirichlet([0.6, 0.8, 0.5], n)
    labels = [None if i % unlabelled == 0 else int(rng.choice(3, p=0.5 * probs[i] + 0.5 / 3)) for i in range(n)]
    costs = rng.random((n, 3)) + np.array([0, 1, 2])
    quality = rng.integers(0, 2, (n, 3)).astype(float)
    data = [
        (i, f"g{i % 4}", probs[i].tolist(), labels[i], quality[i].tolist(), costs[i].tolist()) for i in range(n)
    ]
    schema = "query_id long, eval_name string, probs array<double>, label int, quality array<double>, cost array<double>"
    return spark.createDataFrame(data, schema), probs, labels, quality, costs


def test_temperature_has_the_least_nll(spark):
    df, *_ = predictions(spark)
    found = K.fit_temperature(df, THREE)
    scan = [found * (1 + d) for d in (-0.5, -0.1, -0.01, -0.001, 0.001, 0.01, 0.1, 1.0)]
    nll = {r.temperature: r.nll for r in K.nll_by_temperature(df, THREE, [*scan, found]).collect()}
    assert all(nll[found] <= nll[t] for t in scan) and 0.5 < found < 5


def test_temperature_at_the_ends(spark):
    """Always right: as sharp as allowed; always wrong: as flat as allowed; nothing known: unchanged."""
    df, probs, *_ = predictions(spark, n=60)
    best = F.expr("cast(array_position(probs, array_max(probs)) - 1 as int)")
    worst = F.expr("cast(array_position(probs, array_min(probs)) - 1 as int)")
    assert K.fit_temperature(df.withColumn("label", best), THREE) == K.TEMPERATURE_FLOOR
    assert math.isclose(K.fit_temperature(df.withColumn("label", worst), THREE), 1000.0)
    assert K.fit_temperature(df.withColumn("label", F.lit(None).cast("int")), THREE) == 1.0


def test_frontier_matches_brute_force(spark):
    df, probs, labels, _, costs = predictions(spark)
    out = G.outcomes(df, THREE)
    known = np.array([y is not None for y in labels])
    y = np.array([labels[i] for i in np.flatnonzero(known)])
    conf, pred, cost = probs.max(axis=1)[known], probs.argmax(axis=1)[known], costs[known]
    got = {round(r.tau, 2): r for r in K.frontier(K.frontier_cells(out, THREE), 1).collect()}
    assert len(got) == 51
    for i in range(51):
        chosen = np.where(conf >= i * 0.02, pred, 1)
        r = got[round(i * 0.02, 2)]
        assert math.isclose(r.acc, (chosen == y).mean(), abs_tol=1e-12)
        assert math.isclose(r.cost, cost[np.arange(len(y)), chosen].mean(), abs_tol=1e-12)


def test_evaluate(spark):
    df, probs, labels, quality, costs = predictions(spark)
    m = evaluate(df, THREE).first().asDict()
    pred = probs.argmax(axis=1)
    n = len(labels)
    assert math.isclose(m["avg_cost"], costs[np.arange(n), pred].mean())
    assert math.isclose(m["avg_quality"], quality[np.arange(n), pred].mean())
    assert math.isclose(m["oracle_quality"], quality.max(axis=1).mean())
    known = [i for i, v in enumerate(labels) if v is not None]
    assert math.isclose(m["top1_acc"], np.mean([pred[i] == labels[i] for i in known]))
    assert m["top3_acc"] == 1.0 and "top5_acc" not in m
    assert math.isclose(sum(m[f"route_{k}"] for k in "abc"), 1.0)


def test_report_is_complete(spark):
    df, *_ = predictions(spark, 120)
    tables = report(df, THREE, RouterConfig(fallback_strategy="name", fallback_model="c"))
    assert tables["confusion_matrix"].count() == 9 and tables["frontier_points"].count() == 51
    assert tables["frontier_fallback"].first().model == "c"
    assert tables["subgroups"].count() == 4 and tables["calibration"].count() == 10


def test_costs_fall_back_to_the_mean(spark):
    data = [(1, [0.1, 0.9], 1, [5.0, None]), (2, [0.9, 0.1], None, None), (3, [0.9, 0.1], 0, [7.0])]
    df = spark.createDataFrame(data, "query_id long, probs array<double>, label int, cost array<double>")
    got = {r.query_id: r.chosen_cost for r in G.outcomes(df, TWO).collect()}
    assert got == {1: 2.0, 2: 1.0, 3: 1.0}


@pytest.mark.parametrize("labelled", [False, True])
def test_empty_input(spark, labelled):
    df, *_ = predictions(spark, 10)
    empty = df.withColumn("label", F.lit(None).cast("int")) if labelled else df.limit(0)
    m = evaluate(empty, THREE).first().asDict()
    assert m["n_labelled"] == 0 and m["top1_acc"] is None and m["mcc"] is None
    assert (m["avg_cost"] is None) == (not labelled)


def test_matched_baseline_none(spark):
    _, t = tally(spark, [0, 1, 2], [0, 1, 2], THREE)
    with_cost = t.withColumn("cost_sum", F.lit(3.0))
    row = G.matched_baseline(with_cost, THREE).first()
    assert (row.model_idx, row.model, row.cost, row.cost_ratio, row.meets) == (-1, "none", float("inf"), 0.0, 1.0)


def test_config_and_grid():
    assert RouterConfig(lambda_soft=0.8).beta == 0.8
    assert RouterConfig(lambda_soft=0.8, fusion_beta=0.5).beta == 0.5
    assert RouterConfig(fusion_beta=3.0).beta == 1.0
    assert RouterConfig().coarse_count(1000) == 16 and RouterConfig().coarse_count(5) == 5
    with pytest.raises(ValueError):
        RouterConfig(embed_k=0)
    grid = configs(RouterConfig(), [0.2, 0.5, 0.8], [0.4, 0.6, 0.8], fusion_betas=[None])
    assert len(grid) == 9 and {c.beta for c in grid} == {0.2, 0.5, 0.8}
