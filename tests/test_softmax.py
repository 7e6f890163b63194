"""The multinomial fit against its definition, over few and many features, one part and several."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchyard.operators import softmax as X

ROWS = "query_id long, terms array<long>, dense array<double>, target array<double>"


def made(rng, n, features=30, dims=3, m=4):
    """Rows whose targets a linear model explains."""
    weights, slopes = rng.normal(0, 2, (features, m)), rng.normal(0, 1, (dims, m))
    rows = []
    for i in range(n):
        own = np.sort(rng.choice(features, rng.integers(0, 6), replace=False))
        dense = rng.normal(0, 1, dims)
        margins = weights[own].sum(axis=0) / np.sqrt(max(1, len(own))) + dense @ slopes
        rows.append((i, [int(1000 + t) for t in own], dense.tolist(), X.row_softmax(margins[None])[0].tolist()))
    return rows


def divergence(rows, weights, dims):
    """The mean divergence of what the weights answer, row by row."""
    by_term, total = {r.term: np.array(r.w) for r in weights}, 0.0
    for _, terms, dense, target in rows:
        known = [by_term[t] for t in terms if t in by_term]
        margins = by_term[dims] + np.array(dense) @ np.stack([by_term[i] for i in range(dims)])
        margins = margins + (np.sum(known, axis=0) / np.sqrt(len(known)) if known else 0.0)
        p, t = X.row_softmax(margins[None])[0], np.array(target)
        total += (t * np.log(np.maximum(t, 1e-300) / p)).sum()
    return total / len(rows)


def test_slope_is_the_derivative():
    rng = np.random.default_rng(0)
    rows = made(rng, 40, features=8)
    known = np.arange(1000, 1008)
    part = X.Part([np.array(t, np.int64) for _, t, *_ in rows], np.array([d for *_, d, _ in rows]), np.array([t for *_, t in rows]), known, (0.7, 0.3))
    at = rng.normal(0, 1, (8 + 4, 4))
    _, slope = part.loss(at)
    for place in ((0, 0), (5, 2), (8, 1), (11, 3)):
        step = np.zeros_like(at)
        step[place] = 1e-6
        assert slope[place] == pytest.approx((part.loss(at + step)[0] - part.loss(at - step)[0]) / 2e-6, abs=1e-6)


def test_common_terms_are_columns_of_a_matrix():
    """Only the terms that few rows have are left to the sparse block; both add up as by definition."""
    rng = np.random.default_rng(3)
    n, known = 200, np.arange(1000, 1000 + 20 + 200)
    rows = [np.append(np.flatnonzero(rng.random(20) < 0.7) + 1000, 1020 + i) for i in range(n)]
    dense, target = rng.normal(0, 1, (n, 2)), X.row_softmax(rng.normal(0, 1, (n, 3)))
    part = X.Part(rows, dense, target, known, (0.6, 0.4))
    assert len(part.row) == n and part.block.shape == (n, 20)
    weights = rng.normal(0, 1, (len(known) + 3, 3))
    plain = [0.4 * dense[i] @ weights[-3:-1] + weights[-1] + 0.6 * weights[rows[i] - 1000].sum(axis=0) / np.sqrt(len(rows[i])) for i in range(n)]
    assert np.allclose(part.margins(weights), plain)


def test_minimum_of_a_quadratic():
    scale = np.array([1.0, 10.0, 100.0])
    found = X.minimise(lambda x: (float((scale * (x - 3) ** 2).sum() / 2), scale * (x - 3)), np.zeros(3), 100)
    assert np.allclose(found, 3, atol=1e-4)


@pytest.mark.parametrize("size", [1 << 14, 150])
def test_fit_explains_its_targets(spark, monkeypatch, size):
    """One part finds the weights, several agree on nearly as good ones; partitioning decides nothing."""
    monkeypatch.setattr(X, "PART_ROWS", size)
    rows = made(np.random.default_rng(1), 600)
    df = spark.createDataFrame(rows, ROWS)
    fits = [X.fit(d, 3, 4, 200).collect() for d in (df, df.repartition(5))]
    assert divergence(rows, fits[0], 3) < (1e-3 if size > 600 else 0.03)
    one, two = ({r.term: r.w for r in f} for f in fits)
    assert one.keys() == two.keys() and all(np.allclose(one[t], two[t], atol=1e-6) for t in one)


def test_more_features_than_rows_of_a_part(spark, monkeypatch):
    """Every row brings features of its own; parts hold only theirs."""
    monkeypatch.setattr(X, "PART_ROWS", 1000)
    n = 4000
    rows = spark.range(n).select(
        F.col("id").alias("query_id"),
        F.array_sort(F.array(*[F.col("id") * 50 + 100 + j for j in range(50)])).alias("terms"),
        F.array(F.lit(1.0)).alias("dense"),
        F.when(F.col("id") % 3 == 0, F.array(F.lit(1.0), F.lit(0.0))).otherwise(F.array(F.lit(0.0), F.lit(1.0))).alias("target"),
    )
    weights = X.fit(rows, 1, 2, 10)
    assert weights.count() == 50 * n + 2
    right = weights.where("term >= 100").select((((F.col("term") - 100) / 50).cast("long") % 3 == 0).alias("first"), (F.col("w")[0] > F.col("w")[1]).alias("more"))
    assert right.where("first != more").isEmpty()


def test_scores_follow_the_weights(spark):
    weights = {("a", "1"): [1.0, 0.0], ("b", "2"): [0.0, 3.0]}
    coefficients = spark.createDataFrame([(k, v, w) for (k, v), w in weights.items()], "key string, value string, w array<double>")
    rows = [("x", {"a": "1", "b": "2", "c": "3"}), ("y", {"c": "3"}), ("z", {}), ("w", None)]
    records = spark.createDataFrame(rows, "record_key string, features map<string,string>")
    df = records.join(X.sparse_sums(records, coefficients, 2), "record_key", "left").withColumn("dense", F.array(F.lit(2.0)))
    probs = X.probabilities(F.col("dense"), F.col("known"), F.col("sums"), [[0.5, 0.0], [0.1, 0.2]], (0.6, 0.4))
    got = {r.record_key: r.p for r in df.select("record_key", probs.alias("p")).collect()}
    base = np.array([0.4 * 2 * 0.5 + 0.1, 0.2])
    assert np.allclose(got["x"], X.row_softmax((base + 0.6 / np.sqrt(2) * np.array([1.0, 3.0]))[None])[0])
    assert all(np.allclose(got[k], X.row_softmax(base[None])[0]) for k in "yzw")


def test_no_rows_give_no_weights(spark):
    assert X.fit(spark.createDataFrame([], ROWS), 3, 4, 5).count() == 0


def test_weights_do_not_depend_on_the_order_of_parts(spark, monkeypatch):
    """Each part is a task's at most, and their sums, with which the next round begins, are the same in any order."""
    monkeypatch.setattr(X, "PART_ROWS", 40)
    df = spark.createDataFrame(made(np.random.default_rng(7), 400), ROWS)
    found = []
    for tasks in (2, 3, 11):
        monkeypatch.setattr(X, "task_count", lambda _, n=tasks: n, raising=False)
        found.append({r.term: tuple(r.w) for r in X.fit(df, 3, 4, 15).collect()})
    assert found[0] == found[1] == found[2]
    parts = df.withColumn("part", (F.col("query_id") % 5).cast("int"))
    wanted = parts.select("part", F.explode("terms").alias("term")).distinct()
    plan = X._round(parts, wanted, None, 3, 4, 2, (1.0, 1.0))._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan
