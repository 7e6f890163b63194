"""The network against its derivative, on data that no linear model explains, and in parts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from switchyard.operators import network as N
from switchyard.operators import softmax as X

ROWS = "query_id long, terms array<long>, dense array<double>, target array<double>"


def crossed(rng, n):
    """The class is whether two numbers agree in sign; the feature says nothing."""
    rows = []
    for i in range(n):
        a, b = rng.normal(0, 1, 2)
        share = 0.9 if a * b > 0 else 0.1
        rows.append((i, [1000 + int(rng.integers(0, 5))], [float(a), float(b)], [share, 1 - share]))
    return rows


def divergence(df, probs):
    apart = F.aggregate(F.zip_with("target", probs, lambda t, p: t * (F.log(t) - F.log(p))), F.lit(0.0), lambda a, x: a + x)
    return df.select(F.avg(apart)).first()[0]


def test_slope_is_the_derivative():
    rng = np.random.default_rng(0)
    network = N.Network.begin(3, 4, (5, 6), (0.7, 0.3), 1)
    x = network.inputs([[1, 2], [], None, [-3]], rng.normal(size=(4, 3)))
    target = X.row_softmax(rng.normal(size=(4, 4)))
    at = network.weights + rng.normal(0, 0.1, len(network.weights))
    _, slope = network.loss(x, target, at)
    for place in rng.choice(len(at), 60, replace=False):
        step = np.zeros_like(at)
        step[place] = 1e-6
        found = (network.loss(x, target, at + step)[0] - network.loss(x, target, at - step)[0]) / 2e-6
        assert slope[place] == pytest.approx(found, abs=1e-5)


@pytest.mark.parametrize("size", [1 << 14, 500])
def test_explains_what_a_regression_cannot(spark, monkeypatch, size):
    monkeypatch.setattr(N, "PART_ROWS", size)
    rng = np.random.default_rng(1)
    train, held = (spark.createDataFrame(crossed(rng, n), ROWS) for n in (2000, 500))
    network = N.fit(train, 2, 2, hidden=(32, 16))
    weights = X.fit(train, 2, 2, 50).collect()
    dense = [list(r.w) for r in sorted(weights, key=lambda r: r.term) if 0 <= r.term <= 2]
    zero = F.array(F.lit(0.0), F.lit(0.0))
    linear = held.withColumn("p", X.probabilities(F.col("dense"), F.lit(0), zero, dense, (1.0, 1.0)))
    deep = held.withColumn("p", network.probabilities(F.col("terms"), F.col("dense")))
    assert divergence(deep, "p") < 0.1 < 0.3 < divergence(linear, "p")


def test_same_weights_on_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(N, "PART_ROWS", 200)
    df = spark.createDataFrame(crossed(np.random.default_rng(2), 700), ROWS)
    one, two = (N.fit(d, 2, 2, hidden=(8, 4), rounds=2, steps=5) for d in (df, df.repartition(6)))
    assert np.array_equal(one.weights, two.weights)
    assert not np.array_equal(one.weights, N.fit(df, 2, 2, hidden=(8, 4), rounds=2, steps=5, seed=7).weights)
    read = N.Network.read(one.frame(spark))
    assert np.array_equal(read.weights, one.weights) and read.sizes == one.sizes and read.scale == one.scale


def test_odd_inputs(spark):
    none = spark.createDataFrame([], ROWS)
    network = N.fit(none, 2, 3, hidden=(4,), rounds=2)
    assert np.array_equal(network.weights, N.Network.begin(2, 3, (4,), (1.0, 1.0), 42).weights)
    df = spark.createDataFrame([(1, None, [0.0, 1.0], None), (2, [], [0.0, 1.0], None)], ROWS)
    a, b = (r.p for r in df.select(network.probabilities(F.col("terms"), F.col("dense")).alias("p")).collect())
    assert a == b and sum(a) == pytest.approx(1)
    assert none.select(network.probabilities(F.col("terms"), F.col("dense"))).count() == 0
    with pytest.raises(ValueError):
        N.Network.begin(1 << 20, 2, (256,), (1.0, 1.0), 1)
