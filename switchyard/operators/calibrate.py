"""Confidence calibration, temperature fit and the cost/accuracy frontier."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from switchyard.functions import rows
from switchyard.models import Models
from switchyard.operators.evaluate import EPSILON

BINS = 10
CUTS = 50  # frontier cut-offs 0, 1/50, ..., 1
TEMPERATURE_FLOOR = 1e-3


def bin_of(conf: Column, bins: int = BINS) -> Column:
    """Equal-width bin on [0, 1]; an edge belongs to the upper bin and 1.0 to
    the last one.  Edges are i * (1/bins) in double arithmetic."""
    chain = F.when(conf < 1 * (1.0 / bins), 0)
    for i in range(2, bins):
        chain = chain.when(conf < i * (1.0 / bins), i - 1)
    return chain.otherwise(bins - 1)


def calibration_bins(out: DataFrame, bins: int = BINS, conf: str = "conf") -> DataFrame:
    """(bin, n, mean_conf, mean_acc) over labelled rows; empty bins are 0, 0, 0."""
    hit = F.when(F.col("pred") == F.col("label"), 1).otherwise(0)
    counted = (
        out.where(F.col("label").isNotNull())
        .groupBy(bin_of(F.col(conf), bins).alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum(conf).alias("conf_sum"), F.sum(hit).alias("hits"))
    )
    empty = out.sparkSession.range(bins).select(
        F.col("id").cast("int").alias("bin"),
        F.lit(0).cast("bigint").alias("n"),
        F.lit(0.0).alias("conf_sum"),
        F.lit(0).cast("bigint").alias("hits"),
    )
    total = counted.unionByName(empty).groupBy("bin").agg(*[F.sum(c).alias(c) for c in ("n", "conf_sum", "hits")])
    at_least_one = F.greatest(F.lit(1), F.col("n"))
    return total.select(
        "bin",
        "n",
        (F.col("conf_sum") / at_least_one).alias("mean_conf"),
        (F.col("hits") / at_least_one).alias("mean_acc"),
    )


def calibration_error(bins: DataFrame) -> DataFrame:
    """(ece, mce): mean gap weighted by bin size, and the largest gap."""
    gap = F.abs(F.col("mean_conf") - F.col("mean_acc"))
    total = F.greatest(F.lit(1), F.sum("n"))
    return bins.agg(
        (F.sum(F.col("n") * gap) / total).alias("ece"),
        F.max(F.when(F.col("n") > 0, gap).otherwise(0.0)).alias("mce"),
    )


# --- temperature ------------------------------------------------------------------


def centred_logits(probs: list[Column]) -> list[Column]:
    """Log probabilities minus their mean."""
    return rows.centred([F.log(F.greatest(p, F.lit(1e-300))) for p in probs])


def recalibrated(probs: list[Column], temperature: float | Column) -> list[Column]:
    """softmax of the centred log probabilities over T."""
    floor = temperature if isinstance(temperature, Column) else max(temperature, TEMPERATURE_FLOOR)
    return rows.softmax(centred_logits(probs), floor)


def _labelled_logits(out: DataFrame, m: int) -> DataFrame:
    z = centred_logits(rows.entries("probs", m))
    return out.where(F.col("label").isNotNull()).select("label", F.array(*z).alias("z"))


def _at_temperatures(logits: DataFrame, temperatures: list[float]) -> DataFrame:
    """Each row once per temperature of a short list; the sums that follow are
    taken per temperature inside the task."""
    values = F.array(*[F.lit(max(float(t), TEMPERATURE_FLOOR)) for t in temperatures])
    return logits.select("label", "z", F.posexplode(values).alias("i", "t"))


def nll_by_temperature(out: DataFrame, models: Models, temperatures: list[float]) -> DataFrame:
    """(temperature, nll): mean negative log-likelihood of the labels, for
    several temperatures in one pass."""
    m = len(models)
    probs = rows.softmax(rows.entries("z", m), F.col("t"))
    return (
        _at_temperatures(_labelled_logits(out, m), temperatures)
        .groupBy(F.col("t").alias("temperature"))
        .agg(F.avg(-F.log(rows.pick(probs, F.col("label")))).alias("nll"))
    )


def _slopes(logits: DataFrame, m: int, temperatures: list[float]) -> list[float | None]:
    """T * T times d NLL / dT at several temperatures, in one distributed pass."""
    z = rows.entries("z", m)
    expected = rows.total([p * c for p, c in zip(rows.softmax(z, F.col("t")), z)])
    slope = rows.pick(z, F.col("label")) - expected
    found = _at_temperatures(logits, temperatures).groupBy("i").agg(F.avg(slope).alias("s")).collect()
    at = {r["i"]: r["s"] for r in found}  # one number per temperature
    return [at.get(i) for i in range(len(temperatures))]


def fit_temperature(
    out: DataFrame, models: Models, *, low: float = TEMPERATURE_FLOOR, high: float = 1000.0, nodes: int = 16, tolerance: float = 1e-7
) -> float:
    """The temperature in [``low``, ``high``] with the least NLL; 1 without labelled rows.

    The expected logit falls as the temperature rises, so the slope changes its sign once
    at most, from falling to rising NLL.  Each pass measures it at ``nodes`` temperatures
    in equal ratios and keeps the two between which the sign changes.  Without a change
    the NLL is least at an end: at ``low`` if the most likely model is always right, at
    ``high`` if uniform answers are best.
    """
    m = len(models)
    logits = _labelled_logits(out, m).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        while high / low > 1.0 + tolerance:
            grid = [float(t) for t in np.geomspace(low, high, nodes)]
            slopes = _slopes(logits, m, grid)
            if slopes[0] is None:
                return 1.0
            rising = next((i for i, s in enumerate(slopes) if s >= 0), None)
            if rising is None:
                return grid[-1]
            if rising == 0:
                return grid[0]
            low, high = grid[rising - 1], grid[rising]
        return (low * high) ** 0.5
    finally:
        logits.unpersist()


# --- frontier -----------------------------------------------------------------------


def cut_cell(conf: Column, cuts: int = CUTS) -> Column:
    """The largest i with i/cuts <= conf, exact at the cut-offs."""
    step = 1.0 / cuts
    guess = F.floor(conf * float(cuts)).cast("int")
    return (
        F.when((guess + 1) * step <= conf, guess + 1).when(guess * step > conf, guess - 1).otherwise(guess)
    )


def frontier_cells(out: DataFrame, models: Models, conf: str = "conf", cuts: int = CUTS) -> DataFrame:
    """Sums per confidence cell: what routing and what each fixed model would do.

    The only pass over the queries; the result has at most ``cuts`` + 1 rows,
    whatever the number of cut-offs.
    """
    m = len(models)
    costs = rows.entries("costs", m)
    hit = F.when(F.col("pred") == F.col("label"), 1).otherwise(0)
    return (
        out.where(F.col("label").isNotNull())
        .groupBy(F.least(cut_cell(F.col(conf), cuts), F.lit(cuts)).alias("cell"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum(hit).alias("hits"),
            F.sum("chosen_cost").alias("cost"),
            F.array(*[F.sum(F.when(F.col("label") == i, 1).otherwise(0)) for i in range(m)]).alias("label_n"),
            F.array(*[F.sum(c) for c in costs]).alias("model_cost"),
        )
    )


def frontier(cell: DataFrame, fallback: int, cuts: int = CUTS) -> DataFrame:
    """(tau, acc, cost): below confidence tau the fallback model answers.

    Above a cut-off routing counts, below it the fallback, so every point is a
    running sum over the cells from both ends.
    """
    zero = F.lit(0).cast("bigint")
    own = cell.select(
        "cell",
        "n",
        "hits",
        "cost",
        F.get("label_n", F.lit(fallback)).alias("fb_hits"),
        F.get("model_cost", F.lit(fallback)).alias("fb_cost"),
    )
    empty = cell.sparkSession.range(cuts + 1).select(
        F.col("id").cast("int").alias("cell"),
        zero.alias("n"),
        zero.alias("hits"),
        F.lit(0.0).alias("cost"),
        zero.alias("fb_hits"),
        F.lit(0.0).alias("fb_cost"),
    )
    every = own.unionByName(empty).groupBy("cell").agg(
        *[F.sum(c).alias(c) for c in ("n", "hits", "cost", "fb_hits", "fb_cost")]
    )
    from_here = W.orderBy("cell").rowsBetween(W.currentRow, W.unboundedFollowing)
    below = W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    total = F.sum("n").over(W.partitionBy())

    def mix(routed: str, fixed: str) -> Column:
        return F.sum(routed).over(from_here) + F.coalesce(F.sum(fixed).over(below), F.lit(0))

    return every.select(
        (F.col("cell") * (1.0 / cuts)).alias("tau"),
        F.when(total > 0, mix("hits", "fb_hits") / total).alias("acc"),
        F.when(total > 0, mix("cost", "fb_cost") / total).alias("cost"),
    )


def best_point(points: DataFrame) -> DataFrame:
    """The cheapest point at least as accurate as routing everything.

    Routing everything is the point tau = 0.  Columns: tau, acc, cost,
    savings_vs_current.
    """
    everything = W.partitionBy()  # one row per cut-off
    now = F.max(F.when(F.col("tau") == 0, F.struct("acc", "cost"))).over(everything)
    current = points.withColumn("now", now)
    return (
        current.where(F.col("acc") >= F.col("now.acc") - EPSILON)
        .orderBy(F.round("cost", 12), "tau")  # equal sums may differ in the last bits
        .limit(1)
        .select(
            "tau",
            "acc",
            "cost",
            ((F.col("now.cost") - F.col("cost")) / F.greatest(F.lit(EPSILON), F.col("now.cost"))).alias(
                "savings_vs_current"
            ),
        )
    )
