"""Multinomial regression on soft targets, over feature maps with any number of different values.

The margin of a class is an intercept, a dense part, and the sum of the weights of the row's
known features divided by the root of their number - the unit one-hot vector of the row times
its weights.  The weights are a table with a row per feature (key, value), so nothing of
the vocabulary's size is collected, broadcast or held by one task.

Fitting.  Rows are dealt by hash into parts of about ``PART_ROWS``.  In a round each part gets
the current weights of its own features by a join on the feature, minimises its mean
Kullback-Leibler divergence by L-BFGS, and returns its weights; a feature's new weight is the
mean over its parts, by the rows that have it, again grouped by feature.  One part gives
the minimum itself; several are brought together by ``ROUNDS`` rounds.

Scoring.  Each different feature map is joined once with the weights of its features and
summed up; rows take that sum by the key of their map.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from switchyard.session import materialise, task_count

PART_ROWS = 1 << 14
ROUNDS = 4
#: Terms that at least one in so many rows of a part has are columns of a matrix there.
COMMON = 4
RIDGE = 1e-6
_MEMORY = 8
_WEIGHTS = "term long, rows double, w array<double>"


def minimise(fun: Callable[[np.ndarray], tuple[float, np.ndarray]], x: np.ndarray, iterations: int) -> np.ndarray:
    """L-BFGS with halving steps; stops where a step no longer helps."""
    value, slope = fun(x)
    steps: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(iterations):
        direction, factors = -slope, []
        for s, y, r in reversed(steps):
            factors.append(r * (s @ direction))
            direction = direction - factors[-1] * y
        if steps:
            s, y, _ = steps[-1]
            direction = direction * ((s @ y) / (y @ y))
        for (s, y, r), f in zip(steps, reversed(factors), strict=True):
            direction = direction + (f - r * (y @ direction)) * s
        fall = slope @ direction
        if fall >= -1e-14:
            break
        length = 1.0 if steps else min(1.0, 1.0 / max(1e-12, np.abs(slope).sum()))
        while length > 1e-10:
            new = x + length * direction
            found, bend = fun(new)
            if found <= value + 1e-4 * length * fall:
                break
            length /= 2
        else:
            break
        s, y = new - x, bend - slope
        if s @ y > 1e-14:
            steps = [*steps[1 - _MEMORY :], (s, y, 1.0 / (s @ y))]
        gain, x, value, slope = value - found, new, found, bend
        if gain < 1e-10 * max(1.0, abs(value)):
            break
    return x


def row_softmax(margins: np.ndarray) -> np.ndarray:
    e = np.exp(margins - margins.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class Part:
    """The rows of a part as a sparse and two dense blocks: common terms, given numbers.

    The matrix of the common terms has at most ``COMMON`` cells per term of a row."""

    def __init__(self, terms: list[np.ndarray], dense: np.ndarray, target: np.ndarray, known: np.ndarray, scale: tuple[float, float]):
        sizes = np.array([len(t) for t in terms], np.int64)
        flat = np.concatenate(terms) if len(terms) else np.zeros(0, np.int64)
        column, row = np.searchsorted(known, flat), np.repeat(np.arange(len(terms)), sizes)
        self.unit = scale[0] / np.sqrt(np.maximum(sizes, 1))
        self.seen = np.bincount(column, minlength=len(known))
        often = self.seen * COMMON >= max(1, len(terms))
        self.common, self.rare = np.flatnonzero(often), np.flatnonzero(~often)
        place, here = np.cumsum(often) - 1, often[column]
        cells = row[here] * len(self.common) + place[column[here]]
        block = np.bincount(cells, weights=self.unit[row[here]], minlength=len(terms) * len(self.common))
        self.block = block.reshape(len(terms), len(self.common))
        self.column, self.row = (np.cumsum(~often) - 1)[column[~here]], row[~here]
        self.dense = np.hstack([scale[1] * dense, np.ones((len(terms), 1))])
        self.target, self.width = target, len(known)
        self.entropy = float((target * np.log(np.maximum(target, 1e-300))).sum())

    def margins(self, weights: np.ndarray) -> np.ndarray:
        out = self.dense @ weights[self.width :] + self.block @ weights[self.common]
        rare = weights[self.rare]
        for m in range(weights.shape[1] if len(self.row) else 0):
            out[:, m] += self.unit * np.bincount(self.row, weights=rare[self.column, m], minlength=len(self.unit))
        return out

    def loss(self, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean divergence with its ridge, and the slope."""
        n, margins = max(1, len(self.unit)), self.margins(weights)
        top = margins.max(axis=1, keepdims=True)
        logs = margins - top - np.log(np.exp(margins - top).sum(axis=1, keepdims=True))
        rest = np.exp(logs) * self.target.sum(axis=1, keepdims=True) - self.target
        slope = np.empty_like(weights)
        scaled = rest * self.unit[:, None]
        slope[self.common] = self.block.T @ rest
        for m in range(weights.shape[1]):
            slope[self.rare, m] = np.bincount(self.column, weights=scaled[self.row, m], minlength=len(self.rare))
        slope[self.width :] = self.dense.T @ rest
        value = (self.entropy - (self.target * logs).sum()) / n + RIDGE / 2 * (weights**2).sum()
        return float(value), slope / n + RIDGE * weights


def _round(rows: DataFrame, wanted: DataFrame, weights: DataFrame | None, dims: int, m: int, iterations: int, scale: tuple[float, float]) -> DataFrame:
    """One round: (term, rows, w) of every part."""
    empty = F.array().cast("array<bigint>")
    none = F.lit(None).cast("array<double>")
    begun = wanted.withColumn("w", none) if weights is None else wanted.join(weights.select("term", "w"), "term", "left")
    heads = begun.select("part", F.lit(0).alias("kind"), "term", "w", empty.alias("terms"), none.alias("dense"), none.alias("target"))
    body = rows.select("part", F.lit(1).alias("kind"), F.col("query_id").alias("term"), none.alias("w"), "terms", "dense", "target")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: int | None = None
        heads: list[tuple[np.ndarray, np.ndarray]] = []
        body: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

        def numbers(column: pa.Array) -> np.ndarray:
            return column.flatten().to_numpy(zero_copy_only=False)

        def solved() -> pa.RecordBatch:
            known, begin = np.concatenate([t for t, _ in heads]), np.concatenate([w for _, w in heads])
            order = np.argsort(known, kind="stable")
            known, begin = known[order], begin[order]
            own = (known < 0) | (known > dims)
            terms, first = known[own], np.vstack([begin[own], begin[~own]])
            listed = [t for flat, sizes, *_ in body for t in np.split(flat, np.cumsum(sizes)[:-1])]
            dense, target = (np.concatenate([b[i] for b in body]) for i in (2, 3))
            part = Part(listed, dense, target, terms, scale)
            body.clear()  # the blocks hold the rows now
            shape = first.shape

            def fun(x: np.ndarray) -> tuple[float, np.ndarray]:
                value, slope = part.loss(x.reshape(shape))
                return value, slope.ravel()

            found = minimise(fun, first.ravel(), iterations).reshape(shape)
            seen = np.concatenate([part.seen, np.full(dims + 1, len(listed))]).astype(float)
            return pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate([terms, known[~own]])), pa.array(seen), pa.array(list(found), pa.list_(pa.float64()))], ["term", "rows", "w"]
            )

        for batch in batches:
            keys = [batch.column(c).to_numpy() for c in ("part", "kind")]
            cuts = [0, *(np.flatnonzero(np.any([np.diff(k) != 0 for k in keys], axis=0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts, cuts[1:]):
                if a == b:
                    continue
                some = batch.slice(a, b - a)
                if keys[0][a] != now:
                    if body:
                        yield solved()
                    now, heads, body = keys[0][a], [], []
                if keys[1][a] == 0:
                    begin = np.zeros((b - a, m))
                    begin[some.column("w").is_valid().to_numpy(zero_copy_only=False)] = numbers(some.column("w")).reshape(-1, m)
                    heads.append((some.column("term").to_numpy(), begin))
                else:
                    sizes = some.column("terms").value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                    blocks = (numbers(some.column(c)).reshape(b - a, width) for c, width in (("dense", dims), ("target", m)))
                    body.append((numbers(some.column("terms")), sizes, *blocks))
        if body:
            yield solved()

    placed = heads.union(body).repartition(task_count(rows.sparkSession), "part").sortWithinPartitions("part", "kind", "term")
    found = placed.mapInArrow(run, _WEIGHTS)
    # Sums of decimals are the same in any order; what rounds begin with grows a millionfold in each.
    sums = [F.sum((F.col("rows") * F.col("w")[i]).cast("decimal(28,12)")).cast("double") for i in range(m)]
    total = F.sum("rows")
    return found.groupBy("term").agg(F.array(*[s / total for s in sums]).alias("w"))


def fit(rows: DataFrame, dims: int, m: int, iterations: int, scale: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    """Weights (term, w) from (query_id, terms, dense, target).

    ``terms`` are the row's feature hashes, each once; ``dense`` has ``dims`` numbers; terms 0 to
    ``dims`` stand for the dense columns and the intercept.  ``scale`` multiplies the two
    blocks.  The parts depend on ids and the number of rows alone, so the weights don't
    depend on partitioning.  No rows give no weights."""
    parts = max(1, -(-rows.count() // PART_ROWS))
    dealt = materialise(rows.withColumn("part", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int")), "parts")
    own = dealt.select("part", F.explode("terms").alias("term")).distinct()
    columns = F.sequence(F.lit(0).cast("long"), F.lit(dims).cast("long"))
    every = dealt.select("part").distinct().select("part", F.explode(columns).alias("term"))
    wanted = materialise(own.union(every), "part-terms")
    weights = None
    for _ in range(ROUNDS if parts > 1 else 1):
        weights = materialise(_round(dealt, wanted, weights, dims, m, iterations, scale), "weights")
    return weights


def feature_weights(pairs: DataFrame, weights: DataFrame) -> DataFrame:
    """(key, value, w) of the (key, value) pairs that have weights."""
    named = pairs.select("key", "value", F.xxhash64("key", "value").alias("term")).distinct()
    return named.join(weights, "term").select("key", "value", "w")


def sparse_sums(records: DataFrame, coefficients: DataFrame, m: int) -> DataFrame:
    """(record_key, known, sums) of different (record_key, features): what known features add."""
    each = records.select("record_key", F.explode("features").alias("key", "value"))
    met = each.join(coefficients, ["key", "value"])
    sums = [F.sum(F.col("w")[i]).alias(f"_s{i}") for i in range(m)]
    found = met.groupBy("record_key").agg(F.count(F.lit(1)).alias("known"), *sums)
    return found.select("record_key", "known", F.array(*[F.col(f"_s{i}") for i in range(m)]).alias("sums"))


def probabilities(dense: Column, known: Column, sums: Column, weights: list[list[float]], scale: tuple[float, float]) -> Column:
    """Model probabilities per row; ``weights`` are those of the dense columns and the intercept."""
    matrix = np.array(weights)

    @F.pandas_udf("array<double>")
    def probs(rows: pd.Series, counts: pd.Series, parts: pd.Series) -> pd.Series:
        if not len(rows):
            return pd.Series([], dtype=object)
        margins = scale[1] * np.stack(rows.to_numpy()) @ matrix[:-1] + matrix[-1]
        unit = scale[0] / np.sqrt(np.maximum(counts.fillna(0).to_numpy(float), 1.0))
        zero = np.zeros(matrix.shape[1])
        margins += unit[:, None] * np.stack([zero if p is None else p for p in parts])
        return pd.Series(list(row_softmax(margins)))

    return probs(dense, known, sums)
