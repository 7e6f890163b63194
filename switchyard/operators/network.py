"""A classifier with hidden layers on soft targets, fitted in parts that are averaged.

A row's input has a fixed width whatever the vocabulary: its feature hashes counted in
``HASHED`` columns and divided by the root of their number, then its dense numbers.  So the weights
are of fixed size too, ``MAX_WEIGHTS`` at most, and travel to every task by broadcast.

Rows are dealt by hash of their id into parts of about ``PART_ROWS``, all that a task holds
at a time.  In a round each part starts from the common weights and lowers its own mean
Kullback-Leibler divergence by a few L-BFGS steps; the new common weights are the mean over the
parts.  Tasks add up their parts' weights as integers, whose sums depend on no order, so the same
seed gives the same weights on any partitioning.  A part also reports the divergence at its
start: a round that made it worse is taken back and tried with half the steps.  Rounds are
ordinary jobs over a stored table, so a lost executor costs its tasks only.

A null or empty list of hashes counts as no feature.  No rows give the starting weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.operators.softmax import minimise, row_softmax
from switchyard.session import materialise

HASHED = 256
HIDDEN = (256, 128)
PART_ROWS = 1 << 14
MAX_WEIGHTS = 1 << 22
ROUNDS = 8
STEPS = 25
RIDGE = 1e-4
_UNIT = float(1 << 32)  # integers per one; a weight stays below 1,000, so a million parts fit
_BLOCK = 4096


@dataclass
class Network:
    """Weights of all layers in one vector; ``sizes`` are the widths from input to classes."""

    sizes: list[int]
    scale: tuple[float, float]
    weights: np.ndarray

    @staticmethod
    def begin(dims: int, m: int, hidden: tuple[int, ...], scale: tuple[float, float], seed: int) -> "Network":
        sizes = [HASHED + dims, *hidden, m]
        n = sum(a * b + b for a, b in zip(sizes, sizes[1:]))
        if n > MAX_WEIGHTS:
            raise ValueError(f"{n} weights, more than {MAX_WEIGHTS}")
        random = np.random.default_rng(seed)
        layers = [np.vstack([random.normal(0, np.sqrt(2 / a), (a, b)), np.zeros((1, b))]) for a, b in zip(sizes, sizes[1:])]
        return Network(sizes, scale, np.concatenate([w.ravel() for w in layers]))

    def layers(self, weights: np.ndarray) -> list[np.ndarray]:
        """One matrix per layer, its last row the constants; views into the vector."""
        shapes = [(a + 1, b) for a, b in zip(self.sizes, self.sizes[1:])]
        ends = np.cumsum([a * b for a, b in shapes])
        return [weights[e - a * b : e].reshape(a, b) for e, (a, b) in zip(ends, shapes)]

    def inputs(self, terms: list, dense: np.ndarray) -> np.ndarray:
        counts = np.array([0 if t is None else len(t) for t in terms], np.int64)
        own = [np.asarray(t, np.int64) for t in terms if t is not None and len(t)]
        flat = np.concatenate(own) if own else np.zeros(0, np.int64)
        cells = np.repeat(np.arange(len(terms)), counts) * HASHED + flat % HASHED
        hashed = np.bincount(cells, minlength=len(terms) * HASHED).reshape(len(terms), HASHED)
        unit = self.scale[0] / np.sqrt(np.maximum(counts, 1))
        return np.hstack([hashed * unit[:, None], self.scale[1] * dense])

    def margins(self, x: np.ndarray, weights: np.ndarray) -> list[np.ndarray]:
        """Outputs of all layers, the input first."""
        found = [x]
        matrices = self.layers(weights)
        for i, w in enumerate(matrices):
            out = found[-1] @ w[:-1] + w[-1]
            found.append(out if i == len(matrices) - 1 else np.maximum(out, 0))
        return found

    def loss(self, x: np.ndarray, target: np.ndarray, weights: np.ndarray) -> tuple[float, np.ndarray]:
        """Mean divergence with its ridge, and the slope."""
        outputs, n = self.margins(x, weights), max(1, len(x))
        probs = row_softmax(outputs[-1])
        apart = target * (np.log(np.maximum(target, 1e-300)) - np.log(np.maximum(probs, 1e-300)))
        value = apart.sum() / n + RIDGE / 2 * (weights**2).sum()
        slope = RIDGE * weights
        rest = (probs * target.sum(axis=1, keepdims=True) - target) / n
        matrices, slopes = self.layers(weights), self.layers(slope)
        for i in range(len(matrices) - 1, -1, -1):
            slopes[i][:-1] += outputs[i].T @ rest
            slopes[i][-1] += rest.sum(axis=0)
            rest = (rest @ matrices[i][:-1].T) * (outputs[i] > 0)
        return float(value), slope

    def probabilities(self, terms: Column, dense: Column) -> Column:
        """Class probabilities of rows, as an Arrow function."""
        own = self

        @F.pandas_udf("array<double>")
        def probs(hashes: pd.Series, numbers: pd.Series) -> pd.Series:
            if not len(hashes):
                return pd.Series([], dtype=object)
            x = own.inputs(list(hashes), np.array(numbers.tolist(), float).reshape(len(hashes), -1))
            return pd.Series(list(row_softmax(own.margins(x, own.weights)[-1])))

        return probs(terms, dense)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(block, sizes, scale, w): the weights in blocks."""
        blocks = [self.weights[i : i + _BLOCK].tolist() for i in range(0, len(self.weights), _BLOCK)]
        rows = [(i, self.sizes, list(self.scale), w) for i, w in enumerate(blocks)]
        return spark.createDataFrame(rows, "block int, sizes array<int>, scale array<double>, w array<double>")

    @staticmethod
    def read(frame: DataFrame) -> "Network":
        blocks = sorted(frame.collect(), key=lambda r: r["block"])  # MAX_WEIGHTS numbers at most
        return Network(list(blocks[0]["sizes"]), tuple(blocks[0]["scale"]), np.concatenate([r["w"] for r in blocks]))


def _round(rows: DataFrame, network: Network, weights: np.ndarray, steps: int) -> tuple[float, np.ndarray]:
    """The mean divergence at ``weights``, and the mean of what the parts make of them."""
    dims, shared = network.sizes[0] - HASHED, rows.sparkSession.sparkContext.broadcast(weights)
    plain = Network(network.sizes, network.scale, np.zeros(0))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n, now, held = np.zeros(len(shared.value) + 1, np.int64), 0, None, []

        def solved() -> np.ndarray:
            x = plain.inputs([t for t, *_ in held], np.array([d for _, d, _ in held], float).reshape(len(held), dims))
            target = np.array([t for *_, t in held], float)
            before, _ = plain.loss(x, target, shared.value)
            found = minimise(lambda w: plain.loss(x, target, w), shared.value, steps) if steps else shared.value
            return np.rint(np.append(found, before) * _UNIT).astype(np.int64)

        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("part", "terms", "dense", "target"))
            for part, terms, dense, target in zip(*columns, strict=True):
                if part != now:
                    if held:
                        total, n = total + solved(), n + 1
                    now, held = part, []
                held.append((terms, dense, target))
        if held:
            total, n = total + solved(), n + 1
        if n:
            starts = range(0, len(total), _BLOCK)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(range(len(starts)), pa.int32()),
                    pa.array([n] * len(starts), pa.int64()),
                    pa.array([total[i : i + _BLOCK] for i in starts], pa.list_(pa.int64())),
                ],
                ["block", "parts", "w"],
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, tuple[int, np.ndarray]] = {}
        for batch in batches:
            for block, parts, w in zip(*(batch.column(c) for c in ("block", "parts", "w"))):
                n, total = sums.get(block.as_py(), (0, 0))
                sums[block.as_py()] = n + parts.as_py(), total + np.asarray(w.values)
        columns = [pa.array(list(sums), pa.int32()), pa.array([n for n, _ in sums.values()], pa.int64())]
        yield pa.RecordBatch.from_arrays([*columns, pa.array([w for _, w in sums.values()], pa.list_(pa.int64()))], ["block", "parts", "w"])

    schema = "block int, parts long, w array<bigint>"
    placed = rows.repartition("part").sortWithinPartitions("part", "query_id")
    found = sorted(placed.mapInArrow(run, schema).repartition("block").mapInArrow(add, schema).collect(), key=lambda r: r["block"])
    shared.unpersist()
    if not found:
        return 0.0, weights
    mean = np.concatenate([np.array(r["w"], float) for r in found]) / found[0]["parts"] / _UNIT
    return float(mean[-1]), mean[:-1]


def fit(
    rows: DataFrame,
    dims: int,
    m: int,
    hidden: tuple[int, ...] = HIDDEN,
    scale: tuple[float, float] = (1.0, 1.0),
    rounds: int = ROUNDS,
    steps: int = STEPS,
    seed: int = 42,
) -> Network:
    """Fit on (query_id, terms, dense, target): feature hashes, ``dims`` numbers, ``m`` shares."""
    network = Network.begin(dims, m, hidden, scale, seed)
    parts = max(1, -(-rows.count() // PART_ROWS))
    dealt = rows.select("query_id", "terms", "dense", "target", F.pmod(F.xxhash64("query_id"), F.lit(parts)).cast("int").alias("part"))
    dealt = materialise(dealt, "network-rows")
    best, tried = (float("inf"), network.weights, network.weights), network.weights
    for i in range(rounds + 1):
        value, after = _round(dealt, network, tried, steps if i < rounds else 0)
        if value < best[0]:
            best, tried = (value, tried, after), after
        elif i < rounds - 1 and steps > 1:
            steps //= 2
            _, tried = _round(dealt, network, best[1], steps)
        else:
            break
    network.weights = best[1]
    return network
