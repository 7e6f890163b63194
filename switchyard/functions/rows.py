"""Per-row arithmetic over the candidate models.

A query's quality, cost and probability vectors have one entry per model, so
softmax, argmax and soft labels are row-local: no explode, window or shuffle.
The functions take and return one Column per model, which keeps them inside
generated code (array lambdas are interpreted).
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F


def entries(vector: Column | str, size: int) -> list[Column]:
    """The first ``size`` entries of an array column."""
    vector = F.col(vector) if isinstance(vector, str) else vector
    return [F.get(vector, F.lit(i)) for i in range(size)]


def total(cols: list[Column]) -> Column:
    return reduce(add, cols)


def row_max(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.greatest(*cols)


def row_min(cols: list[Column]) -> Column:
    return cols[0] if len(cols) == 1 else F.least(*cols)


def argmax(cols: list[Column]) -> Column:
    """Index of the largest entry, the first one on ties."""
    return (F.array_position(F.array(*cols), row_max(cols)) - 1).cast("int")


def argmin(cols: list[Column]) -> Column:
    return (F.array_position(F.array(*cols), row_min(cols)) - 1).cast("int")


def pick(cols: list[Column], index: Column) -> Column:
    """The entry at ``index``; null when the index is null or out of range."""
    return F.get(F.array(*cols), index)


def one_hot(index: Column, size: int) -> list[Column]:
    return [F.when(index == i, 1.0).otherwise(0.0) for i in range(size)]


def softmax(cols: list[Column], temperature: float | Column = 1.0) -> list[Column]:
    """exp((x - max) / T), normalised; the shift makes the sum at least 1."""
    top = row_max(cols)
    exps = [F.exp((c - top) / temperature) for c in cols]
    denominator = total(exps)
    return [e / denominator for e in exps]


def centred(cols: list[Column]) -> list[Column]:
    """Entries minus their mean."""
    mean = total(cols) / float(len(cols))
    return [c - mean for c in cols]


def any_of(flags: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, flags)


def long_rows(values: dict[str, list[Column]], index: str = "model_idx") -> Column:
    """Generator: one row per model with the index and the named values."""
    size = len(next(iter(values.values())))
    return F.inline(
        F.array(
            *[
                F.struct(
                    F.lit(i).alias(index),
                    *[cols[i].alias(name) for name, cols in values.items()],
                )
                for i in range(size)
            ]
        )
    )
