"""Several Python functions of a row in one pass."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import tee

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType


def together(**functions):
    """One function of as many columns as there are ``functions``, Arrow functions of one column each.

    It gives a struct with the fields of those that give structs and a field of the others' name.
    Each Arrow function on its own would have a Python process per task and get the rows sent anew."""
    fields: list[StructField] = []
    for name, function in functions.items():
        kind = function.returnType
        fields.extend(kind.fields if isinstance(kind, StructType) else [StructField(name, kind)])
    own = {name: function.func for name, function in functions.items()}

    @F.pandas_udf(StructType(fields))
    def every(batches: Iterator[tuple[pd.Series, ...]]) -> Iterator[pd.DataFrame]:
        def column(rows: Iterator[tuple[pd.Series, ...]], i: int) -> Iterator[pd.Series]:
            return (row[i] for row in rows)

        if len(own) == 1:  # Spark hands over a lone column as it is
            batches = ((batch,) for batch in batches)
        found = [f(column(rows, i)) for i, (f, rows) in enumerate(zip(own.values(), tee(batches, len(own)), strict=True))]
        for parts in zip(*found, strict=True):
            named = (p if isinstance(p, pd.DataFrame) else p.rename(n) for n, p in zip(own, parts, strict=True))
            yield pd.concat(list(named), axis=1)

    return every
