"""What the operators of this package share."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.session import configure

# The characters that separate words, U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\f\r"
WORD = "[^\\x20\\x09-\\x0D]+"
GAP = "[\\x20\\x09-\\x0D]+"

_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table, with Arrow batches small enough for a modest Python worker.

    A batch holds a single row where that row alone is larger."""
    configure(spark).conf.set(_BATCH_BYTES, "16m")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text; none for null."""
    parts = F.split(F.coalesce(text, F.lit("")), GAP)
    return F.filter(parts, lambda w: w != "")


def sorted_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Whole groups of a stream sorted by ``keys``, one table each; holds one group at a time."""
    kept: pa.Table | None = None
    for batch in batches:
        data = pa.Table.from_batches([batch]) if kept is None else pa.concat_tables([kept, pa.Table.from_batches([batch])])
        if not data.num_rows:
            continue
        columns = [data[k].combine_chunks().to_numpy(zero_copy_only=False) for k in keys]
        last, cuts = 0, []
        changed = columns[0][1:] != columns[0][:-1]
        for c in columns[1:]:
            changed = changed | (c[1:] != c[:-1])
        for cut in (changed.nonzero()[0] + 1).tolist():
            cuts.append((last, cut))
            last = cut
        for a, b in cuts:
            yield data.slice(a, b - a)
        kept = data.slice(last)
    if kept is not None and kept.num_rows:
        yield kept
