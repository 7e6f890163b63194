"""The wide benchmark table: one quality and one cost column per model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from switchyard.functions import rows
from switchyard.models import Models

# The column names of the benchmark layout.
COST_SUFFIX = "|total_cost"
PROMPT = "prompt"
EVAL_NAME = "eval_name"
ORACLE = "oracle_model_to_route_to"


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def read_wide(spark: SparkSession, path: str, fmt: str = "parquet", schema: str | None = None, **options) -> DataFrame:
    """A parquet, ORC, CSV or JSON file in the benchmark layout.

    Parquet and ORC carry their schema; CSV and JSON should be given one, so
    that the file is not read a second time to guess it.
    """
    reader = spark.read.options(**options)
    if fmt == "csv":
        reader = reader.options(header="true", quote='"', escape='"', multiLine="true")
    if schema is not None:
        reader = reader.schema(schema)
    elif fmt == "csv":
        reader = reader.option("inferSchema", "true")
    return reader.format(fmt).load(path)


def model_names(columns: list[str]) -> list[str]:
    """Names in front of the first ``|`` of the cost columns, in column order."""
    return [c.split("|", 1)[0] for c in columns if c.endswith(COST_SUFFIX)]


def _quality(df: DataFrame, name: str) -> Column:
    """Observed quality; a missing column counts as 0.0."""
    return _quoted(name).cast("double") if name in df.columns else F.lit(0.0)


def _cost(name: str) -> Column:
    """Observed cost; NaN is treated as missing."""
    cost = _quoted(name + COST_SUFFIX).cast("double")
    return F.when(~F.isnan(cost), cost)


def mean_costs(df: DataFrame) -> DataFrame:
    """(model_idx, model, mean_cost); a missing cost counts as 0 in the mean.

    One aggregate row with a column per model, turned into rows afterwards.
    """
    names = model_names(df.columns)
    means = df.agg(*[F.avg(F.coalesce(_cost(n), F.lit(0.0))).alias(f"m{i}") for i, n in enumerate(names)])
    return means.select(
        rows.long_rows({"model": [F.lit(n) for n in names], "mean_cost": [F.col(f"m{i}") for i in range(len(names))]})
    )


def collect_models(df: DataFrame) -> Models:
    """The model dimension; as many values reach the driver as there are models."""
    found = sorted(mean_costs(df).collect(), key=lambda r: r["model_idx"])
    return Models(tuple(r["model"] for r in found), tuple(float(r["mean_cost"] or 0.0) for r in found))


def label_of(names: list[str], oracle: Column) -> Column:
    """Oracle model name -> index; null unless it names one of the models."""
    position = F.array_position(F.array(*[F.lit(n) for n in names]), oracle)
    return F.when(position > 0, (position - 1).cast("int"))


def to_items(df: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(query_id, text, features, label, quality, costs), one row per query.

    Everything is row-local.  Defaults: prompt "", eval_name "unknown", no
    oracle -> no label.
    """
    names = model_names(df.columns)

    def text_or(column: str, default: str) -> Column:
        present = column in df.columns
        return F.coalesce(F.col(column).cast("string"), F.lit(default)) if present else F.lit(default)

    oracle = F.col(ORACLE).cast("string") if ORACLE in df.columns else F.lit(None).cast("string")
    return df.select(
        F.col(id_col).alias("query_id"),
        text_or(PROMPT, "").alias("text"),
        F.create_map(F.lit("eval"), text_or(EVAL_NAME, "unknown")).alias("features"),
        label_of(names, oracle).alias("label"),
        F.array(*[_quality(df, n) for n in names]).alias("quality"),
        F.array(*[_cost(n) for n in names]).alias("costs"),
    )


def to_long(df: DataFrame, id_col: str = "query_id") -> DataFrame:
    """(query_id, model_idx, model, quality, cost) in one pass, no join."""
    names = model_names(df.columns)
    return df.select(
        F.col(id_col).alias("query_id"),
        rows.long_rows(
            {
                "model": [F.lit(n) for n in names],
                "quality": [_quality(df, n) for n in names],
                "cost": [_cost(n) for n in names],
            }
        ),
    )


def read_items(spark: SparkSession, path: str, fmt: str = "parquet", id_col: str = "query_id", **options):
    """Items and the model dimension of one benchmark file."""
    df = read_wide(spark, path, fmt, **options)
    return to_items(df, id_col), collect_models(df)


def completeness(items: DataFrame) -> DataFrame:
    """One row of flags: is label / quality / costs present on every row?"""
    full = F.count(F.lit(1))
    return items.agg(
        full.alias("n_rows"),
        *[
            (F.count(c) == full).alias(f"has_{c}")
            for c in ("label", "quality", "costs")
            if c in items.columns
        ],
    )


def usable(items: DataFrame) -> DataFrame:
    """Null out every label / quality / costs column that is not complete."""
    flags = completeness(items).first().asDict()
    incomplete = [c for c in ("label", "quality", "costs") if flags.get(f"has_{c}") is False]
    types = dict(items.dtypes)
    return items.withColumns({c: F.lit(None).cast(types[c]) for c in incomplete}) if incomplete else items
