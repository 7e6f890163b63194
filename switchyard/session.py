"""Shared-folder helpers for jobs that must cut lineage or reread a result."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

_CHECKPOINT_DIR = "spark.checkpoint.dir"
_HUGE_METHOD = "spark.sql.codegen.hugeMethodLimit"


def configure(spark: SparkSession) -> SparkSession:
    """Session settings the operators count on; results do not depend on them.

    The JVM never compiles methods above 8,000 bytes of bytecode.  Wide feature
    rows fuse into such methods and then run interpreted, at half the speed;
    with this limit Spark splits them instead.
    """
    if spark.conf.get(_HUGE_METHOD, None) != "8000":
        spark.conf.set(_HUGE_METHOD, "8000")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can read: the one named in ``spark.checkpoint.dir``, or
    else a folder of the warehouse, which all executors share as well."""
    context = spark.sparkContext
    folder = context.getConf().get(_CHECKPOINT_DIR) or context.getCheckpointDir()
    return (folder or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch").rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/switchyard/{name}-{uuid.uuid4().hex}"


def task_count(spark: SparkSession) -> int:
    """A number of tasks to deal rows to whose few bytes are much arithmetic: left to itself, Spark would
    put small partitions together."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once and read it back: later jobs reuse the stored result
    instead of recomputing it, also after an executor is lost."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)

