"""Written stage tables: the points where a long plan is cut.

A stage table is Parquet in the shared folder the cluster names in
`spark.checkpoint.dir`. Later steps read only the columns they need from it,
and an executor lost after the write costs nothing.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach; a local one only in local mode."""
    context = spark.sparkContext
    named = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if named:
        return named
    # One machine only: "local" or "local[n]", not a local cluster.
    if context.master != "local" and not context.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="pairwright-"))
    return context.getCheckpointDir()


def stage_path(spark: SparkSession, label: str) -> str:
    """A new path under the shared folder, grouped by application for later clean-up."""
    app = spark.sparkContext.applicationId
    return f"{shared_folder(spark).rstrip('/')}/pairwright/{app}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str, partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write `df` once and go on from the written table."""
    spark = df.sparkSession
    path = stage_path(spark, label)
    writer = df.write
    if partition_by:
        # One shuffle by the partition columns would put a whole fold in one task;
        # rebalancing on them splits big folds and keeps the number of files low.
        writer = df.hint("rebalance", *partition_by).write.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
