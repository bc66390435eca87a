"""Shared-folder staging tables, used instead of long lineages."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it in ``spark.checkpoint.dir``.

    Only where the session names none and runs on this machine alone (a test) is a folder made up here.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = tempfile.mkdtemp(prefix="sessionlake-")
    spark.sparkContext.setCheckpointDir(folder)
    return folder


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and continue from the table.

    The table survives lost executors, cuts the lineage, and unlike ``checkpoint()`` computes its
    input a single time and keeps column pruning for the readers.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/sessionlake-stage/{label}-{uuid.uuid4().hex}"
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)
