"""Checkpoints in the folder that the cluster names, and helpers shared by the operators."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_top, ship


def checkpoint_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder; where none is set yet, spark.checkpoint.dir (see shared_top)."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_top(spark))
    return sc.getCheckpointDir()


def release(spark: SparkSession) -> None:
    """Collects garbage, which lets Spark's cleaner drop shuffle files of steps that are done."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def saved(df: DataFrame) -> DataFrame:
    """df computed once and written to the shared checkpoint folder, so lost executors cost no recomputation of its lineage. What earlier steps left is released first."""
    checkpoint_dir(df.sparkSession)
    release(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded_arrow(spark: SparkSession, rows: int = 512) -> None:
    """Fewer rows in an Arrow batch, since one text may have megabytes; and the package for the Python workers."""
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def text_size(col: str = "text"):
    return F.coalesce(F.octet_length(F.col(col)), F.lit(0)).cast("long")
