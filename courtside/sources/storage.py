"""Folders that driver and executors share."""

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def scratch(spark: SparkSession) -> str:
    """A new folder's path in what driver and executors share; one of our own only where a local session names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir names no folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/courtside-{uuid.uuid4().hex}"


def kept(rows: DataFrame, key: str = "game_id") -> DataFrame:
    """rows, worked out once and written; whoever reads them again and again, as the training of models does, reads the files.

    They are dealt by ``key`` to one file a core, so that all cores share the reading, and large files are read in parts.
    """
    path = scratch(rows.sparkSession)
    rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key).write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def cut_lineage(spark: SparkSession) -> None:
    """A checkpoint folder for a session that has none: without one the plan of boosting grows by a step every round."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(scratch(spark))
