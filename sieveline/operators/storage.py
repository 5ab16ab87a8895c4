"""The folder that the driver and all executors share."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Used only where the session names no shared folder and runs in one JVM, as in tests.
LOCAL = "/tmp/checkpoints"


def shared_folder(spark: SparkSession) -> str:
    """From spark.checkpoint.dir; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not named and spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return (named or LOCAL).rstrip("/")
