"""The shared folder of a session, for tables that cut lineage or are read again."""

from __future__ import annotations

import re
import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that the session names in spark.checkpoint.dir; a new local one is set only where a session on one machine names none."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="neurotab-")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def settled(df: DataFrame) -> DataFrame:
    """A reliable checkpoint of df in the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def parts(df: DataFrame, rows: int = 500_000) -> int:
    """How many parts of about ``rows`` rows df makes, at least as many as tasks run at once: a number that grows with the table, where the session's number of shuffle partitions doesn't."""
    return max(df.sparkSession.sparkContext.defaultParallelism, -(-df.count() // rows))
