"""Lineage cut at reliable checkpoints."""

from __future__ import annotations

import atexit
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession

_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, a temporary one of this process, on local masters only."""
    there = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if there:
        return there
    if spark.sparkContext.master.partition("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _own:
        _own.append(tempfile.mkdtemp(prefix="arclattice-core-"))
        atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
    return _own[0]


def kept(df: DataFrame) -> DataFrame:
    """df read from a checkpoint, in the same partitions."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()
