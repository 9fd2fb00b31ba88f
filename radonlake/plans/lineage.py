"""Cutting the lineage of iterative plans, in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A folder of a new name in the one that driver and executors share."""
    set_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def set_folder(spark: SparkSession) -> None:
    """Sets the checkpoint folder that is named; where none is, one of our own, which only a local session can share, so that others raise."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="radonlake-"))


def cut(df: DataFrame) -> DataFrame:
    """Computes df once; its files outlive an executor."""
    set_folder(df.sparkSession)
    return df.checkpoint()
