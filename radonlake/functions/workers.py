"""Functions over Arrow batches in Python workers, which import the package from where the driver has it."""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parents[2])


def on_workers(spark: SparkSession) -> None:
    """Lets Python workers import the package where its folder is at the same path; a cluster that has it elsewhere sets its own PYTHONPATH."""
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (ROOT, env.get("PYTHONPATH", "")) if x)


def map_arrow(df: DataFrame, fn: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    on_workers(df.sparkSession)
    return df.mapInArrow(fn, schema)
