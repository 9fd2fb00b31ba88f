"""Arrays, grids and matrices as tables, and back; tables of measurements as volumes and sinograms."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = {"vol2d": ("r", "c", "v"), "sino2d": ("a", "d", "p"), "vol3d": ("z", "r", "c", "v"), "sino3d": ("dv", "a", "du", "p")}


def from_array(spark: SparkSession, array, kind: str) -> DataFrame:
    """A dense array in coordinate form; any number type becomes double."""
    array = np.asarray(array, np.float64)
    names = AXES[kind]
    if array.ndim != len(names) - 1:
        raise ValueError(f"{kind} takes an array of {len(names) - 1} axes")
    index = np.indices(array.shape, np.int32).reshape(array.ndim, -1)
    columns = {n: x for n, x in zip(names, [*index, array.ravel()], strict=True)}
    import pandas as pd

    return spark.createDataFrame(pd.DataFrame(columns), ", ".join(f"{n} int" for n in names[:-1]) + f", {names[-1]} double")


def to_array(df: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The dense array on the driver, with zeros for absent cells; for results that fit there."""
    out = np.zeros(shape)
    pdf = df.toPandas()
    value = next(c for c in pdf.columns if c in ("v", "p", "s"))
    keys = max((x[:-1] for x in AXES.values() if set(x[:-1]) <= set(pdf.columns)), key=len)
    out[tuple(pdf[k].to_numpy() for k in keys)] = pdf[value].to_numpy()
    return out


def filled(spark: SparkSession, shape: tuple[int, ...], kind: str, value: float = 0.0) -> DataFrame:
    """A grid of one value, made on the executors."""
    names = AXES[kind]
    df = spark.range(shape[0]).selectExpr(f"CAST(id AS INT) AS {names[0]}")
    for name, n in zip(names[1:-1], shape[1:], strict=True):
        df = df.selectExpr("*", f"explode(sequence(0, {n - 1})) AS {name}")
    return df.withColumn(names[-1], F.lit(float(value)))


def packed(volume: DataFrame) -> DataFrame:
    """Rows as arrays (z, r, row), for storage."""
    return volume.groupBy("z", "r").agg(F.transform(F.sort_array(F.collect_list(F.struct("c", "v"))), lambda x: x["v"]).alias("row"))


def unpacked(rows: DataFrame) -> DataFrame:
    return rows.select("z", "r", F.posexplode("row").alias("c", "v"))


def binned(spark: SparkSession, sf_dir: str, keys: dict[str, tuple[str, int]], value: str, name: str, table: str = "lineitem") -> DataFrame:
    """A whole table summed into the cells of a grid: keys gives for each axis a column and how many cells it is dealt to."""
    rows = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    cells = [F.expr(f"CAST({column} % {n} AS INT)").alias(axis) for axis, (column, n) in keys.items()]
    return rows.groupBy(*cells).agg((F.sum(F.expr(value)) / 1000.0).alias(name))
