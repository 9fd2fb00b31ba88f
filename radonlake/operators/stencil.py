"""Neighbourhood operators of discrete tomography: each cell is dealt to its neighbours' places and summed there with theirs.

A cell goes to each place that it is a neighbour of, so that one aggregation with sums before the shuffle does the work of a
join for every offset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import num


def offsets(connectivity: int, radius: int = 1) -> list[tuple[int, ...]]:
    """Neighbours by connectivity: 4 and 8 in 2D, 6 and 26 in 3D; of radius r in 2D the cross or square of that radius."""
    if connectivity in (6, 26):
        every = [(z, r, c) for z in (-1, 0, 1) for r in (-1, 0, 1) for c in (-1, 0, 1) if (z, r, c) != (0, 0, 0)]
        return every if connectivity == 26 else [x for x in every if sum(map(abs, x)) == 1]
    span = range(-radius, radius + 1)
    return [(r, c) for r in span for c in span if (r, c) != (0, 0) and (connectivity == 8 or 0 in (r, c))]


def gathered(df: DataFrame, near: list[tuple[int, ...]], what: str, keys: list[str]) -> DataFrame:
    """For each cell (keys, v): own value, and the aggregate what over neighbours' values n and own value v."""
    moves = ", ".join("named_struct(" + ", ".join(f"'{k}', {x}" for k, x in zip(keys, by, strict=True)) + ")" for by in near)
    moved = df.selectExpr(*keys, "v", f"explode(array({moves})) AS x").selectExpr(*(f"CAST({k} - x.{k} AS INT) AS {k}" for k in keys), "v AS n")
    return moved.join(df.selectExpr(*keys, "v"), keys).groupBy(*keys, "v").agg(F.expr(what).alias("s"))


def inner(keys: list[str], shape: tuple[int, ...], radius: int) -> str:
    return " AND ".join(f"{k} >= {radius} AND {k} < {n - radius}" for k, n in zip(keys, shape, strict=True))


def mask(df: DataFrame, shape: tuple[int, ...], connectivity: int = 8, threshold: int = 1, radius: int = 1) -> DataFrame:
    """1 where at least threshold neighbours differ, else 0; cells nearer than radius to the border are 0."""
    keys = ["z", "r", "c"][-len(shape) :]
    found = gathered(df, offsets(connectivity, radius), "sum(CASE WHEN n <> v THEN 1 ELSE 0 END)", keys)
    return found.selectExpr(*keys, f"CASE WHEN {inner(keys, shape, radius)} AND s >= {threshold} THEN 1e0 ELSE 0e0 END AS v")


def smooth(df: DataFrame, shape: tuple[int, ...], b: float = 0.3, radius: int = 1) -> DataFrame:
    """(1 - b) times the value plus b times the mean of its neighbours; cells at the border stay as they are."""
    keys = ["z", "r", "c"][-len(shape) :]
    found = gathered(df, offsets(26 if len(shape) == 3 else 8, radius), "avg(n)", keys)
    return found.selectExpr(*keys, f"CASE WHEN {inner(keys, shape, radius)} THEN {num(1 - b)} * v + {num(b)} * s ELSE v END AS v")


def smooth_padded(df: DataFrame, b: float = 0.1) -> DataFrame:
    """As smooth in 2D, with zeros around the image, and for all cells."""
    found = gathered(df, offsets(8), "sum(n)", ["r", "c"])
    return found.selectExpr("r", "c", f"{num(1 - b)} * v + {num(b)} * s / 8e0 AS v")


def mask_over(df: DataFrame, threshold: int = 0, connectivity: int = 8) -> DataFrame:
    """1 where more than threshold neighbours inside the image differ."""
    found = gathered(df, offsets(connectivity), "sum(CASE WHEN n <> v THEN 1 ELSE 0 END)", ["r", "c"])
    return found.selectExpr("r", "c", f"CASE WHEN s > {threshold} THEN 1e0 ELSE 0e0 END AS v")
