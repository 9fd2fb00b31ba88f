"""Phantoms and noise."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import num
from ..functions.workers import map_arrow

# The Shepp-Logan phantom's ellipsoids (x, y, z, half axes x, y, z, degrees, value, value of the modified phantom).
ELLIPSOIDS = (
    (0, 0, 0, 0.69, 0.92, 0.81, 0, 2.0, 1.0),
    (0, -0.0184, 0, 0.6624, 0.874, 0.78, 0, -0.98, -0.8),
    (0.22, 0, 0, 0.11, 0.31, 0.22, -18, -0.02, -0.2),
    (-0.22, 0, 0, 0.16, 0.41, 0.28, 18, -0.02, -0.2),
    (0, 0.35, 0, 0.21, 0.25, 0.41, 0, 0.01, 0.1),
    (0, 0.1, 0, 0.046, 0.046, 0.05, 0, 0.01, 0.1),
    (0, -0.1, 0, 0.046, 0.046, 0.05, 0, 0.01, 0.1),
    (-0.08, -0.605, 0, 0.046, 0.023, 0.05, 0, 0.01, 0.1),
    (0, -0.605, 0, 0.023, 0.023, 0.02, 0, 0.01, 0.1),
    (0.06, -0.605, 0, 0.023, 0.046, 0.02, 0, 0.01, 0.1),
)


def inside(rows: int, cols: int, slices: int = 0) -> list[tuple[str, float, float]]:
    """(condition on r, c and z, value, modified value) of each ellipsoid."""
    out = []
    for x, y, z, ax, ay, az, turn, value, modified in ELLIPSOIDS:
        cos, sin = math.cos(math.radians(turn)), math.sin(math.radians(turn))
        dx, dy = f"(c - {num((0.5 + 0.5 * x) * cols - 0.5)})", f"(r - {num((0.5 - 0.5 * y) * rows - 0.5)})"
        u, v = f"(({dx} * {num(cos)} - {dy} * {num(sin)}) / {num(0.5 * ax * cols)})", f"(({dx} * {num(sin)} + {dy} * {num(cos)}) / {num(0.5 * ay * rows)})"
        test = f"{u} * {u} + {v} * {v}"
        if slices:
            w = f"((z - {num((0.5 + 0.5 * z) * slices - 0.5)}) / {num(0.5 * az * slices)})"
            test += f" + {w} * {w}"
        out.append((f"{test} <= 1e0", value, modified))
    return out


def value_expression(rows: int, cols: int, slices: int = 0, modified: bool = True) -> str:
    terms = " + ".join(f"CASE WHEN {test} THEN {num(m if modified else v)} ELSE 0e0 END" for test, v, m in inside(rows, cols, slices))
    return f"greatest(0e0, {terms})"


def shepp_logan(spark: SparkSession, rows: int, cols: int, slices: int = 0, modified: bool = True) -> DataFrame:
    """The phantom as (r, c, v), or (z, r, c, v): one expression of a cell's place, no table of ellipsoids is joined."""
    n = max(1, slices)
    cells = spark.range(n * rows).selectExpr(f"CAST(id DIV {rows} AS INT) AS z", f"CAST(id % {rows} AS INT) AS r").selectExpr("z", "r", f"explode(sequence(0, {cols - 1})) AS c")
    return cells.selectExpr(*(["z"] if slices else []), "r", "c", f"{value_expression(rows, cols, slices, modified)} AS v")


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def uniform(keys: list[np.ndarray], seed: int, draw: int) -> np.ndarray:
    """A number in (0, 1) for each row, from its keys, the seed and the number of the draw alone."""
    x = np.full(len(keys[0]), (seed * 0x9E3779B97F4A7C15 + draw * 0xD1B54A32D192ED03) % (1 << 64), np.uint64)
    for k in keys:
        with np.errstate(over="ignore"):
            x = _mixed(x + k.astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)


def poisson(mean: np.ndarray, keys: list[np.ndarray], seed: int) -> np.ndarray:
    """Poisson counts of these means: by inversion below a mean of 100, and from there on
    the rounded normal with the term of its skewness."""
    u = uniform(keys, seed, 0)
    small = mean < 100
    out = np.zeros(len(mean))
    m, left = mean[small], u[small].copy()
    term, count, alive = np.exp(-m), np.zeros(len(m)), np.ones(len(m), bool)
    for k in range(1, 400):
        alive &= left >= term
        if not alive.any():
            break
        left[alive] -= term[alive]
        term = term * m / k
        count[alive] += 1
    out[small] = count
    big = ~small
    z = np.sqrt(-2 * np.log(u[big])) * np.cos(2 * np.pi * uniform(keys, seed, 1)[big])
    out[big] = np.maximum(0, np.round(mean[big] + np.sqrt(mean[big]) * z + (z * z - 1) / 6))
    return out


def add_noise(sino: DataFrame, intensity: float, seed: int = 0) -> DataFrame:
    """Poisson noise of so many photons: p = -top log(n / intensity), n a count of mean intensity exp(-p / top), top the largest p.

    Each value is drawn from its own place and the seed, so that a lost task's rows come out the same. A count of 0 counts as 1, as a ray without photons
    has no finite value; a top of 0 leaves values at 0.
    """
    keys = [c for c in sino.columns if c != "p"]
    kinds = dict(sino.dtypes)
    top = sino.agg(F.max("p").alias("_top"))

    def noisy(batches):
        for b in batches:
            p, m = (b.column(k).to_numpy(zero_copy_only=False) for k in (len(keys), len(keys) + 1))
            scale = np.where(m == 0, 1.0, m)
            places = [b.column(k).to_numpy(zero_copy_only=False) for k in range(len(keys))]
            n = poisson(intensity * np.exp(-p / scale), places, seed)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(len(keys))), pa.array(np.where(m == 0, 0.0, -m * np.log(np.maximum(1, n) / intensity)))], [*keys, "p"])

    return map_arrow(sino.select(*keys, "p").join(F.broadcast(top)), noisy, ", ".join(f"{k} {kinds[k]}" for k in keys) + ", p double")  # one row
