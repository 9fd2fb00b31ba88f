"""Tools around sinograms and images: downsampling, rebinning, orders, resampling, comparison, slices."""

from __future__ import annotations

import math
import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import num
from .geometry import Projection


def downsample(sino: DataFrame, factor: int, square: bool = False) -> DataFrame:
    """Sums of factor neighbouring detector pixels, divided by factor squared if asked for."""
    scale = factor * factor if square else 1
    return sino.groupBy("a", F.expr(f"CAST(d DIV {factor} AS INT)").alias("d")).agg((F.sum("p") / scale).alias("p"))


def superresolution(g: Projection, factor: int) -> Projection:
    """The geometry with factor detector pixels for each; views stay."""
    views = tuple((*v[:4], v[4] / factor, v[5] / factor) for v in g.views)
    return Projection(g.kind, g.cols * factor, views, distances=g.distances, angles=g.angles)


def rebin(sino: DataFrame, g: Projection, angles: list[float], width: float) -> DataFrame:
    """A fan sinogram as a parallel one (a, d, p): each parallel ray takes the nearest fan ray by angle, then by distance from the origin.

    Parallel rays are at the detector's pixel centres times width. A parallel ray's nearest fan angle and detector follow from its own, so that no two tables are compared.
    """
    spark = sino.sparkSession
    source = g.distances[0]
    total = sum(g.distances)
    pitch = math.hypot(*g.views[0][4:]) * source / total
    first, step = g.angles[0], g.angles[1] - g.angles[0]
    table = spark.createDataFrame([(k, float(t)) for k, t in enumerate(angles)], "a int, t double")
    rays = table.selectExpr("a", "t", f"explode(sequence(0, {g.cols - 1})) AS d").selectExpr("a", "d", "t", f"(d - {num((g.cols - 1) / 2)}) * {num(width)} AS s").where(f"abs(s) < {num(source)}")
    near = rays.selectExpr("a", "d", f"asin(s / {num(source)}) AS gamma", "t").selectExpr("a", "d", f"CAST(floor((t - gamma - {num(first)}) / {num(step)} + 0.5e0) AS INT) AS fa", f"CAST(floor(tan(gamma) * {num(source)} / {num(pitch)} + {num((g.cols - 1) / 2)} + 0.5e0) AS INT) AS fd")
    return near.join(sino.selectExpr("a AS fa", "d AS fd", "p"), ["fa", "fd"]).select("a", "d", "p")


def ray_order(kind: str, views: int, detectors: int, seed: int = 0) -> list[tuple[int, int]]:
    """Orders of rays for row-action methods: sequential, randomray, randomproj."""
    rays = [(a, d) for a in range(views) for d in range(detectors)]
    made = random.Random(seed)
    if kind == "randomray":
        made.shuffle(rays)
    elif kind == "randomproj":
        order = list(range(views))
        made.shuffle(order)
        rays = [(a, d) for a in order for d in range(detectors)]
    elif kind != "sequential":
        raise ValueError(f"{kind} is no order")
    return rays


def rnmp(found: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: nmp, how many pixels differ, and rnmp, that relative to the truth's pixels that aren't 0."""
    both = found.join(truth.withColumnRenamed("v", "t"), ["r", "c"])
    return both.agg(F.sum(F.when(F.col("v") != F.col("t"), 1).otherwise(0)).cast("long").alias("nmp"), (F.sum(F.when(F.col("v") != F.col("t"), 1.0).otherwise(0.0)) / F.sum(F.when(F.col("t") != 0, 1.0).otherwise(0.0))).alias("rnmp"))


def projection_difference(found: DataFrame, measured: DataFrame) -> DataFrame:
    """One row (s): the sum of squared differences over the sum of what was measured."""
    both = measured.join(found.withColumnRenamed("p", "q"), ["a", "d"], "left")
    gap = F.col("p") - F.coalesce("q", F.lit(0.0))
    return both.agg((F.sum(gap * gap) / F.sum("p")).alias("s"))


def resize3d(volume: DataFrame, old: tuple[int, int, int], new: tuple[int, int, int]) -> DataFrame:
    """Nearest-neighbour resampling of a volume: each old cell goes to the new cells that it is nearest to."""
    df = volume
    for k, n, m in zip(("z", "r", "c"), old, new, strict=True):
        low, high = f"CAST(ceil({k} * {num(m / n)}) AS INT)", f"CAST(ceil(({k} + 1) * {num(m / n)}) AS INT) - 1"
        df = df.where(f"{high} >= {low}").selectExpr(*[x for x in df.columns if x != k], f"explode(sequence({low}, {high})) AS {k}")
    return df.select("z", "r", "c", "v")


def slice_of(volume: DataFrame, axis: str, k: int) -> DataFrame:
    """One slice across an axis: z, r or c."""
    return volume.where(F.col(axis) == k).drop(axis)


def overlay(image: DataFrame, over: DataFrame, share: float = 0.5) -> DataFrame:
    """Both images mixed where over isn't 0."""
    df = image.join(over.withColumnRenamed("v", "w"), ["r", "c"], "left")
    return df.selectExpr("r", "c", f"CASE WHEN coalesce(w, 0e0) <> 0e0 THEN {num(1 - share)} * v + {num(share)} * w ELSE v END AS v")


def overlay_rgb(image: DataFrame, truth: DataFrame) -> DataFrame:
    """(r, c, red, green, blue): the image as red and the truth as green, each by its largest value. The two numbers join as one row each."""
    scaled = lambda df, name: df.join(F.broadcast(df.agg(F.max("v").alias("top")))).selectExpr("r", "c", f"v / top AS {name}")
    return scaled(image, "red").join(scaled(truth, "green"), ["r", "c"], "full").fillna(0.0, ["red", "green"]).withColumn("blue", F.lit(0.0))


def kaiser_bessel(points, alpha: float, radius: float, order: int = 0) -> list[float]:
    """A Kaiser-Bessel window of that order (0 to 2), alpha and radius at distances from its middle, 0 outside.

    (1 - (r / a)^2)^(m / 2) I_m(alpha sqrt(1 - (r / a)^2)) / I_m(alpha), by the series of the modified Bessel function.
    """
    if order not in (0, 1, 2):
        raise ValueError("the order is 0, 1 or 2")

    def bessel(x: float) -> float:
        term = (x / 2) ** order / math.factorial(order)
        total, k = term, 0
        while term > 1e-17 * total:
            k += 1
            term *= (x / 2) ** 2 / (k * (k + order))
            total += term
        return total

    out = []
    for r in points:
        q = 1 - (r / radius) ** 2
        out.append(math.sqrt(q) ** order * bessel(alpha * math.sqrt(q)) / bessel(alpha) if q >= 0 else 0.0)
    return out


def linspace2(first: float, last: float, n: int) -> list[float]:
    """n evenly spaced numbers from first on, of which the next would be last."""
    return [first + (last - first) * k / n for k in range(n)]
