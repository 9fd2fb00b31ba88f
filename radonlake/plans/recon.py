"""Reconstruction: iterative methods as loops over DataFrames, and filtered back projection.

Each iteration's volume is written to the shared folder, so that plans stay short and a lost executor costs no iterations.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import filters
from ..functions.text import num
from ..operators import geometry as geo
from ..operators import pixel_driven as pd3
from ..operators.geometry import Projection, Volume
from ..operators.project import PIXEL, RAY, Projector, grid, masked
from ..sources.arrays import filled
from .lineage import cut

GATE = 1e-6


def inverse(s: str) -> str:
    return f"CASE WHEN {s} > 1e-6 THEN 1e0 / {s} ELSE 0e0 END"


class Method:
    """What iterative methods share: projector, measured sinogram, masks, bounds, and the volume so far."""

    def __init__(self, projector: Projector, sino: DataFrame, start: DataFrame | None = None, mask: DataFrame | None = None, ray_mask: DataFrame | None = None, low: float | None = None, high: float | None = None, relaxation: float = 1.0, hold: bool = True, low_mask: DataFrame | None = None, high_mask: DataFrame | None = None):
        self.holds = hold and projector._held is None
        self.projector = projector.hold() if self.holds else projector
        self.bounds = {k: x.select("r", "c", F.col(next(c for c in x.columns if c not in PIXEL)).alias(k)) for k, x in (("lo", low_mask), ("hi", high_mask)) if x is not None}
        self.spark = projector.spark
        self.sino = masked(sino.select("a", "d", "p"), ray_mask, RAY)
        self.mask, self.low, self.high, self.relaxation = mask, low, high, relaxation
        zero = filled(self.spark, projector.v.shape, "vol2d")
        self.volume = cut(start.select("r", "c", "v") if start is not None else zero)

    def release(self) -> None:
        """Lets go of W, if this method made it be held."""
        if self.holds:
            self.projector.release()

    def clamped(self, v: str) -> str:
        if self.low is not None:
            v = f"greatest({v}, {num(self.low)})"
        v = f"least({v}, {num(self.high)})" if self.high is not None else v
        v = f"greatest({v}, lo)" if "lo" in self.bounds else v  # a cell that has no bound is left as it is
        return f"least({v}, hi)" if "hi" in self.bounds else v

    def updated(self, change: DataFrame, form: str) -> None:
        """volume := form of v and x, the change's value, in the reconstruction mask; other cells stay."""
        df = self.volume.join(change.select("r", "c", F.col("v").alias("x")), PIXEL, "left").fillna(0.0, ["x"])
        for bound in self.bounds.values():
            df = df.join(bound, PIXEL, "left")
        new = self.clamped(form)
        if self.mask is not None:
            own = next(c for c in self.mask.columns if c not in PIXEL)
            df = df.join(self.mask.select("r", "c", F.col(own).alias("m")), PIXEL, "left").fillna(0.0, ["m"])
            new = f"CASE WHEN m <> 0e0 THEN {new} ELSE v END"
        self.volume = cut(df.selectExpr("r", "c", f"{new} AS v"))

    def inside(self, volume: DataFrame) -> DataFrame:
        return masked(volume, self.mask, PIXEL)

    def residual_norm(self) -> float:
        """The length of b - W v."""
        return math.sqrt(self.projector.residual(self.sino, self.volume).agg(F.sum(F.col("p") * F.col("p"))).first()[0] or 0.0)

    def run(self, iterations: int = 1) -> DataFrame:
        for _ in range(iterations):
            self.step()
        return self.volume


class SIRT(Method):
    """x += relaxation C W' R (b - W x), with C and R the inverse column and row sums."""

    def __init__(self, *args, **options):
        super().__init__(*args, **options)
        ones = self.inside(grid(self.spark, self.projector.v).withColumn("v", F.lit(1.0)))
        lengths = self.projector.fp(ones).join(self.sino.select(*RAY), RAY, "left_semi")
        self.rays = cut(lengths.selectExpr("a", "d", f"{inverse('p')} AS s"))
        self.pixels = cut(self.inside(self.projector.bp(self.sino.withColumn("p", F.lit(1.0)))).selectExpr("r", "c", f"{inverse('v')} AS s"))

    def step(self) -> None:
        gap = self.projector.residual(self.sino, self.volume).join(self.rays, RAY).selectExpr("a", "d", "p * s AS p")
        back = self.projector.bp(gap).join(self.pixels, PIXEL).selectExpr("r", "c", "v * s AS v")
        self.updated(back, f"v + {num(self.relaxation)} * x")


class EM(Method):
    """x := x W'(b / W x) / W' 1."""

    def __init__(self, *args, **options):
        if options.get("mask") is not None or options.get("ray_mask") is not None:
            raise ValueError("this method takes no masks")
        super().__init__(*args, **options)
        if options.get("start") is None and len(args) < 3:
            self.volume = cut(self.volume.selectExpr("r", "c", "1e0 AS v"))
        self.pixels = cut(self.projector.pixel_weight().selectExpr("r", "c", f"{inverse('s')} AS s"))

    def step(self) -> None:
        quotient = self.sino.join(self.projector.fp(self.volume).withColumnRenamed("p", "q"), RAY).selectExpr("a", "d", "CASE WHEN q > 1e-6 THEN p / q ELSE 0e0 END AS p")
        back = self.projector.bp(quotient).join(self.pixels, PIXEL).selectExpr("r", "c", "v * s AS v")
        self.updated(back, "v * x")


class SART(Method):
    """One view a step, in a given order (repeats count once), by SIRT's update on its rays.

    Each step depends on the one before it and is a job of its own, so that many views take many jobs: SIRT, CGLS and EM scale further.
    """

    def __init__(self, *args, order: list[int] | None = None, **options):
        super().__init__(*args, **options)
        self.order = list(dict.fromkeys(order)) if order else list(range(len(self.projector.g.views)))
        self.at = 0

    def view(self) -> DataFrame:
        """The rays of the next view."""
        a = self.order[self.at % len(self.order)]
        self.at += 1
        return self.sino.where(F.col("a") == a)

    def step(self) -> None:
        rays = self.view()
        w = masked(self.projector.matrix(rays.select(*RAY)), self.mask, PIXEL)
        length, weight = w.groupBy("a", "d").agg(F.sum("w").alias("length")), w.groupBy("r", "c").agg(F.sum("w").alias("weight"))
        fp = w.join(self.volume, PIXEL).groupBy("a", "d").agg(F.sum(F.col("w") * F.col("v")).alias("q"))
        gap = rays.join(fp, RAY, "left").join(length, RAY).selectExpr("a", "d", "p - coalesce(q, 0e0) AS p", "length")
        back = w.join(gap, RAY).join(weight, PIXEL).where("abs(weight * length) > 0.001e0").groupBy("r", "c").agg(F.sum(F.expr("w * p / (weight * length)")).alias("v"))
        self.updated(back, f"v + {num(self.relaxation)} * x")


class PixelSART(SART):
    """SART with pixel-driven back projection, whose density of rays and pixel weights cancel out: a pixel takes what its place on the view has."""

    def step(self) -> None:
        rays = self.view()
        own = rays.select(*RAY)
        length = self.projector.fp(self.inside(grid(self.spark, self.projector.v).withColumn("v", F.lit(1.0))), own).selectExpr("a", "d", f"{inverse('p')} AS s")
        fp = self.projector.fp(self.volume, own).withColumnRenamed("p", "q")
        gap = rays.join(fp, RAY, "left").join(length, RAY).selectExpr("a", "d", "(p - coalesce(q, 0e0)) * s AS p")
        back = pd3.bp_pixel(self.spark, self.projector.g, self.projector.v, gap, plain=True)
        self.updated(self.inside(back), f"v + {num(self.relaxation)} * x")


class ART(Method):
    """One ray a step: x += relaxation (b - <w, x>) / <w, w> w; only the ray's pixels are clamped. A step is a job, for orders of some hundred rays."""

    def __init__(self, *args, order: list[tuple[int, int]] | None = None, **options):
        super().__init__(*args, **options)
        self.order = order or [(a, d) for a in range(len(self.projector.g.views)) for d in range(self.projector.g.cols)]
        self.at = 0

    def step(self) -> None:
        a, d = self.order[self.at % len(self.order)]
        self.at += 1
        w = masked(self.projector.single_ray(a, d), self.mask, PIXEL).select("r", "c", "w")
        b = self.sino.where((F.col("a") == a) & (F.col("d") == d)).select("p")
        sums = w.join(self.volume, PIXEL).agg(F.sum(F.col("w") * F.col("v")).alias("wx"), F.sum(F.col("w") * F.col("w")).alias("ww"))
        new = self.clamped(f"v + {num(self.relaxation)} * (p - wx) / ww * w")
        df = self.volume.join(w, PIXEL, "left").join(F.broadcast(sums.join(b)), how="left")  # one row
        self.volume = cut(df.selectExpr("r", "c", f"CASE WHEN w IS NULL OR p IS NULL OR coalesce(ww, 0e0) = 0e0 THEN v ELSE {new} END AS v"))


class CGLS(Method):
    """Conjugate gradients on the normal equations; restart takes the start volume into account, else the first residual is b."""

    def __init__(self, *args, restart: bool = False, **options):
        super().__init__(*args, **options)
        self.r = cut(self.projector.residual(self.sino, self.volume)) if restart else self.sino
        self.p = self.gamma = None

    def back(self) -> DataFrame:
        z = grid(self.spark, self.projector.v).join(self.inside(self.projector.bp(self.r)), PIXEL, "left").fillna(0.0, ["v"])
        return cut(z)

    def step(self) -> None:
        if self.p is None:
            self.p = self.back()
            self.gamma = self.p.agg(F.sum(F.col("v") * F.col("v"))).first()[0]
        w = cut(self.projector.fp(self.p))
        ww = w.agg(F.sum(F.col("p") * F.col("p"))).first()[0]
        if not ww:
            return
        alpha = self.gamma / ww
        self.updated(self.p, f"v + {num(alpha)} * x")
        self.r = cut(self.r.join(w.withColumnRenamed("p", "q"), RAY, "left").selectExpr("a", "d", f"p - {num(alpha)} * coalesce(q, 0e0) AS p"))
        z = self.back()
        gamma = z.agg(F.sum(F.col("v") * F.col("v"))).first()[0]
        beta, self.gamma = gamma / self.gamma if self.gamma else 0.0, gamma
        self.p = cut(z.join(self.p.withColumnRenamed("v", "x"), PIXEL).selectExpr("r", "c", f"v + {num(beta)} * x AS v"))


def filtered(rows: DataFrame, g: Projection, name: str, parameter: float, d: float, taps: dict | None, by: tuple[str, ...] = ("a",)) -> DataFrame:
    """Rows filtered by name, or by a user's taps; none leaves them as they are."""
    if taps is None and name == "none":
        return rows
    return filters.filter_rows(rows, taps or filters.taps_of(name, g.cols, parameter, d), g.cols, by)


def fbp(projector: Projector, sino: DataFrame, name: str = "ram-lak", parameter: float = -1.0, d: float = 1.0, taps: dict | None = None) -> DataFrame:
    """Filtered back projection of a parallel geometry: (r, c, v). taps: a user's filter, by lag, or by view and lag."""
    g = projector.g
    if not g.kind.startswith("parallel"):
        raise ValueError("this method takes parallel rays")
    px, py = projector.v.pixel[:2]
    return projector.bp(filtered(sino, g, name, parameter, d, taps)).selectExpr("r", "c", f"v * {num(math.pi / (2 * len(g.views) * px * py))} AS v")


def relative_angles(angles: list[float]) -> tuple[list[float], float]:
    """Each view's turn from the lower end of the scan, from 0 to 2 pi, and the range that was scanned, with a step after its last view."""
    turn = 2 * math.pi
    base = angles[0] if (angles[1] - angles[0] + math.pi) % turn - math.pi >= 0 else angles[-1]
    found = [(t - base) % turn for t in angles]
    # A view as good as at the base is there, and not a turn on.
    found = [0.0 if turn - t < 1e-9 else t for t in found]
    return found, abs(found[-1] - found[0]) / (len(angles) - 1) * len(angles)


def parker_weight(n: int, width: float, whole: float, scanned: float, d: str = "d") -> str:
    """The short-scan weight of a fan's ray, by column angle (the view's turn) and detector number; whole: distance of source and detector.

    Each line is seen by one ray or by two, whose weights add up to 1: they rise and fall as squared sines over the ends of the scan. The scale makes the sum over
    views that of a scan of half a turn.
    """
    half = abs(math.atan(width * n / 2 / whole))
    gamma = f"atan(({d} - {num((n - 1) / 2)}) * {num(width / whole)})"
    rise, fall = f"sin({num(math.pi / 4)} * angle / ({num(half)} + {gamma}))", f"sin({num(math.pi / 4)} * ({num(math.pi + 2 * half)} - angle) / ({num(half)} - {gamma}))"
    share = f"CASE WHEN angle <= 0e0 THEN 0e0 WHEN angle <= 2e0 * ({num(half)} + {gamma}) THEN {rise} * {rise} WHEN angle <= {num(math.pi)} + 2e0 * {gamma} THEN 1e0 WHEN angle <= {num(math.pi + 2 * half)} THEN {fall} * {fall} ELSE 0e0 END"
    return f"{num(scanned / math.pi)} * ({share})"


def with_parker(sino: DataFrame, angles: list[float], n: int, width: float, whole: float) -> DataFrame:
    """The sinogram (a, d, p) or (dv, a, du, p) times its short-scan weights; a scan of one view is left as it is."""
    if len(angles) < 2:
        return sino
    turns, scanned = relative_angles(angles)
    keys = [c for c in sino.columns if c != "p"]
    table = sino.sparkSession.createDataFrame(list(enumerate(map(float, turns))), "a int, angle double")
    return sino.join(F.broadcast(table), "a").selectExpr(*keys, f"p * ({parker_weight(n, width, whole, scanned, 'd' if 'd' in keys else 'du')}) AS p")  # a row for each view


def fan_weight(n: int, width: float, whole: float) -> str:
    """The cosine of a fan's ray to the central one, by d."""
    u = f"((d - {num((n - 1) / 2)}) * {num(width)})"
    return f"{num(whole)} / sqrt({num(whole * whole)} + {u} * {u})"


def fbp_pixel(spark: SparkSession, g: Projection, v: Volume, sino: DataFrame, name: str = "ram-lak", short: bool = False, parameter: float = -1.0, d: float = 1.0, taps: dict | None = None) -> DataFrame:
    """Filtered back projection with pixel-driven back projection, of parallel and fan geometries; vectors of a fan give their circle. short: of a short scan of a fan."""
    work, scale = sino, math.pi / (2 * len(g.views))
    if g.diverges:
        angles, source, detector, width = geo.circular_fan(g)
        whole = source + detector
        work = sino.selectExpr("a", "d", f"p * ({fan_weight(g.cols, width, whole)}) AS p")
        work = with_parker(work, angles, g.cols, width, whole) if short else work
        scale *= whole / source / width
    work = filtered(work, g, name, parameter, d, taps)
    return pd3.bp_pixel(spark, g, v, work, fbp=g.diverges).selectExpr("r", "c", f"v * {num(scale)} AS v")


def fdk(spark: SparkSession, g: Projection, v: Volume, sino: DataFrame, name: str = "ram-lak", short: bool = False, parameter: float = -1.0, d: float = 1.0, taps: dict | None = None, subvoxels: int = 1) -> DataFrame:
    """Cone-beam reconstruction: weights by the ray's length, filter along rows, voxel-driven back projection. Vectors must be those of an upright cone; its detector may be shifted along z."""
    if not g.kind.startswith("cone"):
        raise ValueError("this method takes a cone geometry")
    angles, source, detector, su, sv, shift = geo.circular_cone(g)
    whole = source + detector
    u, w = f"((du - {num((g.cols - 1) / 2)}) * {num(su)})", f"((dv - {num((g.rows - 1) / 2)}) * {num(sv)} + {num(shift)})"
    weighted = sino.selectExpr("dv", "a", "du", f"p * {num(whole * whole / (su * source) * math.pi / 2 / len(g.views))} / sqrt({num(whole * whole)} + {u} * {u} + {w} * {w}) AS p")
    weighted = with_parker(weighted, angles, g.cols, su, whole) if short else weighted
    rows = filtered(weighted.withColumnRenamed("du", "d"), g, name, parameter, d, taps, ("dv", "a")).withColumnRenamed("d", "du")
    return pd3.bp_voxel(spark, g, v, rows, "fdk", subvoxels)


class Volume3D:
    """SIRT and CGLS in 3D. matched = False takes voxel-driven back projection; masks are tables of cells that count where their value isn't 0; start: the first volume.

    Rays that sino lacks don't count, and neither do those of a ray mask's 0. subrays and subvoxels: as in fp_3d and bp_voxel.
    """

    def __init__(self, spark: SparkSession, g: Projection, v: Volume, sino: DataFrame, matched: bool = True, low: float | None = None, high: float | None = None, relaxation: float = 1.0, start: DataFrame | None = None, mask: DataFrame | None = None, ray_mask: DataFrame | None = None, subrays: int = 1, subvoxels: int = 1):
        self.spark, self.g, self.v, self.matched, self.low, self.high, self.relaxation = spark, g, v, matched, low, high, relaxation
        self.keys, self.ray, self.mask, self.subrays, self.subvoxels = ["z", "r", "c"], ["dv", "a", "du"], mask, subrays, subvoxels
        self.sino = masked(sino.select(*self.ray, "p"), ray_mask, self.ray)
        grid3 = filled(spark, v.shape, "vol3d")
        self.volume = cut(start.select(*self.keys, "v") if start is not None else grid3)
        self.grid = masked(grid3, mask, self.keys).select(*self.keys)

    def bp(self, sino: DataFrame) -> DataFrame:
        if self.matched:
            out = pd3.bp_matched_3d(self.spark, self.g, self.v, sino, self.subrays)
        else:
            out = pd3.bp_voxel(self.spark, self.g, self.v, sino, subvoxels=self.subvoxels)
        return masked(out, self.mask, self.keys)

    def fp(self, volume: DataFrame) -> DataFrame:
        return pd3.fp_3d(self.spark, self.g, self.v, volume, subrays=self.subrays)

    def residual(self, sino: DataFrame) -> DataFrame:
        return sino.join(self.fp(self.volume).withColumnRenamed("p", "q"), self.ray, "left").selectExpr(*self.ray, "p - coalesce(q, 0e0) AS p")

    def residual_norm(self) -> float:
        return math.sqrt(self.residual(self.sino).agg(F.sum(F.col("p") * F.col("p"))).first()[0] or 0.0)

    def clamped(self, v: str) -> str:
        v = f"greatest({v}, {num(self.low)})" if self.low is not None else v
        return f"least({v}, {num(self.high)})" if self.high is not None else v

    def updated(self, change: DataFrame, form: str) -> None:
        """volume := form of v and x in the mask; other cells stay."""
        inside = self.grid.withColumn("m", F.lit(1))
        df = self.volume.join(change.select(*self.keys, F.col("v").alias("x")), self.keys, "left").fillna(0.0, ["x"]).join(inside, self.keys, "left")
        self.volume = cut(df.selectExpr(*self.keys, f"CASE WHEN m = 1 THEN {self.clamped(form)} ELSE v END AS v"))

    def sirt(self, iterations: int) -> DataFrame:
        rays = cut(self.fp(self.grid.withColumn("v", F.lit(1.0))).selectExpr(*self.ray, f"{inverse('p')} AS s"))
        pixels = cut(self.bp(self.sino.withColumn("p", F.lit(1.0))).selectExpr(*self.keys, f"{inverse('v')} AS s"))
        for _ in range(iterations):
            gap = self.residual(self.sino).join(rays, self.ray).selectExpr(*self.ray, "p * s AS p")
            self.updated(self.bp(gap).join(pixels, self.keys).selectExpr(*self.keys, "v * s AS v"), f"v + {num(self.relaxation)} * x")
        return self.volume

    def cgls(self, iterations: int) -> DataFrame:
        r = cut(self.residual(self.sino))
        full = lambda df: cut(self.grid.join(df, self.keys, "left").fillna(0.0, ["v"]))
        square = lambda df, c: df.agg(F.sum(F.col(c) * F.col(c))).first()[0] or 0.0
        p = full(self.bp(r))
        gamma = square(p, "v")
        for _ in range(iterations):
            w = cut(self.fp(p).join(self.sino.select(*self.ray), self.ray, "left_semi"))
            if not (ww := square(w, "p")):
                break
            alpha = gamma / ww
            self.updated(p, f"v + {num(alpha)} * x")
            r = cut(r.join(w.withColumnRenamed("p", "q"), self.ray, "left").selectExpr(*self.ray, f"p - {num(alpha)} * coalesce(q, 0e0) AS p"))
            z = full(self.bp(r))
            now = square(z, "v")
            beta, gamma = now / gamma if gamma else 0.0, now
            p = cut(z.join(p.withColumnRenamed("v", "x"), self.keys).selectExpr(*self.keys, f"v + {num(beta)} * x AS v"))
        return self.volume


def bp_sirt_weighted(spark: SparkSession, g: Projection, v: Volume, volume: DataFrame, sino: DataFrame) -> DataFrame:
    """volume + BP(sino) / BP(1)."""
    keys = ["z", "r", "c"]
    one = pd3.bp_voxel(spark, g, v, sino.withColumn("p", F.lit(1.0))).withColumnRenamed("v", "n")
    back = pd3.bp_voxel(spark, g, v, sino).withColumnRenamed("v", "x").join(one, keys)
    return volume.join(back, keys, "left").selectExpr(*keys, "v + CASE WHEN n > 1e-6 THEN x / n ELSE 0e0 END AS v")
