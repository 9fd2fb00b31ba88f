"""Forward and back projection and what goes with them, as joins with the weight relation and sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.arrays import filled
from . import pixel_driven as pd3
from .geometry import Projection, Volume
from .weights import project_lines, rays_of, weights

RAY, PIXEL = ["a", "d"], ["r", "c"]


class Projector:
    """A projection geometry, a volume geometry and a kernel. Volumes are (r, c, v), sinograms (a, d, p)."""

    def __init__(self, spark: SparkSession, g: Projection, v: Volume, kernel: str = "linear", subrays: int = 1, blob: tuple[float, list[float]] | None = None):
        self.spark, self.g, self.v, self.kernel, self.subrays, self.blob = spark, g, v, kernel, subrays, blob
        self._held: DataFrame | None = None

    def matrix(self, rays: DataFrame | None = None, keep: str = "") -> DataFrame:
        """W(a, d, r, c, w), generated, or as held."""
        if self._held is not None:
            return self._held if rays is None else self._held.join(rays, RAY)
        return weights(self.spark, self.g, self.v, self.kernel, rays, self.subrays, self.blob, keep)

    def hold(self) -> Projector:
        """Keeps W on the executors' disks and memory, for methods that use it again and again."""
        self._held = weights(self.spark, self.g, self.v, self.kernel, None, self.subrays, self.blob).persist()
        return self

    def release(self) -> None:
        if self._held is not None:
            self._held.unpersist()
            self._held = None

    def rays(self) -> DataFrame:
        return rays_of(self.spark, self.g).select("a", "d")

    def pixels(self) -> DataFrame:
        return grid(self.spark, self.v)

    def fp(self, volume: DataFrame, rays: DataFrame | None = None, mask: DataFrame | None = None) -> DataFrame:
        """p = W v, for each ray that meets the volume. mask: (r, c, v), pixels that count where v isn't 0."""
        source = masked(volume, mask, PIXEL)
        if self._held is None and self.kernel != "sparse_matrix":
            found = project_lines(self.spark, self.g, self.v, self.kernel, source, rays, self.subrays, self.blob)
            if found is not None:
                return found
        return self.matrix(rays).join(source.select("r", "c", "v"), PIXEL).groupBy("a", "d").agg(F.sum(F.col("w") * F.col("v")).alias("p"))

    def bp(self, sino: DataFrame, mask: DataFrame | None = None, ray_mask: DataFrame | None = None) -> DataFrame:
        """v = W' p. The sinogram is carried along the rays, so that it needs no join with W unless W is held."""
        source = masked(sino, ray_mask, RAY).select("a", "d", "p")
        out = self.matrix(source, "p").groupBy("r", "c").agg(F.sum(F.col("w") * F.col("p")).alias("v"))
        return masked(out, mask, PIXEL)

    def residual(self, sino: DataFrame, volume: DataFrame) -> DataFrame:
        """p - W v for each ray of sino."""
        return sino.join(self.fp(volume).withColumnRenamed("p", "q"), RAY, "left").select("a", "d", (F.col("p") - F.coalesce("q", F.lit(0.0))).alias("p"))

    def ray_length(self) -> DataFrame:
        return self.matrix().groupBy("a", "d").agg(F.sum("w").alias("s"))

    def pixel_weight(self) -> DataFrame:
        return self.matrix().groupBy("r", "c").agg(F.sum("w").alias("s"))

    def square_weights(self) -> DataFrame:
        return self.matrix().groupBy("a", "d").agg(F.sum(F.col("w") * F.col("w")).alias("s"))

    def single_ray(self, a: int, d: int) -> DataFrame:
        """The weights of one ray, of which alone they are made."""
        return self.matrix(self.rays().where((F.col("a") == a) & (F.col("d") == d)))

    def projection(self, a: int) -> DataFrame:
        return self.matrix(self.rays().where(F.col("a") == a))

    def splat(self, r: int, c: int) -> DataFrame:
        """The weights of one pixel on all rays."""
        return self.matrix().where((F.col("r") == r) & (F.col("c") == c))

    def sparse(self) -> DataFrame:
        """W by ray number and pixel number: (row, col, val)."""
        return self.matrix().selectExpr(f"CAST(a * {self.g.cols} + d AS INT) AS row", f"CAST(r * {self.v.cols} + c AS INT) AS col", "w AS val")


class PixelProjector(Projector):
    """Forward projection along rays and back projection by pixels, which isn't its transpose; subrays for each detector pixel, subpixels along each axis of a pixel."""

    def __init__(self, spark: SparkSession, g: Projection, v: Volume, subrays: int = 1, subpixels: int = 1):
        super().__init__(spark, g, v, "cuda", subrays)
        self.subpixels = subpixels

    def bp(self, sino: DataFrame, mask: DataFrame | None = None, ray_mask: DataFrame | None = None) -> DataFrame:
        source = masked(sino, ray_mask, RAY).select("a", "d", "p")
        return masked(pd3.bp_pixel(self.spark, self.g, self.v, source, subpixels=self.subpixels), mask, PIXEL)

    def pixel_weight(self) -> DataFrame:
        return self.bp(self.rays().withColumn("p", F.lit(1.0))).withColumnRenamed("v", "s")


KERNELS_3D = ("default", "sum_square_weights", "2d_weighting", "matched_bp")


class Projector3D:
    """A projection geometry and a volume geometry in 3D, and a kernel: sum_square_weights changes forward projection, the other two back projection."""

    def __init__(self, spark: SparkSession, g: Projection, v: Volume, kernel: str = "default", subrays: int = 1, subvoxels: int = 1):
        if kernel not in KERNELS_3D:
            raise ValueError(f"{kernel} is no kernel")
        self.spark, self.g, self.v, self.kernel, self.subrays, self.subvoxels = spark, g, v, kernel, subrays, subvoxels

    def fp(self, volume: DataFrame) -> DataFrame:
        return pd3.fp_3d(self.spark, self.g, self.v, volume, self.kernel == "sum_square_weights", self.subrays)

    def bp(self, sino: DataFrame) -> DataFrame:
        if self.kernel == "matched_bp":
            return pd3.bp_matched_3d(self.spark, self.g, self.v, sino, self.subrays)
        return pd3.bp_voxel(self.spark, self.g, self.v, sino, "2d_weighting" if self.kernel == "2d_weighting" else "default", self.subvoxels)

    def rays(self) -> DataFrame:
        return filled(self.spark, self.g.shape, "sino3d").drop("p")

    def pixels(self) -> DataFrame:
        return filled(self.spark, self.v.shape, "vol3d").drop("v")


def grid(spark: SparkSession, v: Volume) -> DataFrame:
    rows = spark.range(v.rows).selectExpr("CAST(id AS INT) AS r")
    return rows.selectExpr("r", f"explode(sequence(0, {v.cols - 1})) AS c")


def masked(df: DataFrame, mask: DataFrame | None, on: list[str]) -> DataFrame:
    """The rows of df where the mask's value isn't 0."""
    if mask is None:
        return df
    value = next(c for c in mask.columns if c not in on)
    return df.join(mask.where(F.col(value) != 0).select(*on), on, "left_semi")
