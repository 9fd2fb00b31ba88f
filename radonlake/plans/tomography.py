"""Reconstruction settings in one object: what discrete tomography and its users call again and again, in 2D and 3D."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame

from ..functions import elementwise
from ..operators import tools
from ..operators.geometry import Projection, Volume
from ..operators.project import PixelProjector, Projector, Projector3D
from . import recon

METHODS = {"SIRT": recon.SIRT, "SART": recon.SART, "ART": recon.ART, "CGLS": recon.CGLS, "EM": recon.EM}


class IterativeTomography:
    """project, reconstruct and reconstruct_mask by one method.

    Without a volume geometry the grid has superresolution pixels for each detector pixel, or for each of image_size (rows, cols), around the origin.
    In 2D kernel names the weights, or cuda for pixel-driven back projection; SART and ART make a whole round of their views or rays for each iteration.
    In 3D the methods are SIRT and CGLS, matched unless kernel is cuda3d. inner_circle: 0 outside the grid's inner circle, slice by slice. use_minc: values of 0 at least.
    """

    def __init__(self, spark, g: Projection, v: Volume | None = None, method: str = "SIRT", kernel: str = "linear", superresolution: int = 1, inner_circle: bool = True, image_size: tuple[int, int] | None = None, use_minc: bool = False):
        if v is None:
            if g.rows:
                raise ValueError("a volume geometry is needed in 3D")
            rows, cols = image_size or (g.cols, g.cols)
            v = Volume(rows * superresolution, cols * superresolution, 0, (-cols / 2, cols / 2, -rows / 2, rows / 2))
        self.spark, self.g, self.v, self.kernel, self.superresolution, self.inner_circle, self.use_minc = spark, g, v, kernel, superresolution, inner_circle, use_minc
        self.method = method.upper().removesuffix("_CUDA").removesuffix("3D")
        if self.method not in (("SIRT", "CGLS") if g.rows else METHODS):
            raise ValueError(f"{method} is no method here")

    def settings(self) -> dict:
        return {k: getattr(self, k) for k in ("method", "kernel", "superresolution", "inner_circle", "use_minc")}

    def _projector(self, g: Projection):
        if g.rows:
            return Projector3D(self.spark, g, self.v)
        return PixelProjector(self.spark, g, self.v) if self.kernel == "cuda" else Projector(self.spark, g, self.v, self.kernel)

    def project(self, volume: DataFrame) -> DataFrame:
        """The projections: with superresolution the mean over each detector pixel's parts."""
        n = self.superresolution
        if n == 1 or self.g.rows:
            return self._projector(self.g).fp(volume)
        fine = replace(tools.superresolution(self.g, n), matrix=self.g.matrix)
        return tools.downsample(self._projector(fine).fp(volume), n).selectExpr("a", "d", f"p / {n} AS p")

    def reconstruct(self, sino: DataFrame, iterations: int, start: DataFrame | None = None) -> DataFrame:
        return self.reconstruct_mask(sino, None, iterations, start)

    def reconstruct_mask(self, sino: DataFrame, mask: DataFrame | None, iterations: int, start: DataFrame | None = None) -> DataFrame:
        """The reconstruction of the mask's cells alone; others stay as in start."""
        low = 0.0 if self.use_minc else None
        if self.g.rows:
            own = recon.Volume3D(self.spark, self.g, self.v, sino, matched=self.kernel != "cuda3d", low=low, start=start, mask=mask)
            found = own.sirt(iterations) if self.method == "SIRT" else own.cgls(iterations)
        else:
            rounds = {"SART": len(self.g.views), "ART": len(self.g.views) * self.g.cols}.get(self.method, 1)
            more = {"mask": mask} if mask is not None else {}
            if self.method == "CGLS" and start is not None:
                more["restart"] = True
            method = METHODS[self.method](self._projector(self.g), sino, start=start, low=low, **more)
            found = method.run(iterations * rounds)
            method.release()
        return elementwise.roi_select(found, self.v.rows, self.v.cols, (min(self.v.rows, self.v.cols) / 2) ** 2) if self.inner_circle else found

