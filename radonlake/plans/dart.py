"""Discrete tomography: segment, find the border, reconstruct it alone, smooth, again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import num
from ..operators import stencil
from ..operators.project import Projector
from .lineage import cut
from .recon import SIRT


def segmentation(levels: list[float], thresholds: list[float]) -> str:
    """The grey level of v: levels[k] from thresholds[k - 1] on."""
    cases = "".join(f" WHEN v >= {num(t)} THEN {num(x)}" for x, t in reversed(list(zip(levels[1:], thresholds, strict=True))))
    return f"CASE{cases} ELSE {num(levels[0])} END"


def segment(volume: DataFrame, levels: list[float], thresholds: list[float]) -> DataFrame:
    keys = [c for c in volume.columns if c != "v"]
    return volume.selectExpr(*keys, f"{segmentation(levels, thresholds)} AS v")


def schedule(values: dict[str, list[float]], k: int) -> dict[str, float]:
    """Adaptive parameters: the k-th value of each, or its last."""
    return {name: x[min(k, len(x) - 1)] for name, x in values.items()}


def dart(projector: Projector, sino: DataFrame, levels: list[float], thresholds: list[float], iterations: int = 2, first: int = 10, inner: int = 3, smoothing: float = 0.1, free: float = 0.0, seed: int = 0, adapt: dict[str, list[float]] | None = None, linear: bool = True) -> DataFrame:
    """Iterations of the method from a SIRT start. free: share of pixels outside the border that are updated too, by a hash of their place.

    linear: the fixed pixels' projections are taken off the sinogram and the border is reconstructed from the rest; otherwise all pixels are projected, and the border alone
    changes, which also suits projections that aren't linear in the image. adapt: values of smoothing and free by iteration.
    """
    own = SIRT(projector, sino)
    volume = own.run(first)
    for k in range(iterations):
        now = {"smoothing": smoothing, "free": free} | schedule(adapt or {}, k)
        flat = cut(segment(volume, levels, thresholds))
        border = stencil.mask_over(flat, 0, 8)
        chance = F.pmod(F.xxhash64("r", "c", F.lit(seed + k)), F.lit(1_000_000)) < int(now["free"] * 1_000_000)
        border = cut(border.withColumn("v", F.when(chance, 1.0).otherwise(F.col("v"))))
        fixed = flat.join(border.where("v = 0").select("r", "c"), ["r", "c"], "left_semi")
        rest = projector.residual(sino, fixed) if linear else sino
        outside = "0e0" if linear else "s"
        start = volume.join(border.withColumnRenamed("v", "m"), ["r", "c"]).join(flat.withColumnRenamed("v", "s"), ["r", "c"]).selectExpr("r", "c", f"CASE WHEN m <> 0e0 THEN v ELSE {outside} END AS v")
        moved = SIRT(projector, rest, start=start, mask=border).run(inner)
        merged = moved.join(border.withColumnRenamed("v", "m"), ["r", "c"]).join(flat.withColumnRenamed("v", "s"), ["r", "c"]).selectExpr("r", "c", "CASE WHEN m <> 0e0 THEN v ELSE s END AS v")
        volume = cut(stencil.smooth_padded(merged, now["smoothing"]))
    own.release()
    return segment(volume, levels, thresholds)


def search_all(score: Callable[..., float], ranges: dict[str, tuple[float, float]], rounds: int = 2, steps: int = 12) -> dict[str, float]:
    """The least of a score of several named parameters, by golden section along one after the other from the middles of their ranges, rounds times over."""
    best = {name: (low + high) / 2 for name, (low, high) in ranges.items()}
    for _ in range(rounds):
        for name, (low, high) in ranges.items():
            best[name] = search(lambda x, name=name: score(**best | {name: x}), low, high, steps)
    return best


def search(score: Callable[[float], float], low: float, high: float, steps: int = 20) -> float:
    """The least of a score with one valley, by golden section; each try is a run."""
    g = (5**0.5 - 1) / 2
    a, b = low, high
    x, y = b - g * (b - a), a + g * (b - a)
    fx, fy = score(x), score(y)
    for _ in range(steps):
        if fx < fy:
            b, y, fy = y, x, fx
            x = b - g * (b - a)
            fx = score(x)
        else:
            a, x, fx = x, y, fy
            y = a + g * (b - a)
            fy = score(y)
    return (a + b) / 2
