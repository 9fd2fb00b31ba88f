"""Iterations in blocks of arrays, for volumes small enough to be sent to all executors.

A task takes whole views, makes their weights as arrays, projects, compares and back projects in one pass, and emits its sum in
blocks of pixels, which meet by block. The volume is bounded by MOST_CELLS; beyond it the joins of plans.recon do the same.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.workers import map_arrow, on_workers
from ..operators.geometry import Projection, Volume
from ..operators.project import Projector
from ..sources.arrays import from_array
from . import recon

#: Cells of a volume at most; cells of a block; bytes of all tasks' sums that go to the driver without meeting on executors first.
MOST_CELLS, BLOCK, MOST_COLLECTED = 4_000_000, 1 << 14, 64 << 20
KERNELS = ("line", "linear", "strip", "distance_driven")


def _area(x: np.ndarray, s: float, t: float) -> np.ndarray:
    if t - s < 1e-12:
        return np.clip(0.5 + x, 0.0, 1.0)
    near = np.clip(np.abs(x), 0.0, t)
    bend = np.maximum(near - s, 0.0)
    return 0.5 + np.sign(x) * (near - bend * bend / (2 * (t - s)))


def view_weights(view: tuple[float, ...], v: Volume, cols: int, kernel: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(detector, pixel, weight) of the non-zero weights of a view of parallel rays."""
    ex, ey, dx, dy, ux, uy = view
    px, py = v.pixel[:2]
    d = np.arange(cols) + 0.5
    x, y = dx + d * ux, dy + d * uy
    norm, steep = float(np.hypot(ex, ey)), abs(ex) < abs(ey)
    first_x, first_y = v.window[0] + px / 2, v.window[3] - py / 2
    if steep:
        m, length, half, dt = ex / ey, px * norm / abs(ey), abs((ux - uy * ex / ey) / px) / 2, -(ex / ey) * py / px
        t0, steps, wide = (x + (first_y - y) * m - first_x) / px, v.rows, v.cols
    else:
        m, length, half, dt = ey / ex, py * norm / abs(ex), abs((uy - ux * ey / ex) / py) / 2, -(ey / ex) * px / py
        t0, steps, wide = -(y + (first_x - x) * m - first_y) / py, v.cols, v.rows
    t = t0[:, None] + dt * np.arange(steps)
    s, e = 0.5 - abs(m) / 2, 0.5 + abs(m) / 2
    reach = {"line": e, "linear": 1.0, "strip": half + e, "distance_driven": half + 0.5}[kernel]
    low = np.ceil(t - reach).astype(np.int32)
    scale = px * py * norm / abs(ux * ey - uy * ex)
    out: list[tuple] = []
    rays, walk = np.arange(cols, dtype=np.int32)[:, None], np.arange(steps, dtype=np.int32)
    for j in range(int(2 * reach) + 1):
        q = low + j
        o = t - q
        if kernel == "line":
            w = length * np.clip((e - np.abs(o)) / max(e - s, 1e-12), 0.0, 1.0)
        elif kernel == "linear":
            w = length * np.maximum(0.0, 1 - np.abs(o))
        elif kernel == "strip":
            w = (_area(o + half, s, e) - _area(o - half, s, e)) * scale
        else:
            w = np.maximum(0.0, np.minimum(0.5, o + half) - np.maximum(-0.5, o - half)) * scale
        there = (q >= 0) & (q < wide) & (w > 1e-12)
        pixel = walk * v.cols + q if steep else q * v.cols + walk
        out.append((np.broadcast_to(rays, t.shape)[there], pixel[there], w[there]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


class Strips:
    """The strip kernel of a view without its weights: a ray's share of a pixel is the difference of what lies beside its two edges, which neighbours share.

    Along each step of the walk an edge has whole pixels on one side, whose sum is a running total, and at most two that it cuts.
    """

    def __init__(self, view: tuple[float, ...], v: Volume, cols: int):
        ex, ey, dx, dy, ux, uy = view
        px, py = v.pixel[:2]
        d = np.arange(cols + 1)
        x, y = dx + d * ux, dy + d * uy
        first_x, first_y = v.window[0] + px / 2, v.window[3] - py / 2
        self.steep, self.shape, self.cols = abs(ex) < abs(ey), v.shape, cols
        if self.steep:
            m, dt = ex / ey, -(ex / ey) * py / px
            t0, self.steps, self.wide = (x + (first_y - y) * m - first_x) / px, v.rows, v.cols
        else:
            m, dt = ey / ex, -(ey / ex) * px / py
            t0, self.steps, self.wide = -(y + (first_x - x) * m - first_y) / py, v.cols, v.rows
        s, e = 0.5 - abs(m) / 2, 0.5 + abs(m) / 2
        self.scale = px * py * float(np.hypot(ex, ey)) / abs(ux * ey - uy * ex) * (1.0 if t0[-1] >= t0[0] else -1.0)
        t = t0[:, None] + dt * np.arange(self.steps)
        q = np.floor(t - e).astype(np.int64) + 1  # the first pixel that isn't wholly beside the edge
        row = np.arange(self.steps) * (self.wide + 1)
        self.whole = (np.clip(q, 0, self.wide) + row).ravel()
        self.cut = []
        for j in (0, 1):
            there = (q + j >= 0) & (q + j < self.wide) & (t - (q + j) > -e)
            edge, step = np.nonzero(there)
            at = q[there] + j
            self.cut.append((edge, at + step * self.wide, _area(t[there] - at, s, e)))

    def forward(self, image: np.ndarray) -> np.ndarray:
        """Ray sums of an image of the volume's shape."""
        rows = image if self.steep else image.T
        sums = np.zeros((self.steps, self.wide + 1))
        np.cumsum(rows, 1, out=sums[:, 1:])
        total = sums.ravel()[self.whole].reshape(self.cols + 1, -1).sum(1)
        flat = np.ascontiguousarray(rows).ravel()
        for edge, cell, share in self.cut:
            total += np.bincount(edge, flat[cell] * share, self.cols + 1)
        return self.scale * np.diff(total)

    def back(self, ray: np.ndarray) -> np.ndarray:
        """The transpose of forward."""
        edges = self.scale * (np.concatenate(([0.0], ray)) - np.concatenate((ray, [0.0])))
        totals = np.bincount(self.whole, np.repeat(edges, self.steps), self.steps * (self.wide + 1)).reshape(self.steps, -1)
        out = np.cumsum(totals[:, :0:-1], 1)[:, ::-1]
        flat = np.ascontiguousarray(out).ravel()
        for edge, cell, share in self.cut:
            flat += np.bincount(cell, edges[edge] * share, len(flat))
        image = flat.reshape(self.steps, self.wide)
        return image if self.steep else image.T


class Weighted:
    """A view of another kernel by its weights."""

    def __init__(self, view: tuple[float, ...], v: Volume, cols: int, kernel: str):
        self.ray, self.pixel, self.w = view_weights(view, v, cols, kernel)
        self.cols, self.shape = cols, v.shape

    def forward(self, image: np.ndarray) -> np.ndarray:
        return np.bincount(self.ray, self.w * image.ravel()[self.pixel], self.cols)

    def back(self, ray: np.ndarray) -> np.ndarray:
        return np.bincount(self.pixel, self.w * ray[self.ray], self.shape[0] * self.shape[1]).reshape(self.shape)


class Sweep:
    """A sinogram (a, d, p) packed by view on the executors, and passes over it. Rays that it lacks, or whose value is null, don't count, as in the joins."""

    def __init__(self, spark: SparkSession, g: Projection, v: Volume, kernel: str, sino: DataFrame | None = None, tasks: int | None = None):
        if v.rows * v.cols > MOST_CELLS or not g.kind.startswith("parallel") or g.rows or kernel not in KERNELS:
            raise ValueError("this needs parallel rays in 2D and a volume of at most so many cells")
        self.spark, self.g, self.v, self.kernel = spark, g, v, kernel
        self.tasks = tasks or spark.sparkContext.defaultParallelism
        views = g.table(spark)
        if sino is not None:
            rows = sino.where("p IS NOT NULL").groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("d", "p"))).alias("m"))
            views = views.join(rows.selectExpr("a", f"transform(sequence(0, {g.cols - 1}), d -> m[d]) AS p"), "a")
        else:
            views = views.selectExpr("*", "CAST(NULL AS array<double>) AS p")
        self.views = recon.cut(views.repartition(self.tasks, "a"))

    def pass_over(self, volume: np.ndarray, what: str) -> np.ndarray | DataFrame:
        """what: project gives (a, d, p); update gives the sum of W' ((b - W x) / row sums), weights that of W' 1, over the sinogram's rays."""
        v, cols, kernel, cells = self.v, self.g.cols, self.kernel, self.v.rows * self.v.cols
        sent = self.spark.sparkContext.broadcast(np.asarray(volume, np.float64).reshape(v.shape))

        def run(batches):
            x, ones, total = sent.value, np.ones(v.shape), np.zeros(v.shape)
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for a, *view, p in zip(*columns, strict=True):
                    own = Strips(tuple(view), v, cols) if kernel == "strip" else Weighted(tuple(view), v, cols, kernel)
                    seen = np.ones(cols, bool) if p is None else np.array([y is not None for y in p])
                    if what == "weights":
                        total += own.back(seen.astype(np.float64))
                        continue
                    q = own.forward(x)
                    if what == "project":
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(cols, a, np.int32)), pa.array(np.arange(cols, dtype=np.int32)), pa.array(q)], ["a", "d", "p"])
                        continue
                    sums = own.forward(ones)
                    gap = (np.array([y or 0.0 for y in p]) - q) * seen * np.where(sums > recon.GATE, 1 / np.maximum(sums, recon.GATE), 0.0)
                    total += own.back(gap)
            if what != "project":
                flat = total.ravel()
                yield pa.RecordBatch.from_pydict({"block": pa.array(range(0, cells, BLOCK), pa.int64()), "sums": [flat[k : k + BLOCK].tobytes() for k in range(0, cells, BLOCK)]})

        if what == "project":
            return map_arrow(self.views, run, "a int, d int, p double")
        parts = map_arrow(self.views, run, "block long, sums binary")
        if self.tasks * cells * 8 > MOST_COLLECTED:
            on_workers(self.spark)
            parts = parts.groupBy("block").applyInPandas(lambda pdf: pd.DataFrame({"block": pdf.block[:1], "sums": [sum(np.frombuffer(x) for x in pdf.sums).tobytes()]}), "block long, sums binary")
        out = np.zeros(cells)
        for block, sums in parts.collect():  # at most MOST_COLLECTED bytes, or MOST_CELLS numbers
            out[block : block + BLOCK] += np.frombuffer(sums)
        sent.destroy()
        return out


def sirt(spark: SparkSession, g: Projection, v: Volume, kernel: str, sino: DataFrame, iterations: int, relaxation: float = 1.0, low: float | None = None, high: float | None = None) -> DataFrame:
    """SIRT's volume (r, c, v) from zero: in blocks of arrays where the volume is small enough, else by joins, which give the same."""
    if v.rows * v.cols > MOST_CELLS or not g.kind.startswith("parallel") or g.rows or kernel not in KERNELS:
        method = recon.SIRT(Projector(spark, g, v, kernel), sino.where("p IS NOT NULL"), relaxation=relaxation, low=low, high=high)
        out = method.run(iterations)
        method.release()
        return out
    sweep = Sweep(spark, g, v, kernel, sino)
    x = np.zeros(v.rows * v.cols)
    sums = sweep.pass_over(x, "weights")
    scale = relaxation * np.where(sums > recon.GATE, 1 / np.maximum(sums, recon.GATE), 0.0)
    for _ in range(iterations):
        x = x + scale * sweep.pass_over(x, "update")
        if low is not None or high is not None:
            x = np.clip(x, low, high)
    return from_array(spark, x.reshape(v.shape), "vol2d")
