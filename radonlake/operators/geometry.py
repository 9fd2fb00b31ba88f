"""Volume and projection geometries, and the tables of views that plans are built from.

A view is a row of doubles, made once on the driver; queries and their SQL take the same rows. User vectors give a
detector's centre; a view keeps its corner, where detector pixel 0 begins.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

VIEW_2D = ("ex", "ey", "dx", "dy", "ux", "uy")
VIEW_3D = ("ex", "ey", "ez", "dx", "dy", "dz", "ux", "uy", "uz", "vx", "vy", "vz")


@dataclass(frozen=True)
class Volume:
    """Grid of rows and cols, and slices in 3D; row 0 is at the largest y. window: min x, max x, min y, max y[, min z, max z]."""

    rows: int
    cols: int
    slices: int = 0
    window: tuple[float, ...] = ()

    def __post_init__(self):
        if self.rows <= 0 or self.cols <= 0 or self.slices < 0:
            raise ValueError("a volume needs a positive number of rows and columns")
        own = self.window or tuple(x for n in (self.cols, self.rows, self.slices) if n for x in (-n / 2, n / 2))
        if len(own) != (6 if self.slices else 4) or any(a >= b for a, b in zip(own[::2], own[1::2], strict=True)):
            raise ValueError(f"{own} is no window of this volume")
        object.__setattr__(self, "window", tuple(map(float, own)))

    @property
    def pixel(self) -> tuple[float, ...]:
        return tuple((b - a) / n for a, b, n in zip(self.window[::2], self.window[1::2], (self.cols, self.rows, self.slices), strict=False))

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.slices, self.rows, self.cols) if self.slices else (self.rows, self.cols)

    def moved(self, *by: float, absolute: bool = False) -> Volume:
        """The same grid elsewhere: shifted by so much along x, y (and z), or, if absolute, with its centre there."""
        middle = [(a + b) / 2 if absolute else 0.0 for a, b in zip(self.window[::2], self.window[1::2], strict=True)]
        return replace(self, window=tuple(x + by[k // 2] - middle[k // 2] for k, x in enumerate(self.window)))


@dataclass(frozen=True)
class Projection:
    """kind, detectors (columns, and rows in 3D), and for each view VIEW_2D or VIEW_3D. e is a ray's direction, or the source of a fan or cone."""

    kind: str
    cols: int
    views: tuple[tuple[float, ...], ...]
    rows: int = 0
    radius: tuple[float, ...] = ()
    distances: tuple[float, float] = (0.0, 0.0)
    angles: tuple[float, ...] = ()
    matrix: object = None

    @property
    def diverges(self) -> bool:
        return self.kind.startswith(("fan", "cone", "cyl"))

    @property
    def shape(self) -> tuple[int, ...]:
        return (self.rows, len(self.views), self.cols) if self.rows else (len(self.views), self.cols)

    def table(self, spark: SparkSession) -> DataFrame:
        """(a, view columns): one row for each view."""
        names = VIEW_3D if self.rows else VIEW_2D
        return spark.createDataFrame([(k, *map(float, v)) for k, v in enumerate(self.views)], "a int, " + ", ".join(f"{x} double" for x in names))


def create_vol_geom(*sizes) -> Volume:
    """From rows[, cols[, slices]] or a list of them, with an optional window after them."""
    flat = list(sizes[0]) if len(sizes) == 1 and not isinstance(sizes[0], int) else list(sizes)
    if len(flat) == 1:
        flat *= 2
    if len(flat) in (2, 3):
        return Volume(*map(int, flat))
    if len(flat) == 6:
        return Volume(int(flat[0]), int(flat[1]), 0, tuple(flat[2:]))
    if len(flat) == 9:
        return Volume(*map(int, flat[:3]), tuple(flat[3:]))
    raise ValueError(f"{len(flat)} numbers don't give a volume geometry")


def _turn(x: float, y: float, angle: float) -> tuple[float, float]:
    c, s = math.cos(angle), math.sin(angle)
    return x * c - y * s, x * s + y * c


def create_proj_geom(kind: str, *args) -> Projection:
    """Geometries by kind: parallel, parallel_vec, fanflat, fanflat_vec, sparse_matrix, parallel3d, parallel3d_vec, cone, cone_vec, cyl_cone_vec."""
    if kind in ("parallel", "sparse_matrix"):
        width, n, angles = args[:3]
        views = [(*_turn(0, 1, t), *_turn(-n * width / 2, 0, t), *_turn(width, 0, t)) for t in angles]
        return Projection(kind, int(n), tuple(views), angles=tuple(angles), matrix=args[3] if kind == "sparse_matrix" else None)
    if kind == "fanflat":
        width, n, angles, source, detector = args
        views = [(*_turn(0, -source, t), *_turn(-n * width / 2, detector, t), *_turn(width, 0, t)) for t in angles]
        return Projection(kind, int(n), tuple(views), distances=(float(source), float(detector)), angles=tuple(angles))
    if kind in ("parallel_vec", "fanflat_vec"):
        n, vectors = args
        views = [(*v[:2], v[2] - n / 2 * v[4], v[3] - n / 2 * v[5], *v[4:6]) for v in np.asarray(vectors, float).reshape(-1, 6).tolist()]
        return Projection(kind, int(n), tuple(views))
    if kind in ("parallel3d", "cone"):
        su, sv, rows, cols, angles = args[:5]
        source, detector = args[5:] if kind == "cone" else (-1.0, 0.0)
        views = [(*_turn(0, -source, t), 0.0, *_turn(-cols * su / 2, detector, t), -rows * sv / 2, *_turn(su, 0, t), 0.0, 0.0, 0.0, float(sv)) for t in angles]
        return Projection(kind, int(cols), tuple(views), int(rows), distances=(float(source), float(detector)) if kind == "cone" else (0.0, 0.0), angles=tuple(angles))
    if kind in ("parallel3d_vec", "cone_vec"):
        rows, cols, vectors = args
        views = [(*v[:3], *(v[3 + i] - cols / 2 * v[6 + i] - rows / 2 * v[9 + i] for i in range(3)), *v[6:12]) for v in np.asarray(vectors, float).reshape(-1, 12).tolist()]
        return Projection(kind, int(cols), tuple(views), int(rows))
    if kind == "cyl_cone_vec":
        rows, cols, vectors = args
        table = np.asarray(vectors, float).reshape(-1, 13).tolist()
        return Projection(kind, int(cols), tuple(tuple(v[:12]) for v in table), int(rows), tuple(v[12] for v in table))
    raise ValueError(f"{kind} is no kind of projection geometry")


def geom_2vec(g: Projection) -> np.ndarray:
    """The geometry as user vectors, with detector centres."""
    half_u, half_v = g.cols / 2, g.rows / 2
    out = []
    for k, v in enumerate(g.views):
        if not g.rows:
            out.append((*v[:2], v[2] + half_u * v[4], v[3] + half_u * v[5], *v[4:]))
        elif g.kind == "cyl_cone_vec":
            out.append((*v, g.radius[k]))
        else:
            out.append((*v[:3], *(v[3 + i] + half_u * v[6 + i] + half_v * v[9 + i] for i in range(3)), *v[6:]))
    return np.array(out)


def to_vector(g: Projection) -> Projection:
    kind = {"parallel": "parallel_vec", "fanflat": "fanflat_vec", "parallel3d": "parallel3d_vec", "cone": "cone_vec"}.get(g.kind, g.kind)
    return g if kind == g.kind else replace(g, kind=kind, distances=(0.0, 0.0), angles=())


def geom_postalignment(g: Projection, by) -> Projection:
    """The geometry with its detector shifted by so many pixels, (along u) or (along u, along v), for all views or for each."""
    shifts = np.broadcast_to(np.atleast_2d(np.asarray(by, float)), (len(g.views), 2 if g.rows else 1))
    n = 3 if g.rows else 2
    views = []
    for v, shift in zip(g.views, shifts.tolist(), strict=True):
        steps = [v[2 * n + i * n : 2 * n + i * n + n] for i in range(len(shift))]
        views.append((*v[:n], *(v[n + i] + sum(s * step[i] for s, step in zip(shift, steps, strict=True)) for i in range(n)), *v[2 * n :]))
    return replace(to_vector(g), views=tuple(views))


def sub_geometry(g: Projection, cols: range | None = None, rows: range | None = None, views: range | None = None) -> Projection:
    """Part of the detector and of the views."""
    n = 3 if g.rows else 2
    out = []
    for v in (g.views[k] for k in views) if views else g.views:
        corner = list(v[n : 2 * n])
        for i in range(n):
            corner[i] += (cols.start if cols else 0) * v[2 * n + i] + ((rows.start if rows else 0) * v[3 * n + i] if n == 3 else 0)
        out.append((*v[:n], *corner, *v[2 * n :]))
    return replace(to_vector(g), views=tuple(out), cols=len(cols) if cols else g.cols, rows=len(rows) if rows else g.rows, radius=tuple(g.radius[k] for k in views) if views and g.radius else g.radius)


def project_point(g: Projection, view: int, x: float, y: float, z: float) -> tuple[float, float]:
    """Detector coordinates (u, v), in pixels from its corner, of a point in 3D."""
    v = np.array(g.views[view]).reshape(4, 3)
    e, corner, u, w = v
    p = np.array((x, y, z))
    if g.kind == "cyl_cone_vec":
        radius, a = g.radius[view], np.linalg.norm(u)
        up = w / np.linalg.norm(w)
        out = corner - e
        out -= out @ up * up
        out /= np.linalg.norm(out)
        side, middle = u / a, corner - radius * out
        ray = p - e
        flat, start = ray - ray @ up * up, (e - middle) - (e - middle) @ up * up
        qa, qb, qc = flat @ flat, flat @ start, start @ start - radius**2
        t = (-qb + math.sqrt(qb * qb - qa * qc)) / qa
        hit = e + t * ray - middle
        return math.atan2(hit @ side, hit @ out) * radius / a + g.cols / 2, (hit + middle - corner) @ up / np.linalg.norm(w) + g.rows / 2
    ray = p - e if g.diverges else e
    found = np.linalg.solve(np.stack((u, w, -ray), 1), (e if g.diverges else p) - corner)
    return float(found[0]), float(found[1])


def projected_bbox(g: Projection, v: Volume) -> tuple[float, float, float, float]:
    """(min u, max u, min v, max v) over all views of the volume's corners."""
    x0, x1, y0, y1, z0, z1 = v.window
    found = [project_point(g, k, x, y, z) for k in range(len(g.views)) for x in (x0, x1) for y in (y0, y1) for z in (z0, z1)]
    us, vs = zip(*found, strict=True)
    return min(us), max(us), min(vs), max(vs)


def parallel_parameters(view: tuple[float, ...], n: int) -> tuple[float, float, float]:
    """(angle, detector width, offset of the detector's centre along it) of a 2D view whose detector is perpendicular to its rays."""
    width = math.hypot(*view[4:])
    centre = (view[2] + n / 2 * view[4], view[3] + n / 2 * view[5])
    return math.atan2(view[5], view[4]), width, (centre[0] * view[4] + centre[1] * view[5]) / width


def fan_parameters(view: tuple[float, ...], n: int) -> tuple[float, float, float, float]:
    """(angle, detector width, distance of the source, distance of the detector) of a fan's view, both from the origin."""
    width = math.hypot(*view[4:])
    ox, oy = view[5] / width, -view[4] / width
    return math.atan2(view[5], view[4]), width, abs(view[0] * ox + view[1] * oy), abs((view[2] * ox) + view[3] * oy)


def circular_fan(g: Projection) -> tuple[list[float], float, float, float]:
    """(angles, distance of the source, distance of the detector, detector width) of a fan geometry, those of the last view for all.

    Each view's source must be over the origin, as seen along the detector's normal, else this raises.
    """
    found = []
    for v in g.views:
        source, step = math.hypot(*v[:2]), math.hypot(*v[4:])
        if abs(v[0] * v[4] + v[1] * v[5]) > 1e-4 * source * step:
            raise ValueError("this fan has a source that isn't over the origin")
        near = -(v[2] * v[4] + v[3] * v[5]) / (step * step)
        found.append((math.atan2(v[5], v[4]), source, math.hypot(v[2] + near * v[4], v[3] + near * v[5]), step))
    angles = list(g.angles) if g.angles else [x[0] for x in found]
    return angles, *found[-1][1:]


def circular_cone(g: Projection) -> tuple[list[float], float, float, float, float, float]:
    """(angles, distance of the source, distance of the detector, widths along u and v, shift along z) of an upright cone geometry, by its first view.

    u must lie across the z axis and v along it, else this raises.
    """
    if any(abs(v[8]) > 1e-4 * math.hypot(*v[6:9]) or math.hypot(v[9], v[10]) > 1e-4 * abs(v[11]) for v in g.views):
        raise ValueError("this cone's detector isn't upright")
    v = g.views[0]
    centre = [v[3 + i] + g.cols / 2 * v[6 + i] + g.rows / 2 * v[9 + i] for i in range(3)]
    angles = [math.pi - math.atan2(x[0], x[1]) for x in g.views]
    return angles, math.hypot(v[0], v[1]), math.hypot(*centre[:2]), math.hypot(*v[6:9]), abs(v[11]), centre[2] - v[2]
