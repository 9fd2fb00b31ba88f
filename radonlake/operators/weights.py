"""The weight relation W(a, d, r, c, w) of a 2D projector, as column expressions that Spark compiles.

Each ray walks the rows if it is steep and the columns otherwise; at each step it has a fractional position t on the
other axis, and a kernel gives the weights of the pixels near t. Nothing is stored: W is generated where it is needed.
"""

from __future__ import annotations

import functools
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import num
from .geometry import Projection, Volume

KERNELS = ("line", "linear", "strip", "distance_driven", "blob", "line_fanflat", "strip_fanflat", "sparse_matrix", "cuda")


def ray_columns(g: Projection, v: Volume, subrays: int = 1) -> list[tuple[str, ...]]:
    """Stages of (expression AS name): from views and detector numbers d (and subrays s) to steep, slope m, positions and lengths."""
    at = "(d + 0.5e0)" if subrays == 1 else f"(d + (s + 0.5e0) / {num(subrays)})"
    x, y = f"(dx + {at} * ux)", f"(dy + {at} * uy)"
    direction = (f"ex - {x}", f"ey - {y}") if g.diverges else ("ex", "ey")
    px, py = v.pixel[:2]
    first_x, first_y = v.window[0] + px / 2, v.window[3] - py / 2
    keep = "a, d, ux, uy, ex, ey"
    return [
        (keep, f"{x} AS x", f"{y} AS y", f"{direction[0]} AS rx", f"{direction[1]} AS ry"),
        (keep, "x, y, rx, ry", "abs(rx) < abs(ry) AS steep", "sqrt(rx * rx + ry * ry) AS norm"),
        (
            keep,
            "x, y, rx, ry, norm, steep",
            "CASE WHEN steep THEN rx / ry ELSE ry / rx END AS m",
            f"CASE WHEN steep THEN {num(px)} * norm / abs(ry) ELSE {num(py)} * norm / abs(rx) END AS len",
            f"CASE WHEN steep THEN abs((ux - uy * rx / ry) / {num(px)}) / 2e0 ELSE abs((uy - ux * ry / rx) / {num(py)}) / 2e0 END AS half",
            "abs(ux * ry - uy * rx) / norm AS width",
        ),
        ("*", "sqrt(1e0 + m * m) AS tilt", f"CASE WHEN steep THEN (x + ({num(first_y)} - y) * m - {num(first_x)}) / {num(px)} ELSE -(y + ({num(first_x)} - x) * m - {num(first_y)}) / {num(py)} END AS t0", f"CASE WHEN steep THEN -m * {num(py / px)} ELSE -m * {num(px / py)} END AS dt", f"CASE WHEN steep THEN {v.rows} ELSE {v.cols} END AS steps"),
    ]


def _flat(x: str) -> str:
    """Share of a pixel left of a line of slope m, at most 1, that crosses its middle row at x, less a half."""
    near = f"least(abs({x}), (1e0 + abs(m)) / 2e0)"
    return f"sign({x}) * ({near} - pow(greatest({near} - (1e0 - abs(m)) / 2e0, 0e0), 2e0) / greatest(2e0 * abs(m), 1e-300))"


def _beside(x: str, m: str) -> str:
    """Share of a pixel left of a line of any slope m that crosses its middle row at x."""
    s, t = f"(abs(1e0 - abs({m})) / 2e0)", f"((1e0 + abs({m})) / 2e0)"
    near, bend = f"least(abs({x}), {t})", f"greatest(least(abs({x}), {t}) - {s}, 0e0)"
    return f"0.5e0 + sign({x}) * least(1e0, 1e0 / greatest(abs({m}), 1e-300)) * ({near} - CASE WHEN {t} > {s} THEN {bend} * {bend} / (2e0 * ({t} - {s})) ELSE 0e0 END)"


def candidates(kernel: str, v: Volume, reach: float = 0.0) -> tuple[str, str]:
    """First and last pixel q of a step that may have weight, by t, half and m."""
    if kernel in ("line", "line_fanflat"):
        return "floor(t + 0.5e0) - 1", "floor(t + 0.5e0) + 1"
    if kernel in ("linear", "cuda"):
        return "floor(t)", "floor(t) + 1"
    if kernel == "blob":  # whole parts, so that a ray that just misses the grid still meets its first pixel
        return f"greatest(0e0, t - {num(0.5 + reach)})", f"t + {num(0.5 + reach)}"
    if kernel == "strip_fanflat":
        return "floor(least(t, t1) - 0.5e0 - greatest(abs(m), abs(m1)) / 2e0)", "ceil(greatest(t, t1) + 0.5e0 + greatest(abs(m), abs(m1)) / 2e0)"
    edge = "half + 0.5e0" + (" + abs(m) / 2e0" if kernel == "strip" else "")
    return f"ceil(t - ({edge}))", f"floor(t + {edge})"


def weight(kernel: str, v: Volume, blob: tuple[float, list[float]] | None = None, g: Projection | None = None) -> str:
    """The weight of pixel q at a step, with o = t - q."""
    area = num(v.pixel[0] * v.pixel[1])
    s, t = "(0.5e0 - abs(m) / 2e0)", "(0.5e0 + abs(m) / 2e0)"
    if kernel in ("line", "line_fanflat"):
        return f"CASE WHEN m = 0e0 THEN CASE WHEN floor(t + 0.5e0) = q THEN len ELSE 0e0 END WHEN abs(o) <= {s} THEN len WHEN abs(o) < {t} THEN len * ({t} - abs(o)) / ({t} - {s}) ELSE 0e0 END"
    if kernel in ("linear", "cuda"):
        return "len * (1e0 - abs(o))"
    if kernel == "strip":
        return f"(({_flat('(o + half)')}) - ({_flat('(o - half)')})) * {area} / width"
    if kernel == "strip_fanflat":
        source = sum(g.distances)
        du = (g.views[0][4] ** 2 + g.views[0][5] ** 2) ** 0.5
        lever = f"(({num(source**2)} + (d + 0.5e0 - {num(g.cols / 2)}) * (d + 0.5e0 - {num(g.cols / 2)}) * {num(du**2)}) / {num(source * du)})"
        px, py = v.pixel[:2]
        cx = f"({num(v.window[0] + px / 2)} + (CASE WHEN steep THEN q ELSE k END) * {num(px)} - ex)"
        cy = f"({num(v.window[3] - py / 2)} - (CASE WHEN steep THEN k ELSE q END) * {num(py)} - ey)"
        return f"abs(({_beside('(t - q)', 'm')}) - ({_beside('(t1 - q)', 'm1')})) * {area} * {lever} / sqrt({cx} * {cx} + {cy} * {cy})"
    if kernel == "distance_driven":
        return f"greatest(0e0, least(q + 1e0, t + 0.5e0 + half) - greatest(q + 0e0, t + 0.5e0 - half)) * {area} / width"
    raise ValueError(f"{kernel} is no kernel")


def blob_index(v: Volume, blob: tuple[float, list[float]]) -> str:
    """Place, from 1, in a blob's table of the value for o: the distance from the ray in blobs, with the length of the pixels along which the ray walks."""
    size, table = blob
    px, py = v.pixel[:2]
    return f"CAST(least({len(table) - 1}, floor(abs(o) * (CASE WHEN steep THEN {num(py)} ELSE {num(px)} END) / {num(size)} / tilt * {num(len(table))} + 0.5e0)) + 1 AS INT)"


def edge_columns(g: Projection, v: Volume) -> list[tuple[str, ...]]:
    """Stages from views and detector numbers to the two edges of a fan's strip: positions t0 and slope m of the ray through the pixel's beginning, the same with 1 for its end, and the walk of its middle."""
    px, py = v.pixel[:2]
    first_x, first_y = v.window[0] + px / 2, v.window[3] - py / 2
    at = [f"(dx + (d + {k}) * ux) AS x{n}, (dy + (d + {k}) * uy) AS y{n}" for n, k in (("", "0e0"), ("1", "1e0"))]
    keep = "a, d, ex, ey"
    slope = lambda n: f"CASE WHEN steep THEN (ex - x{n}) / (ey - y{n}) ELSE (ey - y{n}) / (ex - x{n}) END AS m{n}"
    start = lambda n: f"CASE WHEN steep THEN (x{n} + ({num(first_y)} - y{n}) * m{n} - {num(first_x)}) / {num(px)} ELSE -(y{n} + ({num(first_x)} - x{n}) * m{n} - {num(first_y)}) / {num(py)} END AS t0{n}"
    step = lambda n: f"CASE WHEN steep THEN -m{n} * {num(py / px)} ELSE -m{n} * {num(px / py)} END AS dt{n}"
    return [
        (keep, *(y for x in at for y in x.split(", ")), "abs(ex - dx - (d + 0.5e0) * ux) < abs(ey - dy - (d + 0.5e0) * uy) AS steep"),
        (keep, "x", "y", "x1", "y1", "steep", slope(""), slope("1")),
        (keep, "steep", "m", "m1", start(""), start("1"), step(""), step("1"), f"CASE WHEN steep THEN {v.rows} ELSE {v.cols} END AS steps"),
    ]


def rays_of(spark: SparkSession, g: Projection, subrays: int = 1) -> DataFrame:
    rays = g.table(spark).selectExpr("*", f"explode(sequence(0, {g.cols - 1})) AS d")
    return rays if subrays == 1 else rays.selectExpr("*", f"explode(sequence(0, {subrays - 1})) AS s")


def walked(spark: SparkSession, g: Projection, v: Volume, kernel: str, rays: DataFrame | None, subrays: int, own: list[str]) -> DataFrame:
    """The rays with their walk: a row for each step k, with the place t there (and of a fan strip's other edge, t1)."""
    if kernel == "strip_fanflat" and subrays > 1:
        raise ValueError("a strip takes in the whole detector pixel")
    if kernel == "strip_fanflat" and g.kind != "fanflat":
        raise ValueError("the fan strip kernel takes a fanflat geometry")
    if rays is None:
        df = rays_of(spark, g, subrays)
    else:
        df = rays.join(F.broadcast(g.table(spark)), "a")  # a row for each view
        df = df if subrays == 1 else df.selectExpr("*", f"explode(sequence(0, {subrays - 1})) AS s")
    fan_strip = kernel == "strip_fanflat"
    for stage in edge_columns(g, v) if fan_strip else ray_columns(g, v, subrays):
        df = df.selectExpr(*stage) if stage[0] == "*" else df.selectExpr(*own, *(y.strip() for x in stage for y in ([x] if " AS " in x else x.split(","))))
    return df.selectExpr("*", "explode(sequence(0, steps - 1)) AS k").selectExpr("*", "t0 + k * dt AS t", *(["t01 + k * dt1 AS t1"] if fan_strip else []))


def weight_form(kernel: str, v: Volume, blob: tuple[float, list[float]] | None, g: Projection) -> str:
    if kernel == "blob":
        return f"element_at(array({', '.join(map(num, blob[1]))}), {blob_index(v, blob)})"
    return weight(kernel, v, blob, g)


def weights(spark: SparkSession, g: Projection, v: Volume, kernel: str = "linear", rays: DataFrame | None = None, subrays: int = 1, blob: tuple[float, list[float]] | None = None, keep: str = "") -> DataFrame:
    """W(a, d, r, c, w) of all rays, or of those in rays (a, d[, keep]); without a shuffle.

    blob: (half width of the kernel in pixels, its values from the centre outwards). With subrays each detector's weight is the mean of as many rays.
    """
    if kernel not in KERNELS:
        raise ValueError(f"{kernel} is no kernel")
    if kernel == "sparse_matrix":
        n = v.cols
        found = g.matrix.selectExpr(f"CAST(row DIV {g.cols} AS INT) AS a", f"CAST(row % {g.cols} AS INT) AS d", f"CAST(col DIV {n} AS INT) AS r", f"CAST(col % {n} AS INT) AS c", "val AS w")
        return found if rays is None else found.join(rays, ["a", "d"])
    own = [x.strip() for x in keep.split(",") if x.strip()]
    df = walked(spark, g, v, kernel, rays, subrays, own)
    low, high = candidates(kernel, v, blob[0] if blob else 0.0)
    df = df.where(f"CAST({low} AS INT) <= CAST({high} AS INT)")
    df = df.selectExpr("*", f"explode(sequence(CAST({low} AS INT), CAST({high} AS INT))) AS q").where(f"q >= 0 AND q < CASE WHEN steep THEN {v.cols} ELSE {v.rows} END")
    df = df.selectExpr("*", "t - q AS o")
    scale = f" / {num(subrays)}" if subrays > 1 else ""
    out = df.selectExpr("a", "d", "CASE WHEN steep THEN k ELSE q END AS r", "CASE WHEN steep THEN q ELSE k END AS c", f"({weight_form(kernel, v, blob, g)}){scale} AS w", *own)
    return out.where("w <> 0e0")


#: Cells of a volume whose lines are sent to all executors (twice, as rows and as columns); larger ones are joined by line.
MOST_SENT = 4_000_000


def most_candidates(g: Projection, kernel: str, reach: float, v: Volume) -> int | None:
    """How many pixels of a step may have weight at most, where that follows from the views."""
    if kernel in ("linear", "cuda"):
        return 2
    if kernel in ("line", "line_fanflat"):
        return 3
    if kernel == "blob":
        return int(2 * (0.5 + reach)) + 2
    if g.diverges:
        return None
    px, py = v.pixel[:2]
    half = max(abs((ux - uy * ex / ey) / px) if abs(ex) < abs(ey) else abs((uy - ux * ey / ex) / py) for ex, ey, _, _, ux, uy in g.views) / 2
    return int(2 * half + (2 if kernel == "strip" else 1)) + 1


def project_lines(spark: SparkSession, g: Projection, v: Volume, kernel: str, volume: DataFrame, rays: DataFrame | None, subrays: int, blob: tuple[float, list[float]] | None) -> DataFrame | None:
    """(a, d, p) of a volume (r, c, v): each step of a ray meets the line of pixels that it crosses as one array, so that W is neither exploded by pixel nor shuffled.

    Sums are made by ray before the shuffle. None for kernels whose pixels of a step have no bound.
    """
    n = most_candidates(g, kernel, blob[0] if blob else 0.0, v)
    if n is None or n > 12:
        return None
    cells = volume.groupBy("r", "c").agg(F.sum("v").alias("v"))

    def lines(by: str, across: str, steep: bool, wide: int) -> DataFrame:
        packed = cells.groupBy(F.col(by).alias("k")).agg(F.map_from_entries(F.collect_list(F.struct(across, "v"))).alias("m"))
        return packed.selectExpr("k", f"{str(steep).lower()} AS steep", f"transform(sequence(0, {wide - 1}), q -> m[q]) AS xs")

    table = lines("r", "c", True, v.cols).unionByName(lines("c", "r", False, v.rows))
    df = walked(spark, g, v, kernel, rays, subrays, [])
    low, high = candidates(kernel, v, blob[0] if blob else 0.0)
    df = df.selectExpr("*", f"CAST({low} AS INT) AS q0", f"CAST({high} AS INT) AS q1").where(f"q1 >= 0 AND q0 < CASE WHEN steep THEN {v.cols} ELSE {v.rows} END AND q0 <= q1")
    df = df.join(F.broadcast(table) if v.rows * v.cols <= MOST_SENT else table, ["steep", "k"])
    form = weight_form(kernel, v, blob, g)
    terms = [re.sub(r"\bq\b", f"(q0 + {j})", re.sub(r"\bo\b", f"(t - (q0 + {j}))", form)) for j in range(n)]
    df = df.selectExpr("a", "d", *(f"CASE WHEN q0 + {j} <= q1 AND q0 + {j} >= 0 THEN get(xs, q0 + {j}) END AS x{j}" for j in range(n)), *(f"{term} AS w{j}" for j, term in enumerate(terms)))
    hit = " OR ".join(f"(x{j} IS NOT NULL AND w{j} <> 0e0)" for j in range(n))
    part = " + ".join(f"coalesce(w{j} * x{j}, 0e0)" for j in range(n))
    sums = df.where(hit).groupBy("a", "d").agg(F.sum(F.expr(part)).alias("p"))
    return sums if subrays == 1 else sums.select("a", "d", (F.col("p") / float(subrays)).alias("p"))


@functools.lru_cache(64)
def blob_table(n: int = 20, shape: float = 2.0) -> tuple[float, ...]:
    """A smooth kernel from its centre to its edge, for tests and queries."""
    return tuple((1 - (k / n) ** 2) ** shape for k in range(n))
