"""Pixel-driven back projection in 2D and 3D: each pixel's place on each view's detector, interpolated between detector pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import num
from ..plans.lineage import cut
from .geometry import Projection, Volume


def det2(a: str, b: str, c: str, d: str) -> str:
    return f"({a} * {d} - {b} * {c})"


def det3(u: tuple[str, ...], v: tuple[str, ...], w: tuple[str, ...]) -> str:
    return f"({u[0]} * ({v[1]} * {w[2]} - {v[2]} * {w[1]}) - {u[1]} * ({v[0]} * {w[2]} - {v[2]} * {w[0]}) + {u[2]} * ({v[0]} * {w[1]} - {v[1]} * {w[0]}))"


def places_2d(g: Projection, v: Volume) -> tuple[str, str, str]:
    """(u, density, fbp density) of pixel (r, c) on a view: expressions of the view's columns."""
    px, py = v.pixel[:2]
    x, y = f"({num(v.window[0] + px / 2)} + c * {num(px)})", f"({num(v.window[3] - py / 2)} - r * {num(py)})"
    if not g.diverges:
        den = det2("ux", "uy", "ex", "ey")
        return f"{det2(f'({x} - dx)', f'({y} - dy)', 'ex', 'ey')} / {den}", f"sqrt(ex * ex + ey * ey) / abs({den})", f"sqrt(ex * ex + ey * ey) / abs({den})"
    den = det2("ux", "uy", f"(ex - {x})", f"(ey - {y})")
    u = f"{det2(f'({x} - ex)', f'({y} - ey)', '(ex - dx)', '(ey - dy)')} / {den}"
    return u, f"abs({det2('ux', 'uy', '(ex - dx)', '(ey - dy)')}) / (sqrt(ux * ux + uy * uy) * abs({den}))", f"{det2('ux', 'uy', 'ex', 'ey')} * {det2('ux', 'uy', 'ex', 'ey')} / ({den} * {den})"


def bp_pixel(spark: SparkSession, g: Projection, v: Volume, sino: DataFrame, fbp: bool = False, subpixels: int = 1, plain: bool = False) -> DataFrame:
    """(r, c, v): the sum over views of the sinogram at each pixel's place, 0 outside the detector, times the density of rays (or, if plain, times 1).

    subpixels: each pixel is the mean of so many by so many points. Views are a table as small as their number; the sinogram is joined by view and detector.
    """
    u, density, fan = places_2d(g, v)
    n = subpixels
    pixels = spark.range(v.rows).selectExpr("CAST(id AS INT) AS r0").selectExpr("r0", f"explode(sequence(0, {v.cols - 1})) AS c0")
    if n > 1:
        pixels = pixels.selectExpr("r0", "c0", f"explode(sequence(0, {n * n - 1})) AS k").selectExpr("r0", "c0", f"r0 + ((k DIV {n}) + 0.5e0) / {num(n)} - 0.5e0 AS r", f"c0 + ((k % {n}) + 0.5e0) / {num(n)} - 0.5e0 AS c")
    else:
        pixels = pixels.selectExpr("r0", "c0", "r0 AS r", "c0 AS c")
    views = F.broadcast(g.table(spark))  # a row for each view of the geometry, which the driver holds
    at = pixels.selectExpr("*", f"explode(sequence(0, {len(g.views) - 1})) AS a").join(views, "a")
    at = at.selectExpr("r0", "c0", "a", f"{u} - 0.5e0 AS u", f"{'1e0' if plain else fan if fbp and g.diverges else density} AS z").selectExpr("*", "CAST(floor(u) AS INT) AS d0", "u - floor(u) AS o")
    near = at.selectExpr("r0", "c0", "a", "z", "explode(array(named_struct('d', d0, 'f', 1e0 - o), named_struct('d', d0 + 1, 'f', o))) AS x").selectExpr("r0", "c0", "a", "z", "x.d AS d", "x.f AS f")
    return near.join(sino.select("a", "d", "p"), ["a", "d"]).groupBy(F.col("r0").alias("r"), F.col("c0").alias("c")).agg((F.sum(F.col("p") * F.col("f") * F.col("z")) / float(n * n)).alias("v"))


E3, D3, U3, V3 = (tuple(f"{k}{x}" for x in "xyz") for k in "eduv")


def voxel(v: Volume) -> tuple[str, str, str]:
    px, py, pz = v.pixel
    return f"({num(v.window[0] + px / 2)} + c * {num(px)})", f"({num(v.window[3] - py / 2)} - r * {num(py)})", f"({num(v.window[4] + pz / 2)} + z * {num(pz)})"


def minus(a: tuple[str, ...], b: tuple[str, ...]) -> tuple[str, ...]:
    return tuple(f"({x} - {y})" for x, y in zip(a, b, strict=True))


def places_3d(g: Projection, v: Volume, kind: str = "default") -> tuple[str, str, str]:
    """(u, v, weight) of voxel (z, r, c) on a view. kind: default, fdk, 2d_weighting."""
    x = voxel(v)
    if not g.diverges:
        den = det3(U3, V3, E3)
        length = "sqrt(ex * ex + ey * ey + ez * ez)"
        return f"{det3(minus(x, D3), V3, E3)} / {den}", f"{det3(U3, minus(x, D3), E3)} / {den}", f"{length} / abs({den})"
    far = minus(E3, x)
    den = det3(U3, V3, far)
    back, near = minus(E3, D3), minus(x, E3)
    u, w = f"{det3(near, V3, back)} / {den}", f"{det3(U3, near, back)} / {den}"
    whole = det3(U3, V3, E3)
    if kind == "fdk":
        return u, w, f"({whole} / {den}) * ({whole} / {den})"
    plane = det3(U3, V3, back)
    if kind == "2d_weighting":
        return u, w, f"abs({plane} / {den})"
    cross = "sqrt((uy * vz - uz * vy) * (uy * vz - uz * vy) + (uz * vx - ux * vz) * (uz * vx - ux * vz) + (ux * vy - uy * vx) * (ux * vy - uy * vx))"
    return u, w, f"{plane} * {plane} / ({cross} * {den} * {den})"


def bp_voxel(spark: SparkSession, g: Projection, v: Volume, sino: DataFrame, kind: str = "default", subvoxels: int = 1) -> DataFrame:
    """(z, r, c, v): as bp_pixel with a detector of rows and columns, interpolated in both. sino: (dv, a, du, p).

    subvoxels: each voxel is the mean of so many points along each axis.
    """
    n = subvoxels
    voxels = spark.range(v.slices * v.rows).selectExpr(f"CAST(id DIV {v.rows} AS INT) AS z0", f"CAST(id % {v.rows} AS INT) AS r0").selectExpr("z0", "r0", f"explode(sequence(0, {v.cols - 1})) AS c0")
    if n > 1:
        part = lambda x, k: f"{x}0 + ({k} + 0.5e0) / {num(n)} - 0.5e0 AS {x}"
        voxels = voxels.selectExpr("*", f"explode(sequence(0, {n**3 - 1})) AS k").selectExpr("z0", "r0", "c0", part("z", f"(k DIV {n * n})"), part("r", f"((k DIV {n}) % {n})"), part("c", f"(k % {n})"))
    else:
        voxels = voxels.selectExpr("*", "z0 AS z", "r0 AS r", "c0 AS c")
    at = voxels.selectExpr("*", f"explode(sequence(0, {len(g.views) - 1})) AS a")
    if g.kind == "cyl_cone_vec":
        at = places_on_cylinder(at.join(F.broadcast(cylinder_table(spark, g)), "a"), g, v)  # a row for each view
    else:
        u, w, weight = places_3d(g, v, kind)
        at = at.join(F.broadcast(g.table(spark)), "a").selectExpr("z0", "r0", "c0", "a", f"{u} AS u", f"{w} AS w", f"{weight} AS f")  # a row for each view
    at = at.selectExpr("z0 AS z", "r0 AS r", "c0 AS c", "a", "u - 0.5e0 AS u", "w - 0.5e0 AS w", "f").selectExpr("*", "CAST(floor(u) AS INT) AS u0", "CAST(floor(w) AS INT) AS w0", "u - floor(u) AS ou", "w - floor(w) AS ow")
    near = at.selectExpr("z", "r", "c", "a", "f", "u0", "w0", "ou", "ow", "explode(sequence(0, 3)) AS k").selectExpr("z", "r", "c", "a", "u0 + k % 2 AS du", "CAST(w0 + (k DIV 2) AS INT) AS dv", "f * (CASE WHEN k % 2 = 1 THEN ou ELSE 1e0 - ou END) * (CASE WHEN k >= 2 THEN ow ELSE 1e0 - ow END) AS f")
    return near.join(sino.select("dv", "a", "du", "p"), ["dv", "a", "du"]).groupBy("z", "r", "c").agg((F.sum(F.col("p") * F.col("f")) / float(n**3)).alias("v"))


def cylinder_table(spark: SparkSession, g: Projection) -> DataFrame:
    """For each view of a curved detector, in the frame of its middle's normal o, its side s and its axis t: the frame, the source (ex, ey, ez), the source's place po and ps
    from the cylinder's middle and pt from the detector's, the radius, the turn between detector pixels, the height of one, and the area of one."""
    rows = []
    for a, (view, radius) in enumerate(zip(g.views, g.radius, strict=True)):
        e, middle, u, up = np.array(view).reshape(4, 3)
        side, axis = u / np.linalg.norm(u), up / np.linalg.norm(up)
        out = np.cross(u, up)
        out = out / np.linalg.norm(out) * (-1.0 if out @ (middle - e) < 0 else 1.0)
        off = e - (middle - radius * out)
        rows.append((a, *map(float, (*out, *side, *axis, *e, off @ out, off @ side, (e - middle) @ axis, radius, np.linalg.norm(u) / radius, np.linalg.norm(up), np.linalg.norm(np.cross(u, up))))))
    names = [*(f"{k}{x}" for k in "oste" for x in "xyz"), "po", "ps", "pt", "radius", "turn", "height", "area"]
    return spark.createDataFrame(rows, "a int, " + ", ".join(f"{n} double" for n in names))


def places_on_cylinder(at: DataFrame, g: Projection, v: Volume) -> DataFrame:
    """(z0, r0, c0, a, u, w, f): where the ray from the source through a voxel meets a curved detector, and the density of rays in the voxel."""
    x = voxel(v)
    along = lambda k: " + ".join(f"({p} - e{c}) * {k}{c}" for p, c in zip(x, "xyz", strict=True))
    at = at.selectExpr("*", *(f"{along(k)} AS r{k}" for k in "ost")).selectExpr("*", "ro * ro + rs * rs AS qa", "ro * po + rs * ps AS qb", "po * po + ps * ps - radius * radius AS qc").where("qb * qb >= qa * qc")
    at = at.selectExpr("*", "(sqrt(qb * qb - qa * qc) - qb) / qa AS far")
    return at.selectExpr("z0", "r0", "c0", "a", f"asin((far * rs + ps) / radius) / turn + {num(g.cols / 2)} AS u", f"(far * rt + pt) / height + {num(g.rows / 2)} AS w", "far * far / area AS f")


def view_table(spark: SparkSession, g: Projection) -> DataFrame:
    """The views, with their radius where the detector is curved."""
    table = g.table(spark)
    return table.join(spark.createDataFrame(list(enumerate(map(float, g.radius))), "a int, radius double"), "a") if g.radius else table


def weights_3d(spark: SparkSession, g: Projection, v: Volume, subrays: int = 1) -> DataFrame:
    """W(dv, a, du, z, r, c, w): rays walk the slices of the axis along which they run most, bilinear between voxels.

    subrays: each detector pixel's weight is the mean of so many rays along each of its axes.
    """
    if g.kind == "cyl_cone_vec":
        if subrays > 1:
            raise ValueError("a curved detector takes one ray for each pixel")
        return weights_cylinder(spark, g, v)
    rays = g.table(spark).selectExpr("*", f"explode(sequence(0, {g.cols - 1})) AS du").selectExpr("*", f"explode(sequence(0, {g.rows - 1})) AS dv")
    if subrays > 1:
        rays = rays.selectExpr("*", f"explode(sequence(0, {subrays**2 - 1})) AS k").selectExpr("*", f"(k % {subrays} + 0.5e0) / {num(subrays)} - 0.5e0 AS su", f"((k DIV {subrays}) + 0.5e0) / {num(subrays)} - 0.5e0 AS sv")
    for stage in ray_stages_3d(g, v, subrays):
        rays = rays.selectExpr(*stage)
    out = _walk(rays, v)
    return out if subrays == 1 else out.withColumn("w", F.col("w") / float(subrays**2))


def _walk(rays: DataFrame, v: Volume) -> DataFrame:
    df = rays.selectExpr("*", "explode(sequence(0, steps - 1)) AS k").selectExpr("*", "p0 + k * dp AS p", "q0 + k * dq AS q").selectExpr("*", "CAST(floor(p) AS INT) AS pi", "CAST(floor(q) AS INT) AS qi", "p - floor(p) AS op", "q - floor(q) AS oq")
    df = df.selectExpr("*", "explode(sequence(0, 3)) AS j").selectExpr("dv", "a", "du", "axis", "k", "pi + j % 2 AS pi", "CAST(qi + (j DIV 2) AS INT) AS qi", "len * (CASE WHEN j % 2 = 1 THEN op ELSE 1e0 - op END) * (CASE WHEN j >= 2 THEN oq ELSE 1e0 - oq END) AS w")
    return df.selectExpr(*OUT_3D).where(inside_3d(v))


#: Axis 0 walks columns with (p, q) = (row, slice), 1 rows with (column, slice), 2 slices with (column, row).
OUT_3D = ("dv", "a", "du", "CASE WHEN axis = 2 THEN k ELSE qi END AS z", "CASE WHEN axis = 0 THEN pi WHEN axis = 1 THEN k ELSE qi END AS r", "CASE WHEN axis = 0 THEN k ELSE pi END AS c", "w")


def inside_3d(v: Volume) -> str:
    return f"w <> 0e0 AND z >= 0 AND z < {v.slices} AND r >= 0 AND r < {v.rows} AND c >= 0 AND c < {v.cols}"


def ray_stages_3d(g: Projection, v: Volume, subrays: int = 1) -> list[list[str]]:
    """Point and direction of each ray in voxel units (column, row, slice), then start, step and length along its main axis."""
    px, py, pz = v.pixel
    first = (v.window[0] + px / 2, v.window[3] - py / 2, v.window[4] + pz / 2)
    signs = (px, -py, pz)
    du, dv = ("du", "dv") if subrays == 1 else ("du + su", "dv + sv")
    point = [f"(d{x} + ({du} + 0.5e0) * u{x} + ({dv} + 0.5e0) * v{x})" for x in "xyz"]
    ray = [f"(e{x} - {p})" if g.diverges else f"e{x}" for x, p in zip("xyz", point, strict=True)]
    keep = ["dv", "a", "du"]
    one = [*keep, *(f"({p} - {num(f)}) / {num(s)} AS x{i}" for i, (p, f, s) in enumerate(zip(point, first, signs, strict=True))), *(f"{r} / {num(s)} AS t{i}" for i, (r, s) in enumerate(zip(ray, signs, strict=True)))]
    two = [*keep, "x0", "x1", "x2", "t0", "t1", "t2", "CASE WHEN abs(t0) >= abs(t1) AND abs(t0) >= abs(t2) THEN 0 WHEN abs(t1) >= abs(t2) THEN 1 ELSE 2 END AS axis"]
    slope = lambda i, j: f"t{i} / t{j}"
    part = lambda cases: "CASE axis " + " ".join(f"WHEN {k} THEN {x}" for k, x in enumerate(cases)) + " END"
    three = [
        *keep,
        "axis",
        f"{part((f'x1 - x0 * {slope(1, 0)}', f'x0 - x1 * {slope(0, 1)}', f'x0 - x2 * {slope(0, 2)}'))} AS p0",
        f"{part((slope(1, 0), slope(0, 1), slope(0, 2)))} AS dp",
        f"{part((f'x2 - x0 * {slope(2, 0)}', f'x2 - x1 * {slope(2, 1)}', f'x1 - x2 * {slope(1, 2)}'))} AS q0",
        f"{part((slope(2, 0), slope(2, 1), slope(1, 2)))} AS dq",
        f"sqrt(t0 * t0 * {num(px * px)} + t1 * t1 * {num(py * py)} + t2 * t2 * {num(pz * pz)}) / abs({part(('t0', 't1', 't2'))}) AS len",
        f"{part((str(v.cols), str(v.rows), str(v.slices)))} AS steps",
    ]
    return [one, two, three]


def fp_3d(spark: SparkSession, g: Projection, v: Volume, volume: DataFrame | None, square: bool = False, subrays: int = 1) -> DataFrame:
    """(dv, a, du, p): the sums of weights and voxels (z, r, c, v); with square, of squared weights, and no volume."""
    w = weights_3d(spark, g, v, subrays)
    if square:
        return w.groupBy("dv", "a", "du").agg(F.sum(F.col("w") * F.col("w")).alias("p"))
    return w.join(volume.select("z", "r", "c", "v"), ["z", "r", "c"]).groupBy("dv", "a", "du").agg(F.sum(F.col("w") * F.col("v")).alias("p"))


def bp_matched_3d(spark: SparkSession, g: Projection, v: Volume, sino: DataFrame, subrays: int = 1) -> DataFrame:
    """(z, r, c, v): the transpose of fp_3d."""
    return weights_3d(spark, g, v, subrays).join(sino.select("dv", "a", "du", "p"), ["dv", "a", "du"]).groupBy("z", "r", "c").agg(F.sum(F.col("w") * F.col("p")).alias("v"))


def cylinder_as_planes(spark: SparkSession, g: Projection) -> DataFrame:
    """The detector points of a curved detector: (a, dv, du, px, py, pz), from which rays run to the source.

    A view's d is the middle of the detector; u is the step along the arc there and v the step along the axis.
    """
    known = view_table(spark, g).selectExpr("*", "sqrt(ux * ux + uy * uy + uz * uz) AS lu", "sqrt(vx * vx + vy * vy + vz * vz) AS lv").selectExpr("*", "(uy * vz - uz * vy) / (lu * lv) AS ax", "(uz * vx - ux * vz) / (lu * lv) AS ay", "(ux * vy - uy * vx) / (lu * lv) AS az")
    known = cut(known.selectExpr("*", "CASE WHEN ax * (dx - ex) + ay * (dy - ey) + az * (dz - ez) < 0e0 THEN -1e0 ELSE 1e0 END AS way"))  # a row for each view
    pixels = known.selectExpr("*", f"explode(sequence(0, {g.cols * g.rows - 1})) AS k").selectExpr("*", f"k % {g.cols} AS du", f"CAST(k DIV {g.cols} AS INT) AS dv")
    pixels = pixels.selectExpr("*", f"(du + 0.5e0 - {num(g.cols / 2)}) * lu / radius AS turn", f"dv + 0.5e0 - {num(g.rows / 2)} AS up")
    return pixels.selectExpr("a", "dv", "du", "ex", "ey", "ez", *(f"d{x} + radius * way * a{x} * (cos(turn) - 1e0) + radius * sin(turn) * u{x} / lu + up * v{x} AS p{x}" for x in "xyz"))


def weights_cylinder(spark: SparkSession, g: Projection, v: Volume) -> DataFrame:
    """W of a curved detector, as weights_3d from each detector point's own ray."""
    points = cut(cylinder_as_planes(spark, g)).selectExpr("a", "dv", "du", "ex", "ey", "ez", "px AS dx", "py AS dy", "pz AS dz", *(f"0e0 AS u{x}" for x in "xyz"), *(f"0e0 AS v{x}" for x in "xyz"))
    df = points
    for stage in ray_stages_3d(g, v):
        df = df.selectExpr(*stage)
    return _walk(df, v)
