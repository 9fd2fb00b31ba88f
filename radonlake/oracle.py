"""DuckDB SQL of the queries, from closed forms of each operator by pixel and ray, independent of the package's plans.

Grids are of unit pixels around the origin; a view at angle t has its detector along (cos t, sin t) and rays along (-sin t, cos t). Where plans walk
along rays step by step, these forms take each pair of ray and pixel by itself. Numbers that a query is made with stand here a second time.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

N, VIEWS, DETECTORS, N3, D3 = 16, 8, 24, 6, 8
ANGLES = [0.1 + k * math.pi / 8 for k in range(8)]
FAN_ANGLES = [0.1 + 2 * math.pi * k / 8 for k in range(8)]
SHORT_ANGLES = [0.1 + 1.3 * math.pi * k / 8 for k in range(8)]
PAR3_ANGLES = [0.1, 0.9, 1.7, 2.5]
CONE_ANGLES = [0.1 + 2 * math.pi * k / 4 for k in range(4)]
CONE_SHORT_ANGLES = [0.1 + 1.3 * math.pi * k / 4 for k in range(4)]
#: Distances of a fan's source and detector from the origin and its detector's width; the same of a cone, with its detector's widths.
FS, FD, FW = 40.0, 15.0, 1.3
CS, CD, CU, CV = 30.0, 10.0, 1.1, 1.2


def values(rows: Iterable[Iterable[float]]) -> str:
    return ", ".join("(" + ", ".join(repr(x) if isinstance(x, int) else f"CAST({x!r} AS DOUBLE)" for x in row) + ")" for row in rows)


def upto(n: int | str, name: str) -> str:
    return f"(SELECT CAST(unnest(range({n})) AS INT) AS {name})"


def binned(keys: dict[str, tuple[str, int]], value: str, name: str, table: str = "lineitem") -> str:
    cells = ", ".join(f"CAST({column} % {n} AS INT) AS {axis}" for axis, (column, n) in keys.items())
    return f"SELECT {cells}, sum({value}) / 1000.0 AS {name} FROM {table} GROUP BY ALL"


def query(ctes: list[str], keys: str, value: str, body: str, digits: int = 4) -> str:
    with_ = f"WITH {', '.join(ctes)} " if ctes else ""
    each = ", ".join(f"round({x}, {digits}) + 0.0 AS {x}" for x in value.split())
    return f"{with_}SELECT {', '.join([*keys.split(), each])} FROM ({body})"


def turns(angles: list[float], name: str = "turns") -> str:
    return f"{name}(a, t) AS (VALUES {values(enumerate(angles))})"


# Rays in 2D as lines nx * x + ny * y = s with a unit normal, and what a pixel of centre (x, y) has of them. far: s - (nx * x + ny * y);
# hi and lo: the larger and smaller of the normal's components, so that a unit pixel reaches (hi + lo) / 2 along the normal.


def parallel(angles: list[float] = ANGLES, shift: float = 0.0, sub: int = 1, right: float = 0.0) -> list[str]:
    """CTEs with line(a, d, nx, ny, s). sub: so many rays a detector pixel; right: how far the volume is to the right."""
    return [turns(angles), f"line AS (SELECT a, d, cos(t) AS nx, sin(t) AS ny, d - {DETECTORS / 2} + {shift} + (j + 0.5) / {sub} - {right} * cos(t) AS s FROM turns, {upto(DETECTORS, 'd')}, {upto(sub, 'j')})"]


def fan(angles: list[float] = FAN_ANGLES) -> list[str]:
    """CTEs with line(a, d, nx, ny, s) from the source at (FS sin t, -FS cos t) to the middle of each detector pixel, and edge: the same for the two edges (k = 0, 1) of each."""
    at = lambda u: f"{FS + FD} * sin(t) - {u} * cos(t) AS rx, -{FS + FD} * cos(t) - {u} * sin(t) AS ry"
    lines = lambda cells, u: f"SELECT *, ry / sqrt(rx * rx + ry * ry) AS nx, -rx / sqrt(rx * rx + ry * ry) AS ny, (ry * {FS} * sin(t) + rx * {FS} * cos(t)) / sqrt(rx * rx + ry * ry) AS s FROM (SELECT a, d, t, {'k, ' if 'k' in cells else ''}{at(u)} FROM turns, {cells})"
    return [
        turns(angles),
        f"line AS ({lines(upto(DETECTORS, 'd'), f'((d - {(DETECTORS - 1) / 2}) * {FW})')})",
        f"edge AS ({lines(upto(DETECTORS, 'd') + ', ' + upto(2, 'k'), f'((d + k - {DETECTORS / 2}) * {FW})')})",
    ]


PIXELS = f"px AS (SELECT r, c, c - {(N - 1) / 2} AS x, {(N - 1) / 2} - r AS y FROM {upto(N, 'r')}, {upto(N, 'c')})"
CHORD = "CASE WHEN abs(far) <= (hi - lo) / 2 THEN 1 / hi WHEN abs(far) < (hi + lo) / 2 THEN ((hi + lo) / 2 - abs(far)) / (hi * lo) ELSE 0 END"
HAT = "greatest(0, 1 - abs(far) / hi) / hi"


def beside(far: str, hi: str = "hi", lo: str = "lo") -> str:
    """The part of a unit pixel whose points are less than far along the normal from its centre: a sum of squares that start at its four corners."""
    corner = lambda sign, at: f"{sign} greatest(0, {far} {at}) ** 2"
    return f"(({corner('', f'+ ({hi} + {lo}) / 2')} {corner('-', f'+ ({hi} - {lo}) / 2')} {corner('-', f'- ({hi} - {lo}) / 2')} {corner('+', f'- ({hi} + {lo}) / 2')}) / (2 * {hi} * {lo}))"


STRIP = f"{beside('(far + 0.5)')} - {beside('(far - 0.5)')}"
DRIVEN = "greatest(0, least(0.5, (far + 0.5) / hi) - greatest(-0.5, (far - 0.5) / hi))"
BLOB_SIZE, BLOB_VALUES = 1.5, [(1 - (k / 20) ** 2) ** 2 for k in range(20)]
#: The ray's place along the row (or column) of a pixel it walks over, in pixels, and that pixel's number.
_T = f"CASE WHEN abs(nx) > abs(ny) THEN (s - ny * y) / nx + {(N - 1) / 2} ELSE {(N - 1) / 2} - (s - nx * x) / ny END"
_Q = "CASE WHEN abs(nx) > abs(ny) THEN c ELSE r END"
BLOB = f"CASE WHEN {_Q} BETWEEN trunc({_T} - 0.5 - {BLOB_SIZE}) AND trunc({_T} + 0.5 + {BLOB_SIZE}) THEN list_extract({BLOB_VALUES}, 1 + CAST(least(19, trunc(abs({_T} - ({_Q})) * hi / {BLOB_SIZE} * 20 + 0.5)) AS INT)) ELSE 0 END"


def weights(lines: list[str], form: str, sub: int = 1, name: str = "w") -> list[str]:
    """CTEs that end with w(a, d, r, c, w): the form for each line and pixel."""
    near = f"SELECT a, d, r, c, x, y, nx, ny, s, s - nx * x - ny * y AS far, greatest(abs(nx), abs(ny)) AS hi, least(abs(nx), abs(ny)) AS lo FROM line, px"
    return [*lines, PIXELS, f"{name} AS MATERIALIZED (SELECT a, d, r, c, sum({form}) / {sub} AS w FROM ({near}) WHERE abs(far) < {BLOB_SIZE + 2 if form is BLOB else 2} GROUP BY ALL HAVING abs(sum({form})) > 1e-12)"]


def fan_strip() -> list[str]:
    """A strip's weight: the part of a pixel between its edges, by what a detector pixel's rays fan out to, over the distance from the source."""
    near = "SELECT e.a, e.d, r, c, k, x, y, t, s - nx * x - ny * y AS far, greatest(abs(nx), abs(ny)) AS hi, least(abs(nx), abs(ny)) AS lo FROM edge e, px"
    mid = f"((d - {(DETECTORS - 1) / 2}) * {FW})"
    lever = f"({(FS + FD) ** 2} + {mid} * {mid}) / {(FS + FD) * FW} / sqrt((x - {FS} * sin(t)) ** 2 + (y + {FS} * cos(t)) ** 2)"
    return [*fan(), PIXELS, f"w AS MATERIALIZED (SELECT a, d, r, c, abs(sum(CASE WHEN k = 0 THEN part ELSE -part END)) * any_value({lever}) AS w FROM (SELECT *, {beside('far')} AS part FROM ({near})) GROUP BY a, d, r, c HAVING abs(sum(CASE WHEN k = 0 THEN part ELSE -part END)) > 1e-13)"]


# Back projection by pixels and voxels: in the frame of a view, (xr, yr) along the detector and along the rays; between detector pixels a hat.


def bp_pixel(angles: list[float] = ANGLES, of_fan: bool = False, weight: str | None = None, sub: int = 1, sino: str = "sino", named: str = "turns", out: str = "back") -> list[str]:
    """CTEs that end with back(r, c, v). weight: of a point, by yr and mag; else the density of rays."""
    points = f"SELECT r, c, c - {(N - 1) / 2} + (i + 0.5) / {sub} - 0.5 AS x, {(N - 1) / 2} - r - (j + 0.5) / {sub} + 0.5 AS y FROM {upto(N, 'r')}, {upto(N, 'c')}, {upto(sub, 'i')}, {upto(sub, 'j')}"
    mag = f"{FS + FD} / ({FS} + yr)" if of_fan else "1"
    width = FW if of_fan else 1
    place = f"SELECT r, c, a, yr, {mag} AS mag, xr * {mag} / {width} + {(DETECTORS - 1) / 2} AS u FROM (SELECT r, c, a, x * cos(t) + y * sin(t) AS xr, y * cos(t) - x * sin(t) AS yr FROM ({points}), {named})"
    return [turns(angles, named), f"{out} AS MATERIALIZED (SELECT r, c, sum(p * greatest(0, 1 - abs(u - d)) * {weight or f'mag / {width}'}) / {sub * sub} AS v FROM ({place}) q JOIN {sino} s ON s.a = q.a AND abs(q.u - s.d) < 1 GROUP BY r, c)"]


FAN_FBP = f"({FS} / ({FS} + yr)) ** 2"
CELLS3 = lambda sub: f"SELECT z, r, c, c - {(N3 - 1) / 2} + (i + 0.5) / {sub} - 0.5 AS x, {(N3 - 1) / 2} - r - (j + 0.5) / {sub} + 0.5 AS y, z - {(N3 - 1) / 2} + (k + 0.5) / {sub} - 0.5 AS h FROM {upto(N3, 'z')}, {upto(N3, 'r')}, {upto(N3, 'c')}, {upto(sub, 'i')}, {upto(sub, 'j')}, {upto(sub, 'k')}"
DENSITY, FDK_WEIGHT, FLAT_WEIGHT = f"mag * mag / {CU * CV}", f"({CS} / ({CS} + yr)) ** 2", "mag"


def bp_voxel(angles: list[float] = CONE_ANGLES, kind: str = "cone", weight: str = DENSITY, sub: int = 1, sino: str = "sino", out: str = "back", lift: float = 0.0, named: str = "turns3") -> list[str]:
    """CTEs that end with back(z, r, c, v). kind: par, cone or cyl; lift: how high the detector's middle is above the source."""
    frame = f"SELECT z, r, c, a, x * cos(t) + y * sin(t) AS xr, y * cos(t) - x * sin(t) AS yr, h FROM ({CELLS3(sub)}), {named}"
    if kind == "par":
        place = f"SELECT *, 1 AS mag, xr + {(D3 - 1) / 2} AS u, h + {(D3 - 1) / 2} AS w FROM ({frame})"
        weight = "1"
    elif kind == "cone":
        place = f"SELECT *, xr * mag / {CU} + {(D3 - 1) / 2} AS u, (h * mag - {lift}) / {CV} + {(D3 - 1) / 2} AS w FROM (SELECT *, {CS + CD} / ({CS} + yr) AS mag FROM ({frame}))"
    else:
        place = f"SELECT *, asin(xr * mag / {CS + CD}) * {CS + CD} / {CU} + {(D3 - 1) / 2} AS u, h * mag / {CV} + {(D3 - 1) / 2} AS w FROM (SELECT *, {CS + CD} / sqrt(xr * xr + ({CS} + yr) ** 2) AS mag FROM ({frame}))"
    return [turns(angles, named), f"{out} AS MATERIALIZED (SELECT z, r, c, sum(p * greatest(0, 1 - abs(u - du)) * greatest(0, 1 - abs(w - dv)) * {weight}) / {sub**3} AS v FROM ({place}) q JOIN {sino} s ON s.a = q.a AND abs(q.u - s.du) < 1 AND abs(q.w - s.dv) < 1 GROUP BY z, r, c)"]


def weights_3d(kind: str, sub: int = 1, angles: list[float] | None = None, name: str = "w", lift: float = 0.0) -> list[str]:
    """CTEs that end with w(dv, a, du, z, r, c, w): at the slice of voxels that a ray crosses along its main axis, a hat along each of the other two."""
    angles = angles or (PAR3_ANGLES if kind == "par" else CONE_ANGLES)
    su, sv = (1, 1) if kind == "par" else (CU, CV)
    cell = f"SELECT a, t, du, dv, (du - {D3 / 2} + (i + 0.5) / {sub}) * {su} AS u, (dv - {D3 / 2} + (j + 0.5) / {sub}) * {sv} + {lift} AS qz FROM turns3, {upto(D3, 'du')}, {upto(D3, 'dv')}, {upto(sub, 'i')}, {upto(sub, 'j')}"
    if kind == "par":
        ray = f"SELECT *, u * cos(t) AS qx, u * sin(t) AS qy, -sin(t) AS rx, cos(t) AS ry, 0 AS rz FROM ({cell})"
    elif kind == "cone":
        ray = f"SELECT *, {CS} * sin(t) - qx AS rx, -{CS} * cos(t) - qy AS ry, -qz AS rz FROM (SELECT *, u * cos(t) - {CD} * sin(t) AS qx, u * sin(t) + {CD} * cos(t) AS qy FROM ({cell}))"
    else:  # the detector is an arc around the source
        ray = f"SELECT *, {CS} * sin(t) - qx AS rx, -{CS} * cos(t) - qy AS ry, -qz AS rz FROM (SELECT *, {CS} * sin(t) + {CS + CD} * (sin(u / {CS + CD}) * cos(t) - cos(u / {CS + CD}) * sin(t)) AS qx, -{CS} * cos(t) + {CS + CD} * (sin(u / {CS + CD}) * sin(t) + cos(u / {CS + CD}) * cos(t)) AS qy FROM ({cell}))"
    x_first = "abs(rx) >= abs(ry)"
    far = f"CASE WHEN {x_first} THEN (x - qx) / rx ELSE (y - qy) / ry END"
    near = f"SELECT dv, a, du, z, r, c, sqrt(rx * rx + ry * ry + rz * rz) / greatest(abs(rx), abs(ry)) * greatest(0, 1 - abs(CASE WHEN {x_first} THEN qy + f * ry - y ELSE qx + f * rx - x END)) * greatest(0, 1 - abs(qz + f * rz - h)) AS w FROM (SELECT *, {far} AS f FROM ray3, vx)"
    return [turns(angles, "turns3"), f"ray3 AS ({ray})", f"vx AS ({CELLS3(1)})", f"{name} AS MATERIALIZED (SELECT dv, a, du, z, r, c, sum(w) / {sub * sub} AS w FROM ({near}) WHERE w <> 0 GROUP BY ALL)"]


# Filters: the half spectrum F(k) of n values by the sum over the ramp's spatial form, times a window; taps by the sum back.

_X, _LAST = "(pi() * k / last)", "last"
WINDOWS = {
    "ram-lak": "1",
    "shepp-logan": "sin(w / 2) / (w / 2)",
    "cosine": "cos(w / 2)",
    "hamming": "0.54 + 0.46 * cos(w)",
    "hann": "(1 + cos(w)) / 2",
    "tukey": "CASE WHEN k BETWEEN (last + 1) / 4 AND (last + 1) * 3 / 4 THEN 1 ELSE 0.5 * (1 + cos(pi() * (k - (last + 1) / 4) / ((last + 1) / 4))) END",
    "lanczos": "CASE WHEN abs(pi() * (2 * k / last - 1)) > 0.001 THEN sin(pi() * (2 * k / last - 1)) / (pi() * (2 * k / last - 1)) ELSE 1 END",
    "triangular": "2 / last * (last / 2 - abs(k - last / 2))",
    "gaussian": "exp(-0.5 * ((k - last / 2) / (0.4 * last / 2)) ** 2)",
    "barlett-hann": f"0.62 - 0.48 * abs(k / last - 0.5) - 0.38 * cos(2 * {_X})",
    "blackman": f"0.42 - 0.5 * cos({_X}) + 0.08 * cos(2 * {_X})",
    "nuttall": f"0.355768 - 0.487396 * cos(2 * {_X}) + 0.144232 * cos(4 * {_X}) - 0.012604 * cos(6 * {_X})",
    "blackman-harris": f"0.35875 - 0.48829 * cos(2 * {_X}) + 0.14128 * cos(4 * {_X}) - 0.01168 * cos(6 * {_X})",
    "blackman-nuttall": f"0.3635819 - 0.4891775 * cos(2 * {_X}) + 0.1365995 * cos(4 * {_X}) - 0.0106411 * cos(6 * {_X})",
    "flat-top": f"1 - 1.93 * cos(2 * {_X}) + 1.29 * cos(4 * {_X}) - 0.388 * cos(6 * {_X}) + 0.032 * cos(8 * {_X})",
    "kaiser": "(SELECT avg(cos(3 * pi() * sqrt(1 - (2 * k / last - 1) ** 2) * sin((i + 0.5) * pi() / 200))) FROM range(200) x(i)) / (SELECT avg(cos(3 * pi() * sin((i + 0.5) * pi() / 200))) FROM range(200) x(i))",
    "parzen": "CASE WHEN k / last <= 0.5 THEN 1 - 6 * (k / last) ** 2 * (1 - k / last) ELSE 2 * (1 - k / last) ** 3 END",
}


def back_to_taps(n: int, detectors: int) -> str:
    return f"taps AS MATERIALIZED (SELECT m, sum(f * cos(2 * pi() * k * m / {n}) * CASE WHEN k = 0 OR k = {n // 2} THEN 1 ELSE 2 END) / {n} AS h FROM half, (SELECT unnest(range({1 - detectors}, {detectors})) AS m) GROUP BY m)"


def window_taps(name: str, detectors: int) -> list[str]:
    """CTEs that end with taps(m, h)."""
    n = 2 * (1 << (detectors - 1).bit_length())
    ramp = f"SELECT k, 2 * sum(CASE WHEN j = 0 THEN 0.25 WHEN j % 2 = 1 THEN -1 / (pi() * least(j, {n} - j)) ** 2 ELSE 0 END * cos(2 * pi() * j * k / {n})) AS f FROM {upto(n // 2 + 1, 'k')}, {upto(n, 'j')} GROUP BY k"
    return [f"half AS MATERIALIZED (SELECT k, f * CASE WHEN k = 0 THEN 1 ELSE {WINDOWS[name]} END AS f FROM (SELECT k, f, 2 * pi() * k / {n} AS w, CAST({n // 2} AS DOUBLE) AS last FROM ({ramp})))", back_to_taps(n, detectors)]


def filtered(detectors: int, sino: str = "sino", by: str = "a", d: str = "d") -> str:
    """filtered(by, d, p): each row's sum over the taps."""
    keys = ", ".join(f"s.{x.strip()}" for x in by.split(","))
    return f"filtered AS MATERIALIZED (SELECT {keys}, o.d AS {d}, sum(s.p * t.h) AS p FROM {sino} s, {upto(detectors, 'd')} o JOIN taps t ON t.m = o.d - s.{d} GROUP BY ALL)"


def parker(angles: list[float], detectors: int, width: float, whole: float, d: str) -> str:
    """The short-scan weight by a and d, for views in ascending order of evenly spaced angles."""
    step = (angles[-1] - angles[0]) / (len(angles) - 1)
    beta, gamma, most = f"(a * {step!r})", f"atan(({d} - {(detectors - 1) / 2}) * {width} / {whole})", f"atan({width * detectors / 2} / {whole})"
    return f"{step * len(angles)!r} / pi() * CASE WHEN {beta} <= 0 THEN 0 WHEN {beta} <= 2 * ({most} + {gamma}) THEN sin(pi() / 4 * {beta} / ({most} + {gamma})) ** 2 WHEN {beta} <= pi() + 2 * {gamma} THEN 1 WHEN {beta} <= pi() + 2 * {most} THEN sin(pi() / 4 * (pi() + 2 * {most} - {beta}) / ({most} - {gamma})) ** 2 ELSE 0 END"


FAN_COSINE = f"{FS + FD} / sqrt({(FS + FD) ** 2} + ((d - {(DETECTORS - 1) / 2}) * {FW}) ** 2)"
FAN_SCALE = f"(pi() / {2 * VIEWS} * {(FS + FD) / FS / FW!r})"


def cone_weight(lift: float = 0.0) -> str:
    return f"{(CS + CD) ** 2 / (CU * CS)!r} * pi() / {2 * len(CONE_ANGLES)} / sqrt({(CS + CD) ** 2} + ((du - {(D3 - 1) / 2}) * {CU}) ** 2 + ((dv - {(D3 - 1) / 2}) * {CV} + {lift}) ** 2)"


#: The new value of o by operator: a and b are others, s a scalar.
ELEMENTWISE = {
    "add": "o + a", "mul": "a * o", "mul_scalar": "s * o", "add_scaled": "o + s * a", "scale_and_add": "s * o + a", "add_mul_scaled": "o + s * a * b", "add_mul": "o + b * a", "add2": "a + b + o", "div": "CASE WHEN a > 0.000001 THEN o / a ELSE 0 END", "mul2": "a * b * o",
    "divided_by": "CASE WHEN o > 0.000001 THEN a / o ELSE 0 END", "invert": "CASE WHEN o > 0.000001 THEN 1 / o ELSE 0 END", "set": "s", "clamp_min": "CASE WHEN o < s THEN s ELSE o END", "clamp_max": "CASE WHEN o > s THEN s ELSE o END", "clamp_min_mask": "CASE WHEN o < a THEN a ELSE o END",
    "clamp_max_mask": "CASE WHEN o > a THEN a ELSE o END", "set_masked": "CASE WHEN a <> 0 THEN o ELSE s END", "mul_mask": "CASE WHEN a <= 0 THEN o ELSE s * o END", "copy": "a",
}
DATA_OPS = {"mul": "1.5 * o", "div": "o / 1.5", "add": "1.5 + o", "sub": "o - 1.5", "muldata": "a * o", "adddata": "a + o"}

# The Shepp-Logan phantom's ellipsoids (x, y, z, half axes x, y, z, degrees, value, value of the modified phantom).
ELLIPSOIDS = "(0, 0, 0, 0.69, 0.92, 0.81, 0, 2.0, 1.0), (0, -0.0184, 0, 0.6624, 0.874, 0.78, 0, -0.98, -0.8), (0.22, 0, 0, 0.11, 0.31, 0.22, -18, -0.02, -0.2), (-0.22, 0, 0, 0.16, 0.41, 0.28, 18, -0.02, -0.2), (0, 0.35, 0, 0.21, 0.25, 0.41, 0, 0.01, 0.1), (0, 0.1, 0, 0.046, 0.046, 0.05, 0, 0.01, 0.1), (0, -0.1, 0, 0.046, 0.046, 0.05, 0, 0.01, 0.1), (-0.08, -0.605, 0, 0.046, 0.023, 0.05, 0, 0.01, 0.1), (0, -0.605, 0, 0.023, 0.023, 0.02, 0, 0.01, 0.1), (0.06, -0.605, 0, 0.023, 0.046, 0.02, 0, 0.01, 0.1)"


def phantom(n: int, slices: int, modified: bool) -> str:
    """Each cell's sum over the ellipsoids that its centre is in, 0 at least. The volume reaches from -1 to 1 along each axis, y downwards."""
    at = lambda k, n: f"((2 * {k} + 1.0) / {n} - 1)"
    dx, dy = f"({at('c', n)} - ex)", f"(-{at('r', n)} - ey)"
    u, v = f"({dx} * cos(radians(turn)) + {dy} * sin(radians(turn)))", f"({dy} * cos(radians(turn)) - {dx} * sin(radians(turn)))"
    flat = f"({u} / ax) ** 2 + ({v} / ay) ** 2"
    flat += f" + (({at('z', slices)} - ez) / az) ** 2" if slices else ""
    cells = f"{upto(n, 'r')}, {upto(n, 'c')}" + (f", {upto(slices, 'z')}" if slices else "")
    keys = "z, r, c" if slices else "r, c"
    return f"SELECT {keys}, greatest(0, sum(CASE WHEN {flat} <= 1 THEN {'modified' if modified else 'plain'} ELSE 0 END)) AS v FROM {cells}, (VALUES {ELLIPSOIDS}) e(ex, ey, ez, ax, ay, az, turn, plain, modified) GROUP BY ALL"


def neighbours(what: str, keys: str, near: str) -> str:
    """near(keys, v, s): an aggregate over the cells whose distances dz, dr, dc meet a condition."""
    names = keys.split()
    wide = " AND ".join(f"abs(x.{k} - o.{k}) <= 2" for k in names)
    gaps = ", ".join(f"x.{k} - o.{k} AS d{k}" for k in names)
    return f"near AS (SELECT {', '.join(names)}, v, {what} AS s FROM (SELECT o.*, x.v AS n, {gaps} FROM flat o JOIN flat x ON {wide}) WHERE {near} GROUP BY ALL)"
