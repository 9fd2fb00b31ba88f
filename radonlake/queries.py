"""One query for each operator over whole tables, with its SQL."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracle as q
from .functions import elementwise, filters
from .functions.text import values
from .operators import geometry as geo
from .operators import pixel_driven as pd3
from .operators import stencil, tools
from .operators.project import PixelProjector, Projector, Projector3D
from .operators.weights import blob_table
from .plans import api, dart, recon
from .plans.lineage import shared_folder
from .sources import arrays, phantoms

N, VIEWS, DETECTORS, N3 = 16, 8, 24, 6
V, V3 = geo.Volume(N, N), geo.Volume(N3, N3, N3)
ANGLES = [0.1 + k * math.pi / VIEWS for k in range(VIEWS)]
PAR = geo.create_proj_geom("parallel", 1.0, DETECTORS, ANGLES)
VEC = geo.geom_postalignment(PAR, 0.3)
FAN = geo.create_proj_geom("fanflat", 1.3, DETECTORS, [0.1 + 2 * math.pi * k / VIEWS for k in range(VIEWS)], 40.0, 15.0)
FAN_VEC = geo.create_proj_geom("fanflat_vec", DETECTORS, geo.geom_2vec(FAN))
FAN_SHORT = geo.create_proj_geom("fanflat", 1.3, DETECTORS, [0.1 + 1.3 * math.pi * k / VIEWS for k in range(VIEWS)], 40.0, 15.0)
PAR3 = geo.create_proj_geom("parallel3d", 1.0, 1.0, 8, 8, [0.1, 0.9, 1.7, 2.5])
CONE = geo.create_proj_geom("cone", 1.1, 1.2, 8, 8, [0.1 + 2 * math.pi * k / 4 for k in range(4)], 30.0, 10.0)
CONE_SHORT = geo.create_proj_geom("cone", 1.1, 1.2, 8, 8, [0.1 + 1.3 * math.pi * k / 4 for k in range(4)], 30.0, 10.0)
CONE_UP = geo.geom_postalignment(CONE, (0.0, 0.75))
CYL = geo.create_proj_geom("cyl_cone_vec", 8, 8, [[*x, 40.0] for x in geo.geom_2vec(CONE).tolist()])
BLOB = (1.5, list(blob_table()))
VOLUME_KEYS = {"r": ("l_partkey", N), "c": ("l_orderkey", N)}
OTHER_KEYS = {"r": ("l_orderkey", N), "c": ("l_suppkey", N)}
SINO_KEYS = {"a": ("l_orderkey", VIEWS), "d": ("l_partkey", DETECTORS)}
VOLUME3_KEYS = {"z": ("l_suppkey", N3), "r": ("l_partkey", N3), "c": ("l_orderkey", N3)}
SINO3_KEYS = {"dv": ("l_suppkey", 8), "a": ("l_orderkey", 4), "du": ("l_partkey", 8)}
QUANTITY = "l_quantity"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def vol(s: SparkSession, d: str, keys: dict = VOLUME_KEYS) -> DataFrame:
    return arrays.binned(s, d, keys, QUANTITY, "v")


def sino(s: SparkSession, d: str, keys: dict = SINO_KEYS) -> DataFrame:
    return arrays.binned(s, d, keys, QUANTITY, "p")


VOL = f"vol AS MATERIALIZED ({q.binned(VOLUME_KEYS, QUANTITY, 'v')})"
OTHER = f"other AS MATERIALIZED ({q.binned(OTHER_KEYS, QUANTITY, 'v')})"
SINO = f"sino AS MATERIALIZED ({q.binned(SINO_KEYS, QUANTITY, 'p')})"
VOL3 = f"vol3 AS MATERIALIZED ({q.binned(VOLUME3_KEYS, QUANTITY, 'v')})"
SINO3 = f"sino AS MATERIALIZED ({q.binned(SINO3_KEYS, QUANTITY, 'p')})"


def rounded(df: DataFrame, digits: int = 4) -> DataFrame:
    return df.select(*((F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None, digits: int = 4) -> None:
    QUERIES[name] = lambda s, d: rounded(run(s, d), digits)
    if sql:
        ORACLES[name] = sql


def flat_name(kernel: str) -> str:
    return {"distance_driven": "distdriven", "line_fanflat": "fan_line", "strip_fanflat": "fan_strip"}.get(kernel, kernel)


FP = "SELECT a, d, sum(w * v) AS p FROM w JOIN vol USING (r, c) GROUP BY ALL"
BP = "SELECT r, c, sum(w * p) AS v FROM w JOIN sino USING (a, d) GROUP BY ALL"

_WEIGHTS = {
    "linear": q.weights(q.parallel(), q.HAT), "line": q.weights(q.parallel(), q.CHORD), "strip": q.weights(q.parallel(), q.STRIP), "distance_driven": q.weights(q.parallel(), q.DRIVEN),
    "blob": q.weights(q.parallel(), q.BLOB), "line_fanflat": q.weights(q.fan(), q.CHORD), "strip_fanflat": q.fan_strip(),
}
for _k, _w in _WEIGHTS.items():
    _g, _b = FAN if "fan" in _k else PAR, BLOB if _k == "blob" else None
    add(f"fp_{flat_name(_k)}", lambda s, d, k=_k, g=_g, b=_b: Projector(s, g, V, k, blob=b).fp(vol(s, d)), q.query([*_w, VOL], "a d", "p", FP))
    add(f"bp_{flat_name(_k)}", lambda s, d, k=_k, g=_g, b=_b: Projector(s, g, V, k, blob=b).bp(sino(s, d)), q.query([*_w, SINO], "r c", "v", BP))
_W, _WF = _WEIGHTS["linear"], q.weights(q.fan(), q.HAT)
add("fp_parallel_vec", lambda s, d: Projector(s, VEC, V, "linear").fp(vol(s, d)), q.query([*q.weights(q.parallel(shift=0.3), q.HAT), VOL], "a d", "p", FP))
add("fp_supersample", lambda s, d: Projector(s, PAR, V, "linear", subrays=3).fp(vol(s, d)), q.query([*q.weights(q.parallel(sub=3), q.HAT, 3), VOL], "a d", "p", FP))
add("fp_cuda_fan", lambda s, d: PixelProjector(s, FAN, V).fp(vol(s, d)), q.query([*_WF, VOL], "a d", "p", FP))


def mask_of(s: SparkSession, d: str) -> DataFrame:
    """1 where the second image is above 0.7 of its mean, else 0."""
    o = vol(s, d, OTHER_KEYS)
    return o.join(F.broadcast(o.agg(F.avg("v").alias("m")))).selectExpr("r", "c", "CASE WHEN v > 0.7e0 * m THEN 1e0 ELSE 0e0 END AS m")  # one row


MASK = "mask AS (SELECT r, c, CASE WHEN v > 0.7e0 * (SELECT avg(v) FROM other) THEN 1.0 ELSE 0.0 END AS m FROM other)"
add("fp_masked", lambda s, d: Projector(s, PAR, V).fp(vol(s, d), mask=mask_of(s, d)), q.query([*_W, VOL, OTHER, MASK], "a d", "p", "SELECT a, d, sum(w * v) AS p FROM w JOIN vol USING (r, c) JOIN mask USING (r, c) WHERE m <> 0 GROUP BY ALL"))
add("bp_masked", lambda s, d: Projector(s, PAR, V).bp(sino(s, d), mask=mask_of(s, d)), q.query([*_W, SINO, OTHER, MASK], "r c", "v", "SELECT r, c, sum(w * p) AS v FROM w JOIN sino USING (a, d) JOIN mask USING (r, c) WHERE m <> 0 GROUP BY ALL"))


def matrix_table(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/lineitem.parquet").groupBy(F.expr(f"CAST(l_orderkey % {VIEWS * DETECTORS} AS INT)").alias("row"), F.expr(f"CAST(l_partkey % {N * N} AS INT)").alias("col")).agg((F.sum("l_quantity") / 1000.0).alias("val"))


add(
    "fp_sparse_matrix",
    lambda s, d: Projector(s, geo.create_proj_geom("sparse_matrix", 1.0, DETECTORS, ANGLES, matrix_table(s, d)), V, "sparse_matrix").fp(vol(s, d)),
    q.query([VOL, f"w AS (SELECT row // {DETECTORS} AS a, row % {DETECTORS} AS d, col // {N} AS r, col % {N} AS c, val AS w FROM (SELECT CAST(l_orderkey % {VIEWS * DETECTORS} AS INT) AS row, CAST(l_partkey % {N * N} AS INT) AS col, sum(l_quantity) / 1000.0 AS val FROM lineitem GROUP BY ALL))"], "a d", "p", FP, 7),
    7,
)
add("ray_length", lambda s, d: Projector(s, PAR, V).ray_length(), q.query(_W, "a d", "s", "SELECT a, d, sum(w) AS s FROM w GROUP BY ALL"))
add("pixel_weight", lambda s, d: Projector(s, PAR, V).pixel_weight(), q.query(_W, "r c", "s", "SELECT r, c, sum(w) AS s FROM w GROUP BY ALL"))
add("sum_sq_weights", lambda s, d: Projector(s, PAR, V).square_weights(), q.query(_W, "a d", "s", "SELECT a, d, sum(w * w) AS s FROM w GROUP BY ALL"))
add("pixel_weight_by_sino", lambda s, d: Projector(s, PAR, V, "strip").bp(sino(s, d)), q.query([*_WEIGHTS["strip"], SINO], "r c", "v", BP))
add("diff_fp", lambda s, d: Projector(s, PAR, V).residual(sino(s, d), vol(s, d)), q.query([*_W, VOL, SINO], "a d", "p", f"SELECT a, d, p - coalesce(f, 0) AS p FROM sino LEFT JOIN (SELECT a, d, p AS f FROM ({FP})) USING (a, d)"))
add("matrix_export", lambda s, d: Projector(s, PAR, V).sparse(), q.query(_W, "row col", "val", f"SELECT CAST(a * {DETECTORS} + d AS INT) AS row, CAST(r * {N} + c AS INT) AS col, w AS val FROM w"))
add("weights_single_ray", lambda s, d: Projector(s, PAR, V).single_ray(3, 11), q.query(_W, "a d r c", "w", "SELECT * FROM w WHERE a = 3 AND d = 11"))
add("weights_projection", lambda s, d: Projector(s, PAR, V).projection(2), q.query(_W, "a d r c", "w", "SELECT * FROM w WHERE a = 2"))
add("splat", lambda s, d: Projector(s, PAR, V).splat(5, 7), q.query(_W, "a d r c", "w", "SELECT * FROM w WHERE r = 5 AND c = 7"))
add("bp_pixel_par", lambda s, d: pd3.bp_pixel(s, PAR, V, sino(s, d)), q.query([SINO, *q.bp_pixel()], "r c", "v", "SELECT * FROM back"))
add("bp_pixel_fan", lambda s, d: pd3.bp_pixel(s, FAN, V, sino(s, d)), q.query([SINO, *q.bp_pixel(q.FAN_ANGLES, True)], "r c", "v", "SELECT * FROM back"))
add("bp_pixel_supersample", lambda s, d: pd3.bp_pixel(s, PAR, V, sino(s, d), subpixels=2), q.query([SINO, *q.bp_pixel(sub=2)], "r c", "v", "SELECT * FROM back"))

for _n in filters.WINDOWS:
    add(f"filter_{_n.replace('-', '_')}", lambda s, d, n=_n: filters.filter_rows(sino(s, d), filters.taps_of(n, DETECTORS), DETECTORS), q.query([SINO, *q.window_taps(_n, DETECTORS), q.filtered(DETECTORS)], "a d", "p", "SELECT * FROM filtered"))
_HALF = [1 / (1 + k) for k in range(filters.size_for(DETECTORS) // 2 + 1)]
_SPACE = [1 / (1 + abs(k - 8)) for k in range(17)]
_HALF_SQL = ["half AS (SELECT k, 1 / (1.0 + k) AS f FROM " + q.upto(33, "k") + ")", q.back_to_taps(64, DETECTORS)]
_SPACE_SQL = [f"taps AS (SELECT m, CASE WHEN abs(m) <= 8 THEN 1 / (1.0 + abs(m)) ELSE 0 END AS h FROM (SELECT unnest(range({1 - DETECTORS}, {DETECTORS})) AS m))"]
for _kind, _base, _taps in (("projection", _HALF, _HALF_SQL), ("rprojection", _SPACE, _SPACE_SQL)):
    add(f"filter_custom_{_kind}", lambda s, d, k=_kind, x=_base: filters.filter_rows(sino(s, d), filters.taps_of_custom(k, x, DETECTORS), DETECTORS), q.query([SINO, *_taps, q.filtered(DETECTORS)], "a d", "p", "SELECT * FROM filtered", 9), 9)
for _kind, _base, _taps in (("sinogram", _HALF, _HALF_SQL), ("rsinogram", _SPACE, _SPACE_SQL)):
    add(f"filter_custom_{_kind}", lambda s, d, k=_kind, x=_base: filters.filter_rows(sino(s, d), {a: filters.taps_of_custom(k, [y * (1 + a / 4) for y in x], DETECTORS) for a in range(VIEWS)}, DETECTORS), q.query([SINO, *_taps, q.filtered(DETECTORS)], "a d", "p", "SELECT a, d, p * (1 + a / 4) AS p FROM filtered", 9), 9)
add("filter_none", lambda s, d: sino(s, d), q.query([SINO], "a d", "p", "SELECT * FROM sino"))
_SCALE = "(pi() / 16)"
_RAMP = [*q.window_taps("ram-lak", DETECTORS), q.filtered(DETECTORS)]
add("fbp_ramlak", lambda s, d: recon.fbp(Projector(s, PAR, V), sino(s, d)), q.query([*_W, SINO, *_RAMP], "r c", "v", f"SELECT r, c, sum(w * p) * {_SCALE} AS v FROM w JOIN filtered USING (a, d) GROUP BY ALL"))
add("fbp_cuda", lambda s, d: recon.fbp_pixel(s, PAR, V, sino(s, d), "hann"), q.query([SINO, *q.window_taps("hann", DETECTORS), q.filtered(DETECTORS), *q.bp_pixel(sino="filtered")], "r c", "v", f"SELECT r, c, v * {_SCALE} AS v FROM back"))
add("fbp_fan_preweight", lambda s, d: sino(s, d).selectExpr("a", "d", f"p * ({recon.fan_weight(DETECTORS, 1.3, 55.0)}) AS p"), q.query([SINO], "a d", "p", f"SELECT a, d, p * {q.FAN_COSINE} AS p FROM sino"))


def fan_fbp_sql(angles: list[float], weight: str = "1") -> list[str]:
    return [SINO, f"pre AS (SELECT a, d, p * {q.FAN_COSINE} * {weight} AS p FROM sino)", *q.window_taps("ram-lak", DETECTORS), q.filtered(DETECTORS, "pre"), *q.bp_pixel(angles, True, q.FAN_FBP, sino="filtered")]


for _n, _g in (("fbp_fan", FAN), ("fbp_fan_vec", FAN_VEC)):
    add(_n, lambda s, d, g=_g: recon.fbp_pixel(s, g, V, sino(s, d)), q.query(fan_fbp_sql(q.FAN_ANGLES), "r c", "v", f"SELECT r, c, v * {q.FAN_SCALE} AS v FROM back"))
_PARKER = q.parker(q.SHORT_ANGLES, DETECTORS, 1.3, 55.0, "d")
add("parker_weight", lambda s, d: recon.with_parker(sino(s, d), list(FAN_SHORT.angles), DETECTORS, 1.3, 55.0), q.query([SINO], "a d", "p", f"SELECT a, d, p * ({_PARKER}) AS p FROM sino"))
add("fbp_short", lambda s, d: recon.fbp_pixel(s, FAN_SHORT, V, sino(s, d), short=True), q.query(fan_fbp_sql(q.SHORT_ANGLES, f"({_PARKER})"), "r c", "v", f"SELECT r, c, v * {q.FAN_SCALE} AS v FROM back"))

# Iterative methods: one materialized step after the other.
_G = f"grid AS (SELECT r, c FROM {q.upto(N, 'r')} x, {q.upto(N, 'c')} y)"
_INV = lambda x: f"CASE WHEN {x} > 0.000001 THEN 1 / {x} ELSE 0 END"


def pixel_back(sino: str, out: str, named: str) -> list[str]:
    """CTEs that end with out(r, c, b): the pixel-driven back projection of sino(a, d, p)."""
    return [*q.bp_pixel(sino=sino, out=f"{out}_", named=named), f"{out} AS MATERIALIZED (SELECT r, c, v AS b FROM {out}_)"]


def sirt_pixel_sql(iterations: int, clamp: str = "{}") -> list[str]:
    """SIRT with rays forward and pixels back."""
    out = [*_W, SINO, _G, f"rl AS MATERIALIZED (SELECT a, d, {_INV('sum(w)')} AS s FROM w GROUP BY ALL)", "one AS (SELECT a, d, 1 AS p FROM sino)", *pixel_back("one", "pw", "tpw"), "x0 AS MATERIALIZED (SELECT r, c, CAST(0 AS DOUBLE) AS v FROM grid)"]
    for k in range(iterations):
        out.append(f"g{k} AS MATERIALIZED (SELECT sino.a, sino.d, (p - coalesce(f, 0)) * s AS p FROM sino LEFT JOIN (SELECT a, d, sum(w * v) AS f FROM w JOIN x{k} USING (r, c) GROUP BY ALL) USING (a, d) JOIN rl USING (a, d))")
        out += pixel_back(f"g{k}", f"b{k}", f"tb{k}")
        new = clamp.format(f"v + coalesce(b{k}.b * {_INV('pw.b')}, 0)")
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT r, c, {new} AS v FROM x{k} LEFT JOIN b{k} USING (r, c) LEFT JOIN pw USING (r, c))")
    return out


def sirt_sql(iterations: int, clamp: str = "{}", mask: bool = False) -> list[str]:
    within = " JOIN (SELECT r, c FROM mask WHERE m <> 0) USING (r, c)" if mask else ""
    out = [*_W, SINO, _G, f"wm AS MATERIALIZED (SELECT w.* FROM w{within} SEMI JOIN sino USING (a, d))", f"rl AS MATERIALIZED (SELECT a, d, {_INV('sum(w)')} AS s FROM wm GROUP BY ALL)", f"pw AS MATERIALIZED (SELECT r, c, {_INV('sum(w)')} AS s FROM wm GROUP BY ALL)", "x0 AS MATERIALIZED (SELECT r, c, CAST(0 AS DOUBLE) AS v FROM grid)"]
    for k in range(iterations):
        out.append(f"g{k} AS MATERIALIZED (SELECT sino.a, sino.d, (p - coalesce(f, 0)) * s AS p FROM sino LEFT JOIN (SELECT a, d, sum(w * v) AS f FROM w JOIN x{k} USING (r, c) GROUP BY ALL) USING (a, d) JOIN rl USING (a, d))")
        new = clamp.format("v + coalesce(b, 0)")
        new = f"CASE WHEN m <> 0 THEN {new} ELSE v END" if mask else new
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT r, c, {new} AS v FROM x{k} LEFT JOIN (SELECT r, c, sum(w * p) * any_value(s) AS b FROM w JOIN g{k} USING (a, d) JOIN pw USING (r, c) GROUP BY ALL) USING (r, c)" + (" LEFT JOIN mask USING (r, c)" if mask else "") + ")")
    return out


add("sirt_2it", lambda s, d: recon.SIRT(Projector(s, PAR, V), sino(s, d)).run(2), q.query(sirt_sql(2), "r c", "v", "SELECT * FROM x2", 3), 3)
add("sirt_mask_clamp", lambda s, d: recon.SIRT(Projector(s, PAR, V), sino(s, d), mask=mask_of(s, d), low=0.01, high=0.4).run(2), q.query([OTHER, MASK, *sirt_sql(2, "least(greatest({}, 0.01e0), 0.4e0)", True)], "r c", "v", "SELECT * FROM x2", 3), 3)


def lake_run(s: SparkSession, d: str, kind: str, option: dict | None = None, iterations: int = 1, start: DataFrame | None = None, g: geo.Projection = PAR, masks: tuple[str, ...] = (), extra: dict | None = None, kernel: str | None = None) -> DataFrame:
    """An algorithm by its configuration over the tables: the reconstruction, or the projections of FP."""
    lake = api.Lake(s)
    image = lake.data2d.create("-vol", V, vol(s, d))
    p, out = lake.data2d.create("-sino", g, sino(s, d)), lake.data2d.create("-vol", V, start if start is not None else 0.0)
    option = dict(option or {}) | {k: lake.data2d.create("-vol", V, mask_of(s, d)) for k in masks} | {k: lake.store.put("data", x) for k, x in (extra or {}).items()}
    cfg = {"type": kind, "VolumeDataId": image, "ProjectionDataId": p, "ReconstructionDataId": out, "option": option}
    if kernel:
        cfg["ProjectorId"] = lake.create_projector(kernel, g, V)
    k = lake.algorithm(cfg)
    lake.run(k, iterations)
    found = lake.data2d.table(p if kind.startswith("FP") else out)
    lake.store.get(k).release()
    return found


add("sirt_cuda_2it", lambda s, d: lake_run(s, d, "SIRT_CUDA", iterations=2), q.query(sirt_pixel_sql(2), "r c", "v", "SELECT * FROM x2", 3), 3)
add("sirt_cuda_bound_masks", lambda s, d: lake_run(s, d, "SIRT_CUDA", masks=("MinMaskId",), iterations=1), q.query([OTHER, MASK, *sirt_pixel_sql(1)], "r c", "v", "SELECT r, c, greatest(v, coalesce(m, v)) AS v FROM x1 LEFT JOIN mask USING (r, c)", 3), 3)
_FULL = f"SELECT a, d, coalesce(p, 0) AS p FROM (SELECT a, d FROM {q.upto(VIEWS, 'a')}, {q.upto(DETECTORS, 'd')}) g LEFT JOIN ({{}}) f USING (a, d)"
_FULLV = "SELECT r, c, coalesce(v, 0) AS v FROM grid LEFT JOIN ({}) USING (r, c)"
add("fp_cuda_masked", lambda s, d: lake_run(s, d, "FP_CUDA", masks=("VolumeMaskId",)), q.query([*_W, VOL, OTHER, MASK], "a d", "p", _FULL.format("SELECT a, d, sum(w * v) AS p FROM w JOIN vol USING (r, c) JOIN mask USING (r, c) WHERE m <> 0 GROUP BY ALL")))
add("fp_cuda_supersample", lambda s, d: lake_run(s, d, "FP_CUDA", {"DetectorSuperSampling": 2}), q.query([*q.weights(q.parallel(sub=2), q.HAT, 2), VOL], "a d", "p", _FULL.format(FP)))
add("bp_cuda_fan", lambda s, d: lake_run(s, d, "BP_CUDA", {"PixelSuperSampling": 3}, g=FAN), q.query([SINO, _G, *q.bp_pixel(q.FAN_ANGLES, True, sub=3)], "r c", "v", _FULLV.format("SELECT * FROM back")))
add("fbp_custom_filter", lambda s, d: lake_run(s, d, "FBP", {"FilterType": "projection"}, extra={"FilterSinogramId": api.Data(geo.create_proj_geom("parallel", 1.0, 33, [0.0]), arrays.from_array(s, [_HALF], "sino2d"))}, kernel="linear"), q.query([*_W, SINO, _G, *_HALF_SQL, q.filtered(DETECTORS)], "r c", "v", _FULLV.format(f"SELECT r, c, sum(w * p) * {_SCALE} AS v FROM w JOIN filtered USING (a, d) GROUP BY ALL")))
add("fbp_cuda_short", lambda s, d: lake_run(s, d, "FBP_CUDA", {"ShortScan": True}, g=FAN_SHORT), q.query([*fan_fbp_sql(q.SHORT_ANGLES, f"({_PARKER})"), _G], "r c", "v", _FULLV.format(f"SELECT r, c, v * {q.FAN_SCALE} AS v FROM back")))


def residual_norm(s: SparkSession, d: str) -> DataFrame:
    own = recon.SIRT(Projector(s, PAR, V), sino(s, d))
    own.run(1)
    return own.projector.residual(own.sino, own.volume).agg(F.sqrt(F.sum(F.col("p") * F.col("p"))).alias("s"))


add("residual_norm", residual_norm, q.query(sirt_sql(1), "", "s", "SELECT sqrt(sum((p - coalesce(f, 0)) ** 2)) AS s FROM sino LEFT JOIN (SELECT a, d, sum(w * v) AS f FROM w JOIN x1 USING (r, c) GROUP BY ALL) USING (a, d)", 3).replace("SELECT , ", "SELECT "), 3)


def sart_sql(order: list[int]) -> list[str]:
    out = [*_W, SINO, _G, "x0 AS MATERIALIZED (SELECT r, c, CAST(0 AS DOUBLE) AS v FROM grid)"]
    for k, a in enumerate(order):
        out.append(f"w{k} AS MATERIALIZED (SELECT w.* FROM w SEMI JOIN (SELECT * FROM sino WHERE a = {a}) USING (a, d))")
        out.append(f"g{k} AS MATERIALIZED (SELECT a, d, p - coalesce(f, 0) AS p, len FROM sino LEFT JOIN (SELECT a, d, sum(w * v) AS f FROM w{k} JOIN x{k} USING (r, c) GROUP BY ALL) USING (a, d) JOIN (SELECT a, d, sum(w) AS len FROM w{k} GROUP BY ALL) USING (a, d) WHERE a = {a})")
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT r, c, v + coalesce(b, 0) AS v FROM x{k} LEFT JOIN (SELECT r, c, sum(w * p / (pw * len)) AS b FROM w{k} JOIN g{k} USING (a, d) JOIN (SELECT r, c, sum(w) AS pw FROM w{k} GROUP BY ALL) USING (r, c) WHERE abs(pw * len) > 0.001 GROUP BY ALL) USING (r, c))")
    return out


add("sart_custom", lambda s, d: recon.SART(Projector(s, PAR, V), sino(s, d), order=[3, 0, 5]).run(3), q.query(sart_sql([3, 0, 5]), "r c", "v", "SELECT * FROM x3", 3), 3)
_ORDER = [(0, 11), (3, 12), (5, 10), (2, 13)]


def art_sql() -> list[str]:
    out = [*_W, SINO, _G, "x0 AS MATERIALIZED (SELECT r, c, CAST(0 AS DOUBLE) AS v FROM grid)"]
    for k, (a, d) in enumerate(_ORDER):
        out.append(f"w{k} AS MATERIALIZED (SELECT r, c, w FROM w WHERE a = {a} AND d = {d})")
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT r, c, CASE WHEN w IS NULL THEN v ELSE v + w * (SELECT p FROM sino WHERE a = {a} AND d = {d}) / (SELECT sum(w * w) FROM w{k}) - w * (SELECT sum(w * v) FROM w{k} JOIN x{k} USING (r, c)) / (SELECT sum(w * w) FROM w{k}) END AS v FROM x{k} LEFT JOIN w{k} USING (r, c))")
    return out


add("art_custom", lambda s, d: recon.ART(Projector(s, PAR, V), sino(s, d), order=_ORDER).run(4), q.query(art_sql(), "r c", "v", "SELECT * FROM x4", 3), 3)


def cgls_sql(iterations: int) -> list[str]:
    back = "SELECT r, c, coalesce(b, 0) AS v FROM grid LEFT JOIN (SELECT r, c, sum(w * p) AS b FROM w JOIN r{} USING (a, d) GROUP BY ALL) USING (r, c)"
    out = [*_W, SINO, _G, "x0 AS MATERIALIZED (SELECT r, c, CAST(0 AS DOUBLE) AS v FROM grid)", "r0 AS (SELECT * FROM sino)", f"p0 AS MATERIALIZED ({back.format(0)})", "c0 AS MATERIALIZED (SELECT sum(v * v) AS g FROM p0)"]
    for k in range(iterations):
        out += [
            f"q{k} AS MATERIALIZED (SELECT a, d, sum(w * v) AS f FROM w JOIN p{k} USING (r, c) GROUP BY ALL)",
            f"al{k} AS MATERIALIZED (SELECT (SELECT g FROM c{k}) / sum(f * f) AS al FROM q{k})",
            f"x{k + 1} AS MATERIALIZED (SELECT r, c, x.v + al * p.v AS v FROM x{k} x JOIN p{k} p USING (r, c), al{k})",
            f"r{k + 1} AS MATERIALIZED (SELECT a, d, p - al * coalesce(f, 0) AS p FROM r{k} LEFT JOIN q{k} USING (a, d), al{k})",
            f"z{k + 1} AS MATERIALIZED ({back.format(k + 1)})",
            f"c{k + 1} AS MATERIALIZED (SELECT sum(v * v) AS g FROM z{k + 1})",
            f"p{k + 1} AS MATERIALIZED (SELECT r, c, z.v + (SELECT g FROM c{k + 1}) / (SELECT g FROM c{k}) * p.v AS v FROM z{k + 1} z JOIN p{k} p USING (r, c))",
        ]
    return out


add("cgls_2it", lambda s, d: recon.CGLS(Projector(s, PAR, V), sino(s, d)).run(2), q.query(cgls_sql(2), "r c", "v", "SELECT * FROM x2", 3), 3)
_EM = [*_W, SINO, _G, "x0 AS MATERIALIZED (SELECT r, c, CAST(1 AS DOUBLE) AS v FROM grid)", f"pw AS MATERIALIZED (SELECT r, c, {_INV('sum(w)')} AS s FROM w GROUP BY ALL)"]
for _i in range(2):
    _EM.append(f"g{_i} AS MATERIALIZED (SELECT a, d, CASE WHEN f > 1e-6 THEN p / f ELSE 0 END AS p FROM sino JOIN (SELECT a, d, sum(w * v) AS f FROM w JOIN x{_i} USING (r, c) GROUP BY ALL) USING (a, d))")
    _EM.append(f"x{_i + 1} AS MATERIALIZED (SELECT r, c, v * coalesce(b, 0) AS v FROM x{_i} LEFT JOIN (SELECT r, c, sum(w * p) * any_value(s) AS b FROM w JOIN g{_i} USING (a, d) JOIN pw USING (r, c) GROUP BY ALL) USING (r, c))")
_EMP = [*_W, SINO, _G, "x0 AS MATERIALIZED (SELECT r, c, CAST(1 AS DOUBLE) AS v FROM grid)", f"every AS (SELECT a, d, 1 AS p FROM {q.upto(VIEWS, 'a')} x, {q.upto(DETECTORS, 'd')} y)", *pixel_back("every", "pw", "tpw")]
for _i in range(2):
    _EMP.append(f"g{_i} AS MATERIALIZED (SELECT a, d, CASE WHEN f > 1e-6 THEN p / f ELSE 0 END AS p FROM sino JOIN (SELECT a, d, sum(w * v) AS f FROM w JOIN x{_i} USING (r, c) GROUP BY ALL) USING (a, d))")
    _EMP += pixel_back(f"g{_i}", f"b{_i}", f"tb{_i}")
    _EMP.append(f"x{_i + 1} AS MATERIALIZED (SELECT r, c, v * coalesce(b{_i}.b * {_INV('pw.b')}, 0) AS v FROM x{_i} LEFT JOIN b{_i} USING (r, c) LEFT JOIN pw USING (r, c))")
add("em_cuda_2it", lambda s, d: lake_run(s, d, "EM_CUDA", iterations=2), q.query(_EMP, "r c", "v", "SELECT * FROM x2", 3), 3)


def cgls_pixel_sql() -> list[str]:
    """A step of conjugate gradients from the image 0.5, with rays forward and pixels back."""
    return [
        *_W, SINO, _G, "r0 AS MATERIALIZED (SELECT a, d, p - 0.5 * coalesce(f, 0) AS p FROM sino LEFT JOIN (SELECT a, d, sum(w) AS f FROM w GROUP BY ALL) USING (a, d))", *pixel_back("r0", "z0", "tz0"),
        f"q0 AS MATERIALIZED (SELECT a, d, sum(w * b) AS f FROM w JOIN z0 USING (r, c) GROUP BY ALL)", "x1 AS (SELECT r, c, 0.5 + coalesce(b, 0) * (SELECT sum(b * b) FROM z0) / (SELECT sum(f * f) FROM q0) AS v FROM grid LEFT JOIN z0 USING (r, c))",
    ]


add("cgls_cuda", lambda s, d: lake_run(s, d, "CGLS_CUDA", start=arrays.filled(s, (N, N), "vol2d", 0.5)), q.query(cgls_pixel_sql(), "r c", "v", "SELECT * FROM x1", 3), 3)


def sart_pixel_sql(order: list[int]) -> list[str]:
    out = [*_W, SINO, _G, "x0 AS MATERIALIZED (SELECT r, c, CAST(0 AS DOUBLE) AS v FROM grid)"]
    for k, a in enumerate(order):
        out.append(f"g{k} AS MATERIALIZED (SELECT a, d, (p - coalesce(f, 0)) * {_INV('len')} AS p FROM sino LEFT JOIN (SELECT a, d, sum(w * v) AS f FROM w JOIN x{k} USING (r, c) WHERE a = {a} GROUP BY ALL) USING (a, d) JOIN (SELECT a, d, sum(w) AS len FROM w GROUP BY ALL) USING (a, d) WHERE a = {a})")
        out += q.bp_pixel(weight="1", sino=f"g{k}", out=f"b{k}", named=f"tb{k}")
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT r, c, x{k}.v + coalesce(b{k}.v, 0) AS v FROM x{k} LEFT JOIN b{k} USING (r, c))")
    return out


add("sart_cuda_custom", lambda s, d: lake_run(s, d, "SART_CUDA", {"ProjectionOrder": "custom", "ProjectionOrderList": [3, 0, 5]}, iterations=3), q.query(sart_pixel_sql([3, 0, 5]), "r c", "v", "SELECT * FROM x3", 3), 3)
add("em_2it", lambda s, d: recon.EM(Projector(s, PAR, V), sino(s, d)).run(2), q.query(_EM, "r c", "v", "SELECT * FROM x2", 3), 3)

# Elementwise operators.
_BOTH = "SELECT vol.r, vol.c, vol.v AS o, coalesce(other.v, 0) AS a, coalesce(other.v, 0) AS b FROM vol LEFT JOIN other USING (r, c)"
for _n in elementwise.FORMS:
    add(f"op_{_n}", lambda s, d, n=_n: elementwise.apply(n, vol(s, d), vol(s, d, OTHER_KEYS), vol(s, d, OTHER_KEYS), 0.75), q.query([VOL, OTHER], "r c", "v", f"SELECT r, c, {q.ELEMENTWISE[_n]} AS v FROM (SELECT *, CAST(0.75 AS DOUBLE) AS s FROM ({_BOTH}))", 9), 9)
for _n, _e in (("mul", "$1 * s1"), ("div", "$1 ./ s1"), ("add", "$1 + s1"), ("sub", "$1 - s1"), ("muldata", "$1 .* $2"), ("adddata", "$1 + $2")):
    add(f"data_op_{_n}", lambda s, d, e=_e: elementwise.data_op(e, vol(s, d), vol(s, d, OTHER_KEYS), 1.5), q.query([VOL, OTHER], "r c", "v", f"SELECT r, c, {q.DATA_OPS[_n]} AS v FROM ({_BOTH})"))
add("data_op_mul_mask", lambda s, d: elementwise.data_op("$1*s1", vol(s, d), None, 1.5, mask_of(s, d)), q.query([VOL, OTHER, MASK], "r c", "v", "SELECT r, c, CASE WHEN coalesce(m, 0) <> 0 THEN v * 1.5e0 ELSE v END AS v FROM vol LEFT JOIN mask USING (r, c)"))
add("segment_and_mask", lambda s, d: elementwise.segment_and_mask(vol(s, d), mask_of(s, d), 0.6, 1.0), q.query([VOL, OTHER, MASK], "r c", "v mask", "SELECT r, c, CASE WHEN v >= 0.6e0 THEN 1e0 ELSE v END AS v, CASE WHEN v >= 0.6e0 THEN 0e0 ELSE m END AS mask FROM vol JOIN mask USING (r, c)"))
add("dot", lambda s, d: elementwise.dot(vol(s, d), vol(s, d, OTHER_KEYS)), "WITH " + VOL + ", " + OTHER + " SELECT round(sum(vol.v * other.v), 3) + 0.0 AS s FROM vol JOIN other USING (r, c)", 3)
add("roi_select", lambda s, d: elementwise.roi_select(vol(s, d), N, N, 25.0), q.query([VOL], "r c", "v", "SELECT r, c, CASE WHEN (c - 7.5e0) * (c - 7.5e0) + (r - 7.5e0) * (r - 7.5e0) > 25 THEN 0 ELSE v END AS v FROM vol"))
add("clip_circle", lambda s, d: elementwise.clip_circle(vol(s, d), N)[0], q.query([VOL], "r c", "v", "SELECT r, c, CASE WHEN (r - 7.5e0) * (r - 7.5e0) + (c - 7.5e0) * (c - 7.5e0) <= 64 THEN v ELSE 0 END AS v FROM vol"))
add("clip_circle_count", lambda s, d: elementwise.clip_circle(vol(s, d), N)[1], f"SELECT count(*) AS n FROM {q.upto(N, 'r')}, {q.upto(N, 'c')} WHERE (r - 7.5) ** 2 + (c - 7.5) ** 2 > 64")
add("imscale", lambda s, d: elementwise.imscale(vol(s, d)), q.query([VOL], "r c", "v", "SELECT r, c, (v - (SELECT min(v) FROM vol)) / ((SELECT max(v) FROM vol) - (SELECT min(v) FROM vol)) AS v FROM vol"))

# Neighbourhoods, on images of few levels.
LEVELS, THRESHOLDS = [0.0, 1.0, 2.0], [0.97, 1.03]


def flat(s: SparkSession, d: str) -> DataFrame:
    """The image by its mean: three levels."""
    o = vol(s, d)
    return dart.segment(o.join(F.broadcast(o.agg(F.avg("v").alias("m")))).selectExpr("r", "c", "v / m AS v"), LEVELS, THRESHOLDS)


def flat3(s: SparkSession, d: str) -> DataFrame:
    o = vol(s, d, VOLUME3_KEYS)
    return dart.segment(o.join(F.broadcast(o.agg(F.avg("v").alias("m")))).selectExpr("z", "r", "c", "v / m AS v"), LEVELS, THRESHOLDS)


_SEG = "CASE WHEN v / (SELECT avg(v) FROM {0}) >= 1.03e0 THEN 2e0 WHEN v / (SELECT avg(v) FROM {0}) >= 0.97e0 THEN 1e0 ELSE 0e0 END"
FLAT = f"flat AS MATERIALIZED (SELECT r, c, {_SEG.format('vol')} AS v FROM vol)"
FLAT3 = f"flat AS MATERIALIZED (SELECT z, r, c, {_SEG.format('vol3')} AS v FROM vol3)"


_DIFF = "sum(CASE WHEN n <> v THEN 1 ELSE 0 END)"
_FULL2, _CROSS = "greatest(abs(dr), abs(dc)) = 1", "abs(dr) + abs(dc) = 1"
_SQUARE = "greatest(abs(dr), abs(dc)) BETWEEN 1 AND 2"
_IN = {1: "r BETWEEN 1 AND 14 AND c BETWEEN 1 AND 14", 2: "r BETWEEN 2 AND 13 AND c BETWEEN 2 AND 13"}
_IN3 = "z BETWEEN 1 AND 4 AND r BETWEEN 1 AND 4 AND c BETWEEN 1 AND 4"
_FULL3, _CROSS3 = "greatest(abs(dz), abs(dr), abs(dc)) = 1", "abs(dz) + abs(dr) + abs(dc) = 1"
add("segment", flat, q.query([VOL, FLAT], "r c", "v", "SELECT * FROM flat"))
for _n, _conn, _thr, _rad, _near in (("4", 4, 1, 1, _CROSS), ("8", 8, 1, 1, _FULL2), ("thr", 8, 3, 1, _FULL2), ("radius", 8, 2, 2, _SQUARE)):
    add(f"dart_mask_{_n}", lambda s, d, c=_conn, t=_thr, r=_rad: stencil.mask(flat(s, d), (N, N), c, t, r), q.query([VOL, FLAT, q.neighbours(_DIFF, "r c", _near)], "r c", "v", f"SELECT r, c, CASE WHEN {_IN[_rad]} AND s >= {_thr} THEN 1.0 ELSE 0.0 END AS v FROM near"))
for _conn, _near in ((6, _CROSS3), (26, _FULL3)):
    add(f"dart_mask3d_{_conn}", lambda s, d, c=_conn: stencil.mask(flat3(s, d), (N3,) * 3, c), q.query([VOL3, FLAT3, q.neighbours(_DIFF, "z r c", _near)], "z r c", "v", f"SELECT z, r, c, CASE WHEN {_IN3} AND s >= 1 THEN 1.0 ELSE 0.0 END AS v FROM near"))
for _n, _rad, _near in (("", 1, _FULL2), ("_r2", 2, _SQUARE)):
    add(f"dart_smooth{_n}", lambda s, d, r=_rad: stencil.smooth(flat(s, d), (N, N), 0.3, r), q.query([VOL, FLAT, q.neighbours("avg(n)", "r c", _near)], "r c", "v", f"SELECT r, c, CASE WHEN {_IN[_rad]} THEN 0.7 * v + 0.3 * s ELSE v END AS v FROM near"))
add("dart_smooth3d", lambda s, d: stencil.smooth(flat3(s, d), (N3,) * 3), q.query([VOL3, FLAT3, q.neighbours("avg(n)", "z r c", _FULL3)], "z r c", "v", f"SELECT z, r, c, CASE WHEN {_IN3} THEN 0.7 * v + 0.3 * s ELSE v END AS v FROM near"))
add("dart_smooth_padded", lambda s, d: stencil.smooth_padded(flat(s, d)), q.query([VOL, FLAT, q.neighbours("sum(n)", "r c", _FULL2)], "r c", "v", "SELECT r, c, 0.9 * v + 0.1 * s / 8 AS v FROM near"))
add("dart_mask_over", lambda s, d: stencil.mask_over(flat(s, d), 2), q.query([VOL, FLAT, q.neighbours(_DIFF, "r c", _FULL2)], "r c", "v", "SELECT r, c, CASE WHEN s > 2 THEN 1.0 ELSE 0.0 END AS v FROM near"))
add("rnmp", lambda s, d: tools.rnmp(flat(s, d), dart.segment(vol(s, d, OTHER_KEYS), LEVELS, THRESHOLDS)), f"WITH {VOL}, {OTHER}, {FLAT}, t AS (SELECT r, c, CASE WHEN v >= 1.03e0 THEN 2e0 WHEN v >= 0.97e0 THEN 1e0 ELSE 0e0 END AS t FROM other) SELECT CAST(sum(CASE WHEN v <> t THEN 1 ELSE 0 END) AS BIGINT) AS nmp, round(sum(CASE WHEN v <> t THEN 1.0 ELSE 0.0 END) / nullif(sum(CASE WHEN t <> 0 THEN 1.0 ELSE 0.0 END), 0), 4) + 0.0 AS rnmp FROM flat JOIN t USING (r, c)")
add("proj_diff", lambda s, d: tools.projection_difference(Projector(s, PAR, V).fp(vol(s, d)), sino(s, d)), q.query([*_W, VOL, SINO], "", "s", f"SELECT sum((p - coalesce(f, 0)) ** 2) / sum(p) AS s FROM sino LEFT JOIN (SELECT a, d, p AS f FROM ({FP})) USING (a, d)", 3).replace("SELECT , ", "SELECT "), 3)
add("shepp_logan", lambda s, d: phantoms.shepp_logan(s, N, N, modified=False), q.query([], "r c", "v", q.phantom(N, 0, False)))
add("shepp_logan_mod", lambda s, d: phantoms.shepp_logan(s, N, N), q.query([], "r c", "v", q.phantom(N, 0, True)))
add("shepp_logan3d", lambda s, d: phantoms.shepp_logan(s, N, N, 8), q.query([], "z r c", "v", q.phantom(N, 8, True)))
add("downsample_sino", lambda s, d: tools.downsample(sino(s, d), 2, True), q.query([SINO], "a d", "p", "SELECT a, CAST(d // 2 AS INT) AS d, sum(p) / 4 AS p FROM sino GROUP BY ALL", 7), 7)
_RA = [0.3, 1.1, 2.0]
add("overlay_rgb", lambda s, d: tools.overlay_rgb(vol(s, d), vol(s, d, OTHER_KEYS)), q.query([VOL, OTHER], "r c", "red green blue", "SELECT r, c, coalesce(vol.v, 0) / (SELECT max(v) FROM vol) AS red, coalesce(other.v, 0) / (SELECT max(v) FROM other) AS green, 0.0 AS blue FROM vol FULL JOIN other USING (r, c)"))
add("rebin_fan2par", lambda s, d: tools.rebin(sino(s, d), FAN, _RA, 0.9), q.query([SINO, f"t(a, t) AS (VALUES {values(enumerate(_RA))})", f"ray AS (SELECT a, d, t, asin((d - 11.5e0) * 0.9e0 / 40e0) AS gamma FROM t, {q.upto(DETECTORS, 'd')} x)"], "a d", "p", f"SELECT ray.a, ray.d, p FROM ray JOIN sino s ON s.a = CAST(floor((t - gamma - 0.1) / (pi() / 4) + 0.5e0) AS INT) AND s.d = CAST(floor(tan(gamma) * 40e0 / (1.3 * 40 / 55) + 11.5e0 + 0.5e0) AS INT)"))
add("resize3d", lambda s, d: tools.resize3d(vol(s, d, VOLUME3_KEYS), (N3,) * 3, (9, 4, 6)), q.query([VOL3], "z r c", "v", f"SELECT z.z, r.r, c.c, v FROM {q.upto(9, 'z')} z, {q.upto(4, 'r')} r, {q.upto(6, 'c')} c JOIN vol3 ON vol3.z = CAST(floor(z.z * 6 / 9e0 + 1e-9) AS INT) AND vol3.r = CAST(floor(r.r * 6 / 4e0 + 1e-9) AS INT) AND vol3.c = c.c"))
add("slice_extract", lambda s, d: tools.slice_of(vol(s, d, VOLUME3_KEYS), "z", 2), q.query([VOL3], "r c", "v", "SELECT r, c, v FROM vol3 WHERE z = 2"))
add("overlay", lambda s, d: tools.overlay(vol(s, d), flat(s, d)), q.query([VOL, FLAT], "r c", "v", "SELECT vol.r, vol.c, CASE WHEN flat.v <> 0 THEN 0.5e0 * vol.v + 0.5e0 * flat.v ELSE vol.v END AS v FROM vol JOIN flat USING (r, c)"))


# Geometry, as tables.
def table_of(rows, names: str):
    """Rows from the driver's geometry code."""
    kinds = lambda x: "int" if isinstance(x, int) else "double"
    rows = [tuple(x if isinstance(x, int) else float(x) for x in r) for r in rows]
    return lambda s, d: s.createDataFrame(rows, ", ".join(f"{n} {kinds(x)}" for n, x in zip(names.split(), rows[0], strict=True)))


def rotated(k: str, terms: list[str], angles: list[float], names: str) -> str:
    """Vectors by the angle in SQL, independent of the driver's code."""
    return f"WITH t(a, t) AS (VALUES {values(enumerate(angles))}) SELECT a, " + ", ".join(f"CAST(round({x}, 4) + 0.0 AS DOUBLE) AS {n}" for x, n in zip(terms, names.split(), strict=True)) + " FROM t"


add("geom_2vec_parallel", table_of([(k, *x) for k, x in enumerate(geo.geom_2vec(PAR).tolist())], "a x0 x1 x2 x3 x4 x5"), rotated("parallel", ["-sin(t)", "cos(t)", "0", "0", "cos(t)", "sin(t)"], ANGLES, "x0 x1 x2 x3 x4 x5"))
add("geom_2vec_fanflat", table_of([(k, *x) for k, x in enumerate(geo.geom_2vec(FAN).tolist())], "a x0 x1 x2 x3 x4 x5"), rotated("fanflat", ["40 * sin(t)", "-40 * cos(t)", "-15 * sin(t)", "15 * cos(t)", "1.3 * cos(t)", "1.3 * sin(t)"], list(FAN.angles), "x0 x1 x2 x3 x4 x5"))
_names12 = " ".join(f"x{i}" for i in range(12))
add("geom_2vec_cone", table_of([(k, *x) for k, x in enumerate(geo.geom_2vec(CONE).tolist())], "a " + _names12), rotated("cone", ["30 * sin(t)", "-30 * cos(t)", "0", "-10 * sin(t)", "10 * cos(t)", "0", "1.1 * cos(t)", "1.1 * sin(t)", "0", "0", "0", "1.2"], list(CONE.angles), _names12))
add("postalign", table_of([(k, *x) for k, x in enumerate(geo.geom_2vec(VEC).tolist())], "a x0 x1 x2 x3 x4 x5"), rotated("parallel", ["-sin(t)", "cos(t)", "0.3 * cos(t)", "0.3 * sin(t)", "cos(t)", "sin(t)"], ANGLES, "x0 x1 x2 x3 x4 x5"))
_SUB = geo.sub_geometry(CONE, range(2, 6), range(1, 5), range(1, 3))
add("sub_geometry", table_of([(k, *x) for k, x in enumerate(_SUB.views)], "a " + _names12), rotated("cone", ["30 * sin(t)", "-30 * cos(t)", "0", "-10 * sin(t) - 2.2 * cos(t)", "10 * cos(t) - 2.2 * sin(t)", "-3.6", "1.1 * cos(t)", "1.1 * sin(t)", "0", "0", "0", "1.2"], list(CONE.angles[1:3]), _names12))
_POINT = (1.0, 2.0, 0.5)
add("project_point", table_of([(k, *geo.project_point(CONE, k, *_POINT)) for k in range(4)], "a u v"), f"WITH t(a, t) AS (VALUES {values(enumerate(CONE.angles))}), p AS (SELECT a, cos(t) * 1.0 + sin(t) * 2.0 AS x, -sin(t) * 1.0 + cos(t) * 2.0 AS y FROM t) SELECT a, round(x * 40 / (y + 30) / 1.1 + 4, 4) + 0.0 AS u, round(0.5 * 40 / (y + 30) / 1.2 + 4, 4) + 0.0 AS v FROM p")
add("projected_bbox", table_of([geo.projected_bbox(CONE, V3)], "u0 u1 v0 v1"), f"WITH t(t) AS (VALUES {values((x,) for x in CONE.angles)}), k(s) AS (VALUES (-3.0e0), (3.0e0)), p AS (SELECT cos(t) * x.s + sin(t) * y.s AS x, -sin(t) * x.s + cos(t) * y.s AS y, z.s AS z FROM t, k x, k y, k z) SELECT round(min(x * 40 / (y + 30) / 1.1 + 4), 4) + 0.0 AS u0, round(max(x * 40 / (y + 30) / 1.1 + 4), 4) + 0.0 AS u1, round(min(z * 40 / (y + 30) / 1.2 + 4), 4) + 0.0 AS v0, round(max(z * 40 / (y + 30) / 1.2 + 4), 4) + 0.0 AS v1 FROM p")

# Three dimensions.
FP3 = "SELECT dv, a, du, sum(w * v) AS p FROM w JOIN vol3 USING (z, r, c) GROUP BY ALL"
BP3 = "SELECT z, r, c, sum(w * p) AS v FROM w JOIN sino USING (dv, a, du) GROUP BY ALL"
BACK3 = "SELECT * FROM back"
_W3 = {k: q.weights_3d(k) for k in ("par", "cone", "cyl")}


def vol3(s: SparkSession, d: str) -> DataFrame:
    return vol(s, d, VOLUME3_KEYS)


def sino3(s: SparkSession, d: str) -> DataFrame:
    return sino(s, d, SINO3_KEYS)


for _n, _g, _t in (("par", PAR3, q.PAR3_ANGLES), ("cone", CONE, q.CONE_ANGLES), ("cyl", CYL, q.CONE_ANGLES)):
    add(f"fp3d_{_n}", lambda s, d, g=_g: pd3.fp_3d(s, g, V3, vol3(s, d)), q.query([*_W3[_n], VOL3], "dv a du", "p", FP3))
    add("bp3d_cyl" if _n == "cyl" else f"bp3d_matched_{_n}", lambda s, d, g=_g: pd3.bp_matched_3d(s, g, V3, sino3(s, d)), q.query([SINO3, *_W3[_n]], "z r c", "v", BP3))
    add("bp3d_cyl_voxel" if _n == "cyl" else f"bp3d_{_n}", lambda s, d, g=_g: pd3.bp_voxel(s, g, V3, sino3(s, d)), q.query([SINO3, *q.bp_voxel(_t, _n)], "z r c", "v", BACK3))
add("bp3d_2d_weighting", lambda s, d: Projector3D(s, CONE, V3, "2d_weighting").bp(sino3(s, d)), q.query([SINO3, *q.bp_voxel(weight=q.FLAT_WEIGHT)], "z r c", "v", BACK3))
add("fp3d_sum_square", lambda s, d: Projector3D(s, PAR3, V3, "sum_square_weights").fp(None), q.query(_W3["par"], "dv a du", "p", "SELECT dv, a, du, sum(w * w) AS p FROM w GROUP BY ALL"))
add("fp3d_supersample", lambda s, d: Projector3D(s, CONE, V3, subrays=2).fp(vol3(s, d)), q.query([*q.weights_3d("cone", 2), VOL3], "dv a du", "p", FP3))
add("bp3d_supersample", lambda s, d: Projector3D(s, CONE, V3, subvoxels=2).bp(sino3(s, d)), q.query([SINO3, *q.bp_voxel(sub=2)], "z r c", "v", BACK3))
add("bp3d_sirt_weighted", lambda s, d: recon.bp_sirt_weighted(s, CONE, V3, vol3(s, d), sino3(s, d)), q.query([VOL3, SINO3, "ones AS (SELECT dv, a, du, 1 AS p FROM sino)", *q.bp_voxel(), *q.bp_voxel(sino="ones", out="back1", named="turns1")], "z r c", "v", "SELECT vol3.z, vol3.r, vol3.c, vol3.v + CASE WHEN coalesce(back1.v, 0) > 1e-6 THEN back.v / back1.v ELSE 0 END AS v FROM vol3 LEFT JOIN back USING (z, r, c) LEFT JOIN back1 USING (z, r, c)"))


def fdk_sql(angles: list[float], weight: str = "1", lift: float = 0.0) -> list[str]:
    return [SINO3, f"pre AS (SELECT dv, a, du, p * {q.cone_weight(lift)} * {weight} AS p FROM sino)", *q.window_taps("ram-lak", 8), q.filtered(8, "pre", "dv, a", "du"), *q.bp_voxel(angles, weight=q.FDK_WEIGHT, sino="filtered", lift=lift)]


add("fdk", lambda s, d: recon.fdk(s, CONE, V3, sino3(s, d)), q.query(fdk_sql(q.CONE_ANGLES), "z r c", "v", BACK3, 3), 3)
add("fdk_short", lambda s, d: recon.fdk(s, CONE_SHORT, V3, sino3(s, d), short=True), q.query(fdk_sql(q.CONE_SHORT_ANGLES, f"({q.parker(q.CONE_SHORT_ANGLES, 8, 1.1, 40.0, 'du')})"), "z r c", "v", BACK3, 3), 3)
add("fdk_vec_lifted", lambda s, d: recon.fdk(s, CONE_UP, V3, sino3(s, d)), q.query(fdk_sql(q.CONE_ANGLES, lift=0.9), "z r c", "v", BACK3, 3), 3)

_G3 = f"grid3 AS (SELECT z, r, c FROM {q.upto(N3, 'z')} x, {q.upto(N3, 'r')} y, {q.upto(N3, 'c')} t)"
_F3 = "(SELECT dv, a, du, sum(w * v) AS f FROM w JOIN {} USING (z, r, c) GROUP BY ALL)"


def sirt3d_sql(iterations: int, start: str = "0.0", low: str = "", mask: str = "true") -> list[str]:
    """mask: a condition on z, r, c of the voxels that count."""
    out = [*_W3["cone"], SINO3, _G3, f"x0 AS MATERIALIZED (SELECT z, r, c, CAST({start} AS DOUBLE) AS v FROM grid3)", f"rl AS MATERIALIZED (SELECT dv, a, du, {_INV('sum(w)')} AS s FROM w WHERE {mask} GROUP BY ALL)", f"pw AS MATERIALIZED (SELECT z, r, c, {_INV('sum(w)')} AS s FROM w SEMI JOIN sino USING (dv, a, du) GROUP BY ALL)"]
    for k in range(iterations):
        out.append(f"g{k} AS MATERIALIZED (SELECT dv, a, du, (p - coalesce(f, 0)) * s AS p FROM sino LEFT JOIN {_F3.format(f'x{k}')} USING (dv, a, du) JOIN rl USING (dv, a, du))")
        new = f"v + coalesce(b, 0)" if not low else f"greatest(v + coalesce(b, 0), {low})"
        out.append(f"x{k + 1} AS MATERIALIZED (SELECT z, r, c, CASE WHEN {mask} THEN {new} ELSE v END AS v FROM x{k} LEFT JOIN (SELECT z, r, c, sum(w * p) * any_value(s) AS b FROM w JOIN g{k} USING (dv, a, du) JOIN pw USING (z, r, c) GROUP BY ALL) USING (z, r, c))")
    return out


def cgls3d_sql(iterations: int) -> list[str]:
    back = "SELECT z, r, c, coalesce(b, 0) AS v FROM grid3 LEFT JOIN (SELECT z, r, c, sum(w * p) AS b FROM w JOIN r{} USING (dv, a, du) GROUP BY ALL) USING (z, r, c)"
    out = [*_W3["cone"], SINO3, _G3, "x0 AS MATERIALIZED (SELECT z, r, c, CAST(0 AS DOUBLE) AS v FROM grid3)", "r0 AS (SELECT * FROM sino)", f"p0 AS MATERIALIZED ({back.format(0)})", "c0 AS MATERIALIZED (SELECT sum(v * v) AS g FROM p0)"]
    for k in range(iterations):
        out += [
            f"q{k} AS MATERIALIZED (SELECT dv, a, du, f FROM {_F3.format(f'p{k}')} SEMI JOIN sino USING (dv, a, du))",
            f"al{k} AS MATERIALIZED (SELECT (SELECT g FROM c{k}) / sum(f * f) AS al FROM q{k})",
            f"x{k + 1} AS MATERIALIZED (SELECT z, r, c, x.v + al * p.v AS v FROM x{k} x JOIN p{k} p USING (z, r, c), al{k})",
            f"r{k + 1} AS MATERIALIZED (SELECT dv, a, du, p - al * coalesce(f, 0) AS p FROM r{k} LEFT JOIN q{k} USING (dv, a, du), al{k})",
            f"z{k + 1} AS MATERIALIZED ({back.format(k + 1)})",
            f"c{k + 1} AS MATERIALIZED (SELECT sum(v * v) AS g FROM z{k + 1})",
            f"p{k + 1} AS MATERIALIZED (SELECT z, r, c, z.v + (SELECT g FROM c{k + 1}) / (SELECT g FROM c{k}) * p.v AS v FROM z{k + 1} z JOIN p{k} p USING (z, r, c))",
        ]
    return out


add("sirt3d", lambda s, d: recon.Volume3D(s, CONE, V3, sino3(s, d)).sirt(2), q.query(sirt3d_sql(2), "z r c", "v", "SELECT * FROM x2", 3), 3)
add("cgls3d", lambda s, d: recon.Volume3D(s, CONE, V3, sino3(s, d)).cgls(2), q.query(cgls3d_sql(2), "z r c", "v", "SELECT * FROM x2", 3), 3)
add("sirt3d_masked", lambda s, d: recon.Volume3D(s, CONE, V3, sino3(s, d), low=0.2, start=arrays.filled(s, (N3,) * 3, "vol3d", 0.1), mask=arrays.filled(s, (N3,) * 3, "vol3d", 1.0).where("z > 1 AND c < 5")).sirt(1), q.query(sirt3d_sql(1, "0.1", "0.2", "z > 1 AND c < 5"), "z r c", "v", "SELECT * FROM x1", 3), 3)

V_RIGHT = V.moved(4.0, 0.0)
_WR = [x.replace("turns", "turns2").replace("line", "line2").replace("px", "px2") for x in q.weights(q.parallel(right=4.0), q.HAT, name="w2")]
add("composite_fp", lambda s, d: api.Lake(s).composite_fp([(Projector(s, PAR, V), vol(s, d)), (Projector(s, PAR, V_RIGHT), vol(s, d, OTHER_KEYS))]), q.query([*_W, *_WR, VOL, OTHER], "a d", "p", "SELECT a, d, sum(p) AS p FROM (SELECT a, d, w * v AS p FROM w JOIN vol USING (r, c) UNION ALL SELECT a, d, w * v FROM w2 JOIN other USING (r, c)) GROUP BY ALL"))
add("accumulate_bp", lambda s, d: api.accumulate(vol(s, d), Projector(s, PAR, V).bp(sino(s, d))), q.query([*_W, VOL, SINO], "r c", "v", f"SELECT r, c, sum(v) AS v FROM (SELECT * FROM vol UNION ALL {BP}) GROUP BY ALL"))


def composite_bp(s: SparkSession, d: str) -> DataFrame:
    """Two projections on one grid."""
    lake = api.Lake(s)
    out, first, second = lake.data2d.create("-vol", V), lake.data2d.create("-sino", PAR, sino(s, d)), lake.data2d.create("-sino", FAN, sino(s, d))
    lake.do_composite_bp(None, [out], [first, second])
    return lake.data2d.table(out)


def accumulated(s: SparkSession, d: str, what: str) -> DataFrame:
    """A projection or reconstruction added to what is there, in 3D."""
    lake = api.Lake(s)
    v, p = lake.data3d.create("-vol", V3, vol3(s, d)), lake.data3d.create("-proj3d", CONE, sino3(s, d))
    lake.accumulate_fp(None, v, p) if what == "fp" else lake.accumulate_fdk(v, p)
    return lake.data3d.table(p if what == "fp" else v)


def landweber(s: SparkSession, d: str) -> DataFrame:
    return lake_run(s, d, "LANDWEBER-PLUGIN", {"Relaxation": 0.8}, 2, arrays.filled(s, (N, N), "vol2d"), kernel="linear")


_LW = [*_W, SINO, _G, "x0 AS MATERIALIZED (SELECT r, c, CAST(0 AS DOUBLE) AS v FROM grid)"]
for _i in range(2):
    _LW.append(f"g{_i} AS MATERIALIZED (SELECT a, d, p - coalesce(f, 0) AS p FROM sino LEFT JOIN (SELECT a, d, sum(w * v) AS f FROM w JOIN x{_i} USING (r, c) GROUP BY ALL) USING (a, d))")
    _LW.append(f"x{_i + 1} AS MATERIALIZED (SELECT r, c, v + 0.8 / {VIEWS * DETECTORS} * coalesce(b, 0) AS v FROM x{_i} LEFT JOIN (SELECT r, c, sum(w * p) AS b FROM w JOIN g{_i} USING (a, d) GROUP BY ALL) USING (r, c))")
add("plugin_landweber", landweber, q.query(_LW, "r c", "v", "SELECT * FROM x2"))
add("composite_bp", composite_bp, q.query([SINO, _G, *q.bp_pixel(), *q.bp_pixel(q.FAN_ANGLES, True, out="back2", named="turns2")], "r c", "v", "SELECT r, c, coalesce(back.v, 0) + coalesce(back2.v, 0) AS v FROM grid LEFT JOIN back USING (r, c) LEFT JOIN back2 USING (r, c)"))
add("accumulate_fp", lambda s, d: accumulated(s, d, "fp"), q.query([*_W3["cone"], VOL3, SINO3], "dv a du", "p", f"SELECT dv, a, du, sum(p) AS p FROM (SELECT dv, a, du, p FROM sino UNION ALL {FP3}) GROUP BY ALL"))
add("accumulate_fdk", lambda s, d: accumulated(s, d, "fdk"), q.query([VOL3, *fdk_sql(q.CONE_ANGLES)], "z r c", "v", "SELECT z, r, c, sum(v) AS v FROM (SELECT z, r, c, v FROM vol3 UNION ALL SELECT z, r, c, v FROM back) GROUP BY ALL", 3), 3)
_I2 = "(SELECT avg(cos(2 * (i + 0.5) * pi() / 2000) * exp(10.4 * {} * cos((i + 0.5) * pi() / 2000))) FROM range(2000) x(i))"
add("kaiser_bessel", lambda s, d: s.createDataFrame(list(enumerate(tools.kaiser_bessel([k / 8 for k in range(17)], 10.4, 2.0, 2))), "k int, v double"), q.query([], "k", "v", f"SELECT k, q * q * {_I2.format('q')} / {_I2.format('1')} AS v FROM (SELECT k, sqrt(1 - (k / 16.0) ** 2) AS q FROM {q.upto(17, 'k')})", 6), 6)
add("linspace2", table_of([(k, x) for k, x in enumerate(tools.linspace2(0.0, 2.0, 7))], "k v"), q.query([], "k", "v", f"SELECT k, k * 2 / 7.0 AS v FROM {q.upto(7, 'k')}"))

# Without SQL.
add("poisson_noise", lambda s, d: phantoms.add_noise(sino(s, d), 1000.0, 1))
add("art_random", lambda s, d: recon.ART(Projector(s, PAR, V), sino(s, d), order=tools.ray_order("randomray", VIEWS, DETECTORS, 1)).run(3))
add("dart_loop", lambda s, d: dart.dart(Projector(s, PAR, V), sino(s, d), LEVELS, [0.5, 1.5], 1, 2, 1))


def stream_accumulate(s: SparkSession, d: str) -> DataFrame:
    """The whole table lineitem as a stream of rays, back projected as it comes."""
    from .streaming.accumulate import Accumulator

    table = s.read.parquet(f"{d}/lineitem.parquet")
    rays = s.readStream.schema(table.schema).parquet(f"{d}/lineitem.parquet*").selectExpr(f"CAST(l_orderkey % {VIEWS} AS INT) AS a", f"CAST(l_partkey % {DETECTORS} AS INT) AS d", "l_quantity / 1000e0 AS p")
    sums = Accumulator(Projector(s, PAR, V), shared_folder(s, "accumulated"))
    running = sums.start(rays)
    try:
        running.processAllAvailable()
    finally:
        running.stop()
    return sums.table()


add("stream_accumulate", stream_accumulate, q.query([*_W, SINO], "r c", "v", BP, 3), 3)
