"""Analytic and adjoint properties of projectors, reconstructions, filters and stencils."""

import math

import numpy as np
import pytest

from radonlake.functions import elementwise, filters
from radonlake.operators import geometry as geo
from radonlake.operators import pixel_driven as pd3
from radonlake.operators import stencil, tools
from radonlake.operators.project import Projector
from radonlake.operators.weights import blob_table
from radonlake.plans import dart, recon
from radonlake.sources import arrays, phantoms

V = geo.create_vol_geom(16, 16)
ANGLES = [0.1 + k * math.pi / 12 for k in range(12)]
PAR = geo.create_proj_geom("parallel", 1.0, 24, ANGLES)
FAN = geo.create_proj_geom("fanflat", 1.2, 32, [0.05 + 2 * math.pi * k / 16 for k in range(16)], 60.0, 20.0)
BOX = np.zeros((16, 16))
BOX[5:11, 4:12] = 1.0


@pytest.fixture(scope="module")
def box(spark):
    return arrays.from_array(spark, BOX, "vol2d").cache()


def kernels():
    return [(PAR, k) for k in ("line", "linear", "strip", "distance_driven")] + [(FAN, "line_fanflat"), (FAN, "strip_fanflat"), (geo.geom_postalignment(PAR, 0.4), "line")]


@pytest.mark.parametrize(("g", "kernel"), kernels(), ids=lambda x: x if isinstance(x, str) else x.kind)
def test_rectangle(spark, box, g, kernel):
    """Each projection is near the lengths of the rays in the rectangle, averaged over the detector pixel."""
    got = arrays.to_array(Projector(spark, g, V, kernel).fp(box), g.shape)
    n, want = 40, np.zeros(g.shape)
    for a, view in enumerate(g.views):
        e, corner, u = (np.array(view[i : i + 2]) for i in (0, 2, 4))
        for d in range(g.cols):
            for s in range(n):
                p = corner + (d + (s + 0.5) / n) * u
                ray = p - e if g.diverges else e
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.sort((np.array([[-4.0, 4.0], [-3.0, 3.0]]) - p[:, None]) / ray[:, None], axis=1)
                want[a, d] += max(0.0, t[:, 1].min() - t[:, 0].max()) * np.hypot(*ray) / n
    assert abs(got.sum() / want.sum() - 1) < 0.02
    assert np.abs(got - want).max() < (1.3 if "strip" in kernel or kernel == "distance_driven" else 4.5)


@pytest.mark.parametrize(("g", "kernel"), [*kernels(), (PAR, "blob")], ids=lambda x: x if isinstance(x, str) else x.kind)
def test_adjoint(spark, box, g, kernel):
    p = Projector(spark, g, V, kernel, blob=(1.5, list(blob_table())) if kernel == "blob" else None)
    y = np.random.default_rng(0).random(g.shape)
    x = arrays.to_array(p.fp(box), g.shape)
    back = arrays.to_array(p.bp(arrays.from_array(spark, y, "sino2d")), V.shape)
    assert (x * y).sum() == pytest.approx((back * BOX).sum(), rel=1e-9)


def test_column_sums(spark, box):
    g = geo.create_proj_geom("parallel", 1.0, 16, [0.0])
    for kernel in ("line", "linear", "strip", "distance_driven"):
        assert arrays.to_array(Projector(spark, g, V, kernel).fp(box), g.shape)[0] == pytest.approx(BOX.sum(0), abs=1e-9)


def test_reconstructions_to_one(spark, box):
    p = Projector(spark, PAR, V)
    sino = p.fp(box).cache()
    centre = lambda df: arrays.to_array(df, V.shape)[6:10, 5:11].mean()
    assert centre(recon.fbp(p, sino)) == pytest.approx(1, abs=0.05)
    assert centre(recon.fbp_pixel(spark, PAR, V, sino)) == pytest.approx(1, abs=0.05)
    assert centre(recon.fbp_pixel(spark, FAN, V, Projector(spark, FAN, V, "line_fanflat").fp(box))) == pytest.approx(1, abs=0.05)
    assert centre(recon.CGLS(p, sino).run(6)) == pytest.approx(1, abs=0.05)
    sirt = recon.SIRT(p, sino)
    first = sirt.residual_norm()
    sirt.run(8)
    assert sirt.residual_norm() < first / 5
    sart = recon.SART(p, sino, order=[0, 5, 9, 2, 7, 11, 4, 1, 8, 3, 10, 6])
    sart.run(24)
    assert sart.residual_norm() < first / 5
    p.release()


def test_masks_and_bounds(spark, box):
    p = Projector(spark, PAR, V)
    mask = np.zeros((16, 16))
    mask[4:12, 4:12] = 1
    start = arrays.filled(spark, (16, 16), "vol2d", 0.3)
    found = arrays.to_array(recon.SIRT(p, p.fp(box), start=start, mask=arrays.from_array(spark, mask, "vol2d"), low=0.1, high=0.8).run(2), V.shape)
    assert (found[mask == 0] == 0.3).all() and found.min() >= 0.1 and found[mask > 0].max() <= 0.8
    p.release()
    with pytest.raises(ValueError, match="no masks"):
        recon.EM(p, p.fp(box), mask=start)


def test_empty_inputs(spark, box):
    p = Projector(spark, PAR, V)
    assert p.fp(box.limit(0)).count() == 0 and p.bp(p.fp(box).limit(0)).count() == 0
    assert pd3.bp_pixel(spark, PAR, V, p.fp(box).limit(0)).count() == 0


def test_filters():
    n = filters.size_for(24)
    assert n == 64
    ramp = np.array(filters.spectrum("ram-lak", n))
    assert np.allclose(ramp[1:], 2 * np.arange(1, n // 2 + 1) / n, atol=0.02)
    for name in filters.WINDOWS:
        assert np.isfinite(filters.spectrum(name, n)).all()
    assert filters.bessel_j0(2.404825557695773) == pytest.approx(0, abs=1e-12)
    assert filters.spectrum("hann", n, d=0.5)[-1] == 0.0
    with pytest.raises(ValueError, match="no filter"):
        filters.spectrum("nothing", n)


def test_three_dimensions(spark):
    v = geo.create_vol_geom(8, 8, 8)
    g = geo.create_proj_geom("cone", 1.0, 1.0, 12, 12, [2 * math.pi * k / 16 for k in range(16)], 40.0, 10.0)
    x = np.zeros(v.shape)
    x[2:6, 2:6, 2:6] = 1.0
    volume = arrays.from_array(spark, x, "vol3d")
    sino = pd3.fp_3d(spark, g, v, volume).cache()
    s = arrays.to_array(sino, g.shape)
    y = np.random.default_rng(1).random(g.shape)
    ys = arrays.from_array(spark, y, "sino3d")
    assert (arrays.to_array(pd3.bp_matched_3d(spark, g, v, ys), v.shape) * x).sum() == pytest.approx((s * y).sum(), rel=1e-9)
    assert (arrays.to_array(pd3.bp_voxel(spark, g, v, ys), v.shape) * x).sum() == pytest.approx((s * y).sum(), rel=0.1)
    assert arrays.to_array(recon.fdk(spark, g, v, arrays.from_array(spark, s, "sino3d")), v.shape)[3:5, 3:5, 3:5].mean() == pytest.approx(1, abs=0.05)
    u, w = geo.project_point(g, 0, 0.0, 0.0, 0.0)
    assert (u, w) == pytest.approx((6.0, 6.0))


def test_stencils(spark):
    flat = arrays.from_array(spark, BOX, "vol2d")
    mask = arrays.to_array(stencil.mask(flat, (16, 16), 4), (16, 16))
    want = np.zeros((16, 16))
    for r in range(1, 15):
        for c in range(1, 15):
            want[r, c] = any(BOX[r, c] != BOX[r + i, c + j] for i, j in ((0, 1), (1, 0), (0, -1), (-1, 0)))
    assert (mask == want).all()
    smooth = arrays.to_array(stencil.smooth(flat, (16, 16)), (16, 16))
    assert smooth[5, 4] == pytest.approx(0.7 + 0.3 * 3 / 8) and smooth[0, 0] == 0


def test_elementwise_and_tools(spark):
    o = arrays.from_array(spark, [[1.0, 0.0], [2.0, -1.0]], "vol2d")
    assert arrays.to_array(elementwise.apply("invert", o), (2, 2)).tolist() == [[1, 0], [0.5, 0]]
    assert arrays.to_array(elementwise.data_op(" $1 .* s1", o, s=3), (2, 2)).tolist() == [[3, 0], [6, -3]]
    with pytest.raises(ValueError, match="no data operation"):
        elementwise.data_op("$1 ^ s1", o)
    assert elementwise.clip_circle(o, 2)[1].first()[0] == 0 and elementwise.clip_circle(arrays.from_array(spark, np.ones((4, 4)), "vol2d").where("r > 0"), 4)[1].first()[0] == 4
    assert tools.ray_order("randomray", 2, 2, 1) != tools.ray_order("sequential", 2, 2)
    noisy = phantoms.add_noise(arrays.from_array(spark, [[1.0, 2.0]], "sino2d"), 1e6, 3)
    assert arrays.to_array(noisy, (1, 2))[0] == pytest.approx([1, 2], abs=0.05)
    assert dart.search(lambda x: (x - 0.3) ** 2, 0, 1) == pytest.approx(0.3, abs=1e-3)


@pytest.mark.parametrize("linear", [True, False])
def test_dart_finds_levels(spark, box, linear):
    p = Projector(spark, PAR, V)
    found = arrays.to_array(dart.dart(p, p.fp(box), [0.0, 1.0], [0.5], 1, 6, 2, adapt={"smoothing": [0.1, 0.05]}, linear=linear), V.shape)
    assert set(np.unique(found)) <= {0.0, 1.0} and np.abs(found - BOX).sum() <= 6
    p.release()


def test_search_and_schedule():
    assert dart.schedule({"a": [1.0, 2.0], "b": [5.0]}, 3) == {"a": 2.0, "b": 5.0}
    found = dart.search_all(lambda x, y: (x - 0.3) ** 2 + (y + 1 + x) ** 2, {"x": (0, 1), "y": (-3, 3)}, rounds=12)
    assert found["x"] == pytest.approx(0.3, abs=0.02) and found["y"] == pytest.approx(-1.3, abs=0.02)


def test_settings_in_one_object(spark, box):
    from radonlake.plans.tomography import IterativeTomography

    own = IterativeTomography(spark, PAR, V, "CGLS", inner_circle=False)
    sino = own.project(box).cache()
    assert arrays.to_array(own.reconstruct(sino, 6), V.shape)[6:10, 5:11].mean() == pytest.approx(1, abs=0.05)
    half = arrays.from_array(spark, (np.arange(256).reshape(16, 16) % 16 < 8).astype(float), "vol2d")
    part = arrays.to_array(IterativeTomography(spark, PAR, V, "SIRT", use_minc=True, inner_circle=False).reconstruct_mask(sino, half, 1), V.shape)
    assert (part[:, 8:] == 0).all() and part.min() >= 0 < part[:, :8].sum()
    fine = IterativeTomography(spark, PAR, superresolution=2, image_size=(16, 16))
    assert fine.v.shape == (32, 32) and fine.v.window == V.window
    twice = arrays.from_array(spark, np.kron(BOX, np.ones((2, 2))), "vol2d")
    got, want = arrays.to_array(fine.project(twice), PAR.shape), arrays.to_array(sino, PAR.shape)
    assert got.sum() == pytest.approx(want.sum(), rel=0.05)
    assert arrays.to_array(fine.reconstruct(sino, 1), (32, 32))[0, 0] == 0
    with pytest.raises(ValueError, match="no method"):
        IterativeTomography(spark, PAR, V, "FBP")


@pytest.mark.parametrize("kernel", ["line", "linear", "strip", "distance_driven"])
def test_dense_blocks_agree(spark, box, kernel):
    from radonlake.plans import dense

    p = Projector(spark, PAR, V, kernel)
    sino = p.fp(box).cache()
    sweep = dense.Sweep(spark, PAR, V, kernel)
    assert arrays.to_array(sweep.pass_over(BOX, "project"), PAR.shape) == pytest.approx(arrays.to_array(sino, PAR.shape), abs=1e-9)
    if kernel == "strip":
        full = p.rays().join(sino, ["a", "d"], "left").fillna(0.0)
        a, b = dense.sirt(spark, PAR, V, kernel, full, 3), recon.SIRT(p, full).run(3)
        assert arrays.to_array(a, V.shape) == pytest.approx(arrays.to_array(b, V.shape), abs=1e-9)
        p.release()


def test_dense_and_joins_on_a_sparse_sinogram(spark, box):
    """A third of the rays and one view absent, one value null: both ways leave those rays out, and give the same."""
    from radonlake.plans import dense

    for kernel in ("strip", "linear"):
        p = Projector(spark, PAR, V, kernel)
        rays = arrays.from_array(spark, arrays.to_array(p.fp(box), PAR.shape), "sino2d")
        sparse = rays.where("(a * 24 + d) % 3 <> 1 AND a <> 4").selectExpr("a", "d", "CASE WHEN a = 2 AND d = 12 THEN NULL ELSE p END AS p").cache()
        a = arrays.to_array(dense.sirt(spark, PAR, V, kernel, sparse, 3), V.shape)
        joined = recon.SIRT(p, sparse.where("p IS NOT NULL"))
        assert a == pytest.approx(arrays.to_array(joined.run(3), V.shape), abs=1e-9)
        joined.release()
        assert p._held is None


@pytest.mark.parametrize("angles", [[0.3, 1.2, 2.9], [0.0], [math.pi / 2, math.pi, 4.0]])
def test_strips_without_weights(angles):
    """Sums by shared edges are those of the weights, both ways, also for rays along an axis and pixels that aren't square."""
    from radonlake.plans import dense

    v = geo.create_vol_geom(9, 14, -7, 7, -6, 7.5)
    g = geo.create_proj_geom("parallel", 0.8, 31, angles)
    r = np.random.default_rng(1)
    image, ray = r.random((9, 14)), r.random(31)
    for view in g.views:
        own, slow = dense.Strips(view, v, 31), dense.Weighted(view, v, 31, "strip")
        assert own.forward(image) == pytest.approx(slow.forward(image), abs=1e-9)
        assert np.ravel(own.back(ray)) == pytest.approx(np.ravel(slow.back(ray)), abs=1e-9)


def test_short_scans_to_one(spark, box):
    """The scale of short scans: a box of ones comes out at one, in a fan and in a cone, whichever way the scan turns."""
    half = math.atan(1.2 * 16 / 80)
    for sign in (1, -1):
        turn = math.pi + 2 * half + 0.1
        g = geo.create_proj_geom("fanflat", 1.2, 32, [0.4 + sign * turn * k / 40 for k in range(40)], 60.0, 20.0)
        sino = Projector(spark, g, V, "line_fanflat").fp(box)
        assert arrays.to_array(recon.fbp_pixel(spark, g, V, sino, short=True), V.shape)[6:10, 5:11].mean() == pytest.approx(1, abs=0.05)
    v = geo.create_vol_geom(8, 8, 8)
    x = np.zeros(v.shape)
    x[2:6, 2:6, 2:6] = 1.0
    turn = math.pi + 2 * math.atan(6 / 50) + 0.1
    g = geo.create_proj_geom("cone", 1.0, 1.0, 12, 12, [turn * k / 24 for k in range(24)], 40.0, 10.0)
    for one in (g, geo.geom_postalignment(g, (0.0, 1.0))):
        sino = pd3.fp_3d(spark, one, v, arrays.from_array(spark, x, "vol3d"))
        found = arrays.to_array(recon.fdk(spark, one, v, arrays.from_array(spark, arrays.to_array(sino, one.shape), "sino3d"), short=True), v.shape)
        assert found[3:5, 3:5, 3:5].mean() == pytest.approx(1, abs=0.05)


def test_blob_weights_one_by_one(spark):
    """Oblique views and pixels that aren't square, against a loop over the pixels of each row or column that a ray walks over."""
    size, table = 1.5, list(blob_table())
    v, g = geo.create_vol_geom(5, 7, -7, 7, -4, 4), geo.create_proj_geom("parallel", 1.7, 9, [0.3, 1.1, 2.2])
    px, py = v.pixel
    want = {}
    for a, (ex, ey, dx, dy, ux, uy) in enumerate(g.views):
        for d in range(9):
            x, y, norm = dx + (d + 0.5) * ux, dy + (d + 0.5) * uy, math.hypot(ex, ey)
            steep = abs(ex) < abs(ey)
            for k in range(5 if steep else 7):
                if steep:
                    t, scale, n = (x + (4 - py / 2 - k * py - y) * ex / ey + 7 - px / 2) / px, py * abs(ey) / (size * norm), 7
                else:
                    t, scale, n = (4 - py / 2 - y - (-7 + px / 2 + k * px - x) * ey / ex) / py, px * abs(ex) / (size * norm), 5
                for q in range(max(0, int(t - 0.5 - size)), min(n - 1, int(t + 0.5 + size)) + 1):
                    want[a, d, *((k, q) if steep else (q, k))] = table[min(19, int(abs(t - q) * scale * 20 + 0.5))]
    got = {(x.a, x.d, x.r, x.c): x.w for x in Projector(spark, g, v, "blob", blob=(size, table)).matrix().collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_noise_is_poisson():
    keys = [np.arange(200_000), np.arange(200_000) % 7]
    for mean in (0.3, 4.0, 60.0, 250.0, 1e5):
        n = phantoms.poisson(np.full(200_000, mean), keys, 5)
        assert n.mean() == pytest.approx(mean, rel=0.02, abs=0.01) and n.var() == pytest.approx(mean, rel=0.03)
        assert (n == phantoms.poisson(np.full(200_000, mean), keys, 5)).all() and (n != phantoms.poisson(np.full(200_000, mean), keys, 6)).any()


def test_tools():
    assert tools.linspace2(1.0, 3.0, 4) == [1.0, 1.5, 2.0, 2.5]
    values = tools.kaiser_bessel([0.0, 1.0, 2.0, 2.1], 10.4, 2.0, 2)
    assert values[0] == 1.0 and 0 < values[1] < 0.2 and values[2:] == [0.0, 0.0]
    assert V.moved(3.0, 4.0, absolute=True).moved(1.0, 1.0, absolute=True).window == (-7.0, 9.0, -7.0, 9.0)
    with pytest.raises(ValueError, match="origin"):
        geo.circular_fan(geo.create_proj_geom("fanflat_vec", 8, [[3.0, -40.0, 0.0, 15.0, 1.0, 0.0]]))
    with pytest.raises(ValueError, match="upright"):
        geo.circular_cone(geo.create_proj_geom("cone_vec", 8, 8, [[0, -40, 0, 0, 15, 0, 1, 0, 0.5, 0, 0, 1]]))
