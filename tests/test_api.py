"""Objects, algorithms by configuration, plug-ins, the linear operator, streams, and the driver's contract."""

import math

import numpy as np
import pytest

from radonlake.operators import geometry as geo
from radonlake.operators.project import Projector
from radonlake.plans import api
from radonlake.sources import arrays
from radonlake.streaming.accumulate import accumulate_views

V = geo.create_vol_geom(8)
G = geo.create_proj_geom("parallel", 1.0, 12, [0.1 + k * math.pi / 6 for k in range(6)])
IMAGE = np.arange(64.0).reshape(8, 8) / 64


@pytest.fixture()
def lake(spark):
    return api.Lake(spark)


def test_data(lake):
    k = lake.data2d.create("-vol", V, IMAGE)
    assert (lake.data2d.get(k) == IMAGE).all() and lake.data2d.dimensions(k) == (8, 8)
    lake.data2d.store(k, 2)
    assert (lake.data2d.get(k) == 2).all()
    with pytest.raises(ValueError, match="shape"):
        lake.data2d.store(k, np.zeros((3, 3)))
    with pytest.raises(ValueError, match="shape"):
        lake.data2d.change_geometry(k, geo.create_vol_geom(4))
    lake.data2d.change_geometry(k, V.moved(1, 1))
    with pytest.raises(NotImplementedError):
        lake.data2d.get_single(k)
    lake.data2d.delete(k)
    with pytest.raises(api.LakeError):
        lake.data2d.get(k)
    with pytest.raises(api.LakeError):
        lake.data2d.create("-sino", V)


def test_algorithms(lake):
    p = lake.create_projector("linear", G, V)
    vol, sino, rec = lake.data2d.create("-vol", V, IMAGE), lake.data2d.create("-sino", G), lake.data2d.create("-vol", V)
    lake.run(lake.algorithm({"type": "FP", "ProjectorId": p, "VolumeDataId": vol, "ProjectionDataId": sino}))
    assert lake.data2d.get(sino).sum() == pytest.approx(IMAGE.sum() * 6, rel=0.05)
    for kind in ("SIRT", "CGLS", "FBP", "BP", "SIRT-PLUGIN", "CGLS-PLUGIN", "LANDWEBER-PLUGIN"):
        lake.data2d.store(rec, 0)
        k = lake.algorithm({"type": kind, "ProjectorId": p, "ProjectionDataId": sino, "ReconstructionDataId": rec})
        lake.run(k, 2)
        assert np.abs(lake.data2d.get(rec)).sum() > 0, kind
    k = lake.algorithm({"type": "SIRT", "ProjectorId": p, "ProjectionDataId": sino, "ReconstructionDataId": rec, "option": {"MinConstraint": 0.0}})
    lake.run(k, 1)
    assert lake.get_res_norm(k) > 0 and lake.data2d.get(rec).min() >= 0
    lake.run(lake.algorithm({"type": "DataOperation_CUDA", "Operation": "$1*s1", "DataId": [vol], "Scalar": [2.0]}))
    assert (lake.data2d.get(vol) == IMAGE * 2).all()
    with pytest.raises(api.LakeError, match="no algorithm"):
        lake.algorithm({"type": "NONE"})
    lake.store.get(p).release()


def test_cuda_names_and_masks(lake, spark):
    p = lake.create_projector("linear", G, V)
    half = np.zeros((8, 8))
    half[:, :4] = 1
    rays = np.ones((6, 12))
    rays[::2] = 0
    vol, left, sino, seen, rec = lake.data2d.create("-vol", V, IMAGE), lake.data2d.create("-vol", V, half), lake.data2d.create("-sino", G), lake.data2d.create("-sino", G, rays), lake.data2d.create("-vol", V)

    def done(kind, out=rec, **option):
        lake.run(lake.algorithm({"type": kind, "ProjectorId": p, "VolumeDataId": vol, "ProjectionDataId": sino, "ReconstructionDataId": rec, "option": option}))
        return lake.data2d.get(out)

    whole = done("FP", sino)
    part = done("FP", sino, VolumeMaskId=left, SinogramMaskId=seen)
    assert (part[::2] == 0).all() and 0 < part[1::2].sum() < whole[1::2].sum()
    done("FP", sino)
    s, own = lake.store.get(sino).df, lake.store.get(p)
    for kind, want in (("BP_CUDA", api.pd3.bp_pixel(spark, G, V, s)), ("FBP_CUDA", api.recon.fbp_pixel(spark, G, V, s))):
        image = np.zeros((8, 8))
        for r, c, v in want.select("r", "c", "v").collect():
            image[r, c] = v
        assert done(kind) == pytest.approx(image) and np.abs(done(kind) - done(kind.removesuffix("_CUDA"))).max() > 1e-6
    for kind in ("BP", "BP_CUDA"):
        full, cut = done(kind), done(kind, ReconstructionMaskId=left)
        assert cut == pytest.approx(full * half)
        assert 0 < done(kind, SinogramMaskId=seen).sum() < full.sum()
    lake.data2d.store(rec, IMAGE)
    assert done("CGLS_CUDA") == pytest.approx(IMAGE, abs=1e-6)
    own.release()


def test_plugins(lake):
    class Own(api.Plugin):
        """Doubles."""

        name = "OWN"

        def initialize(self, cfg, factor, offset=0):
            self.done = factor, offset

        def run(self, iterations):
            self.done = None

    lake.plugin.register(Own)
    assert lake.plugin.get_help("OWN") == "Doubles."
    with pytest.raises(api.LakeError, match="factor"):
        lake.plugin.create("OWN", {})
    with pytest.warns(UserWarning, match="more"):
        assert lake.plugin.create("OWN", {"option": {"factor": 2, "more": 1}}).done == (2, 0)


def test_operator(spark):
    op = api.Operator(Projector(spark, G, V))
    y = op * IMAGE
    assert op.shape == (72, 64) and y.shape == (72,)
    ones = np.ones(72)
    assert (op.T * ones) @ IMAGE.ravel() == pytest.approx(y @ ones)
    assert op.reconstruct("FBP", y).shape == (8, 8)


def test_geometry():
    assert geo.create_vol_geom(4, 6, -1, 1, -2, 2).pixel == pytest.approx((2 / 6, 1.0))
    with pytest.raises(ValueError):
        geo.create_vol_geom(0)
    with pytest.raises(ValueError):
        geo.create_proj_geom("round", 1)
    back = geo.create_proj_geom("parallel_vec", 12, geo.geom_2vec(G))
    assert np.allclose(back.views, G.views)
    fan = geo.create_proj_geom("fanflat", 1.5, 12, [0.4], 30.0, 10.0)
    assert geo.fan_parameters(fan.views[0], 12) == pytest.approx((0.4, 1.5, 30.0, 10.0))
    assert geo.parallel_parameters(G.views[2], 12) == pytest.approx((G.angles[2], 1.0, 0.0))


def test_stream(spark, tmp_path):
    p = Projector(spark, G, V)
    sino = arrays.from_array(spark, np.random.default_rng(0).random((6, 12)), "sino2d")
    sino.where("a < 3").write.parquet(str(tmp_path / "in"))
    q = accumulate_views(p, spark.readStream.schema(sino.schema).parquet(str(tmp_path / "in")), "views_test")
    q.processAllAvailable()
    sino.where("a >= 3").write.mode("append").parquet(str(tmp_path / "in"))
    q.processAllAvailable()
    q.stop()
    assert arrays.to_array(spark.table("views_test"), (8, 8)) == pytest.approx(arrays.to_array(p.bp(sino), (8, 8)))


def test_contract():
    import __spark_entry__ as entry

    made, oracles = entry.queries(), entry.oracle_sql()
    assert len(made) > 100 and set(oracles) <= set(made)


def test_options(lake):
    """Unknown options raise; orders, bounds by pixel, supersampling and filters by number are taken."""
    p = lake.create_projector("linear", G, V)
    sino, rec = lake.data2d.create("-sino", G, np.arange(72.0).reshape(6, 12) / 72), lake.data2d.create("-vol", V)
    cfg = lambda kind, **option: {"type": kind, "ProjectorId": p, "ProjectionDataId": sino, "ReconstructionDataId": rec, "option": option}
    for kind, option in (("SIRT", "MinMaskId"), ("FBP", "ShortScan"), ("EM", "SinogramMaskId"), ("BP", "Nothing")):
        with pytest.raises(api.LakeError, match=option):
            lake.algorithm(cfg(kind, **{option: 1}))
    lake.algorithm(cfg("BP", GPUindex=0))
    with pytest.raises(api.LakeError, match="order"):
        lake.algorithm(cfg("SART", ProjectionOrder="backwards"))
    with pytest.raises(api.LakeError, match="list"):
        lake.algorithm(cfg("ART", RayOrder="custom"))
    every = lake.store.get(lake.algorithm(cfg("SART", ProjectionOrder="random"))).own.order
    assert sorted(every) == list(range(6))
    assert lake.store.get(lake.algorithm(cfg("ART", RayOrderList=[0, 3, 5, 1]))).own.order == [(0, 3), (5, 1)]
    low = lake.data2d.create("-vol", V, IMAGE)
    k = lake.algorithm(cfg("SIRT_CUDA", MinMaskId=low, MaxMaskId=low))
    lake.run(k, 1)
    assert lake.data2d.get(rec) == pytest.approx(IMAGE)
    with pytest.raises(api.LakeError, match="FilterSinogramId"):
        lake.run(lake.algorithm(cfg("FBP", FilterType="projection")))
    lake.store.get(p).release()


@pytest.mark.parametrize("kind", ["parallel", "parallel_vec", "fanflat", "fanflat_vec"])
def test_cuda_names_on_all_geometries(lake, kind):
    flat = geo.create_proj_geom("fanflat", 1.5, 12, [0.1 + k * math.pi / 3 for k in range(6)], 30.0, 10.0) if "fan" in kind else G
    g = geo.create_proj_geom(kind, 12, geo.geom_2vec(flat)) if "vec" in kind else flat
    vol, sino, rec = lake.data2d.create("-vol", V, IMAGE), lake.data2d.create("-sino", g), lake.data2d.create("-vol", V)
    cfg = lambda name: {"type": name, "VolumeDataId": vol, "ProjectionDataId": sino, "ReconstructionDataId": rec}
    lake.run(lake.algorithm(cfg("FP_CUDA")))
    for name in ("BP_CUDA", "FBP_CUDA", "SIRT_CUDA", "SART_CUDA", "CGLS_CUDA", "EM_CUDA"):
        lake.data2d.store(rec, 0)
        k = lake.algorithm(cfg(name))
        lake.run(k, 1)
        assert np.abs(lake.data2d.get(rec)).sum() > 0, name
        lake.store.get(k).release()


def test_three_dimensions_by_configuration(lake):
    v = geo.create_vol_geom(4, 4, 4)
    g = geo.create_proj_geom("cone", 1.0, 1.0, 6, 6, [0.1 + k * math.pi / 2 for k in range(4)], 30.0, 10.0)
    x = np.zeros(v.shape)
    x[1:3, 1:3, 1:3] = 1
    vol, sino, rec = lake.data3d.create("-vol", v, x), lake.data3d.create("-proj3d", g), lake.data3d.create("-vol", v)
    cfg = lambda name, **option: {"type": name, "VolumeDataId": vol, "ProjectionDataId": sino, "ReconstructionDataId": rec, "option": option}
    lake.run(lake.algorithm(cfg("FP3D_CUDA", DetectorSuperSampling=2)))
    assert lake.data3d.get(sino).sum() > 0 and lake.data3d.dimensions(sino) == (6, 4, 6)
    mask = np.zeros(v.shape)
    mask[:, :2] = 1
    seen = lake.data3d.create("-vol", v, mask)
    for name, option in (("BP3D_CUDA", {"VoxelSuperSampling": 2}), ("FDK_CUDA", {"FilterType": "hann"}), ("SIRT3D_CUDA", {"ReconstructionMaskId": seen}), ("CGLS3D_CUDA", {"ReconstructionMaskId": seen})):
        own = cfg(name, **option) | ({"VolumeDataId": rec} if name in ("BP3D_CUDA", "FDK_CUDA") else {})
        lake.data3d.store(rec, 0.0)
        k = lake.algorithm(own)
        lake.run(k, 1)
        found = lake.data3d.get(rec)
        assert np.abs(found).sum() > 0, name
        if "ReconstructionMaskId" in option:
            assert (found[mask == 0] == 0).all() and lake.get_res_norm(k) > 0
    p = lake.create_projector("2d_weighting", g, v)
    y = lake.direct_fp(p, x)
    assert y.shape == g.shape and lake.direct_bp(p, y).shape == v.shape
    op = api.Operator(lake.store.get(lake.create_projector("matched_bp", g, v)))
    z = np.random.default_rng(0).random(op.shape[0])
    assert (op * x) @ z == pytest.approx(x.ravel() @ (op.T * z))
    with pytest.raises(ValueError, match="no kernel"):
        lake.create_projector("square", g, v)


def test_other_interfaces(lake, spark, tmp_path):
    k = lake.matrix.create_csr([0, 2, 2, 3], [0, 2, 1], [1.0, 2.0, 3.0], (3, 3))
    assert [x.tolist() for x in lake.matrix.get_csr(k)] == [[0, 2, 2, 3], [0, 2, 1], [1.0, 2.0, 3.0]]
    assert lake.matrix.info() == [(k, "matrix")]
    lake.matrix.delete(k)
    assert lake.matrix.info() == []
    k = lake.call("data2d", "create", "-vol", V, 2.0)
    assert (lake.call("data2d", "get", k) == 2).all()
    with pytest.raises(api.LakeError, match="nothing"):
        lake.call("data2d", "nothing")
    assert (lake.data2d.get(lake.data2d.link("-vol", V, IMAGE)) == IMAGE).all()
    with pytest.raises(api.LakeError, match="array"):
        lake.data2d.link("-vol", V, 1.0)
    cfg = {"type": "SIRT", "ProjectorId": 3, "option": {"MinConstraint": 0.5, "ProjectionOrderList": [2, 0, 1], "ShortScan": True, "FilterType": "hann"}}
    assert api.from_xml(api.to_xml(cfg)) == cfg
    for name in ("a.xml", "a.json"):
        api.save_config(cfg, str(tmp_path / name))
        assert api.load_config(str(tmp_path / name)) == cfg
    says = api.Logging()
    says.set_output_file(str(tmp_path / "log"), "warn")
    says.set_format("[%(message)s]")
    says.info("quiet")
    says.warn("loud")
    says.disable()
    says.error("unheard")
    says.enable()
    says.disable_file()
    assert (tmp_path / "log").read_text() == "[loud]\n"
    assert api.self_test(spark) < 1e-6 and not api.use_cuda() and api.has_feature("spark") and "GPU" in api.get_gpu_info() and api.credits()


def test_accumulator(spark, tmp_path):
    from radonlake.streaming.accumulate import Accumulator

    p = Projector(spark, G, V)
    sino = arrays.from_array(spark, np.random.default_rng(0).random((6, 12)), "sino2d")
    sums = Accumulator(p, str(tmp_path / "sums"))
    sums.FOLD = 2
    assert sums.table().count() == 0
    for k in range(5):
        for _ in range(2):  # each batch comes twice, as after a failure
            sums.add(sino.where(f"a = {k}" if k < 4 else "a >= 4"), k)
    assert arrays.to_array(sums.table(), (8, 8)) == pytest.approx(arrays.to_array(p.bp(sino), (8, 8)))
