"""The object interface: data, projectors and algorithms by number, made from dictionaries; a linear operator; plug-ins."""

from __future__ import annotations

import contextlib
import inspect
import itertools
import json
import logging
import random
import warnings
from xml.etree import ElementTree

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import elementwise, filters
from ..operators import pixel_driven as pd3
from ..operators import stencil
from ..operators.geometry import Projection, Volume, create_proj_geom, create_vol_geom
from ..operators.project import PixelProjector, Projector, Projector3D, masked
from ..sources import arrays
from . import recon

log = logging.getLogger("radonlake")


class LakeError(Exception):
    """A wrong configuration or number of an object."""


class Store:
    """Numbered objects of a session: data (geometry, table), projectors, matrices, algorithms."""

    def __init__(self, spark: SparkSession):
        self.spark, self._next, self.objects = spark, itertools.count(1), {}

    def put(self, kind: str, value) -> int:
        self.objects[k := next(self._next)] = (kind, value)
        return k

    def get(self, k: int, kind: str | None = None):
        if k not in self.objects or (kind and self.objects[k][0] != kind):
            raise LakeError(f"there is no {kind or 'object'} {k}")
        return self.objects[k][1]

    def delete(self, ids) -> None:
        for k in [ids] if isinstance(ids, int) else ids:
            self.get(k)
            del self.objects[k]

    def clear(self) -> None:
        self.objects.clear()

    def info(self) -> list[tuple[int, str]]:
        return [(k, kind) for k, (kind, _) in sorted(self.objects.items())]


class Data:
    """A table with its geometry."""

    def __init__(self, geometry, df: DataFrame):
        self.geometry, self.df = geometry, df

    @property
    def kind(self) -> str:
        flat = (self.geometry.slices if isinstance(self.geometry, Volume) else self.geometry.rows) == 0
        return ("vol" if isinstance(self.geometry, Volume) else "sino") + ("2d" if flat else "3d")


class DataModule:
    """create, store, get, get_shared, get_single, get_geometry, change_geometry, dimensions, delete, clear, info of 2D and 3D data."""

    def __init__(self, store: Store):
        self._s = store

    def create(self, datatype: str, geometry, data=None) -> int:
        if datatype not in ("-vol", "-sino", "-proj3d") or isinstance(geometry, Volume) != (datatype == "-vol"):
            raise LakeError(f"{datatype} doesn't go with this geometry")
        k = self._s.put("data", Data(geometry, None))
        self.store(k, 0.0 if data is None else data)
        return k

    def link(self, datatype: str, geometry, data) -> int:
        """As create from an array of the geometry's shape; tables have no memory to share, so that later changes of the array don't show."""
        if not isinstance(data, np.ndarray):
            raise LakeError("only an array can be linked")
        return self.create(datatype, geometry, data)

    def store(self, k: int, data) -> None:
        own = self._s.get(k, "data")
        if isinstance(data, DataFrame):
            own.df = data
        elif np.isscalar(data):
            own.df = arrays.filled(self._s.spark, own.geometry.shape, own.kind, float(data))
        else:
            data = np.from_dlpack(data) if hasattr(data, "__dlpack__") and not isinstance(data, np.ndarray) else np.asarray(data)
            if data.shape != own.geometry.shape:
                raise ValueError(f"the data's shape {data.shape} isn't the geometry's {own.geometry.shape}")
            own.df = arrays.from_array(self._s.spark, data, own.kind)

    def table(self, k: int) -> DataFrame:
        return self._s.get(k, "data").df

    def get(self, k: int) -> np.ndarray:
        own = self._s.get(k, "data")
        return arrays.to_array(own.df, own.geometry.shape)

    get_shared = get

    def get_single(self, k: int):
        raise NotImplementedError("values are stored as doubles only")

    def get_geometry(self, k: int):
        return self._s.get(k, "data").geometry

    def change_geometry(self, k: int, geometry) -> None:
        own = self._s.get(k, "data")
        if geometry.shape != own.geometry.shape:
            raise ValueError("the new geometry has another shape")
        own.geometry = geometry

    def dimensions(self, k: int) -> tuple[int, ...]:
        return self._s.get(k, "data").geometry.shape

    def delete(self, ids) -> None:
        self._s.delete(ids)

    def clear(self) -> None:
        self._s.delete([k for k, kind in self._s.info() if kind == "data"])

    def info(self) -> list[tuple[int, str]]:
        return [x for x in self._s.info() if x[1] == "data"]


class MatrixModule:
    """create, create_csr, store, get, get_csr, get_size, delete, clear, info of sparse matrices as (row, col, val)."""

    def __init__(self, store: Store):
        self._s = store

    def create(self, df: DataFrame, size: tuple[int, int]) -> int:
        return self._s.put("matrix", [df, tuple(size)])

    def store(self, k: int, df: DataFrame) -> None:
        self._s.get(k, "matrix")[0] = df

    def get(self, k: int) -> DataFrame:
        return self._s.get(k, "matrix")[0]

    def get_size(self, k: int) -> tuple[int, int]:
        return self._s.get(k, "matrix")[1]

    def create_csr(self, starts, columns, data, size: tuple[int, int]) -> int:
        """From compressed rows: where each row starts, and columns and values of all."""
        rows = np.repeat(np.arange(size[0]), np.diff(starts))
        return self.create(self._s.spark.createDataFrame(list(zip(rows.tolist(), np.asarray(columns).tolist(), np.asarray(data, float).tolist(), strict=True)), "row int, col int, val double"), size)

    def get_csr(self, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, columns, data) on the driver, for matrices that fit there."""
        pdf = self.get(k).orderBy("row", "col").toPandas()
        return np.concatenate(([0], np.cumsum(np.bincount(pdf.row, minlength=self.get_size(k)[0])))), pdf.col.to_numpy(), pdf.val.to_numpy()

    def delete(self, ids) -> None:
        self._s.delete(ids)

    def clear(self) -> None:
        self._s.delete([k for k, kind in self._s.info() if kind == "matrix"])

    def info(self) -> list[tuple[int, str]]:
        return [x for x in self._s.info() if x[1] == "matrix"]


class Plugin:
    """Base of user algorithms: initialize's parameters are the options by name, those with defaults are optional; run(its) does the work."""

    name = ""

    def initialize(self, cfg: dict, **options) -> None:
        raise NotImplementedError

    def run(self, iterations: int) -> None:
        raise NotImplementedError

    def release(self) -> None:
        """Lets go of what a method held."""
        if hasattr(own := getattr(self, "own", None), "release"):
            own.release()


class SIRTPlugin(Plugin):
    """Simultaneous iterations as a plug-in."""

    name = "SIRT-PLUGIN"

    def initialize(self, cfg: dict, Relaxation: float = 1.0, MinConstraint=None, MaxConstraint=None) -> None:  # noqa: N803
        s = cfg["store"]
        self.out = s.get(cfg["ReconstructionDataId"], "data")
        self.own = recon.SIRT(s.get(cfg["ProjectorId"], "projector"), s.get(cfg["ProjectionDataId"], "data").df, start=self.out.df, relaxation=Relaxation, low=MinConstraint, high=MaxConstraint)

    def run(self, iterations: int) -> None:
        self.out.df = self.own.run(iterations)


class CGLSPlugin(Plugin):
    """Conjugate gradients as a plug-in."""

    name = "CGLS-PLUGIN"

    def initialize(self, cfg: dict) -> None:
        s = cfg["store"]
        self.out = s.get(cfg["ReconstructionDataId"], "data")
        self.own = recon.CGLS(s.get(cfg["ProjectorId"], "projector"), s.get(cfg["ProjectionDataId"], "data").df, start=self.out.df, restart=True)

    def run(self, iterations: int) -> None:
        self.out.df = self.own.run(iterations)


class LandweberPlugin(Plugin):
    """v -= relaxation W'(W v - s) / size of s."""

    name = "LANDWEBER-PLUGIN"

    def initialize(self, cfg: dict, Relaxation: float = 1.0) -> None:  # noqa: N803
        s = cfg["store"]
        self.out, self.projector, self.sino, self.relaxation = s.get(cfg["ReconstructionDataId"], "data"), s.get(cfg["ProjectorId"], "projector"), s.get(cfg["ProjectionDataId"], "data").df, Relaxation

    def run(self, iterations: int) -> None:
        g = self.projector.g
        for _ in range(iterations):
            self.out.df = landweber_step(self.projector, self.sino, self.out.df, self.relaxation / (len(g.views) * g.cols))


def landweber_step(projector: Projector, sino: DataFrame, volume: DataFrame, step: float) -> DataFrame:
    back = projector.bp(projector.residual(sino, volume)).withColumnRenamed("v", "x")
    return recon.cut(volume.join(back, ["r", "c"], "left").select("r", "c", (F.col("v") + step * F.coalesce("x", F.lit(0.0))).alias("v")))


class Plugins:
    """Registry of plug-ins by name."""

    def __init__(self):
        self.known: dict[str, type[Plugin]] = {}
        for x in (SIRTPlugin, CGLSPlugin, LandweberPlugin):
            self.register(x)

    def register(self, cls: type[Plugin], name: str | None = None) -> None:
        self.known[name or cls.name] = cls

    def get_registered(self) -> dict[str, type[Plugin]]:
        return dict(self.known)

    def get_help(self, name: str) -> str:
        return inspect.getdoc(self.known[name]) or ""

    def create(self, name: str, cfg: dict) -> Plugin:
        own = self.known[name]()
        options, wanted = cfg.get("option", {}), inspect.signature(own.initialize).parameters
        names = [x for x in wanted if x != "cfg"]
        if missing := [x for x in names if wanted[x].default is inspect.Parameter.empty and x not in options]:
            raise LakeError(f"{name} needs {', '.join(missing)}")
        for x in options:
            if x not in names:
                warnings.warn(f"{name} doesn't know the option {x}", stacklevel=2)
        own.initialize(cfg, **{k: v for k, v in options.items() if k in names})
        return own


ITERATIVE = {"SIRT": recon.SIRT, "SART": recon.SART, "ART": recon.ART, "CGLS": recon.CGLS, "EM": recon.EM}


class Lake:
    """A session's objects and what can be done with them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.store = spark, Store(spark)
        self.data2d = self.data3d = DataModule(self.store)
        self.matrix, self.plugin = MatrixModule(self.store), Plugins()

    def create_projector(self, kernel: str, g: Projection, v: Volume, **options) -> int:
        """2D: a kernel of weights, or cuda, whose back projection is by pixels. 3D: cuda3d, with the option kernel, or one of its kernels by name."""
        if g.rows:
            return self.store.put("projector", Projector3D(self.spark, g, v, **({"kernel": kernel} if kernel != "cuda3d" else {}) | options))
        if kernel == "cuda":
            return self.store.put("projector", PixelProjector(self.spark, g, v, **options))
        return self.store.put("projector", Projector(self.spark, g, v, kernel, **options))

    def _table(self, data, geometry) -> DataFrame:
        """A table, an object's table by its number, or an array as a table."""
        if isinstance(data, DataFrame):
            return data
        return self.data2d.table(data) if isinstance(data, int) else arrays.from_array(self.spark, data, Data(geometry, None).kind)

    def create_sino(self, data, projector: int, mask: DataFrame | None = None) -> tuple[int, DataFrame]:
        p = self.store.get(projector, "projector")
        volume = self._table(data, p.v)
        out = whole(p.rays(), p.fp(volume, mask=mask) if mask is not None else p.fp(volume))
        return self.store.put("data", Data(p.g, out)), out

    def create_backprojection(self, data, projector: int) -> tuple[int, DataFrame]:
        p = self.store.get(projector, "projector")
        out = whole(p.pixels(), p.bp(self._table(data, p.g)))
        return self.store.put("data", Data(p.v, out)), out

    def create_sino3d(self, volume, g: Projection, v: Volume) -> DataFrame:
        return pd3.fp_3d(self.spark, g, v, self._table(volume, v))

    def create_backprojection3d(self, sino, g: Projection, v: Volume) -> DataFrame:
        return pd3.bp_voxel(self.spark, g, v, self._table(sino, g))

    def create_reconstruction(self, kind: str, projector: int, sino, iterations: int = 1, **options) -> DataFrame:
        """The result of an algorithm by name. options: those of its configuration (MinConstraint, FilterType ...), and start, mask, ray_mask, order as tables and lists."""
        p = self.store.get(projector, "projector")
        named = {"filter": "FilterType", "low": "MinConstraint", "high": "MaxConstraint", "relaxation": "Relaxation", "mask": "ReconstructionMaskId", "ray_mask": "SinogramMaskId"}
        option = {named.get(k, k): v for k, v in options.items() if k not in ("start", "order")}
        made = [s := self.store.put("data", Data(p.g, self._table(sino, p.g))), out := self.store.put("data", Data(p.v, None))]
        start = options.get("start")
        self.data2d.store(out, start if start is not None else 0.0)
        for k in ("ReconstructionMaskId", "SinogramMaskId"):
            if isinstance(option.get(k), DataFrame):
                made.append(self.store.put("data", Data(p.v if k[0] == "R" else p.g, option[k])))
                option[k] = made[-1]
        if "order" in options:
            option |= {"RayOrder": "custom", "RayOrderList": options["order"]} if kind == "ART" else {"ProjectionOrder": "custom", "ProjectionOrderList": options["order"]}
        if start is not None and kind.startswith("EM"):
            option["start"] = True
        made.append(k := self.algorithm({"type": kind, "ProjectorId": projector, "ProjectionDataId": s, "ReconstructionDataId": out, "VolumeDataId": out, "option": option}))
        try:
            self.run(k, iterations)
            return self.data2d.table(out)
        finally:
            self.store.get(k).release()
            self.store.delete(made)

    def algorithm(self, cfg: dict) -> int:
        return self.store.put("algorithm", Algorithm(self, cfg))

    def run(self, k: int, iterations: int = 1) -> None:
        self.store.get(k, "algorithm").run(iterations)

    def get_res_norm(self, k: int) -> float:
        return self.store.get(k, "algorithm").own.residual_norm()

    def projector_of(self, projector: int | None, g: Projection, v: Volume):
        """A projector's like for these geometries; without one that of the 3D or pixel-driven default."""
        p = self.store.get(projector, "projector") if projector is not None else None
        if g.rows:
            return Projector3D(self.spark, g, v, *((p.kernel, p.subrays, p.subvoxels) if p else ()))
        if p is None or isinstance(p, PixelProjector):
            return PixelProjector(self.spark, g, v, *((p.subrays, p.subpixels) if p else ()))
        return Projector(self.spark, g, v, p.kernel, p.subrays, p.blob)

    def direct_fp(self, projector: int, volume):
        """The projections of a table as a table, or of an array as an array, without objects."""
        p = self.store.get(projector, "projector")
        out = whole(p.rays(), p.fp(self._table(volume, p.v)))
        return out if isinstance(volume, DataFrame) else arrays.to_array(out, p.g.shape)

    def direct_bp(self, projector: int, sino):
        """The back projection of a table as a table, or of an array as an array, without objects."""
        p = self.store.get(projector, "projector")
        out = whole(p.pixels(), p.bp(self._table(sino, p.g)))
        return out if isinstance(sino, DataFrame) else arrays.to_array(out, p.v.shape)

    def do_composite_fp(self, projector: int | None, volumes: list[int], sinos: list[int]) -> None:
        """Each projection object becomes the sum of all volumes' projections on its detector, as one aggregation."""
        vols = [self.store.get(k, "data") for k in volumes]
        for k in sinos:
            out = self.store.get(k, "data")
            parts = [self.projector_of(projector, out.geometry, v.geometry).fp(v.df) for v in vols]
            out.df = recon.cut(summed(parts, arrays.filled(self.spark, out.geometry.shape, out.kind)))

    def do_composite_bp(self, projector: int | None, volumes: list[int], sinos: list[int]) -> None:
        """Each volume object becomes the sum of all projections' back projections in its grid, as one aggregation."""
        data = [self.store.get(k, "data") for k in sinos]
        for k in volumes:
            out = self.store.get(k, "data")
            parts = [self.projector_of(projector, x.geometry, out.geometry).bp(x.df) for x in data]
            out.df = recon.cut(summed(parts, arrays.filled(self.spark, out.geometry.shape, out.kind)))

    def accumulate_fp(self, projector: int | None, volume: int, sino: int) -> None:
        """Adds a volume's projections to a projection object."""
        v, out = self.store.get(volume, "data"), self.store.get(sino, "data")
        out.df = recon.cut(summed([self.projector_of(projector, out.geometry, v.geometry).fp(v.df)], out.df))

    def accumulate_bp(self, projector: int | None, volume: int, sino: int) -> None:
        """Adds a back projection to a volume object."""
        out, x = self.store.get(volume, "data"), self.store.get(sino, "data")
        out.df = recon.cut(summed([self.projector_of(projector, x.geometry, out.geometry).bp(x.df)], out.df))

    def accumulate_fdk(self, volume: int, sino: int) -> None:
        """Adds a cone-beam reconstruction with the plain ramp to a volume object."""
        out, x = self.store.get(volume, "data"), self.store.get(sino, "data")
        out.df = recon.cut(summed([recon.fdk(self.spark, x.geometry, out.geometry, x.df)], out.df))

    def composite_fp(self, parts: list[tuple[Projector, DataFrame]]) -> DataFrame:
        """The sum of several volumes' projections on one detector, as one aggregation."""
        out = None
        for p, volume in parts:
            one = p.matrix().join(volume, ["r", "c"]).select("a", "d", (F.col("w") * F.col("v")).alias("p"))
            out = one if out is None else out.unionByName(one)
        return out.groupBy("a", "d").agg(F.sum("p").alias("p"))

    def call(self, module: str, command: str, *args):
        """A module's function by names, as one entry point for all: data2d, data3d, matrix, plugin, algorithm, projector, lake."""
        if command.startswith("_"):
            raise LakeError(f"there is no {module} {command}")
        aliases = {"algorithm": {"create": self.algorithm, "iterate": self.run, "run": self.run, "get_res_norm": self.get_res_norm, "delete": self.store.delete, "info": self.store.info}, "projector": {"create": self.create_projector, "get": lambda k: self.store.get(k, "projector"), "delete": self.store.delete, "info": self.store.info}}
        if module in aliases:
            found = aliases[module].get(command)
        else:
            own = {"data2d": self.data2d, "data3d": self.data3d, "matrix": self.matrix, "plugin": self.plugin, "lake": self}.get(module)
            found = getattr(own, command, None)
        if not callable(found):
            raise LakeError(f"there is no {module} {command}")
        return found(*args)

    @contextlib.contextmanager
    def cancellable(self, group: str):
        """Jobs inside belong to a group, which cancel stops."""
        self.spark.sparkContext.setJobGroup(group, group, True)
        try:
            yield
        finally:
            self.spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    def cancel(self, group: str) -> None:
        self.spark.sparkContext.cancelJobGroup(group)


def whole(cells: DataFrame, found: DataFrame) -> DataFrame:
    """found on all cells, 0 where it has none."""
    value = found.columns[-1]
    return cells.join(found, cells.columns, "left").fillna(0.0, [value]).select(*cells.columns, value)


def summed(parts: list[DataFrame], start: DataFrame) -> DataFrame:
    """The sum of tables with the same coordinates, on the cells of start and all others that a part has."""
    for x in parts:
        start = start.unionByName(x.select(*start.columns))
    value = start.columns[-1]
    return start.groupBy(*start.columns[:-1]).agg(F.sum(value).alias(value))


def accumulate(old: DataFrame, new: DataFrame) -> DataFrame:
    """Adds a result into what was there."""
    value = old.columns[-1]
    keys = [c for c in old.columns if c != value]
    return old.unionByName(new.select(*old.columns)).groupBy(*keys).agg(F.sum(value).alias(value))


_MASKS, _BOUNDS = ("ReconstructionMaskId", "SinogramMaskId"), ("MinConstraint", "MaxConstraint", "UseMinConstraint", "MinConstraintValue", "UseMaxConstraint", "MaxConstraintValue")
_FILTER, _SAMPLING, _SAMPLING3 = ("FilterType", "FilterSinogramId", "FilterParameter", "FilterD"), ("PixelSuperSampling", "DetectorSuperSampling"), ("VoxelSuperSampling", "DetectorSuperSampling")
#: Options of each algorithm. GPUindex, which there is no use for here, is taken by all.
OPTIONS = {
    "FP": ("VolumeMaskId", "SinogramMaskId"), "BP": _MASKS, "FBP": (*_MASKS, *_FILTER), "SIRT": (*_MASKS, *_BOUNDS, "Relaxation", "Lambda"), "SART": (*_MASKS, *_BOUNDS, "Relaxation", "Lambda", "ProjectionOrder", "ProjectionOrderList"),
    "ART": (*_MASKS, *_BOUNDS, "Relaxation", "Lambda", "RayOrder", "RayOrderList"), "CGLS": (*_MASKS, *_BOUNDS), "FP_CUDA": ("VolumeMaskId", "SinogramMaskId", "DetectorSuperSampling"), "BP_CUDA": (*_MASKS, *_SAMPLING), "FBP_CUDA": (*_MASKS, *_FILTER, *_SAMPLING, "ShortScan"),
    "SIRT_CUDA": (*_MASKS, *_BOUNDS, *_SAMPLING, "Relaxation", "Lambda", "MinMaskId", "MaxMaskId"), "SART_CUDA": (*_MASKS, *_BOUNDS, *_SAMPLING, "Relaxation", "Lambda", "ProjectionOrder", "ProjectionOrderList"), "CGLS_CUDA": (*_MASKS, *_BOUNDS, *_SAMPLING), "EM_CUDA": (*_BOUNDS, *_SAMPLING, "start"),
    "FP3D_CUDA": ("DetectorSuperSampling",), "BP3D_CUDA": ("VoxelSuperSampling", "SIRTWeighting"), "FDK_CUDA": ("VoxelSuperSampling", "ShortScan", *_FILTER), "SIRT3D_CUDA": (*_MASKS, *_BOUNDS, *_SAMPLING3, "Relaxation"), "CGLS3D_CUDA": (*_MASKS, *_SAMPLING3),
    "DARTMASK_CUDA": ("Connectivity", "Threshold", "Radius"), "DARTSMOOTHING_CUDA": ("Intensity", "Radius"), "RoiSelect_CUDA": ("Radius",), "DataOperation_CUDA": ("MaskId",),
}
OPTIONS |= {"EM": OPTIONS["EM_CUDA"]} | {f"{k}3D_CUDA": OPTIONS[f"{k}_CUDA"] for k in ("DARTMASK", "DARTSMOOTHING")}
OPTIONS |= {k.removesuffix("_CUDA"): v for k, v in OPTIONS.items() if k.removesuffix("_CUDA") not in OPTIONS}
IGNORED = ("GPUindex", "GPUIndex")


class Algorithm:
    """An algorithm by its configuration: type, object numbers, option. An option that the type doesn't have raises.

    _CUDA names project forward along rays and back by pixels, with the projector's supersampling or that of their options, and need no projector; others
    take the projector's weights both ways.
    """

    def __init__(self, lake: Lake, cfg: dict):
        self.lake, self.cfg, s = lake, cfg, lake.store
        self.option = cfg.get("option", {})
        kind = cfg.get("type", "")
        self.name = kind.removesuffix("_CUDA")
        self.cuda, self.own = kind.endswith("_CUDA"), None
        if kind in lake.plugin.known:
            self.own = lake.plugin.create(kind, cfg | {"store": s})
            return
        if kind not in OPTIONS:
            raise LakeError(f"{kind} is no algorithm")
        if unknown := [x for x in self.option if x not in OPTIONS[kind] and x not in IGNORED]:
            raise LakeError(f"{kind} has no option {', '.join(unknown)}")
        if self.name in ITERATIVE:
            self.own = self.iterative()
        elif self.name in ("SIRT3D", "CGLS3D"):
            start = self.out().df
            more = {"subrays": int(self.option.get("DetectorSuperSampling", 1)), "subvoxels": int(self.option.get("VoxelSuperSampling", 1))}
            low, high = self.limits()
            self.own = recon.Volume3D(lake.spark, self.sino().geometry, self.out().geometry, self.sino().df, matched=self.matched3d(), low=low, high=high, relaxation=self.option.get("Relaxation", 1.0), start=start, mask=self.mask("ReconstructionMaskId"), ray_mask=self.mask("SinogramMaskId"), **more)

    def matched3d(self) -> bool:
        """Whether back projection is the transpose: where there is no projector, or one whose kernel says so."""
        p = self.lake.store.get(self.cfg["ProjectorId"], "projector") if "ProjectorId" in self.cfg else None
        return p is None or p.kernel == "matched_bp"

    def limits(self) -> tuple[float | None, float | None]:
        o, yes = self.option, ("yes", "true", "1", True, 1)
        low = o.get("MinConstraint", o.get("MinConstraintValue", 0.0) if o.get("UseMinConstraint") in yes else None)
        return low, o.get("MaxConstraint", o.get("MaxConstraintValue", 255.0) if o.get("UseMaxConstraint") in yes else None)

    def projector(self, volume: Data | None = None):
        """The projector in 2D: the given one, or for _CUDA names its like by pixels."""
        p = self.lake.store.get(self.cfg["ProjectorId"], "projector") if "ProjectorId" in self.cfg else None
        if not self.cuda:
            if p is None:
                raise LakeError("this algorithm needs a projector")
            return p
        subrays, subpixels = int(self.option.get("DetectorSuperSampling", getattr(p, "subrays", 1))), int(self.option.get("PixelSuperSampling", getattr(p, "subpixels", 1)))
        g, v = (p.g, p.v) if p is not None else (self.sino().geometry, (volume or self.out()).geometry)
        return PixelProjector(self.lake.spark, g, v, subrays, subpixels)

    def order(self, views: int) -> dict:
        """The option order of SART and ART: sequential, random (for SART_CUDA the default) or custom."""
        if self.name == "SART":
            kind = self.option.get("ProjectionOrder", "custom" if "ProjectionOrderList" in self.option else "random" if self.cuda else "sequential")
            found = self.option.get("ProjectionOrderList")
            if kind == "random":
                found = list(range(views))
                random.shuffle(found)
        elif self.name == "ART":
            kind = self.option.get("RayOrder", "custom" if "RayOrderList" in self.option else "sequential")
            found = self.option.get("RayOrderList")
            if found is not None and len(found) and not isinstance(found[0], (tuple, list)):
                found = list(zip(found[::2], found[1::2], strict=True))
        else:
            return {}
        if kind not in ("sequential", "custom", *(["random"] if self.name == "SART" else [])):
            raise LakeError(f"{kind} is no order")
        if kind == "custom" and not found:
            raise LakeError("a custom order needs its list")
        return {} if kind == "sequential" else {"order": [tuple(x) if isinstance(x, list) else x for x in found]}

    def iterative(self):
        p = self.projector()
        low, high = self.limits()
        more = self.order(len(p.g.views)) | ({"restart": True} if self.name == "CGLS" and self.cuda else {})
        start = self.out().df if self.name != "EM" or "start" in self.option else None
        made = recon.PixelSART if self.cuda and self.name == "SART" else ITERATIVE[self.name]
        return made(p, self.sino().df, start=start, mask=self.mask("ReconstructionMaskId"), ray_mask=self.mask("SinogramMaskId"), low=low, high=high, relaxation=self.option.get("Relaxation", self.option.get("Lambda", 1.0)), low_mask=self.mask("MinMaskId"), high_mask=self.mask("MaxMaskId"), **more)

    def release(self) -> None:
        if hasattr(self.own, "release"):
            self.own.release()

    def sino(self) -> Data:
        return self.lake.store.get(self.cfg["ProjectionDataId"], "data")

    def mask(self, option: str) -> DataFrame | None:
        return self.lake.store.get(self.option[option], "data").df if option in self.option else None

    def out(self) -> Data:
        return self.lake.store.get(self.cfg.get("ReconstructionDataId", self.cfg.get("OutDataId", self.cfg.get("MaskDataId", self.cfg.get("DataId", self.cfg.get("VolumeDataId"))))), "data")

    def filtering(self, g: Projection) -> dict:
        """The filter's options, which may also stand beside the others: name, parameter, d, taps."""
        o = {k: self.cfg[k] for k in _FILTER if k in self.cfg} | self.option
        name = str(o.get("FilterType", "ram-lak")).lower()
        if name not in filters.CUSTOM:
            return {"name": name, "parameter": float(o.get("FilterParameter", -1.0)), "d": float(o.get("FilterD", 1.0))}
        if "FilterSinogramId" not in o:
            raise LakeError(f"the filter {name} needs FilterSinogramId")
        own = self.lake.store.get(o["FilterSinogramId"], "data")
        rows = arrays.to_array(own.df, own.geometry.shape)
        many = name.endswith("sinogram")
        if len(rows) != (len(g.views) if many else 1):
            raise LakeError(f"the filter {name} has {len(rows)} rows")
        taps = [filters.taps_of_custom(name, row.tolist(), g.cols) for row in rows]
        return {"taps": dict(enumerate(taps)) if many else taps[0]}

    def run(self, iterations: int = 1) -> None:
        s, spark = self.lake.store, self.lake.spark
        if isinstance(self.own, Plugin):
            self.own.run(iterations)
        elif isinstance(self.own, recon.Volume3D):
            self.out().df = self.own.sirt(iterations) if self.name == "SIRT3D" else self.own.cgls(iterations)
        elif self.own is not None:
            self.out().df = self.own.run(iterations)
        elif self.name == "FP":
            volume = s.get(self.cfg["VolumeDataId"], "data")
            p = self.projector(volume)
            out = masked(p.fp(volume.df, mask=self.mask("VolumeMaskId")), self.mask("SinogramMaskId"), ["a", "d"])
            self.sino().df = whole(p.rays(), out)
        elif self.name in ("BP", "FBP"):
            p = self.projector()
            sino = masked(self.sino().df, self.mask("SinogramMaskId"), ["a", "d"])
            if self.name == "BP":
                done = p.bp(sino)
            elif self.cuda:
                done = recon.fbp_pixel(spark, p.g, p.v, sino, short=self.option.get("ShortScan") in (True, 1, "yes", "true", "1"), **self.filtering(p.g))
            else:
                done = recon.fbp(p, sino, **self.filtering(p.g))
            self.out().df = whole(p.pixels(), masked(done, self.mask("ReconstructionMaskId"), ["r", "c"]))
        elif self.name in ("FDK", "FP3D", "BP3D"):
            self.run3d(self.sino().geometry, s.get(self.cfg.get("VolumeDataId", self.cfg.get("ReconstructionDataId")), "data").geometry)
        elif self.name.startswith("DARTMASK"):
            source = s.get(self.cfg["SegmentationDataId"], "data")
            self.out().df = stencil.mask(source.df, source.geometry.shape, self.option.get("Connectivity", 8 if self.name == "DARTMASK" else 26), self.option.get("Threshold", 1), self.option.get("Radius", 1))
        elif self.name.startswith("DARTSMOOTHING"):
            source = s.get(self.cfg["InDataId"], "data")
            self.out().df = stencil.smooth(source.df, source.geometry.shape, self.option.get("Intensity", 0.3), self.option.get("Radius", 1))
        elif self.name == "RoiSelect":
            own = self.out()
            own.df = elementwise.roi_select(own.df, *own.geometry.shape, self.option.get("Radius", own.geometry.shape[0]) ** 2 / 4)
        else:
            ids = self.cfg["DataId"] if isinstance(self.cfg["DataId"], list) else [self.cfg["DataId"]]
            first = s.get(ids[0], "data")
            other = s.get(ids[1], "data").df if len(ids) > 1 else None
            first.df = elementwise.data_op(self.cfg["Operation"], first.df, other, (self.cfg.get("Scalar") or [0.0])[0], self.mask("MaskId"), first.df.columns[-1])

    def run3d(self, g: Projection, v: Volume) -> None:
        s, spark = self.lake.store, self.lake.spark
        subvoxels = int(self.option.get("VoxelSuperSampling", 1))
        given = s.get(self.cfg["ProjectorId"], "projector") if "ProjectorId" in self.cfg else None
        p = Projector3D(spark, g, v, given.kernel if given else "default", int(self.option.get("DetectorSuperSampling", given.subrays if given else 1)), subvoxels if "VoxelSuperSampling" in self.option or not given else given.subvoxels)
        if self.name == "FP3D":
            self.sino().df = whole(p.rays(), p.fp(s.get(self.cfg["VolumeDataId"], "data").df))
        elif self.name == "FDK":
            done = recon.fdk(spark, g, v, self.sino().df, short=self.option.get("ShortScan") in (True, 1, "yes", "true", "1"), subvoxels=p.subvoxels, **self.filtering(g))
            self.out().df = whole(p.pixels(), done)
        elif self.option.get("SIRTWeighting"):
            self.out().df = recon.bp_sirt_weighted(spark, g, v, self.out().df, self.sino().df)
        else:
            self.out().df = whole(p.pixels(), p.bp(self.sino().df))


try:  # solvers of other packages take an operator of this class, where it is installed
    from scipy.sparse.linalg import LinearOperator as _Base
except ImportError:
    _Base = object


class Operator(_Base):
    """W as a linear operator on arrays, in 2D and 3D: A * x, A.T * y, FP, BP, reconstruct, matvec and rmatvec for solvers."""

    def __init__(self, projector: Projector | Projector3D, transposed: bool = False):
        self.p, self.transposed = projector, transposed
        v, s = projector.v.shape, projector.g.shape
        self.vshape, self.sshape = v, s
        shape = (int(np.prod(v)), int(np.prod(s))) if transposed else (int(np.prod(s)), int(np.prod(v)))
        if _Base is object:
            self.shape, self.dtype = shape, np.dtype(np.float64)
        else:
            super().__init__(np.dtype(np.float64), shape)

    @property
    def T(self) -> Operator:  # noqa: N802
        return Operator(self.p, not self.transposed)

    def _transpose(self) -> Operator:
        return self.T

    _adjoint = _transpose

    def FP(self, x) -> np.ndarray:  # noqa: N802
        return arrays.to_array(self.p.fp(arrays.from_array(self.p.spark, np.reshape(x, self.vshape), f"vol{len(self.vshape)}d")), self.sshape)

    def BP(self, y) -> np.ndarray:  # noqa: N802
        return arrays.to_array(self.p.bp(arrays.from_array(self.p.spark, np.reshape(y, self.sshape), f"sino{len(self.sshape)}d")), self.vshape)

    def _matvec(self, x) -> np.ndarray:
        return (self.BP(x) if self.transposed else self.FP(x)).ravel()

    def _rmatvec(self, x) -> np.ndarray:
        return (self.FP(x) if self.transposed else self.BP(x)).ravel()

    matvec, rmatvec = _matvec, _rmatvec

    def __mul__(self, x) -> np.ndarray:
        return self._matvec(x)

    def __call__(self, x) -> np.ndarray:
        return self._matvec(x)

    def reconstruct(self, method: str, sino, iterations: int = 1, **options) -> np.ndarray:
        """The image that an algorithm makes of a sinogram; options as in Lake.create_reconstruction."""
        lake = Lake(self.p.spark)
        out = lake.create_reconstruction(method, lake.store.put("projector", self.p), np.reshape(sino, self.sshape), iterations, **options)
        return arrays.to_array(out, self.vshape)


def save_config(cfg: dict, path: str) -> None:
    """Writes a configuration as JSON, or as XML where path ends so."""
    with open(path, "w", encoding="utf-8") as f:
        f.write(to_xml(cfg) if path.endswith(".xml") else json.dumps(cfg))


def load_config(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return from_xml(f.read()) if path.endswith(".xml") else json.load(f)


def to_xml(cfg: dict) -> str:
    """A configuration as XML: its type as an attribute, other entries as elements, options as elements Option with key and value, lists with commas."""
    text = lambda x: ",".join(map(text, x)) if isinstance(x, (list, tuple)) else repr(x) if isinstance(x, float) else "yes" if x is True else "no" if x is False else str(x)
    root = ElementTree.Element("configuration", {"type": cfg["type"]} if "type" in cfg else {})
    for k, v in cfg.items():
        if k == "option":
            for name, value in v.items():
                ElementTree.SubElement(root, "Option", {"key": name, "value": text(value)})
        elif k != "type":
            ElementTree.SubElement(root, k).text = text(v)
    return ElementTree.tostring(root, encoding="unicode")


def from_xml(text: str) -> dict:
    """A configuration from to_xml's form; numbers and lists of numbers are numbers again, yes and no become true and false."""

    def value(x: str):
        if "," in x:
            return [value(y) for y in x.split(",")]
        for kind in (int, float):
            with contextlib.suppress(ValueError):
                return kind(x)
        return {"yes": True, "no": False}.get(x, x)

    root = ElementTree.fromstring(text)
    cfg = {"type": root.get("type")} if root.get("type") is not None else {}
    for x in root:
        if x.tag == "Option":
            cfg.setdefault("option", {})[x.get("key")] = value(x.get("value") or "")
        else:
            cfg[x.tag] = value(x.text or "")
    return cfg


class Logging:
    """What the toolbox says: debug, info, warn, error; where to and from which level on, and how."""

    def __init__(self):
        self._screen: logging.Handler | None = None
        self._file: logging.Handler | None = None
        self._format = "%(levelname)s: %(message)s"

    def debug(self, message: str) -> None:
        log.debug(message)

    def info(self, message: str) -> None:
        log.info(message)

    def warn(self, message: str) -> None:
        log.warning(message)

    def error(self, message: str) -> None:
        log.error(message)

    def enable(self) -> None:
        log.disabled = False

    def disable(self) -> None:
        log.disabled = True

    def set_format(self, text: str) -> None:
        """The form of a message, as the logging module has it."""
        self._format = text
        for handler in (self._screen, self._file):
            if handler:
                handler.setFormatter(logging.Formatter(text))

    def _put(self, old: logging.Handler | None, new: logging.Handler | None, level: str) -> logging.Handler | None:
        if old:
            log.removeHandler(old)
            old.close()
        if new:
            new.setLevel(level.upper())
            new.setFormatter(logging.Formatter(self._format))
            log.addHandler(new)
            log.setLevel(logging.DEBUG)
        return new

    def set_output_screen(self, stream=None, level: str = "info") -> None:
        self._screen = self._put(self._screen, logging.StreamHandler(stream), level)

    def set_output_file(self, path: str, level: str = "info") -> None:
        self._file = self._put(self._file, logging.FileHandler(path, encoding="utf-8"), level)

    def disable_screen(self) -> None:
        self._screen = self._put(self._screen, None, "info")

    def disable_file(self) -> None:
        self._file = self._put(self._file, None, "info")


def has_feature(name: str) -> bool:
    """spark: always; cuda and others that there is no hardware for here: never."""
    return name == "spark"


def use_cuda() -> bool:
    return False


def get_gpu_info() -> str:
    return "no GPU is used"


def credits() -> str:
    return "radonlake: projection, reconstruction and corpus operators on Spark DataFrames"


def self_test(spark: SparkSession) -> float:
    """Projects a random image of 2 by 32 pixels on 32 detector pixels below it: the largest difference from the sums of its columns, which must be less than 1e-6."""
    image = np.random.default_rng(0).random((2, 32))
    p = Projector(spark, create_proj_geom("parallel", 1.0, 32, [0.0]), create_vol_geom(2, 32), "line")
    found = arrays.to_array(p.fp(arrays.from_array(spark, image, "vol2d")), (1, 32))
    if (worst := float(np.abs(found[0] - image.sum(0)).max())) >= 1e-6:
        raise LakeError(f"the projection is off by {worst}")
    return worst
