"""Filters of filtered back projection: half spectra F(k) by name, and the spatial kernels that they are.

The ramp comes from its band-limited spatial form; windows multiply all but its first value, and it ends at the cutoff D.
Window formulas are literal in K, the length of the half spectrum.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workers import map_arrow

WINDOWS = ("ram-lak", "shepp-logan", "cosine", "hamming", "hann", "tukey", "lanczos", "triangular", "gaussian", "barlett-hann", "blackman", "nuttall", "blackman-harris", "blackman-nuttall", "flat-top", "kaiser", "parzen")
CUSTOM = ("projection", "sinogram", "rprojection", "rsinogram")
DEFAULTS = {"tukey": 0.5, "gaussian": 0.4, "blackman": 0.16, "kaiser": 3.0}
# Coefficients of cosine-sum windows.
COSINE_SUMS = {"nuttall": (0.355768, 0.487396, 0.144232, 0.012604), "blackman-harris": (0.35875, 0.48829, 0.14128, 0.01168), "blackman-nuttall": (0.3635819, 0.4891775, 0.1365995, 0.0106411), "flat-top": (1.0, 1.93, 1.29, 0.388, 0.032)}


def bessel_j0(x: float) -> float:
    """The mean of cos(x sin t), which converges fast on even points."""
    return float(np.mean(np.cos(x * np.sin((np.arange(64) + 0.5) * math.pi / 64))))


def window(name: str, k: int, n: int, w: float, parameter: float, d: float) -> float:
    """The multiplier of the k-th of n values, at frequency w; parameter < 0 is the default."""
    p = DEFAULTS.get(name, 0.0) if parameter < 0 else parameter
    x, last = math.pi * k / (n - 1), n - 1
    if name in ("ram-lak", "none"):
        return 1.0
    if name == "shepp-logan":
        return math.sin(w / (2 * d)) / (w / (2 * d))
    if name == "cosine":
        return math.cos(w / (2 * d))
    if name == "hamming":
        return 0.54 + 0.46 * math.cos(w / d)
    if name == "hann":
        return 0.5 * (1 + math.cos(w / d))
    if name == "tukey":
        half = n / 2
        return 1.0 if half * (1 - p) <= k <= half * (1 + p) else 0.5 * (1 + math.cos(math.pi * (k - p * half) / ((1 - p) * half)))
    if name == "lanczos":
        z = math.pi * (2 * k / last - 1)
        return math.sin(z) / z if abs(z) > 0.001 else 1.0
    if name == "triangular":
        return 2 / last * (last / 2 - abs(k - last / 2))
    if name == "gaussian":
        return math.exp(-0.5 * ((k - last / 2) / (p * last / 2)) ** 2)
    if name == "barlett-hann":
        return 0.62 - 0.48 * abs(k / last - 0.5) - 0.38 * math.cos(2 * x)
    if name == "blackman":
        return (1 - p) / 2 - 0.5 * math.cos(x) + p / 2 * math.cos(2 * x)
    if name in COSINE_SUMS:
        return sum((-1) ** i * c * math.cos(2 * i * x) for i, c in enumerate(COSINE_SUMS[name]))
    if name == "kaiser":
        return bessel_j0(math.pi * p * math.sqrt(1 - (2 * k / last - 1) ** 2)) / bessel_j0(math.pi * p)
    if name == "parzen":
        q = k / last
        return 1 - 6 * q * q * (1 - q) if q <= 0.5 else 2 * (1 - q) ** 3
    raise ValueError(f"{name} is no filter")


def size_for(detectors: int) -> int:
    return 1 << max(1, (2 * detectors - 1).bit_length())


@functools.lru_cache(128)
def spectrum(name: str, n: int, parameter: float = -1.0, d: float = 1.0) -> tuple[float, ...]:
    """F(0) ... F(n / 2) for a transform of n values."""
    name = name.lower()
    j = np.arange(n)
    lag = np.minimum(j, n - j)
    h = np.where(lag == 0, 0.25, np.where(lag % 2 == 1, -1 / (math.pi * np.maximum(lag, 1)) ** 2, 0.0))
    half = 2 * np.fft.rfft(h).real
    for k in range(1, len(half)):
        w = 2 * math.pi * k / n
        half[k] *= window(name, k, len(half), w, parameter, d)
        if w > math.pi * d:
            half[k] = 0.0
    return tuple(half.tolist())


def kernel(half: tuple[float, ...], n: int) -> tuple[float, ...]:
    """The real even spatial kernel h(0) ... h(n / 2) of a half spectrum."""
    return tuple(np.fft.irfft(np.array(half), n)[: n // 2 + 1].tolist())


def taps_of(name: str, detectors: int, parameter: float = -1.0, d: float = 1.0) -> dict[int, float]:
    n = size_for(detectors)
    h = kernel(spectrum(name, n, parameter, d), n)
    return {m: h[abs(m)] for m in range(1 - detectors, detectors)}


def taps_of_custom(kind: str, values: list[float], detectors: int) -> dict[int, float]:
    """Taps of a user's filter: a half spectrum (projection, sinogram) or a spatial kernel whose middle is lag 0 (rprojection, rsinogram)."""
    if kind in ("projection", "sinogram"):
        n = size_for(detectors)
        if len(values) != n // 2 + 1:
            raise ValueError(f"a half spectrum needs {n // 2 + 1} values")
        h = kernel(tuple(values), n)
        return {m: h[abs(m)] for m in range(1 - detectors, detectors)}
    return {m: values[m + len(values) // 2] if 0 <= m + len(values) // 2 < len(values) else 0.0 for m in range(1 - detectors, detectors)}


def filter_rows(sino: DataFrame, taps: dict[int, float] | dict[int, dict[int, float]], detectors: int, by: tuple[str, ...] = ("a",)) -> DataFrame:
    """Each row of the sinogram convolved with the taps (one table, or one by view): (by, d, p). Absent cells of a row count as 0.

    Rows are packed as arrays, so that each value is shuffled once, and transformed by batch; a transform of twice the row's length makes the
    circular convolution the plain one.
    """
    n, size = detectors, size_for(detectors)
    one = not isinstance(next(iter(taps.values())), dict)

    def response(t: dict[int, float]) -> np.ndarray:
        h = np.zeros(size)
        for m in range(1 - n, n):
            h[m % size] = t.get(m, 0.0)
        return np.fft.rfft(h)

    known = {None: response(taps)} if one else {int(a): response(t) for a, t in taps.items()}
    kinds = dict(sino.dtypes)
    rows = sino.groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("d", "p"))).alias("row"))
    rows = rows.selectExpr(*by, f"transform(sequence(0, {n - 1}), d -> coalesce(row[d], CAST(0 AS DOUBLE))) AS row")

    def run(batches):
        for batch in batches:
            x = batch.column(len(by)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
            views = [None] * len(x) if one else batch.column(by.index("a")).to_pylist()
            there = np.array([v in known for v in views], bool)
            h = np.stack([known[v] for v, ok in zip(views, there, strict=True) if ok]) if there.any() else np.zeros((0, size // 2 + 1))
            y = np.fft.irfft(np.fft.rfft(x[there], size) * h, size)[:, :n]
            kept = batch.filter(pa.array(there))
            yield pa.RecordBatch.from_arrays([*(kept.column(k) for k in range(len(by))), pa.array(list(y), pa.list_(pa.float64()))], [*by, "row"])

    done = map_arrow(rows, run, ", ".join(f"{c} {kinds[c]}" for c in by) + ", row array<double>")
    return done.select(*by, F.posexplode("row").alias("d", "p"))
