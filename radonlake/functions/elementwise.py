"""Elementwise operators on volumes and sinograms: expressions of o (the object), a and b (others) and scalars."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .text import num

GATE = 1e-6
#: The new value of o by operator; {s} is a scalar.
FORMS = {
    "add": "o + a", "mul": "o * a", "mul_scalar": "o * {s}", "add_scaled": "o + a * {s}", "scale_and_add": "a + o * {s}", "add_mul_scaled": "o + a * b * {s}", "add_mul": "o + a * b", "add2": "o + a + b", "div": "CASE WHEN a > 1e-6 THEN o / a ELSE 0e0 END",
    "mul2": "o * a * b", "divided_by": "CASE WHEN o > 1e-6 THEN a / o ELSE 0e0 END", "invert": "CASE WHEN o > 1e-6 THEN 1e0 / o ELSE 0e0 END", "set": "{s}", "clamp_min": "greatest(o, {s})", "clamp_max": "least(o, {s})", "clamp_min_mask": "greatest(o, a)", "clamp_max_mask": "least(o, a)",
    "set_masked": "CASE WHEN a = 0e0 THEN {s} ELSE o END", "mul_mask": "CASE WHEN a > 0e0 THEN o * {s} ELSE o END", "copy": "a",
}
_DATA_OP = re.compile(r"\$1(\.?[*/]|[+-])(s1|\$2)")


def apply(form: str, o: DataFrame, a: DataFrame | None = None, b: DataFrame | None = None, s: float = 0.0, value: str = "v") -> DataFrame:
    """The operator on tables with the same coordinates, whose last column is the value. Absent cells of a and b are 0."""
    keys = [c for c in o.columns if c != value]
    df = o.select(*keys, F.col(value).alias("o"))
    for name, other in (("a", a), ("b", b)):
        if other is not None:
            own = next(c for c in other.columns if c not in keys)
            df = df.join(other.select(*keys, F.col(own).alias(name)), keys, "left").fillna(0.0, [name])
    return df.selectExpr(*keys, f"{FORMS[form].format(s=num(s))} AS {value}")


def segment_and_mask(o: DataFrame, mask: DataFrame, level: float, to: float) -> DataFrame:
    """Where o reaches level, o becomes to and the mask 0: (keys, v, mask)."""
    keys = [c for c in o.columns if c != "v"]
    m = next(c for c in mask.columns if c not in keys)
    df = o.join(mask.select(*keys, F.col(m).alias("m")), keys)
    hit = F.col("v") >= level
    return df.select(*keys, F.when(hit, to).otherwise(F.col("v")).alias("v"), F.when(hit, 0.0).otherwise(F.col("m")).alias("mask"))


def data_op_form(expression: str) -> str:
    """The SQL of a data operation: $1*s1, $1.*s1, $1/s1, $1./s1, $1+s1, $1-s1, $1.*$2, $1+$2."""
    text = expression.replace(" ", "")
    m = _DATA_OP.fullmatch(text)
    if not m or (m[2] == "$2" and m[1] not in (".*", "+")):
        raise ValueError(f"{expression} is no data operation")
    other = "a" if m[2] == "$2" else "{s}"
    return f"o {m[1].lstrip('.')} {other}"


def data_op(expression: str, o: DataFrame, a: DataFrame | None = None, s: float = 0.0, mask: DataFrame | None = None, value: str = "v") -> DataFrame:
    """A data operation; with a mask only where it isn't 0, for products and quotients by a scalar."""
    form = data_op_form(expression).format(s=num(s))
    keys = [c for c in o.columns if c != value]
    df = o.select(*keys, F.col(value).alias("o"))
    if a is not None:
        own = next(c for c in a.columns if c not in keys)
        df = df.join(a.select(*keys, F.col(own).alias("a")), keys, "left").fillna(0.0, ["a"])
    if mask is not None:
        own = next(c for c in mask.columns if c not in keys)
        df = df.join(mask.select(*keys, F.col(own).alias("m")), keys, "left").fillna(0.0, ["m"])
        form = f"CASE WHEN m <> 0e0 THEN {form} ELSE o END"
    return df.selectExpr(*keys, f"{form} AS {value}")


def dot(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row (s): the sum of products of values that share coordinates."""
    value = a.columns[-1]
    keys = [c for c in a.columns if c != value]
    other = next(c for c in b.columns if c not in keys)
    return a.select(*keys, F.col(value).alias("x")).join(b.select(*keys, F.col(other).alias("y")), keys).agg(F.sum(F.col("x") * F.col("y")).alias("s"))


def roi_select(o: DataFrame, rows: int, cols: int, radius2: float) -> DataFrame:
    """0 outside the circle of squared diameter 4 * radius2 around the middle."""
    y, x = f"(r - {num((rows - 1) / 2)})", f"(c - {num((cols - 1) / 2)})"
    keys = [c for c in o.columns if c != "v"]
    return o.selectExpr(*keys, f"CASE WHEN {x} * {x} + {y} * {y} > {num(radius2)} THEN 0e0 ELSE v END AS v")


def clip_circle(o: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """A square image of n by n pixels with 0 outside its inner circle, and one row (n) with how many pixels of the grid are outside, whether or not o has them."""
    x, y = f"(r - {num((n - 1) / 2)})", f"(c - {num((n - 1) / 2)})"
    inside = f"{x} * {x} + {y} * {y} <= {num(n * n / 4)}"
    grid = o.sparkSession.range(n).selectExpr("CAST(id AS INT) AS r").selectExpr("r", f"explode(sequence(0, {n - 1})) AS c")
    return o.selectExpr("r", "c", f"CASE WHEN {inside} THEN v ELSE 0e0 END AS v"), grid.where(f"NOT ({inside})").agg(F.count("*").alias("n"))


def imscale(o: DataFrame) -> DataFrame:
    """Values from 0 to 1 by the least and largest, 0 where all are the same. The two numbers join as one row."""
    keys = [c for c in o.columns if c != "v"]
    ends = o.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    return o.join(F.broadcast(ends)).selectExpr(*keys, "CASE WHEN hi > lo THEN (v - lo) / (hi - lo) ELSE 0e0 END AS v")
