"""Queries against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

from radonlake.queries import ORACLES, QUERIES

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in glob.glob(f"{DIR}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.mark.skipif(not os.path.isdir(DIR), reason="no test tables here")
@pytest.mark.parametrize("name", ["fp_linear", "fp_strip", "fp_fan_strip", "bp_line", "fbp_ramlak", "bp_pixel_fan", "sirt_2it", "cgls_2it", "dart_mask_radius", "fp3d_cone", "fp3d_cyl", "fdk", "composite_fp", "stream_accumulate"])
def test_query(spark, duck, name):
    a, b = QUERIES[name](spark, DIR).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(a.columns)
    assert columns == sorted(b.columns) and len(a) == len(b) > 0
    a, b = (x[columns].sort_values(columns).reset_index(drop=True) for x in (a, b))
    for c in columns:
        assert a[c].to_numpy() == pytest.approx(b[c].to_numpy(), abs=2e-3)
