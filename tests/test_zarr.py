"""Gridded fields: written, read, and chunks skipped by filters."""

import json
import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessella.sources import zarr as Z


@pytest.fixture(scope="module")
def field(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("grid") / "field")
    rng = np.random.default_rng(0)
    cube = rng.normal(size=(10, 5, 7))
    rows = [(i, j, k, float(cube[i, j, k])) for i in range(10) for j in range(5) for k in range(7) if (i + j + k) % 11]
    rows += [(0, 0, 1, -99.0), (0, 0, 2, None), (99, 0, 0, 1.0), (-1, 0, 0, 1.0)]
    Z.write_grid(spark.createDataFrame(rows, "i long, j long, k long, value double"), path, (10, 5, 7), (4, 2, 3))
    return path, cube


def test_all_cells_come_back(spark, field):
    path, cube = field
    got = {(r["time"], r["cell"]): r for r in Z.read_grid(spark, path).collect()}
    assert len(got) == 350
    for i in range(10):
        for j in range(5):
            for k in range(7):
                r = got[datetime(1959, 1, 1) + i * Z.STEP, j * 7 + k]
                assert r["lat"] == pytest.approx(-90 + 45 * j) and r["lon"] == pytest.approx(k * 360 / 7)
                assert r["value"] == (None if (i + j + k) % 11 == 0 else cube[i, j, k])


def test_filters_skip_chunks(spark, field):
    path, _ = field
    df = Z.read_grid(spark, path)
    assert df.rdd.getNumPartitions() == 3 * 3 * 3
    some = df.filter((F.col("time") >= F.lit(datetime(1959, 1, 2, 6)).cast("timestamp_ntz")) & (F.col("lat") > 10) & (F.col("lon") < 100))
    assert some.rdd.getNumPartitions() == 2 * 2 * 1
    want = [(i, j, k) for i in range(5, 10) for j in range(5) for k in range(7) if -90 + 45 * j > 10 and k * 360 / 7 < 100]
    assert some.count() == len(want)
    assert df.filter("lat > 1000").count() == 0 and df.filter("lat = 0").select("cell").distinct().count() == 7


def test_missing_chunks_and_other_formats(spark, field, tmp_path):
    path = f"{tmp_path}/plain"
    Z.write_grid(spark.createDataFrame([(0, 0, 0, 5.0)], "i long, j long, k long, value double"), path, (2, 2, 2), (1, 1, 1), compress=False)
    assert sorted(f for f in os.listdir(path) if f[0] != ".") == ["0.0.0"]
    rows = Z.read_grid(spark, path).collect()
    assert len(rows) == 8 and [r["value"] for r in rows if r["value"] is not None] == [5.0]
    meta = json.load(open(f"{path}/.zarray"))
    json.dump(meta | {"compressor": {"id": "blosc"}}, open(f"{path}/.zarray", "w"))
    with pytest.raises(Exception, match="uncompressed or zlib"):
        Z.read_grid(spark, path).collect()
