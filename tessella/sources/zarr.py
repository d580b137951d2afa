"""Gridded fields (time, lat, lon) in zarr folders of version 2: a file a chunk, uncompressed or zlib.

Reading is a Python data source with one partition a chunk. Filters on time, lat and lon reach it: a chunk whose
coordinates lie outside them is no partition and isn't opened; Spark still tests every row. Coordinates are arithmetic
on the indices: steps of six hours from 1959-01-01, latitudes from -90 to 90, longitudes from 0 to 360 without the end.

Writing groups cells by chunk; each chunk file appears under its name when it is whole, so a task that runs twice does
no harm. A cell without a row, or whose chunk has no file, is the fill value (NaN, read as null); two rows of a cell:
the larger value. The folder must be one that driver and executors reach by the same path.
"""

from __future__ import annotations

import itertools
import json
import os
import uuid
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

EPOCH, STEP = datetime(1959, 1, 1), timedelta(hours=6)
AXES = ("time", "lat", "lon")


def coordinates(axis: str, shape: tuple[int, ...]) -> np.ndarray:
    """Values of an axis; time in microseconds since EPOCH."""
    n = shape[AXES.index(axis)]
    if axis == "time":
        return np.arange(n) * (STEP // timedelta(microseconds=1))
    return np.linspace(-90, 90, n) if axis == "lat" else np.arange(n) * (360.0 / n)


def _local(path: str) -> str:
    return path.removeprefix("file://")


class _Chunk(InputPartition):
    def __init__(self, index: tuple[int, ...]):
        self.index = index


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = _local(options["path"])
        with open(f"{self.path}/.zarray") as f:
            self.meta = json.load(f)
        self.shape, self.chunks = tuple(self.meta["shape"]), tuple(self.meta["chunks"])
        if len(self.shape) != 3 or self.meta.get("filters") or self.meta.get("order", "C") != "C" or (self.meta.get("compressor") or {"id": "zlib"})["id"] != "zlib":
            raise ValueError("only three axes in C order, uncompressed or zlib, are read")
        self.bounds = {a: [-np.inf, np.inf] for a in AXES}

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            axis = f.attribute[0] if isinstance(f, EqualTo | GreaterThan | GreaterThanOrEqual | LessThan | LessThanOrEqual) and len(f.attribute) == 1 else None
            if axis in AXES:
                value = f.value
                if axis == "time":
                    value = (value.replace(tzinfo=None) - EPOCH) // timedelta(microseconds=1)
                low, high = self.bounds[axis]
                if not isinstance(f, LessThan | LessThanOrEqual):
                    low = max(low, float(value))
                if not isinstance(f, GreaterThan | GreaterThanOrEqual):
                    high = min(high, float(value))
                self.bounds[axis] = [low, high]
            yield f  # chunks are left out, rows are for Spark to test

    def partitions(self) -> list[InputPartition]:
        wanted = []
        for axis, size, n in zip(AXES, self.chunks, self.shape, strict=True):
            at, (low, high) = coordinates(axis, self.shape), self.bounds[axis]
            wanted.append([k for k in range(-(-n // size)) if at[k * size] <= high and at[min(n, (k + 1) * size) - 1] >= low])
        return [_Chunk(i) for i in itertools.product(*wanted)]

    def read(self, partition: _Chunk | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no chunk is left
            return
        file = f"{self.path}/{self.meta.get('dimension_separator', '.').join(map(str, partition.index))}"
        if os.path.exists(file):
            with open(file, "rb") as f:
                raw = f.read()
            block = np.frombuffer(zlib.decompress(raw) if self.meta.get("compressor") else raw, self.meta["dtype"]).reshape(self.chunks).astype(float)
        else:
            fill = self.meta.get("fill_value")
            block = np.full(self.chunks, np.nan if fill in (None, "NaN") else float(fill))
        spans = [range(k * c, min(n, (k + 1) * c)) for k, c, n in zip(partition.index, self.chunks, self.shape, strict=True)]
        block = block[tuple(slice(0, len(s)) for s in spans)].ravel()
        at = [g.ravel() for g in np.meshgrid(*[coordinates(a, self.shape)[s.start : s.stop] for a, s in zip(AXES, spans, strict=True)], indexing="ij")]
        cells = np.meshgrid(*[np.arange(s.start, s.stop) for s in spans], indexing="ij")
        cell = (cells[1] * self.shape[2] + cells[2]).ravel()
        times = pa.array(np.datetime64(EPOCH, "us") + at[0].astype("timedelta64[us]"), pa.timestamp("us"))
        yield pa.RecordBatch.from_arrays([times, pa.array(at[1]), pa.array(at[2]), pa.array(cell, pa.int64()), pa.array(block, mask=np.isnan(block))], ["time", "lat", "lon", "cell", "value"])


class ZarrGrid(DataSource):
    """spark.read.format("zarr_grid").option("path", folder): time, lat, lon, cell (lat index * longitudes + lon index), value."""

    @classmethod
    def name(cls) -> str:
        return "zarr_grid"

    def schema(self) -> str:
        return "time timestamp_ntz, lat double, lon double, cell bigint, value double"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    spark.dataSource.register(ZarrGrid)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark.read.format("zarr_grid").option("path", path).load()


def write_grid(df: DataFrame, path: str, shape: tuple[int, int, int], chunks: tuple[int, int, int], compress: bool = True) -> None:
    """df: i, j, k (indices of time, lat, lon), value. Cells outside the shape are left out."""
    folder = _local(path)
    os.makedirs(folder, exist_ok=True)
    meta = {"zarr_format": 2, "shape": list(shape), "chunks": list(chunks), "dtype": "<f8", "order": "C", "fill_value": "NaN", "filters": None, "compressor": {"id": "zlib", "level": 1} if compress else None}
    with open(f"{folder}/.zarray", "w") as f:
        json.dump(meta, f)

    def save(t: pa.Table) -> pa.Table:
        index = [int(t.column(c)[0].as_py()) for c in ("a", "b", "c")]
        block = np.full(chunks, np.nan)
        at = tuple(t.column(c).to_numpy() - n * size for c, n, size in zip("ijk", index, chunks, strict=True))
        np.fmax.at(block, at, t.column("value").to_numpy(zero_copy_only=False).astype(float))
        name = f"{folder}/{'.'.join(map(str, index))}"
        part = f"{folder}/.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            f.write(zlib.compress(block.tobytes(), 1) if compress else block.tobytes())
        os.replace(part, name)
        return pa.table({"cells": [len(t)]})

    rows = df.filter(" and ".join(f"{c} >= 0 and {c} < {n}" for c, n in zip("ijk", shape, strict=True))).select("i", "j", "k", F.col("value").cast("double").alias("value"))
    keyed = rows.withColumns({name: F.expr(f"cast({c} div {size} as int)") for name, c, size in zip("abc", "ijk", chunks, strict=True)})
    keyed.groupBy("a", "b", "c").applyInArrow(save, "cells long").agg(F.sum("cells")).collect()
