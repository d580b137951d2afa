"""Readers and sinks of series files. All rows stay distributed; a file's line order is kept by numbering, not by one task.

Empty folders raise Spark's own error; empty files give no rows; unreadable numbers become null.
"""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def scratch(spark: SparkSession, tag: str) -> str:
    """A fresh folder under the one that driver and executors share; a local one only where the session names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="tessella-")
    return f"{root.rstrip('/')}/tessella-{tag}-{uuid.uuid4().hex}"


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """path, line (from 0, by file), value. Lines are counted by split; only the counts (one row a split) are added up by file."""
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("at"))
    inside = raw.withColumn("k", F.row_number().over(Window.partitionBy("path", "start").orderBy("at")) - 1)
    sizes = raw.groupBy("path", "start").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select("path", "start", F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return inside.join(before, ["path", "start"]).select("path", (F.col("k") + F.col("before")).cast("bigint").alias("line"), "value")


def csv_stride(spark: SparkSession, path: str, n: int, schema: str) -> DataFrame:
    """Keeps line i unless i % n = 1 (i counts the header, which is line 0); n = 1 keeps all, n < 1 raises."""
    if n < 1:
        raise ValueError("the stride must be positive")
    lines = numbered_lines(spark, path).filter((F.col("line") > 0) & ((F.col("line") % n) != 1))
    return lines.select(F.from_csv("value", schema).alias("r")).select("r.*")


def csv_pages(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One CSV (with a header) a page: the columns, `page` (the file's place in sorted names, from 0) and `step` (its row, from 0)."""
    lines = numbered_lines(spark, path)
    pages = lines.select("path").distinct()
    # One row a file: numbering names is a window over the listing, not over the data.
    numbered = pages.select("path", (F.row_number().over(Window.orderBy("path")) - 1).cast("int").alias("page"))
    rows = lines.filter("line > 0").join(numbered, "path").select("page", (F.col("line") - 1).alias("step"), F.from_csv("value", schema).alias("r"))
    return rows.select("page", "step", "r.*")


def pad_pages(df: DataFrame, values: list[str], page: str = "page", step: str = "step") -> DataFrame:
    """Pages shorter than the longest go on with zeros."""
    longest = df.agg(F.max(step).alias("last"))
    grid = df.select(page).distinct().join(F.broadcast(longest), how="inner", on=F.lit(True)).select(page, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("last"))).alias(step))
    return grid.join(df, [page, step], "left").select(page, step, *[F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)).alias(c) for c in values])


def whitespace_text(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """Numbers split by white space, named in order; missing or unreadable ones are null. Blank lines go."""
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(path).filter(F.trim("value") != "").select(*[F.get(parts, F.lit(i)).try_cast("double").alias(n) for i, n in enumerate(names)])


def labelled_tsv(spark: SparkSession, path: str, normalize: bool = False) -> DataFrame:
    """path, line, label (0..L-1 in sorted order), values: a label and a series in each line; with normalize, by the mean and deviation of all values (nulls and NaNs left out)."""
    parts = F.split("value", "\t")
    rows = numbered_lines(spark, path).select("path", "line", F.get(parts, F.lit(0)).cast("double").alias("raw"), F.transform(F.slice(parts, 2, 1 << 30), lambda x: x.try_cast("double")).alias("values"))
    labels = rows.select("raw").distinct().select("raw", (F.row_number().over(Window.orderBy("raw")) - 1).cast("int").alias("label"))  # a row a class
    rows = rows.join(labels, "raw").select("path", "line", "label", "values")
    if not normalize:
        return rows
    each = rows.select(F.explode("values").alias("x")).filter(~F.isnan("x"))
    s = each.agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).first()
    m, sd = s["m"] or 0.0, s["s"] or 1.0
    return rows.withColumn("values", F.transform("values", lambda x: (x - m) / sd))


def relational_arff(spark: SparkSession, path: str) -> DataFrame:
    """path, line, label (0..L-1 in sorted order of the names), values (by channel, by step): each data line is a quoted series, its channels parted by a written \\n, and a class. Unknown values (?) are null;
    declarations, comments, blank lines and lines without a quoted series go."""
    form = r"""^\s*(['"])(.*)\1\s*,\s*['"]?(.*?)['"]?\s*$"""
    lines = numbered_lines(spark, path).filter(~F.col("value").rlike(r"^\s*([@%]|$)") & F.col("value").rlike(form))
    channels = F.split(F.regexp_extract("value", form, 2), r"\\n")
    rows = lines.select("path", "line", F.regexp_extract("value", form, 3).alias("raw"), F.transform(channels, lambda c: F.transform(F.split(c, ","), lambda x: F.trim(x).try_cast("double"))).alias("values"))
    labels = rows.select("raw").distinct().select("raw", (F.row_number().over(Window.orderBy("raw")) - 1).cast("int").alias("label"))  # a row a class
    return rows.join(labels, "raw").select("path", "line", "label", "values")


def standardized(df: DataFrame, train: DataFrame, values: str = "values") -> DataFrame:
    """Series by channel and step, less the mean and over the deviation of their channel in `train` (nulls and NaNs left out; a constant channel is only centred). A channel that `train` lacks becomes null."""
    each = train.select(F.posexplode(values).alias("channel", "xs")).select("channel", F.explode("xs").alias("x")).filter(~F.isnan("x"))
    # a row a channel
    known = {r["channel"]: (r["m"], r["s"] or 1.0) for r in each.groupBy("channel").agg(F.avg("x").alias("m"), F.stddev_pop("x").alias("s")).collect()}
    law = [F.array(*[F.lit(known[c][k] if c in known else None).cast("double") for c in range(max(known, default=-1) + 1)]).cast("array<double>") for k in (0, 1)]
    return df.withColumn(values, F.transform(values, lambda xs, c: F.transform(xs, lambda x: (x - F.get(law[0], c)) / F.get(law[1], c))))


def parse_report(text: Column, fields: str) -> Column:
    """The rows between the marks $$SOE and $$EOE of a text report, as structs; no marks: an empty array."""
    body = F.regexp_extract(text, r"(?s)\$\$SOE\s*(.*?)\s*\$\$EOE", 1)
    lines = F.filter(F.split(body, r"\r?\n"), lambda x: F.trim(x) != "")
    return F.transform(lines, lambda x: F.from_csv(x, fields, {"ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}))


def append_run(run: DataFrame, path: str) -> None:
    """Adds rows to a CSV folder; each part file has the header, so any of them reads alone."""
    run.write.mode("append").option("header", True).csv(path)


def run_summary(runs: DataFrame, last: int, method: str = "method", order: str = "run", value: str = "score") -> DataFrame:
    """Mean and population deviation of the last runs of each method, and as text; methods whose count is below `last` or no multiple of it are left out."""
    per = Window.partitionBy(method)
    rows = runs.withColumn("__n", F.count(F.lit(1)).over(per)).withColumn("__r", F.row_number().over(per.orderBy(F.col(order).desc())))
    kept = rows.filter((F.col("__n") >= last) & (F.col("__n") % last == 0) & (F.col("__r") <= last))
    out = kept.groupBy(method).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.withColumn("cell", F.format_string("$%.3f \\pm %.3f$", "mean", "std"))


def scenario_tracks(df: DataFrame, track: str, focal: str, observed: str, order: list[str], values: list[str]) -> DataFrame:
    """Tracks of a scenario in long form: track, role, step (from 0 in each role), values. Observed rows are inputs, unobserved rows of the focal track targets, others vanish; inputs go on with zeros up to the longest track's."""
    rows = df.filter(F.col(observed) | (F.col(track) == F.col(focal))).withColumn("role", F.when(F.col(observed), "input").otherwise("target"))
    rows = rows.withColumn("step", (F.row_number().over(Window.partitionBy(track, "role").orderBy(*order)) - 1).cast("bigint")).select(track, "role", "step", *values)
    inputs = pad_pages(rows.filter("role = 'input'").drop("role"), values, track)
    return inputs.withColumn("role", F.lit("input")).select(track, "role", "step", *values).unionByName(rows.filter("role = 'target'"))


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def parquet_or_fetch(spark: SparkSession, path: str, fetch: Callable[[], DataFrame], text: tuple[str, ...] = ()) -> DataFrame:
    """The table at path; if there is none, what `fetch` gives, all columns but `text` as numbers (unreadable ones null), is written there first. Getting at a network is the caller's part."""
    if not exists(spark, path):
        got = fetch()
        got.select(*[F.col(c) if c in text else F.col(c).cast("string").try_cast("double").alias(c) for c in got.columns]).write.parquet(path)
    return spark.read.parquet(path)


def cached(spark: SparkSession, path: str, make: Callable[[], dict[str, DataFrame]], use_cache: bool = False) -> dict[str, DataFrame]:
    """The tables of a dataset, by name: read from the folder if use_cache and all are there, else made, written (always) and read."""
    names = path.rstrip("/") + "/names"
    if use_cache and exists(spark, names):
        return {r["value"]: spark.read.parquet(f"{path}/{r['value']}") for r in spark.read.text(names).collect()}
    made = make()
    for name, df in made.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")
    spark.createDataFrame([(n,) for n in made], "value string").coalesce(1).write.mode("overwrite").text(names)
    return {name: spark.read.parquet(f"{path}/{name}") for name in made}


def log_runs(runs: DataFrame, path: str) -> None:
    """Appends runs (dataset, kind, method, run, values array<double>) to a log folder; nothing is read back or rewritten, so writers don't disturb each other."""
    runs.select("dataset", "kind", "method", "run", "values").write.mode("append").parquet(path)


def run_log(spark: SparkSession, path: str) -> DataFrame:
    """The log as one nested JSON text a dataset: kind -> method -> the runs' values in order of run. A missing folder is an empty log."""
    if not exists(spark, path):
        return spark.createDataFrame([], "dataset string, log string")
    rows = spark.read.parquet(path)
    by_method = rows.groupBy("dataset", "kind", "method").agg(F.transform(F.array_sort(F.collect_list(F.struct("run", "values"))), lambda r: r["values"]).alias("runs"))
    by_kind = by_method.groupBy("dataset", "kind").agg(F.array_sort(F.collect_list(F.struct("method", "runs"))).alias("methods"))
    kinds = by_kind.groupBy("dataset").agg(F.array_sort(F.collect_list(F.struct("kind", "methods"))).alias("kinds"))
    nested = F.map_from_entries(F.transform("kinds", lambda k: F.struct(k["kind"], F.map_from_entries(k["methods"]))))
    return kinds.select("dataset", F.to_json(nested).alias("log"))


class _Range(InputPartition):
    def __init__(self, path: str, start: int, first: int, last: int):
        self.path, self.start, self.first, self.last = path, start, first, last


class _NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.rows = options["path"].removeprefix("file://"), int(options.get("rows", 1024))

    def partitions(self) -> list[InputPartition]:
        files = [self.path]
        if os.path.isdir(self.path):
            files = [f"{self.path}/{f}" for f in sorted(os.listdir(self.path)) if f.endswith(".npy")]
        out, start = [], 0
        for file in files:
            n = len(np.load(file, mmap_mode="r", allow_pickle=False))  # the header only
            out += [_Range(file, start, a, min(n, a + self.rows)) for a in range(0, n, self.rows)]
            start += n
        return out

    def read(self, partition: _Range | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # an empty folder
            return
        cube = np.load(partition.path, mmap_mode="r", allow_pickle=False)
        for page in range(partition.first, partition.last):
            steps = np.asarray(cube[page], np.float64)
            steps = steps.reshape(len(steps), -1) if steps.ndim else steps.reshape(1, 1)
            columns = [pa.array(np.full(len(steps), partition.start + page, np.int64)), pa.array(np.arange(len(steps))), pa.array(list(steps), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["page", "step", "values"])


class NpyCube(DataSource):
    """spark.read.format("npy"): (page, step, features) cubes in a shared folder, memory-mapped: a file, or a folder whose files follow each other by name; a partition is a range of pages (option rows)."""

    @classmethod
    def name(cls) -> str:
        return "npy"

    def schema(self) -> str:
        return "page bigint, step bigint, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return _NpyReader(self.options)


def write_npy(df: DataFrame, path: str, page: str, step: str, values: list[str], steps: int, pages: int = 64) -> None:
    """A folder of cubes of `pages` pages each: rows of df by page (from 0, without gaps) and step; missing cells are NaN, steps beyond `steps` are left out. A file appears under its name when it is whole, so a task may run twice."""
    folder = path.removeprefix("file://")
    os.makedirs(folder, exist_ok=True)

    def save(t: pa.Table) -> pa.Table:
        at, k = t.column("page").to_numpy(), t.column("step").to_numpy()
        first = at.min() // pages * pages
        cube = np.full((at.max() - first + 1, steps, len(values)), np.nan)
        for n, v in enumerate(values):
            cube[at - first, k, n] = t.column(v).to_numpy(zero_copy_only=False).astype(float)
        part = f"{folder}/.{uuid.uuid4().hex}"
        with open(part, "wb") as f:
            np.save(f, cube)
        os.replace(part, f"{folder}/{first:018d}.npy")
        return pa.table({"rows": [len(t)]})

    rows = df.select(F.col(page).cast("long").alias("page"), F.col(step).cast("long").alias("step"), *[F.col(v).cast("double").alias(v) for v in values]).filter(f"step >= 0 and step < {steps} and page is not null")
    rows.groupBy(F.expr(f"page div {pages}").alias("__f")).applyInArrow(lambda t: save(t), "rows long").agg(F.sum("rows")).collect()
