"""Helpers the training-data operators share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as the contracts define it: space and tab to carriage return.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"


#: A key with over 1 / HOT of a table's rows, and over HOT_ROWS, is hot; so there are at most HOT of them.
HOT, HOT_ROWS = 4096, 1000


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir where the session names one, else, on a local master only (tests), a fresh local one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = held.get() if held.isDefined() else None
    if not named:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="tessella-")
        spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def _path(spark: SparkSession, path: str) -> tuple:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def cut(df: DataFrame, tag: str, instead: DataFrame | None = None) -> DataFrame:
    """Write df as a table in the shared folder and read it back: lineage ends there, a lost executor costs no recomputation, and its size is known to the planner.
    The tables go when the driver ends; the one that `instead` (a result of this function that nothing else reads) stands on goes at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tessella/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    if instead is not None:
        gone, at = _path(spark, instead._written)
        gone.delete(at, True)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def hot_from(rows: int) -> int:
    """A key of a table with so many rows is hot if it has more than this."""
    return max(rows // HOT, HOT_ROWS)


def spread_join(big: DataFrame, small: DataFrame, on: list[str], hot: DataFrame | None) -> DataFrame:
    """big joined with small, which has at most one row a key. `hot` is the part of small whose keys are hot in big, so at most HOT rows whatever the input (None: there are none):
    it is broadcast, and rows with a hot key are not moved; the others meet by an ordinary join."""
    if hot is None:
        return big.join(small, on)
    few = F.broadcast(hot)
    return big.join(few, on).unionByName(big.join(few.select(*on), on, "left_anti").join(small, on))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(column: str = "text") -> Column:
    """Null text counts as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def squeezed(text: Column) -> Column:
    """Each run of white space becomes one space. Five literal replacements and a regex for the rare longer runs cost half of one regex over every space."""
    for c in "\t\n\x0b\x0c\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return F.when(text.contains("  "), F.regexp_replace(text, "  +", " ")).otherwise(text)


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def key_of(column: str) -> Column:
    """A null-safe grouping key: equal for two rows exactly if both values are equal or both are null."""
    c = F.col(column).cast("string")
    return F.when(c.isNull(), F.lit("n")).otherwise(F.concat(F.lit("s"), c))


def uniform(seed: int, column: str = "doc_id", text: str | None = None) -> Column:
    """A repeatable number in (0, 1) from the seed and an id, 48 bits of MD5: the same on every engine and partitioning. A null id is hashed as the word null; with `text` the MD5 of that column's text (null: empty) counts too, so that rows without an id differ."""
    parts = [F.lit(f"{seed}:"), F.coalesce(F.col(column).cast("string"), F.lit("null"))]
    if text:
        parts += [F.lit(":"), F.md5(text_of(text).cast("binary"))]
    return (F.conv(F.substring(F.md5(F.concat(*parts)), 1, 12), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**48))
