"""Tables that iterative operators stand on."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..sources.files import scratch


def settled(df: DataFrame, tag: str) -> DataFrame:
    """df written to the folder that driver and executors share, and read again: its lineage ends there, so a lost executor costs no earlier round. It goes with the driver, or by `dropped`."""
    spark = df.sparkSession
    path = scratch(spark, tag)
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(df: DataFrame | None) -> None:
    """Removes what `settled` wrote, when nothing reads it any more."""
    path = getattr(df, "_written", None)
    if path:
        at = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)
