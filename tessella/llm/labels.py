"""Which rows a classifier may learn from."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import uniform

FOLDS = 5


def held_out(column: str = "doc_id") -> Column:
    """crc32 of the id as text, modulo 5, is 0. A null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int = 3) -> tuple[DataFrame, float]:
    """doc_id, y, text of at most `most` labelled documents of each class that aren't held out, by smallest hash: a bounded sample. With it the log by which the odds of class 1 among all labelled documents exceed
    those in the sample, 0 unless a class was cut: a classifier adds it, so its scores don't move with the bound. A doc_id with several labels has the largest; null labels and null ids are left out."""
    known = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).groupBy("doc_id").agg(F.max(label).cast("int").alias("y"))
    n = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).filter("y in (0, 1)").collect()}
    drawn = [known.filter(F.col("y") == y).orderBy(uniform(seed), "doc_id").limit(most) for y in (0, 1)]
    chosen = drawn[0].unionByName(drawn[1])  # at most 2 * most rows of two numbers, so it may be broadcast
    shift = sum(sign * math.log(n[y] / min(n[y], most)) for y, sign in ((1, 1.0), (0, -1.0)) if n.get(y))
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text"), shift
