"""Proportional stratified interleaving into shards, as DataFrame operations only.

Rows are shuffled within their source by a seeded hash, ranked, and placed at the fraction
(rank - 1/2) / rows of the source; sorted by fraction and cut into equal runs, every shard holds
every source in the mixture's proportion, and counts differ by at most one (law `rows`).

No rank is taken over a whole source or table: rows are ranked within (source, hash bucket) and
(fraction bucket), and prefix sums over the buckets' counts make the ranks global. There is a bucket for
each `ROWS` rows of the table, so a source with a third of all rows is spread over as many tasks as any
other data, and no bucket grows with the input. The hash covers the id and the text, so rows without an id
spread as well.

Edge cases: null text has size 8; a null source is a source of its own; rows of one doc_id are
ordered by source, text hash and size, so repeated rows are interchangeable; an empty table gives
an empty result; columns other than doc_id, source and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, key_of, text_of, uniform

ROWS = 100_000


def interleave(docs: DataFrame, shards: int = 24, seed: int = 7, buckets: int | None = None) -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, shard, slot."""
    rows = docs.select(
        "doc_id", "source", (F.octet_length(text_of()) + 8).cast("long").alias("size"), F.crc32(text_of().cast("binary")).alias("text_crc32"), key_of("source").alias("stratum"), uniform(seed, text="text").alias("u")
    )
    if buckets is None:
        rows = cut(rows, "sizes")
        buckets = max(64, -(-rows.count() // ROWS))
    rows = rows.withColumn("hb", F.floor(F.col("u") * buckets).cast("int"))

    def ranked(df: DataFrame, strata: list[str], bucket: str, order: list[str], rank: str, total: str) -> DataFrame:
        """Adds a rank from 1 within the strata and their row count, through the buckets."""
        counts = df.groupBy(*strata, bucket).agg(F.count("*").alias("n"))
        over = Window.partitionBy(*strata) if strata else Window.partitionBy(F.lit(0))
        starts = counts.select(*strata, bucket, (F.sum("n").over(over.orderBy(bucket)) - F.col("n")).alias("before"), F.sum("n").over(over).alias(total))
        within = F.row_number().over(Window.partitionBy(*strata, bucket).orderBy(*order))
        return df.withColumn("within", within).join(starts, [*strata, bucket]).withColumn(rank, F.col("before") + F.col("within")).drop("within", "before", bucket)

    placed = ranked(rows, ["stratum"], "hb", ["u", "doc_id", "text_crc32", "size"], "rank", "of_source")
    placed = placed.withColumn("fraction", (F.col("rank") - 0.5) / F.col("of_source")).withColumn("fb", F.floor(F.col("fraction") * buckets).cast("int"))
    lined = ranked(placed, [], "fb", ["fraction", "stratum", "u", "doc_id", "text_crc32", "size"], "place", "of_all")
    at = F.expr(f"((place - 1) * {shards}) div of_all")
    first = F.expr(f"(shard * of_all + {shards - 1}) div {shards}")
    return lined.withColumn("shard", at).withColumn("slot", F.col("place") - 1 - first).select("doc_id", "source", "size", "text_crc32", F.col("shard").cast("int").alias("shard"), F.col("slot").cast("long").alias("slot"))
