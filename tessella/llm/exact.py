"""Exact dedup by content-defined chunk recipes, as DataFrame operations only.

A text (white space squeezed to single spaces) is cut where its own content says: after at least
`LEAST` characters, behind the next full stop, or after `MOST` characters more, so equal passages
give equal chunks wherever they stand. A chunk's identifier is its 64-bit hash and, for the rare
hashes that two different chunks share, a variant number. The chunks are deduplicated once (map-side
first, so a chunk that a third of all rows hold is one row per task) and compared byte for byte;
only from then on do identifiers stand for chunks. Documents are equal exactly if their ordered
identifier lists are; texts themselves are never grouped, sorted or joined.

Edge cases: null text counts as empty; of repeated rows (same doc_id, equal text) one is kept; a
null doc_id is kept only if its whole group has null ids; an empty table gives an empty result; columns
other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_from, spread_join, squeezed, text_of

LEAST, MOST = 512, 3584
CHUNK = rf"(?s).{{1,{LEAST}}}+[^.]{{0,{MOST}}}+\.?"


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.shiftrightunsigned(h, 64 - bits)


def clashes(chunks: DataFrame, bits: int = 64) -> DataFrame:
    """Chunks whose hash another, different one has too: chunk, variant from 0. All chunks of a hash are compared byte for byte, as its least and greatest; they are moved once, each task's copies as one."""
    hashed = chunks.select("chunk", chunk_hash(F.col("chunk"), bits).alias("h"))
    seen = cut(hashed.groupBy("h").agg(F.min("chunk").alias("least"), F.max("chunk").alias("most")).filter("least <> most").select("h"), "clashing")
    if seen.isEmpty():
        return chunks.sparkSession.createDataFrame([], "chunk string, variant int")
    known = hashed.join(seen, "h").distinct()
    return known.select("chunk", (F.row_number().over(Window.partitionBy("h").orderBy("chunk")) - 1).alias("variant"))


def recipes(docs: DataFrame, bits: int = 64) -> DataFrame:
    """doc_id, text_sha256, ids (ordered chunk hashes), variants (position and number of chunks whose hash clashes; else null). Equal (ids, variants) means equal normalised texts."""
    base = docs.select(F.col("doc_id"), squeezed(text_of()).alias("norm"))
    cutup = base.withColumn("chunks", F.regexp_extract_all("norm", F.lit(CHUNK), 0))
    chunks = cutup.select(F.explode("chunks").alias("chunk"))
    # n_chunks makes the array's use a second one, so that Spark doesn't fold the cutting into the interpreted lambda
    listed = cutup.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.size("chunks").alias("n_chunks"), F.transform("chunks", lambda c: chunk_hash(c, bits)).alias("ids"))
    listed = cut(listed, "recipes")
    twins = cut(clashes(chunks, bits), "clashes")
    if twins.isEmpty():
        return listed.withColumn("variants", F.lit(None).cast("array<struct<pos:int,variant:int>>"))
    held = cutup.select("doc_id", F.sha2("norm", 256).alias("text_sha256"), F.posexplode("chunks").alias("pos", "chunk"))
    fixed = held.join(twins.select("chunk", "variant"), "chunk").distinct().groupBy("doc_id", "text_sha256").agg(F.array_sort(F.collect_set(F.struct("pos", "variant"))).alias("variants"))
    same = [F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")), F.col("l.text_sha256") == F.col("r.text_sha256")]
    return listed.alias("l").join(fixed.alias("r"), same, "left").select("l.*", "r.variants")


def exact_dedup(docs: DataFrame, bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    known = recipes(docs, bits)
    known = cut(known, "known") if bits != 64 else known
    known = known.withColumn("variants", F.coalesce("variants", F.array().cast("array<struct<pos:int,variant:int>>")))
    # repeated rows are counted, not kept apart: they are equal in every column of the result
    key = ["ids", "variants"]
    each = known.groupBy(*key, "doc_id", "text_sha256").agg(F.count("*").alias("n"))
    group = each.groupBy(*key).agg(F.min("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    joined = spread_join(each, group, key, group.filter(F.col("group_size") > hot_from(known.count())))
    joined = joined.select("doc_id", "keep_id", "group_size", "text_sha256", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("copy"))
    return joined.select("doc_id", "keep_id", F.col("group_size").cast("long").alias("group_size"), (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"), "text_sha256")


def drop_copies(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    judged = cut(exact_dedup(docs), "judged")
    dropped = judged.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count("*").alias("rows"))
    keyed = docs.withColumn("__sha", F.sha2(squeezed(text_of()), 256))
    if not dropped.filter("stays and rows > 1").isEmpty():
        keyed = keyed.dropDuplicates(["doc_id", "__sha"])
    gone = dropped.filter("not stays").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__gone"))
    return keyed.join(gone, [keyed["doc_id"].eqNullSafe(gone["__id"]), F.col("__sha") == F.col("__gone")], "left_anti").drop("__sha")
