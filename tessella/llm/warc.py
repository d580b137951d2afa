"""A content-addressed archive of WARC records, as DataFrame operations.

An archive is two tables in the shared folder: `payloads`, where every payload's bytes stand once under their
SHA-256, and `heads`, with a row per record: all of its bytes before the payload, exactly (WARC header, HTTP header
and their blank lines). A record is its head, its payload unless it is a revisit, and two line ends; `records` puts
them together again by joins, `export` writes them as WARC files.

Payloads are grouped by digest and bytes, so equality is verified byte for byte, and a digest that two payloads share
stops the archive. Each payload is moved once: `payloads` is laid out in buckets of the digest, and so are the heads
of responses with a payload of `LEAST` bytes or more, of which a payload has one; these meet bucket by bucket without
another shuffle. Copies of a hot payload are put together where they are read. Only shorter payloads have many
responses, so the hot ones among them are few and small (`HOT` keys of under `LEAST` bytes) and are broadcast. Heads
are made from narrow rows: what is known of a hot digest is broadcast to its pages.

Of pages with equal payloads of `LEAST` bytes or more, the one with the largest id is archived as response and the
others as revisits that refer to it; shorter ones are all responses.

Edge cases: null html is an empty payload; a null id is smaller than any other and its record has `null` in place of
the id; rows that repeat the largest id of their payload are responses all, and pages of one id may differ; line ends, controls and `%` in a URL are
percent-encoded, a null URL is left out; payloads may hold blank lines or whole WARC records, since a record's
length decides where it ends; a very long payload is one row; an empty table gives an empty archive; columns other
than page_id, url and html are ignored, whatever their names.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import _path, cut, hot_from, shared_dir, spread_join

#: Payloads of so many bytes are archived once, the others with each record.
LEAST = 1000
BUCKET_BYTES = 64 << 20
END = "\r\n"
DATE = "1970-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    payloads: DataFrame  # digest, payload
    heads: DataFrame  # page_id, digest, kind, head: revisits, and responses to payloads under LEAST bytes
    single: DataFrame  # the same, of responses to longer payloads
    often: DataFrame | None  # digest: those of hot payloads, at most HOT; None: there are none
    hot_rows: int  # a key of more rows than this is hot


def _bucketed(df: DataFrame, tag: str, buckets: int, by: str) -> DataFrame:
    """df written into the shared folder in buckets of a column that it is already dealt by. The catalog knows the table only until it is read; its files go with the driver."""
    spark = df.sparkSession
    name = f"tessella_{tag}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/tessella/{name}"
    df.write.bucketBy(buckets, by).option("path", path).saveAsTable(name)
    fs, at = _path(spark, path)
    fs.deleteOnExit(at)
    out = spark.read.table(name)  # resolved here, before its name goes
    spark.sql(f"DROP TABLE {name}")
    return out


def _digests(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))


def _uri(url: Column) -> Column:
    for c in ["%", *(chr(k) for k in range(32)), "\x7f"]:
        url = F.replace(url, F.lit(c), F.lit(f"%{ord(c):02X}"))
    return F.when(F.col("url").rlike(r"[%\x00-\x1f\x7f]"), url).otherwise(F.col("url"))


def _id(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def _head() -> Column:
    """The bytes of a record before its payload, from page_id, url, digest, sha1, bytes, keeper and kind."""
    line = lambda name, *value: F.concat(F.lit(name + ": "), *value, F.lit(END))
    revisit = F.col("kind") == "revisit"
    length = F.when(revisit, F.lit(len(HTTP))).otherwise(F.col("bytes") + len(HTTP))
    return F.concat(
        F.lit("WARC/1.1" + END),
        line("WARC-Type", F.col("kind")),
        line("WARC-Record-ID", _id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNull(), F.lit("")).otherwise(line("WARC-Target-URI", _uri(F.col("url")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _id(F.col("keeper"))))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.lit("sha1:"), F.col("sha1")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(END + HTTP),
    )


def archive(pages: DataFrame, buckets: int | None = None) -> Archive:
    """The pages' archive, written."""
    spark = pages.sparkSession
    rows = _digests(pages)
    facts = cut(rows.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count("*").alias("rows"), F.max(F.octet_length("payload")).cast("long").alias("bytes")), "facts")
    n, most, size = facts.agg(F.sum("rows"), F.max("rows"), F.sum("bytes")).first()
    if buckets is None:
        buckets = min(max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size or 0) // BUCKET_BYTES)), 100_000)
    hot_rows = hot_from(n or 0)
    often = facts.filter(F.col("rows") > hot_rows).select("digest") if (most or 0) > hot_rows else None

    # a payload moves once; copies of hot ones are put together where they are read
    alike = lambda df: df.groupBy("digest", "payload").count().select("digest", "payload")
    stored = rows.select("digest", "payload")
    once = alike((stored if often is None else stored.join(F.broadcast(often), "digest", "left_anti")).repartition(buckets, "digest"))
    if often is not None:
        once = once.unionByName(alike(stored.join(F.broadcast(often), "digest", "left_semi")).repartition(buckets, "digest"))
    payloads = _bucketed(once, "payloads", buckets, "digest")
    if payloads.select("digest").count() != facts.count():
        raise ValueError("two different payloads have the same SHA-256 digest")

    known = facts.select("digest", "keeper")
    pages_ = rows.select("page_id", "url", "digest", F.octet_length("payload").alias("bytes"), F.sha1("payload").alias("sha1"))
    made = spread_join(pages_, known, ["digest"], None if often is None else known.join(often, "digest", "left_semi"))
    kind = F.when((F.col("bytes") < LEAST) | F.col("page_id").eqNullSafe(F.col("keeper")), F.lit("response")).otherwise(F.lit("revisit"))
    made = made.withColumn("kind", kind).withColumn("single", (F.col("kind") == "response") & (F.col("bytes") >= LEAST))
    heads = cut(made.select("page_id", "digest", "kind", "single", _head().alias("head")), "heads")
    single = _bucketed(heads.filter("single").drop("single").repartition(buckets, "digest"), "single", buckets, "digest")
    return Archive(payloads, heads.filter("not single").drop("single"), single, often, hot_rows)


def records(held: Archive) -> DataFrame:
    """page_id, record: all records, rebuilt byte for byte."""
    whole = lambda *parts: F.concat(F.col("head").cast("binary"), *parts, F.lit(END + END).cast("binary")).alias("record")
    short = held.payloads.filter(F.octet_length("payload") < LEAST)
    hot = None if held.often is None else short.join(F.broadcast(held.often), "digest", "left_semi")
    return (
        held.single.join(held.payloads.hint("merge"), "digest").select("page_id", whole(F.col("payload")))
        .unionByName(spread_join(held.heads.filter("kind = 'response'"), short, ["digest"], hot).select("page_id", whole(F.col("payload"))))
        .unionByName(held.heads.filter("kind = 'revisit'").select("page_id", whole()))
    )


def parse(found: DataFrame) -> DataFrame:
    """record_id, record_type, refers_to_id, target_uri, payload_digest, payload of each record, from its bytes alone; a record that is not as long as it says stops the job."""
    text = F.col("record").cast("string")
    rows = found.select(F.substring_index(text, END + END, 1).alias("_header"), F.col("record"))
    field = lambda name: F.nullif(F.regexp_extract(F.concat(F.lit("\n"), F.col("_header")), rf"\n{name}: ([^\r\n]*)", 1), F.lit(""))
    rows = rows.withColumn("_from", F.octet_length("_header") + 4).withColumn("_length", field("Content-Length").cast("int"))
    whole = F.octet_length("record") == F.col("_from") + F.col("_length") + 4
    block = F.when(whole, F.expr("substring(record, _from + 1, _length)")).otherwise(F.raise_error(F.concat(F.lit("a record isn't as long as it says: "), F.coalesce(field("WARC-Record-ID"), F.lit("no id")))))
    return rows.select(
        field("WARC-Record-ID").alias("record_id"), field("WARC-Type").alias("record_type"), field("WARC-Refers-To").alias("refers_to_id"), field("WARC-Target-URI").alias("target_uri"),
        field("WARC-Payload-Digest").alias("payload_digest"), F.substring(block, len(HTTP) + 1, 2**31 - 1).alias("payload"),
    )


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")


def read_back(held: Archive) -> DataFrame:
    """page_id, record_type, refers_to, payload_bytes, payload_digest: read from the records; a revisit's payload is that of the response it refers to. A payload whose SHA-1 isn't its record's stops the job."""
    got = parse(records(held))
    kept = F.sha1("payload")
    said = F.regexp_extract("payload_digest", "^sha1:([0-9a-f]{40})$", 1)
    digest = F.when((F.col("record_type") == "revisit") | (kept == said), said).otherwise(F.raise_error(F.concat(F.lit("a payload isn't what its record says: "), F.col("record_id"))))
    got = cut(got.select(page_of(F.col("record_id")).alias("page_id"), "record_type", page_of(F.col("refers_to_id")).alias("refers_to"), F.octet_length("payload").cast("long").alias("payload_bytes"), digest.alias("payload_digest")), "read")
    responses, revisits = got.filter("record_type = 'response'"), got.filter("record_type = 'revisit'").drop("payload_bytes")
    on = ["refers_to", "payload_digest"]  # pages of one id may differ
    meant = responses.select(F.col("page_id").alias("refers_to"), "payload_digest", "payload_bytes").distinct()
    hot = None
    if held.often is not None:
        often = revisits.groupBy(*on).count().filter(F.col("count") > held.hot_rows).select(*on)
        hot = meant.join(often, on, "left_semi")
    return responses.unionByName(spread_join(revisits, meant, on, hot))


def export(found: DataFrame, path: str, files: int | None = None) -> None:
    """Records as WARC files: every record ends with two line ends, which stand as the line separator of a text file."""
    body = F.expr("cast(substring(record, 1, octet_length(record) - 4) as string)")
    rows = found.select(body.alias("value"))
    (rows.repartition(files) if files else rows).write.option("lineSep", END + END).text(path)


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for held in b.column("content"):
            held, at, out, size = held.as_py(), 0, [], 0
            while at < len(held):
                head = held.index(b"\r\n\r\n", at) + 4
                length = next(int(line[15:]) for line in held[at:head].split(b"\r\n") if line[:15].lower() == b"content-length:")
                out.append(held[at : head + length + 4])
                if not out[-1].endswith(b"\r\n\r\n"):
                    raise ValueError(f"a WARC record at {at} isn't as long as it says")
                at, size = head + length + 4, size + len(out[-1])
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                    out, size = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """The records of uncompressed WARC files, as column record; a file, which must be below 2 GB, is one task's work."""
    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(_split, "record binary")
