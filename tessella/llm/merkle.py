"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections.

Lines are paragraphs; a paragraph's leaves end behind characters that a hash of them and the two before picks, one of
`DENSE` among its first `HEAD` characters, so that a short text has leaves too, one of `RATE` behind them. The hash knows
no alphabet, and a cut depends on nothing but what stands there (and on a cut at least `LEAST` characters before), so
leaves are soon the same as before behind an edit, in any script. A section ends behind a paragraph whose digest says so,
so an edit moves no other section's ends. Inner digests hash their children's. A fingerprint holds the root's 128
bits, each section's and each paragraph's first 32 and the leaves' first 24 bits, arranged as the tree: equal roots mean
equal texts, and where roots differ, sections and then paragraphs whose digests the other tree lacks are walked into,
others aren't. Likeness is the share of leaves in common (twice the shared over all), counted as multisets below
unequal branches. A stretch of over `MOST` characters without a cut, as in a text that
repeats itself, is cut where the hash is largest, the first of equals.

The next document of each comes from one range shuffle by doc_id (and a hash of the text, so rows of one
doc_id, null ones too, spread as well), into about `RANGE_BYTES` of text each: a row meets its successor
within the sorted partition. First and last rows of the partitions, two each, are aggregated from the same
exchange and joined by the partitions' numbers. Nothing comes to the driver but the number of bytes.

Edge cases: null text counts as empty (one empty leaf); null ids come first, rows of one doc_id in order
of their texts' hashes, repeated rows follow each other; a single document follows itself; an empty table
gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import text_of

#: Of so many characters one ends a leaf, near a paragraph's start and behind it; least and most characters of a leaf.
DENSE, HEAD, RATE, LEAST, MOST = 4, 32, 32, 3, 256
RANGE_BYTES = 64 << 20
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
# Odd 64-bit factors of the hash.
_FACTORS = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


def _cuts(text: str) -> tuple[list[int], np.ndarray]:
    """Places behind which leaves end, line feeds' places among them, and the hashes; each paragraph's depend on it alone."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    feed = c == 10
    one, two = np.zeros_like(c), np.zeros_like(c)
    one[1:] = np.where(feed[:-1], 0, c[:-1])
    two[2:] = np.where(feed[:-2] | feed[1:-1], 0, c[:-2])
    h = c * _FACTORS[0] + one * _FACTORS[1] + two * _FACTORS[2]
    h = (h ^ (h >> np.uint64(29))) * _FACTORS[3] >> np.uint64(40)
    at = np.arange(len(c))
    begin = np.zeros(len(c), np.int64)
    begin[1:] = np.maximum.accumulate(np.where(feed, at + 1, 0))[:-1]
    hit = (h % np.uint64(DENSE) == 0) & ((at - begin < HEAD) | (h % np.uint64(RATE) == 0)) & (c != one)
    return np.flatnonzero(hit | feed).tolist(), h


def _split(text: str) -> list[list[str]]:
    """Paragraphs' leaves."""
    out, own, first = [], [], 0
    cuts, h = _cuts(text) if text else ([], None)
    for at in [*cuts, len(text)]:
        feed = at == len(text) or text[at] == "\n"
        end = at if feed else at + 1
        if not feed and end - first < LEAST:
            continue
        while end - first > MOST:
            cut = first + MOST // 2 + int(h[first + MOST // 2 : first + MOST].argmax()) + 1
            own.append(text[first:cut])
            first = cut
        if end > first:
            own.append(text[first:end])
        first = end
        if feed:
            out.append(own or [""])
            own, first = [], at + 1
    return out


def leaves(paragraph: str) -> list[str]:
    """The paragraph's leaves; joined they are the paragraph."""
    return _split(paragraph)[0]


def fingerprint(text: str) -> str:
    """root : sections split by ; each digest = paragraphs split by , each digest . six hex digits a leaf."""
    sections, section, digests, done = [], [], [], []
    leaf_digest, blake = xxhash.xxh3_128_digest, hashlib.blake2b

    def close() -> None:
        done.append(blake(b"s" + b"".join(digests), digest_size=16).digest())
        sections.append(done[-1][:4].hex() + "=" + ",".join(section))
        section.clear()
        digests.clear()

    for paragraph in _split(text):
        own = [leaf_digest(x.encode("utf-8", "surrogatepass")) for x in paragraph]
        digest = blake(b"p" + b"".join(own), digest_size=16).digest()
        section.append(digest[:4].hex() + "." + "".join([d[:3].hex() for d in own]))
        digests.append(digest)
        if digest[0] < 32:
            close()
    if section:
        close()
    return blake(b"r" + b"".join(done), digest_size=16).hexdigest() + ":" + ";".join(sections)


def _paragraphs(section: str) -> list[str]:
    return section[9:].split(",")


def _leaf_count(section: str) -> int:
    n = section.count(",") + 1
    return (len(section) - 9 - 10 * n + 1) // 6


def _lacking(x: list[str], y: list[str], size: int) -> tuple[list[str], list[str], list[str]]:
    """Branches of x and of y whose digests (the first characters) the other lacks, and those in common."""
    left, right = Counter(s[:size] for s in x), Counter(s[:size] for s in y)
    common = left & right

    def rest(branches: list[str]) -> tuple[list[str], list[str]]:
        free, out, met = Counter(common), [], []
        for s in branches:
            held = free[s[:size]] > 0
            free[s[:size]] -= held
            (met if held else out).append(s)
        return out, met

    (a, met), (b, _) = rest(x), rest(y)
    return a, b, met


def unequal(a: str, b: str) -> tuple[list[str], list[str], int]:
    """The paragraphs of two trees, below sections that the other lacks, that the other lacks too; and the leaves of the branches in common."""
    x, y, met = _lacking(a.split(";"), b.split(";"), 8)
    left, right, also = _lacking([p for s in x for p in _paragraphs(s)], [p for s in y for p in _paragraphs(s)], 8)
    return left, right, sum(map(_leaf_count, met)) + sum((len(p) - 9) // 6 for p in also)


def _leaves_of(paragraphs: list[str]) -> Counter:
    return Counter(p[i : i + 6] for p in paragraphs for i in range(9, len(p), 6))


def likeness(a: str, b: str) -> float:
    """1 if the roots are equal, else twice the leaves in common over all leaves."""
    if a[:32] == b[:32]:
        return 1.0
    x, y = a[33:], b[33:]
    left, right, shared = unequal(x, y)
    shared += sum((_leaves_of(left) & _leaves_of(right)).values()) if left and right else 0
    return 2.0 * shared / max(1, sum(_leaf_count(s) for t in (x, y) for s in t.split(";")))


def edit_spans(a: str, b: str) -> list[int]:
    """Indices of the paragraphs of a whose branch b lacks."""
    missing, out, at = Counter(unequal(a[33:], b[33:])[0]), [], 0
    for s in a[33:].split(";"):
        for p in _paragraphs(s):
            if missing[p]:
                missing[p] -= 1
                out.append(at)
            at += 1
    return out


def edited(text: str, following: str) -> str:
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


def _compare(doc_id: int | None, text: str, own: str, following: str, then: str) -> tuple:
    """A row of OUT."""
    new = edited(text, following)
    made = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new.encode("utf-8", "surrogatepass")).hexdigest(), own, made, likeness(own, made), likeness(own, then)


_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], [c.split()[0] for c in OUT.split(", ")])


def _line_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of OUT for all of a sorted partition but the last."""
    held: tuple | None = None  # doc_id, text, fingerprint
    for b in batches:
        rows, size = [], 0
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            text = text.as_py()
            own = fingerprint(text)
            if held is not None:
                rows.append(_compare(*held, text, own))
                size += len(rows[-1][4]) * 2
            held = doc_id, text, own
            if size > 1 << 23:
                yield _batch(rows)
                rows, size = [], 0
        if rows:
            yield _batch(rows)


def _close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for doc_id, text, following in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "following")), strict=True):
            yield _batch([_compare(doc_id, text, fingerprint(text), following, fingerprint(following))])


def trace_edits(docs: DataFrame, ranges: int | None = None) -> DataFrame:
    """One row per document: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    if ranges is None:
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // RANGE_BYTES))
    dealt = rows.withColumn("h", F.xxhash64("text")).repartitionByRange(ranges, F.col("doc_id").asc_nulls_first(), F.col("h").asc())
    lined = dealt.sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "h", "text").select("doc_id", "text").mapInArrow(_line_up, OUT)
    # first and last row of each partition, from the same exchange; what follows a partition's last row is the first of the next one that has rows
    row = F.struct("doc_id", "h", "text")  # null sorts first in a struct too
    ends = dealt.withColumn("part", F.spark_partition_id()).groupBy("part").agg(F.min(row).alias("first"), F.max(row).alias("last"))
    ends = ends.filter("first is not null and last is not null")  # always so; it keeps all columns in use, so that the three uses share one exchange and its bounds
    every = Window.partitionBy(F.lit(0))
    after = ends.select("part").select(F.col("part").alias("before"), F.coalesce(F.lead("part").over(every.orderBy("part")), F.min("part").over(every)).alias("part"))
    last = ends.select(F.col("part").alias("before"), "last.doc_id", "last.text")
    met = last.join(after, "before").join(ends.select("part", F.col("first.text").alias("following")), "part")
    return lined.unionByName(met.select("doc_id", "text", "following").mapInArrow(_close, OUT))
