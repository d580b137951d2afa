"""SimHash near-dedup with deletion-variant signatures.

A 64-bit fingerprint is cut into three segments. Two fingerprints that differ in at most four bits
have a segment in which they differ in at most one (three segments with two bits each would make
six), so they agree on that segment once the right bit is taken out of it. Every distinct
fingerprint is indexed under its 64 one-wildcard segment variants; equal variants meet, and what
meets is verified on all 64 bits. Documents with equal fingerprints are one node: copies are never
paired.

Rows that share a variant are a bucket. Within a bucket only a spanning forest of its links is
emitted (at most one link less than members), found by numpy over the sorted index, bucket by
bucket. A bucket over `BLOCK` distinct fingerprints is cut into blocks and its pairs of blocks are
dealt to tasks of their own, so no bucket is capped and none is held whole. A variant fixes 20 or 21
bits: a bucket of evenly spread fingerprints grows with their number (1e4 of 1e10), and the work of
comparing with its square; wider fingerprints or more segments would be the way beyond that. Components come from
alternating large-star and small-star steps over the links, written to the shared folder each round.

Edge cases: null text counts as empty; texts without words have fingerprint 0 and are linked like any
other; a null doc_id never names a component unless the component has no other; rows of one doc_id are
judged one by one; an empty table gives an empty result; columns other than doc_id and text are
ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, hot_from, spread_join, text_of

SEGMENTS = ((0, 21), (21, 21), (42, 22))  # first bit, bits
MAX_BITS = 4
#: Distinct fingerprints of one bucket that a task compares by itself.
BLOCK = 16384
SMALL = 12


def fingerprint(data: bytes, width: int = 4) -> int:
    """The SimHash of a text's UTF-8 bytes: a bit is set if it is in over half of the word shingles' hashes."""
    words = data.lower().split()  # of bytes: A-Z only, and white space is space and tab to carriage return
    if not words:
        return 0
    joined, n = b" ".join(words), len(words)
    digest = xxhash.xxh64_intdigest
    if n <= width:
        return digest(joined, 42)
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    hashes = np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n - width + 1)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 14):
        part = hashes[at : at + (1 << 14)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = ones * 2 > len(hashes)
    return int(np.packbits(bits, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in b.column("data")), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def index(nodes: DataFrame) -> DataFrame:
    """fp -> key, fp: a row for each one-wildcard segment variant. A key is the wildcard's place (which names the segment) and the segment without it."""
    fp, keys = F.col("fp"), []
    for first, bits in SEGMENTS:
        segment = F.shiftrightunsigned(fp, first).bitwiseAND(F.lit((1 << bits) - 1))
        keys += [segment.bitwiseAND(F.lit(~(1 << i))).bitwiseOR(F.lit((first + i) << 22)) for i in range(bits)]
    return nodes.select(F.explode(F.array(*keys)).alias("key"), "fp")


def _differ(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x.view(np.uint64))  # of a signed number numpy counts the bits of its magnitude


def _forest(fps: np.ndarray) -> list[np.ndarray]:
    """Links, as two columns, of the components of the fingerprints within MAX_BITS of each other: each component a star around its first."""
    left, links = fps, []
    while len(left) > 1:
        first, front, left = left[0], [left[0]], left[1:]
        while front and len(left):
            near = _differ(left ^ front.pop()) <= MAX_BITS
            if near.any():
                found = left[near]
                links.append(np.column_stack([np.full(len(found), first, np.int64), found]))
                front.extend(found)
                left = left[~near]
    return links


def _links_of_runs(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links within each run of equal keys."""
    found = []
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    size = np.diff(edge)
    for at, n in zip(edge[:-1][size > SMALL], size[size > SMALL], strict=True):
        found += _forest(fp[at : at + n])
    small = np.repeat(size <= SMALL, size)
    key, fp = key[small], fp[small]
    for d in range(1, SMALL):
        near = np.flatnonzero(key[d:] == key[:-d])
        if not len(near):
            break
        near = near[_differ(fp[near] ^ fp[near + d]) <= MAX_BITS]
        found.append(np.column_stack([fp[near], fp[near + d]]))
    return np.unique(np.concatenate(found), axis=0) if found else np.empty((0, 2), np.int64)


def _link_batches(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    names = ["a", "b", "key", "block"]

    def links(pairs: np.ndarray) -> pa.RecordBatch:
        n = len(pairs)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1])), pa.nulls(n, pa.int64()), pa.nulls(n, pa.int32())], names)

    held_key = held_fp = np.empty(0, np.int64)
    large, sent = None, 0  # the key of a bucket over `block`, and its rows handed on so far
    for b in batches:
        key, fp = np.concatenate([held_key, b.column("key").to_numpy()]), np.concatenate([held_fp, b.column("fp").to_numpy()])
        if large is not None or (len(key) and key[0] == key[-1] and len(key) > block):
            large, sent = (key[0], 0) if large is None else (large, sent)
            n = int(np.searchsorted(key, large, "right"))
            at = sent + np.arange(n)
            yield pa.RecordBatch.from_arrays([pa.array(fp[:n]), pa.nulls(n, pa.int64()), pa.array(key[:n]), pa.array((at // block).astype(np.int32))], names)
            sent, key, fp = sent + n, key[n:], fp[n:]
            if not len(key):
                held_key, held_fp = key, fp
                continue
            large, sent = None, 0
        last = int(np.searchsorted(key, key[-1], "left")) if len(key) else 0
        if last:
            yield links(_links_of_runs(key[:last], fp[:last]))
        held_key, held_fp = key[last:], fp[last:]
    if len(held_key):
        yield links(_links_of_runs(held_key, held_fp))


def links(nodes: DataFrame, block: int = BLOCK) -> DataFrame:
    """fp -> a, b: links whose components are those of all pairs within MAX_BITS."""
    parts = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = nodes.repartition(parts, "fp")  # a row becomes 64: few tasks that are small now would be the slowest
    dealt = index(spread).repartition("key").sortWithinPartitions("key", "fp")
    found = cut(dealt.mapInArrow(lambda it: _link_batches(it, block), "a long, b long, key long, block int"), "links")
    pairs = found.filter("key is null").select("a", "b")
    large = found.filter("key is not null").select("key", "block", F.col("a").alias("fp"))
    if not large.isEmpty():
        blocks = large.groupBy("key").agg(F.max("block").alias("most"))
        met = large.join(blocks, "key").select("key", "fp", "block", F.explode(F.sequence(F.lit(0), "most")).alias("other"))
        met = met.select("key", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "fp")

        def meet(t: pa.Table) -> pa.Table:
            out = _forest(t.column("fp").to_numpy())
            out = np.concatenate(out) if out else np.empty((0, 2), np.int64)
            return pa.table({"a": np.ascontiguousarray(out[:, 0]), "b": np.ascontiguousarray(out[:, 1])})

        pairs = pairs.unionByName(met.groupBy("key", "lo", "hi").applyInArrow(meet, "a long, b long"))
    return pairs.distinct()


def components(pairs: DataFrame) -> DataFrame:
    """a, b -> node, root: the smallest node of each node's component, for all nodes with a link but the roots. Rounds grow with the logarithm of a component's diameter.
    A hub of many links is no task of its own: what belongs to a hot node is broadcast to its links."""
    edges, was = cut(pairs.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges"), None
    while True:
        print_of = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now := (print_of["n"], print_of["s"])) == was or not now[0]:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        was, most = now, hot_from(now[0])
        ends = edges.select(F.explode(F.array(F.struct(F.lit("u").alias("end"), F.col("u").alias("node")), F.struct(F.lit("v").alias("end"), F.col("v").alias("node")))).alias("e")).select("e.*") if now[0] > most else None
        hubs = {r["end"] for r in ends.groupBy("end", "node").count().filter(F.col("count") > most).select("end").distinct().collect()} if ends is not None else set()
        up = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))  # each link from its smaller end
        least = edges.union(up).groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.sum((F.col("v") > F.col("u")).cast("long")).alias("n")).filter("n > 0")
        large = spread_join(up, least.select("u", "m"), ["u"], least.filter(F.col("n") > most).select("u", "m") if "v" in hubs else None)
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = spread_join(large, low.select("u", "m"), ["u"], low.filter(F.col("n") > most).select("u", "m") if "u" in hubs else None)
        edges = cut(small.filter("v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", "m")).distinct(), "edges", instead=edges)


def assign(known: DataFrame, node: str, roots: DataFrame) -> DataFrame:
    """known (a written table): doc_id, node column, ...; roots: node, root. Adds component_id, the smallest doc_id of the node's component. Copies of one text and members of one component are spread over tasks."""
    most = hot_from(known.count())
    nodes = known.groupBy(node).agg(F.min("doc_id").alias("rep"), F.count("*").alias("rows"))
    named = cut(nodes.join(roots.withColumnRenamed("node", node), node, "left").withColumn("root", F.coalesce("root", node)), "named")
    of_root = cut(named.groupBy("root").agg(F.min("rep").alias("component_id"), F.count("*").alias("nodes")), "roots")
    hot = lambda df, n: None if (found := df.filter(F.col(n) > most).drop(n)).isEmpty() else found
    of_node = cut(spread_join(named, of_root.drop("nodes"), ["root"], hot(of_root, "nodes")).select(node, "component_id", "rows"), "components")
    return spread_join(known, of_node.drop("rows"), [node], hot(of_node, "rows"))


def near_dedup(docs: DataFrame, width: int = 4, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, fp, component_id."""
    known = cut(fingerprints(docs, width), "fingerprints")
    roots = components(links(known.select("fp").distinct(), block))
    return assign(known, "fp", roots).select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, near: Callable[[DataFrame], DataFrame] = near_dedup) -> DataFrame:
    """The rows of docs whose doc_id names their component under `near`; rows of one doc_id go or stay together."""
    judged = near(docs).groupBy("doc_id").agg(F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays"))
    gone = judged.filter("not stays").select(F.col("doc_id").alias("__id"))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["__id"]), "left_anti")
