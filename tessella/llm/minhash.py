"""Near copies by the Jaccard likeness of their word shingles.

MinHash only proposes: `BANDS` bands of `ROWS` least hashes each, and documents that agree on a band
are linked loosely. Two documents of likeness 0.8 agree on none with a chance of
(1 - 0.8 ** ROWS) ** BANDS = 5e-6, likelier ones with less; this is the only way a pair is lost.
What counts is decided on the whole shingle sets of the documents that are linked loosely; these are made
anew from their texts, so the sets of all others are never stored or moved.

A loose component over `BLOCK` sets is cut into blocks, so none is capped and none is held whole. First
each block is searched by itself; then one set of each group found meets those of the others; at last
sets of different groups meet, block by block, and those of one group don't: a group of very many near
copies costs in proportion to its size, and what is compared by pairs of blocks is what is really apart.
Of the links found in a block only a spanning forest is emitted. Documents with equal sets are one node: copies are never paired.

Edge cases: words are those of SimHash; null text counts as empty; a text of fewer words than a shingle
is one shingle; texts without words are one node; a null doc_id never names a component unless the
component has no other; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, hot_from, spread_join, text_of
from .simhash import assign, components

WIDTH = 5
LIKENESS = 0.8
BANDS, ROWS = 40, 6
#: Sets of one loose component that a task compares by itself.
BLOCK = 512

_RNG = np.random.default_rng(42)
_MASK, _MIX, _BAND = (_RNG.integers(0, 2**64, BANDS * ROWS, np.uint64) | np.uint64(odd) for odd in (0, 1, 1))


def shingles(data: bytes, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of a text's word shingles."""
    words = data.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined, n, digest = b" ".join(words), len(words), xxhash.xxh64_intdigest
    if n <= width:
        return np.array([digest(joined, 42)], np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, n) + 1
    ends = np.cumsum(sizes) - 1
    starts = ends - sizes + 1
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(starts[: n - width + 1].tolist(), ends[width - 1 :].tolist(), strict=True)), np.uint64, n - width + 1))


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A key for each band, of its least hashes."""
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[at : at + 1024, None] ^ _MASK) * _MIX).min(0))
    return (((least ^ (least >> np.uint64(29))) * _BAND).reshape(BANDS, ROWS)).sum(1, dtype=np.uint64)


def _node(own: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(own.tobytes(), 42) if len(own) else 0


def _lists(parts: list[np.ndarray]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, parts)]), pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.uint64)]).view(np.int64)))


def sketches(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """doc_id, said (a hash of the text), node (names the shingle set), keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                nodes, keys = np.empty(part.num_rows, np.uint64), []
                for k, data in enumerate(part.column("data")):
                    own = shingles(data.as_py(), width)
                    nodes[k] = _node(own)
                    keys.append(band_keys(own) if len(own) else own)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("said"), pa.array(nodes.view(np.int64)), _lists(keys)], ["doc_id", "said", "node", "keys"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of()).alias("said"), text_of().cast("binary").alias("data"))
    return rows.mapInArrow(run, "doc_id long, said long, node long, keys array<long>")


def sets_of(docs: DataFrame, known: DataFrame, nodes: DataFrame, width: int = WIDTH) -> DataFrame:
    """node, hashes: the shingle sets of the nodes, each from one document's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                sets = [shingles(x.as_py(), width) for x in b.column("data").slice(at, 1024)]
                yield pa.RecordBatch.from_arrays([pa.array(np.array([_node(x) for x in sets], np.uint64).view(np.int64)), _lists(sets)], ["node", "hashes"])

    one = known.select("node", F.struct(F.col("doc_id").isNull().alias("bare"), "doc_id", "said").alias("row")).groupBy("node").agg(F.min("row").alias("row")).join(nodes, "node")
    ids = one.select(F.col("row.doc_id").alias("__id"), F.col("row.said").alias("__said")).distinct()
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    rows = rows.join(ids, rows["doc_id"].eqNullSafe(ids["__id"]) & (F.xxhash64("text") == F.col("__said")), "left_semi")
    return rows.select(F.col("text").cast("binary").alias("data")).mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def forest(flat: np.ndarray, ends: np.ndarray, likeness: float) -> list[tuple[int, int]]:
    """Links, by position, of the components of the sets with at least the likeness, each a star around its first; set i is flat[ends[i]:ends[i + 1]]."""
    names, flat = np.unique(flat, return_inverse=True)
    size, links = np.diff(ends), []
    left, held = np.ones(len(size), bool), np.zeros(len(names), bool)
    for first in range(len(size)):
        if not left[first]:
            continue
        left[first], front = False, [first]
        while front and left.any():
            x = front.pop()
            own = flat[ends[x] : ends[x + 1]]
            held[own] = True
            at = np.flatnonzero(left & (size >= likeness * size[x]) & (size[x] >= likeness * size))
            if len(at):
                each = size[at]
                place = np.repeat(ends[at] - np.r_[0, np.cumsum(each)[:-1]], each) + np.arange(each.sum())
                both = np.add.reduceat(held[flat[place]].astype(np.int64), np.r_[0, np.cumsum(each)[:-1]])
                found = at[both >= likeness * (each + size[x] - both) - 1e-9]
                links += [(first, y) for y in found.tolist()]
                left[found] = False
                front += found.tolist()
            held[own] = False
    return links


def _meet(likeness: float):
    def meet(t: pa.Table) -> pa.Table:
        node, hashes = t.column("node").to_numpy(), t.column("hashes").combine_chunks()
        ends = np.r_[0, np.cumsum(hashes.value_lengths().to_numpy())]
        pairs = np.array(forest(hashes.flatten().to_numpy(), ends, likeness), np.int64).reshape(-1, 2)
        return pa.table({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    return meet


def across(sets: DataFrame, likeness: float, block: int) -> DataFrame:
    """root, c, node, hashes (a written table) -> a, b: links between sets of one root and different c. A c of many sets has blocks of its own, which meet all blocks but each other; small ones share blocks."""
    of_c = sets.groupBy("root", "c").agg(F.count("*").alias("own"))
    small = F.when(F.col("own") * 2 <= block, F.col("own")).otherwise(0)
    of_c = of_c.withColumn("small", F.sum(small).over(Window.partitionBy("root"))).withColumn("others", F.count("*").over(Window.partitionBy("root")) - 1).filter("others > 0")
    shared = F.col("own") * 2 <= block
    # the numbers of blocks a c is dealt to, and whose they are: a hash of c, or 0 for shared ones
    of_c = of_c.select("root", "c", "own", F.ceil(F.when(shared, F.col("small")).otherwise(F.col("own")) / block).cast("int").alias("n"), F.when(shared, F.lit(None)).otherwise(F.col("c")).alias("owner"))
    name = F.when(F.col("owner").isNull(), F.pmod(F.xxhash64("c"), "n")).otherwise(F.pmod(F.xxhash64("node"), "n")).cast("int")
    of_c = cut(of_c, "groups")
    hot = of_c.filter(F.col("own") > hot_from(sets.count())).drop("own")
    placed = cut(spread_join(sets, of_c.drop("own"), ["root", "c"], hot).withColumn("block", name), "placed")
    blocks = placed.select("root", F.coalesce("owner", F.lit(0)).alias("o"), F.col("owner").isNull().alias("mixed"), "block").distinct()
    left, right = blocks.select("root", *[F.col(x).alias(f"{x}_l") for x in ("o", "mixed", "block")]), blocks.select("root", *[F.col(x).alias(f"{x}_r") for x in ("o", "mixed", "block")])
    key = lambda side: F.struct(*[F.col(f"{x}_{side}").alias(x) for x in ("o", "mixed", "block")])
    pairs = left.join(right, "root").filter((key("l") <= key("r")) & (F.col("mixed_l") | F.col("mixed_r") | (F.col("o_l") != F.col("o_r"))))
    pairs = pairs.select("root", F.xxhash64(key("l"), key("r")).alias("pair"), F.explode(F.array_distinct(F.array(key("l"), key("r")))).alias("side")).select("root", "pair", "side.*")
    met = placed.select("root", "node", "hashes", F.coalesce("owner", F.lit(0)).alias("o"), F.col("owner").isNull().alias("mixed"), "block").join(pairs, ["root", "o", "mixed", "block"])
    return met.select("root", "pair", "node", "hashes").groupBy("root", "pair").applyInArrow(_meet(likeness), "a long, b long")


def links(docs: DataFrame, known: DataFrame, width: int = WIDTH, likeness: float = LIKENESS, block: int = BLOCK) -> DataFrame:
    """known: the sketches of docs (a written table) -> a, b: links whose components are those of all proposed pairs with the likeness."""
    keyed = known.select("node", F.explode("keys").alias("key"))
    buckets = cut(keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count("*").alias("n")).filter("least < most"), "buckets").drop("most")
    hot = buckets.filter(F.col("n") > hot_from(known.count() * BANDS)).drop("n")
    met = spread_join(keyed, buckets.drop("n"), ["key"], None if hot.isEmpty() else hot)
    loose = components(met.filter("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b")))
    loose = cut(loose.union(loose.select("root", "root").distinct()), "loose")
    sizes = cut(loose.groupBy("root").agg(F.count("*").alias("members")), "members")
    hot = sizes.filter(F.col("members") > hot_from(loose.count()))
    placed = spread_join(loose, sizes, ["root"], None if hot.isEmpty() else hot).withColumn("n", F.ceil(F.col("members") / block).cast("int"))
    sets = cut(sets_of(docs, known, loose.select("node"), width).join(placed.select("node", "root", "n"), "node"), "sets")
    own = sets.withColumn("block", F.pmod(F.xxhash64("node"), "n").cast("int")).select("root", "block", "node", "hashes")
    found = cut(own.groupBy("root", "block").applyInArrow(_meet(likeness), "a long, b long"), "alike")
    large = sets.filter("n > 1").select("root", "node", "hashes")
    if large.isEmpty():
        return found

    def judged(rows: DataFrame, tag: str) -> DataFrame:
        c = components(found).withColumnRenamed("root", "c")
        return cut(rows.join(c, "node", "left").withColumn("c", F.coalesce("c", "node")), tag)

    # one set of each group found so far, then whatever is still apart: sets of one group need not meet
    large = judged(large, "judged")
    found = cut(found.union(across(cut(large.filter("c = node"), "heads"), likeness, block)), "alike", instead=found)
    return found.union(across(judged(large.drop("c"), "judged"), likeness, block))


def near_dedup(docs: DataFrame, width: int = WIDTH, likeness: float = LIKENESS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, component_id."""
    known = cut(sketches(docs, width), "sketches")
    return assign(known.select("doc_id", "node"), "node", components(links(docs, known, width, likeness, block))).select("doc_id", "component_id")
