"""A Merkle manifest of a dataset: a ternary hash tree for each source, a tree over the sources' roots, and every
row's authentication path.

Leaves are digests that Spark computes where the texts are read, so no text is moved. Sorted by source and id, they
are numbered through the sorted partitions' counts and cut into aligned blocks of 3 ** `HEIGHT` = 729 consecutive
leaves. A block is a subtree, whatever stands beside it, and blocks' roots are the leaves of the next layer (1e11 rows
need four), whose paths are made first. Within a block, paths come from a fractal traversal: the six levels are
stacked bands of `BAND` levels; for each band the subtree that holds the current leaf's siblings is kept, and the
one after it grows by a leaf a round (its base nodes by a tree hash with at most two open digests a level), so that
it is whole when it is wanted. A block's own steps are followed by those of its root, which meet it by an equality
join on the block (a cogroup). No task holds more than a block, and no source is a group of any shuffle.

H is SHA-256 as lower-case hex text over concatenated texts. A run of fewer than three nodes at the end of a level,
even one, becomes its H like any other, until one node remains.

Edge cases: nulls are `-`, told apart from empty texts by their missing length; a null id comes first and reads as no
id, a null source is a source of its own, before all others; rows of one id are ordered by leaf, so repeated rows
are interchangeable; very long texts are only hashed; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, key_of

#: Levels of a block (3 ** HEIGHT leaves) and of a band of the traversal.
HEIGHT, BAND = 6, 2
#: Rows of a range of the sort.
ROWS = 500_000
PATH = "array<struct<place:int,others:array<string>>>"
_STEP = pa.struct([("place", pa.int32()), ("others", pa.list_(pa.string()))])


def digest(*values: Column) -> Column:
    """H of the values: `-` if null, else UTF-8 byte count, `:`, value."""
    said = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in said]), 256)


def fold(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its path lead to."""

    def step(own: Column, s: Column) -> Column:
        left, right = F.slice(s["others"], F.lit(1), s["place"]), F.slice(s["others"], s["place"] + 1, F.lit(2))
        return F.sha2(F.concat(F.array_join(left, ""), own, F.array_join(right, "")), 256)

    return F.aggregate(path, leaf, step)


def siblings(path: Column) -> Column:
    """All siblings' digests, level by level, as one text."""
    return F.array_join(F.flatten(F.transform(path, lambda s: s["others"])), "")


def _h(nodes: list[str]) -> str:
    return hashlib.sha256("".join(nodes).encode()).hexdigest()


def levels(n: int, height: int = HEIGHT) -> int:
    """Levels of a block that belongs to a group of n nodes."""
    up = 0
    while n > 1 and up < height:
        n, up = -(-n // 3), up + 1
    return up


class _Subtree:
    """The nodes at levels base to top - 1 below one node at level top, growing leaf by leaf; below base only open runs are held."""

    def __init__(self, leaves: list[str], base: int, top: int, index: int):
        self.base, self.top = base, top
        self.open: list[list[str]] = [[] for _ in range(top)]
        self.kept: list[list[str]] = [[] for _ in range(top - base)]
        self.root: str | None = None
        self.leaves = iter(leaves[index * 3**top : (index + 1) * 3**top])

    def _put(self, level: int, node: str) -> None:
        if level == self.top:
            self.root = node
            return
        if level >= self.base:
            self.kept[level - self.base].append(node)
        run = self.open[level]
        run.append(node)
        if len(run) == 3:
            self.open[level] = []
            self._put(level + 1, _h(run))

    def grow(self) -> bool:
        leaf = next(self.leaves, None)
        if leaf is not None:
            self._put(0, leaf)
        return leaf is not None

    def close(self) -> _Subtree:
        """All leaves that are left, then the runs that stay short."""
        while self.grow():
            pass
        for level in range(self.top):
            if run := self.open[level]:
                self.open[level] = []
                self._put(level + 1, _h(run))
        return self


def root(leaves: list[str], height: int) -> str:
    return _Subtree(leaves, height, height, 0).close().root if height else leaves[0]


def traverse(leaves: list[str], height: int, band: int = BAND) -> Iterator[list[tuple[int, list[str]]]]:
    """For each leaf in turn its steps, bottom first: its place in its run and the run's other nodes."""
    bases = list(range(0, height, band))
    tops = [min(b + band, height) for b in bases]
    existing = [_Subtree(leaves, b, t, 0).close() for b, t in zip(bases, tops, strict=True)]
    desired = [_Subtree(leaves, b, t, 1) for b, t in zip(bases, tops, strict=True)]
    for j in range(len(leaves)):
        steps = []
        for i, (b, t) in enumerate(zip(bases, tops, strict=True)):
            size = 3**t
            if j and j % size == 0:
                existing[i], desired[i] = desired[i].close(), _Subtree(leaves, b, t, j // size + 1)
            for level in range(b, t):
                nodes = existing[i].kept[level - b]
                at = j % size // 3**level
                run = nodes[at // 3 * 3 : at // 3 * 3 + 3]
                steps.append((at % 3, run[: at % 3] + run[at % 3 + 1 :]))
            desired[i].grow()
        yield steps


def _sorted(t: pa.Table, height: int) -> tuple[pa.Table, list[str], int]:
    t = t.sort_by("pos")
    return t, t.column("digest").to_pylist(), levels(t.column("total")[0].as_py(), height)


def _root(height: int, t: pa.Table) -> pa.Table:
    t, nodes, up = _sorted(t, height)
    total = -(-t.column("total")[0].as_py() // 3**height)
    return pa.table({"grp": t.column("grp")[:1], "pos": pa.array([t.column("block")[0].as_py()], pa.int64()), "total": pa.array([total], pa.int64()), "digest": [root(nodes, up)]})


def _paths(height: int, t: pa.Table, above: pa.Table) -> pa.Table:
    t, nodes, up = _sorted(t, height)
    rest = above.column("path")[0].as_py()
    places, starts, others, ends = [], [0], [], [0]
    for steps in traverse(nodes, up):
        for place, run in steps + [(s["place"], s["others"]) for s in rest]:
            places.append(place)
            others += run
            ends.append(len(others))
        starts.append(len(places))
    inner = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(others, pa.string()))
    path = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.StructArray.from_arrays([pa.array(places, pa.int32()), inner], fields=list(_STEP)))
    out = t.drop_columns(["block"]).append_column("path", path)
    for c in ("subroot", "root"):
        out = out.append_column(c, pa.repeat(above.column(c)[0], len(t)))
    return out


def numbered(df: DataFrame, order: list[Column], ranges: int) -> DataFrame:
    """df, sorted within its column grp, with pos (from 0) and total of its group: sorted partitions are written, their rows counted a group, and the counts summed up."""
    lined = df.repartitionByRange(ranges, "grp", *order).sortWithinPartitions("grp", *order)
    lined = cut(lined.withColumn("at", F.monotonically_increasing_id()), "lined").withColumn("part", F.shiftright("at", 33))
    runs = lined.groupBy("part", "grp").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    group = Window.partitionBy("grp")  # a row a sorted partition
    runs = runs.select("part", "grp", (F.sum("n").over(group.orderBy("part")) - F.col("n") - F.col("first")).alias("shift"), F.sum("n").over(group).alias("total"))
    return lined.join(runs, ["part", "grp"]).withColumn("pos", F.col("at") + F.col("shift")).drop("part", "at", "shift")


def _blocks(nodes: DataFrame, height: int) -> DataFrame:
    return nodes.withColumn("block", F.expr(f"pos div {3**height}"))


def climb(nodes: DataFrame, grp: str, height: int) -> list[DataFrame]:
    """Layers of nodes (grp, pos, total, digest), the lowest first; the last holds one node a group."""
    most = nodes.agg(F.max("total")).first()[0] or 1
    layers = [nodes]
    while most > 1 or len(layers) == 1:
        made = _blocks(layers[-1].select("grp", "pos", "total", "digest"), height).groupBy("grp", "block").applyInArrow(lambda t: _root(height, t), f"grp {grp}, pos long, total long, digest string")
        layers.append(cut(made, "layer"))
        most = -(-most // 3**height)
    return layers


def descend(layers: list[DataFrame], above: DataFrame, height: int) -> DataFrame:
    """The lowest layer's rows with path, subroot and root; above: grp, path, subroot, root of the groups."""
    above = above.select("grp", F.lit(0).cast("long").alias("block"), "path", "subroot", "root")
    for depth, nodes in enumerate(reversed(layers[:-1])):
        nodes = _blocks(nodes, height)
        kinds = ", ".join(f"`{c}` {k}" for c, k in nodes.dtypes if c != "block")
        above = nodes.groupBy("grp", "block").cogroup(above.groupBy("grp", "block")).applyInArrow(lambda t, a: _paths(height, t, a), f"{kinds}, path {PATH}, subroot string, root string")
        if depth < len(layers) - 2:
            above = cut(above, "paths").select("grp", F.col("pos").alias("block"), "path", "subroot", "root")
    return above


def manifest(rows: DataFrame, height: int = HEIGHT) -> DataFrame:
    """rows (doc_id long, grp string, digest: a leaf, any more) with path, subroot and root; grp orders the sources."""
    n = rows.count()
    ranges = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // ROWS))
    layers = climb(numbered(rows, [F.col("doc_id").asc_nulls_first(), F.col("digest").asc()], ranges), "string", height)
    tops = layers[-1].select(F.lit(0).alias("grp"), F.col("grp").alias("name"), "digest")
    over = climb(numbered(tops, [F.col("name").asc()], max(1, -(-n // ROWS))), "int", height)
    one = over[-1].select("grp", F.lit(None).cast(PATH).alias("path"), F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    named = descend(over, one.withColumn("path", F.expr(f"cast(array() as {PATH})")), height)
    return descend(layers, named.select(F.col("name").alias("grp"), "path", F.col("digest").alias("subroot"), "root"), height)


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, grp, digest and, where a row is chosen for tampering, the digest of its text without line feeds, if that differs."""
    one = lambda text: digest(F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), text)
    chosen = (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0) & F.col("text").contains("\n")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), key_of("source").alias("grp"), one(F.col("text")).alias("digest"), F.when(chosen, one(F.replace(F.col("text"), F.lit("\n"), F.lit("")))).alias("tampered")
    )


def prove(docs: DataFrame, height: int = HEIGHT) -> DataFrame:
    """One row per document: doc_id, leaf, pos, path, subroot, root, and tampered: the leaf that a later reader would compute."""
    made = manifest(cut(leaves(docs), "leaves"), height)
    return made.select("doc_id", F.col("digest").alias("leaf"), "pos", "path", "subroot", "root", F.coalesce("tampered", "digest").alias("tampered"))
