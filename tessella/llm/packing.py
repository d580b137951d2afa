"""Best-fit packing planned over a histogram of lengths.

Documents become token ids (one closing id each); those longer than a sequence are cut into full
pieces, the first of them shorter. Best-fit decreasing then runs over the counts of the at most
`capacity` different lengths, not over documents: groups of sequences with equal room take pieces of
one length at a time, many sequences at once. The plan is a table of slot runs (length, range of ranks,
first sequence, pieces a sequence, offset); a document takes its slot by joining on its rank
within its length. The plan's size doesn't depend on the number of documents: a length opens or splits
at most three groups, and a group takes at most 63 different lengths (1 + ... + 63 < 2048), which
bounds it by 3 * 2048 * 63 runs; a few thousand are usual.

Ranks are taken within (length, bucket of the document), and prefix sums over the buckets make them
global. There is a bucket for each `ROWS` pieces of the table, so a length that a third of all pieces have is
ranked by many tasks, and none grows with the input.

Edge cases: null text counts as empty, and is the closing id alone; rows of one doc_id are packed one by
one, and repeated rows in any order; a null doc_id is packed like any other; an empty table gives an
empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import base64
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of

CAPACITY = 2048
CLOSING = 0
#: Pieces to a bucket of one length, at most on the whole.
ROWS = 100_000
#: Chunks between spaces whose ids a worker keeps; when full it starts anew.
CACHE = 100_000
RUN = "length int, lo long, hi long, sequence long, per int, offset int"

_held: dict = {}


class Encoder:
    """ids of whole texts, equal to Tokenizer.encode(text, add_special_tokens=False) of the JSON file.

    Between two single spaces a byte-level pre-tokenizer never joins what it cuts, so a text is encoded
    chunk by chunk, from a cache, by the rank file of the same vocabulary. Texts in which white space
    could join across a chunk's ends, or which hold a special token's string, go to the JSON file's tokenizer.
    """

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(ranks_path, "rb") if line.strip())}
        self.part = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}  # a chunk behind a space -> its ids

    def __call__(self, text: str) -> bytes:
        if "  " in text or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        head, *rest = text.split(" ")
        known = self.known
        if len(known) > CACHE:
            known.clear()
        out = [np.array(self.part(head), "<u4").tobytes()]
        get = known.get
        for chunk in rest:
            ids = get(chunk)
            if ids is None:
                ids = known[chunk] = np.array(self.part(" " + chunk), "<u4").tobytes()
            out.append(ids)
        return b"".join(out)


def encoder(json_path: str, ranks_path: str, pattern: str) -> Encoder:
    key = (json_path, ranks_path)
    if key not in _held:
        _held[key] = Encoder(json_path, ranks_path, pattern)
    return _held[key]


def cut_points(n: int, capacity: int) -> list[tuple[int, int]]:
    """start and length of each piece of n tokens."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity or capacity
    return [(0, first)] + [(at, capacity) for at in range(first, n, capacity)]


def pieces(docs: DataFrame, json_path: str, ranks_path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, closing = encoder(json_path, ranks_path, pattern), np.array([CLOSING], "<u4").tobytes()
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
        names = ["doc_id", "piece", "start", "length", "ids"]
        for b in batches:
            cols, size = tuple([] for _ in names), 0
            for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                ids = encode(text.as_py()) + closing
                for k, (start, n) in enumerate(cut_points(len(ids) // 4, capacity)):
                    for col, x in zip(cols, (doc_id, k, start, n, ids[4 * start : 4 * (start + n)]), strict=True):
                        col.append(x)
                size += len(ids)
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)
                    cols, size = tuple([] for _ in names), 0
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids binary")


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple], int]:
    """Slot runs by best-fit decreasing over the counts of lengths, and the number of sequences."""
    runs, opened = [], 0
    groups: dict[int, list[tuple[int, int]]] = {}  # room left -> (first sequence, sequences)
    rooms: list[int] = []

    def leave(room: int, first: int, n: int) -> None:
        if n and room:
            if room not in groups:
                groups[room] = []
                insort(rooms, room)
            groups[room].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            i = bisect_left(rooms, length)
            if i < len(rooms):
                room = rooms[i]
                first, n = groups[room].pop()
                if not groups[room]:
                    del groups[room]
                    rooms.pop(i)
            else:
                room, first, n = capacity, opened, -(-todo // (capacity // length))
                opened += n
            per = room // length
            full = min(n, todo // per)
            if full:
                runs.append((length, rank, rank + full * per, first, per, capacity - room))
                leave(room - per * length, first, full)
                rank, todo = rank + full * per, todo - full * per
            if full < n and todo:  # fewer than fit one sequence
                runs.append((length, rank, rank + todo, first + full, todo, capacity - room))
                leave(room - todo * length, first + full, 1)
                rank, todo, full = rank + todo, 0, full + 1
            leave(room, first + full, n - full)
    return runs, opened


def pack(parts: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """parts (a written table): doc_id, piece, start, length and any payload, whatever its columns' names (but for the two added). Adds sequence_id and offset."""
    spark = parts.sparkSession
    buckets = buckets or max(32, -(-parts.count() // ROWS))
    names = [F.col(f"p.`{c}`") for c in parts.columns]
    salted = parts.select(F.struct(*parts.columns).alias("p")).select("p", F.col("p.length").alias("length"), F.pmod(F.xxhash64("p.doc_id", "p.piece"), F.lit(buckets)).cast("int").alias("salt"))
    counts = cut(salted.groupBy("length", "salt").agg(F.count("*").alias("n")), "lengths")  # at most capacity * buckets rows
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # at most capacity rows
    runs, _ = plan(histogram, capacity)
    slots = spark.createDataFrame(runs, RUN).withColumnRenamed("length", "of")
    by_length = Window.partitionBy("length").orderBy("salt")
    starts = counts.select("length", "salt", (F.sum("n").over(by_length) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "salt").orderBy("p.doc_id", "p.piece", "p.start"))
    ranked = salted.withColumn("within", rank).join(starts, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("within") - 1)
    met = ranked.join(F.broadcast(slots), (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    at = F.col("rank") - F.col("lo")
    sequence, offset = F.col("sequence") + F.floor(at / F.col("per")), F.col("offset") + at % F.col("per") * F.col("length")
    return met.select(*names, sequence.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"))
