"""Fill-in-the-middle rearrangement of whole texts, on ropes.

A text becomes a rope: a balanced binary tree over pieces of at most `PIECE` code points, in which every node caches
the units and the code points below it. A unit is a maximal run of the letters A-Z and a-z or any other code
point; a piece counts the units that begin in it, so a run of letters of any length may cross pieces. The tree is
split at two unit ranks, walking down by the cached counts, and the three subtrees are joined with the sentinels into
the output; nothing is copied until the output is read off. To restore, a rope over the output is split behind and
before the sentinels by code point ranks, and the parts are joined in their first order.

A text that contains a sentinel stays plain, so that in an output every sentinel's first place is its own: sentinels
begin with their only `<`, and none can arise across a seam.

Edge cases: null text counts as empty, and empty texts are plain; a null id draws as the word null; rows of one id
draw alike; a very long text is one rope of short pieces, and batches go out by their size; an empty table gives an
empty result; columns other than doc_id and text are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import text_of

PIECE = 1024
P, S, M = "<P>", "<S>", "<M>"
#: Hundredths of the documents that are rearranged, and of those that put the suffix first.
RATE, SUFFIX_FIRST = 90, 20
OUT = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"
_KINDS = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
_BATCH = 1 << 23


@dataclass(frozen=True, slots=True)
class Rope:
    """A piece (text, and where its units begin) or the join of two ropes."""

    units: int
    chars: int
    text: str = ""
    begins: np.ndarray | None = None
    left: Rope | None = None
    right: Rope | None = None

    def pieces(self) -> Iterator[str]:
        stack = [self]
        while stack:
            node = stack.pop()
            if node.left is None:
                yield node.text
            else:
                stack += (node.right, node.left)

    def __str__(self) -> str:
        return "".join(self.pieces())


EMPTY = Rope(0, 0, "", np.zeros(0, np.int64))


def _begins(text: str) -> np.ndarray:
    """Where units begin."""
    letter = ((np.frombuffer(text.encode("utf-32-le"), np.uint32) | 32) - 97) < 26
    inside = letter.copy()
    inside[1:] &= letter[:-1]
    inside[:1] = False
    return np.flatnonzero(~inside)


def rope(text: str, piece: int = PIECE) -> Rope:
    """A balanced rope over the text."""
    begins = _begins(text)
    cuts = np.searchsorted(begins, np.arange(0, len(text) + piece, piece))
    level = [Rope(int(b - a), len(t := text[k * piece : (k + 1) * piece]), t, begins[a:b] - k * piece) for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    while len(level) > 1:
        level = [join(*level[k : k + 2]) if k + 1 < len(level) else level[k] for k in range(0, len(level), 2)]
    return level[0] if level else EMPTY


def sentinel(mark: str) -> Rope:
    return Rope(0, len(mark), mark, np.zeros(0, np.int64))


def join(a: Rope, b: Rope) -> Rope:
    if not a.chars or not b.chars:
        return b if not a.chars else a
    return Rope(a.units + b.units, a.chars + b.chars, left=a, right=b)


def _cut(piece: Rope, at: int, units: int) -> tuple[Rope, Rope]:
    if not at or at == piece.chars:
        return (piece, EMPTY) if at else (EMPTY, piece)
    return Rope(units, at, piece.text[:at], piece.begins[:units]), Rope(piece.units - units, piece.chars - at, piece.text[at:], piece.begins[units:] - at)


def split_units(node: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` units, and the rest."""
    if rank >= node.units:
        return node, EMPTY
    if node.left is None:
        return _cut(node, int(node.begins[rank]), rank)
    # a run of letters may go on into the right rope before its first unit begins, hence < and not <=
    if rank < node.left.units:
        a, b = split_units(node.left, rank)
        return a, join(b, node.right)
    a, b = split_units(node.right, rank - node.left.units)
    return join(node.left, a), b


def split_chars(node: Rope, rank: int) -> tuple[Rope, Rope]:
    """The first `rank` code points, and the rest."""
    if rank >= node.chars:
        return node, EMPTY
    if node.left is None:
        return _cut(node, rank, int(np.searchsorted(node.begins, rank)))
    if rank <= node.left.chars:
        a, b = split_chars(node.left, rank)
        return a, join(b, node.right)
    a, b = split_chars(node.right, rank - node.left.chars)
    return join(node.left, a), b


def draws(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four unsigned 32-bit numbers of an id."""
    found = hashlib.sha256(f"1:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    return tuple(int(found[k : k + 8], 16) for k in range(0, 32, 8))


def rearrange(doc_id: int | None, text: str) -> tuple:
    """A row of OUT."""
    whole = rope(text)
    h1, h2, h3, h4 = draws(doc_id)
    if not text or h3 % 100 >= RATE or any(m in text for m in (P, S, M)):
        return doc_id, whole.units, "plain", None, None, text
    low, high = sorted((h1 % (whole.units + 1), h2 % (whole.units + 1)))
    rest, suffix = split_units(whole, high)
    prefix, middle = split_units(rest, low)
    form = "spm" if h4 % 100 < SUFFIX_FIRST else "psm"
    out = EMPTY
    for part in [sentinel(P), prefix, sentinel(S), suffix, sentinel(M), middle] if form == "psm" else [sentinel(S), suffix, sentinel(P), prefix, sentinel(M), middle]:
        out = join(out, part)
    return doc_id, whole.units, form, prefix.chars, middle.chars, str(out)


def restore(output: str, form: str) -> str:
    """The text that an output was made from."""
    if form == "plain":
        return output
    second, third = output.index(S if form == "psm" else P, len(P)), output.index(M)
    parts = []
    rest = split_chars(rope(output), len(P))[1]
    for at in (second - len(P), third - second - len(P)):
        part, rest = split_chars(rest, at)
        parts.append(part)
        rest = split_chars(rest, len(P))[1]
    prefix, suffix = parts if form == "psm" else parts[::-1]
    return str(join(join(prefix, rest), suffix))


def _rearranged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in OUT.split(", ")]
    for b in batches:
        rows, size = [], 0
        for doc_id, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
            rows.append(rearrange(doc_id, text.as_py()))
            size += len(rows[-1][5])
            if size > _BATCH:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)
                rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), _KINDS, strict=True)], names)


def fill_in_middle(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n (units), form (plain, psm or spm), prefix_chars, middle_chars, output."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).mapInArrow(_rearranged, OUT)


@F.arrow_udf(StringType())
def _restored(output: pa.Array, form: pa.Array) -> pa.Array:
    return pa.array([restore(o.as_py(), f.as_py()) for o, f in zip(output, form, strict=True)], pa.string())


def restored(output: str = "output", form: str = "form") -> Column:
    """The texts that outputs were made from."""
    return _restored(F.col(output), F.col(form))
