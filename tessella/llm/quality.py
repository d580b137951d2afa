"""Quality classifier: a generalised additive model with pairwise interactions.

Twenty-odd shape features of a whole text are binned by quantiles. Shallow trees (at most four leaves on one
feature) are boosted in cycles, a feature at a time with a small step, so each feature's trees add
up to one lookup table over its bins; then pairs of features with the most left to explain get tables
of their own from trees of two cuts. A score is the sigmoid of the sum of a text's table entries:
one vectorised addition per table.

Learning takes at most `SAMPLE` labelled documents of each class (a documented bound, by smallest
hash of the id; where it cuts a class, the odds are set right for that); only their features, some 20 numbers each, come to the driver. Scoring is one pass
over all texts and shuffles nothing.

Edge cases: null text counts as empty and is scored like any other (all features 0); without labels, or
with labels of one class only, the score is the smoothed share of that class; rows of one doc_id are
scored one by one; an empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .labels import held_out, sample

SAMPLE = 6000
THRESHOLD = 0.3
FEATURES = ("log_words", "word_length", "distinct", "distinct_by_size", "repeated_next", "top_word", "pipes", "bangs", "symbols", "stops", "digits", "upper", "non_ascii", "brackets", "quotes", "distinct_lines", "top_line", "longest_line", "log_lines", "deflated", "capitals", "short_words")


def features(data: bytes) -> list[float]:
    """The shape of a text, from its UTF-8 bytes."""
    words = data.split()
    n, size = len(words), len(data)
    if not n:
        return [0.0] * len(FEATURES)
    c = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    of = lambda chars: float(c[list(chars)].sum())
    distinct = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    by_line = Counter(lines)
    upper, lower = float(c[65:91].sum()), float(c[97:123].sum())
    d = len(distinct)
    return [
        float(np.log1p(n)), (size - float(c[[32, 9, 10, 11, 12, 13]].sum())) / n, d / n, d / n**0.75, sum(map(eq, words, words[1:])) / n, max(distinct.values()) / n,
        of(b"|") / n, of(b"!?") / n, of(b"$%#&*@+=~^_\\/<>") / n, of(b".,;:") / n, float(c[48:58].sum()) / size, upper / max(1.0, upper + lower), float(c[128:].sum()) / size, of(b"{}[]()") / n, of(b"'\"`") / n,
        len(by_line) / len(lines), max(by_line.values()) / len(lines), max(map(len, lines)) / size, float(np.log1p(len(lines))), len(zlib.compress(data, 1)) / size,
        sum(w[:1].isupper() for w in words) / n, sum(len(w) <= 3 for w in words) / n,
    ]


def feature_rows(batch: pa.RecordBatch) -> np.ndarray:
    return np.array([features(x.as_py()) for x in batch.column("data")], np.float64).reshape(-1, len(FEATURES))  # one text at a time: a batch of them is large


@dataclass
class Additive:
    """Lookup tables by feature and by pair of features."""

    base: float = 0.0
    edges: list = field(default_factory=list)
    tables: list = field(default_factory=list)
    pairs: list = field(default_factory=list)  # feature, feature, coarse edges of both, table

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for j, (edge, tab) in enumerate(zip(self.edges, self.tables, strict=True)):
            out += tab[np.searchsorted(edge, x[:, j], "right")]
        for i, j, ei, ej, tab in self.pairs:
            out += tab[np.searchsorted(ei, x[:, i], "right"), np.searchsorted(ej, x[:, j], "right")]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    """Quantiles of all values and of the distinct ones, so that a rare tail has bins too."""
    at = np.linspace(0, 1, bins)[1:-1]
    return np.unique(np.r_[np.quantile(x, at), np.quantile(np.unique(x), at)])


def _shallow(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """The values by bin of a greedy tree with at most so many leaves, from sums of gradients and Hessians by bin."""
    cg, ch, cuts = np.r_[0, np.cumsum(g)], np.r_[0, np.cumsum(h)], [0, len(g)]
    worth = lambda a, b: (cg[b] - cg[a]) ** 2 / (ch[b] - ch[a] + ridge)
    for _ in range(leaves - 1):
        best, at = 1e-9, 0
        for a, b in zip(cuts, cuts[1:]):
            if b - a > 1:
                k = np.arange(a + 1, b)
                gain = worth(a, k) + worth(k, b) - worth(a, b)
                if gain.max() > best:
                    best, at = gain.max(), k[gain.argmax()]
        if not at:
            break
        cuts = sorted([*cuts, at])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = (cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 120, pair_rounds: int = 40, pairs: int = 6, step: float = 0.15, bins: int = 24, coarse: int = 9, ridge: float = 2.0) -> Additive:
    """Cyclic boosting of single features, then of the pairs with the largest gain."""
    prior = (y.sum() + 0.5) / (len(y) + 1.0)
    m = Additive(base=float(np.log(prior / (1 - prior))), edges=[np.empty(0)] * x.shape[1], tables=[np.zeros(1)] * x.shape[1])
    if not len(y) or y.min() == y.max():
        return m
    m.edges = [_edges(x[:, j], bins) for j in range(x.shape[1])]
    m.tables = [np.zeros(len(e) + 1) for e in m.edges]
    at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(m.edges)]
    f = np.full(len(y), m.base)
    slope = lambda: (y - (p := 1 / (1 + np.exp(-f))), p * (1 - p))
    for _ in range(rounds):
        for j, tab in enumerate(m.tables):
            g, h = slope()
            add = step * _shallow(np.bincount(at[j], g, len(tab)), np.bincount(at[j], h, len(tab)), 4, ridge)
            tab += add
            f += add[at[j]]
    thin = [_edges(x[:, j], coarse) for j in range(x.shape[1])]
    thin_at = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(thin)]

    def quadrants(i: int, j: int, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best tree of one cut on each feature: its gain, its values."""
        ni, nj = len(thin[i]) + 1, len(thin[j]) + 1
        cell = thin_at[i] * nj + thin_at[j]
        gs, hs = np.bincount(cell, g, ni * nj).reshape(ni, nj), np.bincount(cell, h, ni * nj).reshape(ni, nj)
        best, out = 0.0, np.zeros((ni, nj))
        cg, ch = np.zeros((ni + 1, nj + 1)), np.zeros((ni + 1, nj + 1))
        cg[1:, 1:], ch[1:, 1:] = gs.cumsum(0).cumsum(1), hs.cumsum(0).cumsum(1)
        for a in range(1, ni):
            for b in range(1, nj):
                part = lambda c: np.array([c[a, b], c[a, nj] - c[a, b], c[ni, b] - c[a, b], c[ni, nj] - c[a, nj] - c[ni, b] + c[a, b]])  # noqa: B023, E731
                gq, hq = part(cg), part(ch)
                if (gain := float((gq**2 / (hq + ridge)).sum())) > best:
                    v = gq / (hq + ridge)
                    best, out = gain, np.block([[np.full((a, b), v[0]), np.full((a, nj - b), v[1])], [np.full((ni - a, b), v[2]), np.full((ni - a, nj - b), v[3])]])
        return best, out

    g, h = slope()
    all_pairs = [(i, j) for i in range(x.shape[1]) for j in range(i) if len(thin[i]) and len(thin[j])]
    ranked = sorted(all_pairs, key=lambda p: -quadrants(*p, g, h)[0])[:pairs]
    m.pairs = [(i, j, thin[i], thin[j], np.zeros((len(thin[i]) + 1, len(thin[j]) + 1))) for i, j in ranked]
    for _ in range(pair_rounds):
        for i, j, _, _, tab in m.pairs:
            g, h = slope()
            add = step * quadrants(i, j, g, h)[1]
            tab += add
            f += add[thin_at[i], thin_at[j]]
    return m


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Additive:
    """Fit on at most 2 * most labelled documents; what comes to the driver is their features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = feature_rows(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array(list(rows), pa.list_(pa.float64()))], ["doc_id", "y", "x"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    drawn, shift = sample(docs, labels, "quality", most)
    drawn = drawn.select("doc_id", "y", F.col("text").cast("binary").alias("data"))
    got = sorted((r["doc_id"], r["y"], tuple(r["x"])) for r in drawn.mapInArrow(run, f"doc_id {kind}, y int, x array<double>").collect())
    model = fit(np.array([r[2] for r in got], np.float64).reshape(-1, len(FEATURES)), np.array([r[1] for r in got], np.float64))
    model.base += shift
    return model


def score(docs: DataFrame, model: Additive, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(model.score(feature_rows(b)))], ["doc_id", "held_out", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), text_of().cast("binary").alias("data"))
    return rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold; rows of one doc_id are kept if one of them is good."""
    judged = cut(score(docs, learn(docs, labels), threshold), "quality").groupBy("doc_id").agg(F.max("predicted").alias("good"))
    bad = judged.filter("good = 0").select(F.col("doc_id").alias("__id"))
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["__id"]), "left_anti")
