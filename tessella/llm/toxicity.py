"""Toxicity by noisy-channel deobfuscation.

Source: a character trigram model, its counts taken over every document. Channel: a character may
stand for itself or, at a cost, for the letters it is used to imitate; a mark between letters may be
nothing; a run of one letter may be one or two; a space among short tokens may be a word boundary or
nothing. A token, or neighbouring tokens with their gaps, is a lattice of these readings, and exact Viterbi,
with the last two letters as state, finds the likeliest one; plain tokens restore to themselves.

Scoring decodes every token, and every stretch of neighbouring tokens from each token on, whatever their
lengths: the source is then the model of characters or, with the share of learnt words that is one entry's, an entry of the
lexicon (letters after it follow the model of characters). The stretch restores to the entry if Viterbi likes that
word best under either source, and common words that stand in it are less likely as they stand. The lattice is first walked along the lexicon, and a stretch is left as soon as none of its
readings is the beginning of an entry, so what is left out could not have held one. Learning, which has
no lexicon yet, decodes tokens that look disguised and runs of short tokens.

Restored texts are scored by a logistic model. Its entries are words and word beginnings that labelled
toxic documents hold more often than chance allows; a word stands for its most telling entry, and a text's
value of an entry is how many different restored words stand for it; weights are fitted by coordinate
descent, never negative, with an absolute and a quadratic penalty, so an entry counts for what others
don't tell. The penalties are those of `PENALTIES` with the
least cross-validated loss over the learning rows.

The model of characters is a table of at most len(ALPHABET) ** 3 counts, whatever the input; the
classifier learns from at most `SAMPLE` labelled documents of each class (a documented bound; where it
cuts a class, the odds are set right for that); a worker keeps verdicts on at most `CACHE` tokens and as
many stretches. Scoring is one pass and shuffles nothing.

Edge cases: null text counts as empty and scores the odds of documents without an entry;
without labels of both classes all score the smoothed share of toxic ones, without any label 0; rows of
one doc_id are scored one by one; an empty table gives an empty result; columns other than doc_id and text
are ignored; very long texts and tokens are scored whole (a walk ends where no entry can follow).
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .labels import held_out, sample

SAMPLE = 4000
THRESHOLD = 0.5
CACHE = 400_000
#: Penalties of a weight, absolute and quadratic, from the weakest on, to choose from by cross-validation over the learning rows; `FEW` stands where there are too few.
PENALTIES = ((0.03, 0.1), (0.1, 0.1), (0.3, 0.1), (0.3, 0.3), (0.6, 0.3), (1.0, 0.5), (2.0, 0.5))
FEW = (0.1, 0.1)
CROSS = 3
#: Log probability that a word is some one entry of the lexicon, where none was learnt.
SAID = -10.0
#: A word is common if at least one in so many families of the sample holds it; so the table of common words has at most so many times the mean of a document's different words.
COMMON = 1000
#: Cost of letters after an entry that learning saw alone: about one word in twenty has such an ending.
ENDING = 3.0
#: Letters of a word's beginnings.
BEGINNINGS = (4, 5, 6)
#: Texts whose characters are counted at once.
JOINED = 256

# The letters told apart, and what characters imitate.
LETTERS = "abcdefghijklmnopqrstuvwxyzßàáâäçèéêëíîïñóôöùúûü"
ALPHABET = " " + LETTERS + "?"
IMITATES = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "#": "h"}
MARKS = ".-_*~'`^·,:;/\\"

SIZE = len(ALPHABET)
CODE = {c: i for i, c in enumerate(ALPHABET)}
OTHER = SIZE - 1
_FOLD = np.full(0x180, OTHER, np.int64)
for _i in range(0x180):
    _c = chr(_i).lower()
    _FOLD[_i] = 0 if chr(_i).isspace() else CODE.get(_c, OTHER) if len(_c) == 1 else OTHER

_SUSPECT = re.compile(r"[^\W\d_]*(?:[^\w\s]|[\d_]|(?P<x>[^\W\d_])(?P=x){2})", re.S)
_TWICE = re.compile(r"(.)\1")
_THRICE = re.compile(r"(.)\1\1")
_TWO_DOUBLED = re.compile(r"(.)\1.*(.)\2")
# Runs of tokens of up to three characters less outer marks; a longer token belongs to a run if a single character is next to it.
_SHORT = r"""["'(\[]{0,2}\S{1,3}[!?.,;:"')\]]{0,3}(?!\S)"""
_RUN = re.compile(rf"(?<!\S)(?:\S{{4,12}}\s+(?=\S(?!\S)))?{_SHORT}(?:\s+{_SHORT})*(?:(?<!\S\S)\s+\S{{4,12}}(?!\S))?")
_SPLIT = re.compile(r"(\s+)")
_TRIM = "".join(set(MARKS) | set("!?\"()[]{}<>«»“”’‘…¡¿%&=#$*@+|"))
_SOFT = "".join(set(_TRIM) - set("@$|+(#"))


def trigrams(docs: DataFrame) -> DataFrame:
    """code, n: character trigram counts over all documents, at most SIZE ** 3 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SIZE**3, np.int64)
        for b in batches:
            texts = b.column("text")
            for first in range(0, len(texts), JOINED):
                # two spaces stand before each text and after the last, so no trigram holds letters of two texts
                data = np.frombuffer("  ".join(["", *texts.slice(first, JOINED).to_pylist(), ""]).encode("utf-32-le", "surrogatepass"), "<u4")
                for at in range(0, len(data) - 2, 1 << 20):  # by parts that overlap by two characters
                    c = _FOLD[np.minimum(data[at : at + (1 << 20) + 2], 0x17F)]
                    total += np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["code", "n"])

    return docs.select(text_of().alias("text")).mapInArrow(run, "code long, n long").groupBy("code").agg(F.sum("n").alias("n"))


def log_model(counts: np.ndarray) -> np.ndarray:
    """log p(c | a, b) by code, smoothed towards p(c | b) and the even one."""
    n3 = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    n2 = n3.sum(0)
    p1 = (n2.sum(0) + 1) / (n2.sum() + SIZE)
    p2 = (n2 + 5 * p1) / (n2.sum(1, keepdims=True) + 5)
    return np.log((n3 + 5 * p2) / (n3.sum(2, keepdims=True) + 5)).astype(np.float32)


def readings(c: str) -> list[tuple[str, float]]:
    """What a character can stand for, with its cost."""
    out = [(c, 0.0)] if c in CODE and c not in " ?" else []
    out += [(x, 1.0) for x in IMITATES.get(c, "")]
    return out + [("", 1.5)] if c in MARKS or c in "!|+(#" else out or [("?", 4.0)]


@cache
def _options(c: str, n: int, letter: bool) -> list[tuple[str, float]]:
    """What a run of n (3: or more) characters c can stand for."""
    single = readings(c)
    if n == 1:
        return single
    twice = [(a + a, 2 * s) for a, s in single if a]
    return single + twice if n > 2 or not letter else [*twice, *((a, s + 2.0) for a, s in single)]


#: A gap is a boundary or, in about one word in twenty that is disguised, nothing; longer gaps are so more rarely.
_GAPS = ([(" ", 0.0), ("", 3.0)], [(" ", 0.0), ("", 5.0)])


def lattice(token: str, at: int = 0) -> Iterator[list[tuple[str, float]]]:
    """By position, the strings a stretch of the token can stand for. A run of one letter or imitating character is one position, and so is a gap: a boundary or, at a cost that is higher for a longer gap, nothing."""
    n = len(token)
    while at < n:
        c, k = token[at], at + 1
        if c.isspace():
            while k < n and token[k].isspace():
                k += 1
            yield _GAPS[k - at > 1]
        else:
            while k < n and token[k] == c:
                k += 1
            yield _options(c, min(k - at, 3), c.isalpha())
        at = k


def spoken(said: tuple) -> str:
    """What a path of Viterbi, linked backwards, says."""
    out = []
    while said:
        said, text = said
        out.append(text)
    return "".join(reversed(out))


def viterbi(token: str, model: np.ndarray) -> tuple[float, str]:
    """The likeliest reading of a token's lattice with its log probability, the last two letters as state."""
    best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
    for options in lattice(token):
        new: dict[tuple[int, int], tuple[float, tuple]] = {}
        for (a, b), (score, said) in best.items():
            for text, cost in options:
                s, x, y = score - cost, a, b
                for c in text:
                    z = CODE[c]
                    s += float(model[x, y, z])
                    x, y = y, z
                if (x, y) not in new or new[(x, y)][0] < s:
                    new[(x, y)] = (s, (said, text))
        best = new
    score, said = max(((s + float(model[a, b, 0]), said) for (a, b), (s, said) in best.items()), key=lambda t: t[0])
    return score, spoken(said)


def decode(token: str, model: np.ndarray) -> str:
    """The likeliest restored word of an obfuscated token."""
    return viterbi(token, model)[1]


def suspect(word: str) -> bool:
    """Whether a word looks as if it hid another, for learning: it holds a mark, a digit, a letter three times in a row or doubled letters in two places. Words of letters without enough repeats need no search."""
    if word.isalpha():
        return len(set(word)) <= len(word) - 2 and (_THRICE.search(word) or _TWO_DOUBLED.search(word)) is not None
    return _SUSPECT.search(word) is not None


def bare_run(run: str) -> str:
    """A run of short tokens in lower case; outer marks of its tokens go, gaps stay."""
    return "".join(w if len(w) == 1 or w.isspace() else w.strip(_SOFT) or w for w in re.split(r"(\s+)", run.lower()))


def forms(token: str) -> list[str]:
    """What of a token may hide a word, in lower case: it without outer marks and without those outer marks that imitate no letter. Outer punctuation alone hides nothing."""
    plain, inner = token.strip(_TRIM), token.strip(_SOFT)
    if plain == inner and plain.isalpha() and not suspect(plain):
        return []
    return [x for x in dict.fromkeys((plain, inner)) if x and suspect(x) and any(c.isalpha() or c in IMITATES for c in x)]


@dataclass
class Lexicon:
    """Log odds that a document without an entry is toxic, and what a word of each entry adds, the most telling entries first; learnt words, by the entry that they stand for;
    the log probability that a word is some one entry; entries whose longer words learning saw in documents no more often toxic than others; and the log probability of common words without an entry."""

    base: float = -math.inf
    entries: dict = field(default_factory=dict)
    words: dict = field(default_factory=dict)
    said: float = SAID
    alone: set = field(default_factory=set)
    common: dict = field(default_factory=dict)


class Speller:
    """Walks lattices along the lexicon. A state is a beginning of one of its words, (beginning, mode, 0, 0) with mode GAP just behind a gap, or an entry with letters after it, (entry, MORE, last two letters).
    It holds its best log probability and what was said. Nothing but states that no word can follow is dropped."""

    GAP, MORE = "|", "+"

    def __init__(self, lexicon: Lexicon, model: np.ndarray) -> None:
        self.model, self.entries = model, lexicon.entries
        self.words = {**lexicon.words, **{g: g for g in lexicon.entries if not g.endswith("*")}}
        self.stems = {g.rstrip("*") for g in lexicon.entries if g not in lexicon.alone}
        self.heads = {w[:k] for w in (*self.words, *self.stems) for k in range(1, len(w) + 1)}
        self.start = {("", "", 0, 0): (lexicon.said, ())}

    def letter(self, state: tuple, c: str) -> Iterator[tuple[tuple, float]]:
        """States after one more letter, with the log probability that it adds."""
        head, mode, x, y = state
        if mode != self.MORE:
            if head + c in self.heads:
                yield (head + c, "", 0, 0), 0.0
            if mode or head not in self.stems:
                return
            x, y = [0, *(CODE[k] for k in head)][-2:]
        cost = ENDING if mode != self.MORE and f"{head}*" not in self.entries else 0.0
        yield (head, self.MORE, y, CODE[c]), float(self.model[x, y, CODE[c]]) - cost

    def walk(self, states: dict, token: str) -> dict:
        """States after a token's lattice."""
        for options in lattice(token):
            new: dict = {}
            for state, (score, said) in states.items():
                for text, cost in options:
                    if text == "?":
                        continue
                    reached = [(state, score - cost)]
                    for c in text:
                        reached = [(t, s + gain) for r, s in reached for t, gain in self.letter(r, c)]
                    for t, s in reached:
                        if t not in new or new[t][0] < s:
                            new[t] = (s, (said, text) if text else said)
            states = new
            if not states:
                break
        return states

    def ends(self, states: dict) -> tuple[float, str, str]:
        """The likeliest word that ends here: log probability, word, entry that it stands for. An empty word if none does."""
        score, said, entry = -math.inf, (), ""
        for (head, mode, x, y), (s, path) in states.items():
            e = self.words.get(head) if not mode else None
            if mode == self.MORE:
                s, e = s + float(self.model[x, y, 0]), f"{head}*" if f"{head}*" in self.entries else head
            if e and s > score:
                score, said, entry = s, path, e
        return score, spoken(said), entry

    def across(self, states: dict, gap: str) -> dict:
        """States after a gap that is nothing: a word may go on behind it, but letters after an entry neither start nor go on there."""
        cost = _GAPS[len(gap) > 1][1][1]
        return {(head, self.GAP, 0, 0): (s - cost, said) for (head, mode, _, _), (s, said) in states.items() if head and not mode}


def bare(token: str) -> str:
    """A token of a stretch in lower case, less outer marks; a single character stays, and so does a first one that can be a letter."""
    t = token.lower()
    core = t if len(t) == 1 else t.strip(_SOFT) or t
    return "!" + core if len(t) > 1 and "!" in t[: len(t) - len(t.lstrip(_SOFT))] and core != t[: len(core)] else core


def restore(token: str, model: np.ndarray) -> tuple[str, ...]:
    """Restored readings of one token (of a run of tokens, its words): itself without outer marks, and what it may hide."""
    t = token.lower()
    run = any(map(str.isspace, t))
    hidden = [bare_run(t)] if run else forms(t)
    return tuple(dict.fromkeys(([] if run else [t.strip(_TRIM)]) + [w for x in hidden for w in decode(x, model).split()]))


def grams(word: str) -> list[str]:
    """The word and its beginnings."""
    return [word] + [f"{word[:k]}*" for k in BEGINNINGS if len(word) > k]


def runs_of(text: str) -> set[str]:
    """Runs of short tokens with their gaps."""
    return {r for r in _RUN.findall(text) if len(r) > 2 and not r.isalnum() and len(r.split(None, 1)) > 1}


def family(words: list[str], width: int = 3) -> int:
    """Two least hashes of a document's word shingles: mostly equal for near copies, so that a word that one copied document holds isn't taken for evidence from many."""
    said = {" ".join(words[k : k + width]).encode("utf-8", "surrogatepass") for k in range(max(1, len(words) - width + 1))}
    one, two = (min(xxhash.xxh32_intdigest(w, seed) for w in said) for seed in (1, 2))
    return (one << 32 | two) - (1 << 63)


def fit(rows: list[tuple[int, dict[int, int]]], bare: tuple[int, int], n: int, penalties: tuple[float, float] = FEW, sweeps: int = 300) -> tuple[float, np.ndarray]:
    """Intercept and weights of n entries: rows are a label and the values of the entries held, `bare` counts those without any by label. Penalised logistic likelihood, by cyclic Newton steps."""
    absolute, quadratic = penalties
    y = np.array([0.0, 1.0, *(r[0] for r in rows)])
    times = np.array([*bare, *[1] * len(rows)], float)
    cells: list = [[] for _ in range(n)]
    for k, (_, held) in enumerate(rows):
        for j, x in held.items():
            cells[j].append((k + 2, x))
    cells = [(np.array([k for k, _ in c], np.int64), np.array([x for _, x in c], float)) for c in cells]
    share = (y * times).sum() / times.sum()
    base, w = math.log(share / (1 - share)), np.zeros(n)
    f = np.full(len(y), base)
    for _ in range(sweeps):
        p = 1 / (1 + np.exp(-f))
        step = float((times * (y - p)).sum() / max(1e-9, (times * p * (1 - p)).sum()))
        moved = abs(step := max(-1.0, min(1.0, step)))
        base, f = base + step, f + step
        for j, (own, x) in enumerate(cells):
            p = 1 / (1 + np.exp(-f[own]))
            slope, bend = float((x * (y[own] - p)).sum()) - quadratic * w[j] - absolute, float((x * x * p * (1 - p)).sum()) + quadratic
            new = max(0.0, w[j] + max(-1.0, min(1.0, slope / bend)))
            if new != w[j]:
                f[own] += (new - w[j]) * x
                moved, w[j] = max(moved, abs(new - w[j])), new
        if moved < 1e-4:
            break
    return base, w


def telling(pos: float, neg: float, share: float) -> float:
    """Log-likelihood ratio of an entry's counts by label against the sample's share of toxic documents; 0 if it isn't above that."""
    pure = pos / (pos + neg)
    return pos * math.log(pure / share) + (neg * math.log((1 - pure) / (1 - share)) if neg else 0.0) if pure > share else 0.0


def choose(rows: list[tuple[int, dict[int, int]]], bare: tuple[int, int], n: int, least: float = 0.0) -> tuple[float, float]:
    """The penalties with the least loss over `CROSS` parts of the rows, each scored by what the others teach: which of the entries tell at least `least` there, and their weights. Rows are families of near copies, so no
    part knows another's copies; those without an entry are shared out evenly."""
    if min(sum(y == k for y, _ in rows) + bare[k] for k in (0, 1)) < 2 * CROSS:
        return FEW
    parts = []
    for part in range(CROSS):
        rest = tuple(c - len(range(part, c, CROSS)) for c in bare)
        own = [r for k, r in enumerate(rows) if k % CROSS != part]
        counts = np.zeros((n, 2))
        for y, held in own:
            counts[list(held), y] += 1
        bad = sum(y for y, _ in own) + rest[1]
        keeps = {j for j in np.flatnonzero(counts[:, 1]).tolist() if telling(counts[j, 1], counts[j, 0], bad / (len(own) + sum(rest))) >= least}
        parts.append((part, rest, [(y, {j: x for j, x in held.items() if j in keeps}) for y, held in own]))

    def loss(penalties: tuple[float, float]) -> float:
        total = 0.0
        for part, rest, own in parts:
            base, w = fit(own, rest, n, penalties)
            for y, held in rows[part::CROSS]:
                total += math.log1p(math.exp(min(700.0, (1 - 2 * y) * (base + sum(w[j] * x for j, x in held.items())))))
            total += sum((bare[y] - rest[y]) * math.log1p(math.exp((1 - 2 * y) * base)) for y in (0, 1))
        return total

    return min(PENALTIES, key=loss)


def learn_lexicon(docs: DataFrame, labels: DataFrame, model: np.ndarray, most: int = SAMPLE) -> Lexicon:
    """From at most 2 * most labelled documents. Spark counts families of documents by restored word and label. An entry is tried if the log-likelihood ratio of its counts against the sample's share of toxic
    documents exceeds the log of the number of entries by 1. What the driver gets is which families of the sample hold which of those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, tuple[str, ...]] = {}
        for b in batches:
            for y, text in zip(b.column("y").to_pylist(), b.column("text"), strict=True):
                text = text.as_py()
                words, own = text.split(), {""}  # the empty word stands for the family
                for w in {*words, *runs_of(text)}:
                    if w not in known:
                        known[w] = tuple(r for r in restore(w, model) if len(r) > 1)
                    own.update(known[w])
                if len(known) > CACHE:
                    known.clear()
                yield pa.RecordBatch.from_arrays([pa.array([family(words)] * len(own), pa.int64()), pa.array([y] * len(own), pa.int32()), pa.array(list(own), pa.string())], ["family", "y", "word"])

    drawn, shift = sample(docs, labels, "toxic", most)
    held = cut(drawn.mapInArrow(run, "family long, y int, word string").distinct(), "words")
    sizes = {r["y"]: r["n"] for r in held.filter("word = ''").groupBy("y").agg(F.count("*").alias("n")).collect()}
    good, bad = sizes.get(0, 0), sizes.get(1, 0)
    if not bad or not good:
        return Lexicon(math.log((bad + 0.5) / (good + 0.5)) if bad or good else -math.inf)
    share = bad / (good + bad)
    size = F.length("word")
    each = F.concat(F.array("word"), *[F.when(size > k, F.array(F.concat(F.substring("word", 1, k), F.lit("*")))).otherwise(F.array().cast("array<string>")) for k in BEGINNINGS])
    grams_of = held.filter("word <> ''").select("family", "y", "word", F.explode(each).alias("gram"))
    counted = grams_of.select("family", "y", "gram").distinct().groupBy("gram").agg(F.sum("y").alias("pos"), F.sum(1 - F.col("y")).alias("neg"))
    counted = cut(counted.filter("pos > 0"), "counted")
    pure = F.col("pos") / (F.col("pos") + F.col("neg"))
    ratio = F.col("pos") * F.log(pure / share) + F.when(F.col("neg") > 0, F.col("neg") * F.log((1 - pure) / (1 - share))).otherwise(0.0)
    least = math.log(max(1, counted.count())) + 1
    tried = counted.filter((pure > share) & (ratio >= least)).select("gram", ratio.alias("ratio"))
    tried = cut(tried, "tried")
    best = grams_of.join(tried, "gram").groupBy("family", "y", "word").agg(F.max(F.struct("ratio", "gram")).alias("best"))
    got = best.groupBy("family", "y", "best").agg(F.count("*").alias("n")).groupBy("family", "y").agg(F.collect_list(F.struct("best.ratio", "best.gram", "n")).alias("held")).collect()
    names = [g for _, g in sorted({(-h["ratio"], h["gram"]) for r in got for h in r["held"]})]
    place = {g: j for j, g in enumerate(names)}
    rows = [(r["y"], {place[h["gram"]]: h["n"] for h in r["held"]}) for r in sorted(got, key=lambda r: (r["family"], r["y"]))]
    with_any = [sum(y == k for y, _ in rows) for k in (0, 1)]
    rest = (good - with_any[0], bad - with_any[1])
    base, w = fit(rows, rest, len(names), choose(rows, rest, len(names), least))
    kept = {g: float(x) for g, x in zip(names, w, strict=True) if x > 0}
    learnt = best.select("word", "best.gram").distinct().filter(F.col("gram").endswith("*")).collect()
    times = sum(h["n"] for r in got for h in r["held"] if h["gram"] in kept)
    pairs = held.filter("word <> ''").count()
    said = math.log(times / len(kept) / pairs) if kept else SAID
    often = held.filter("word <> ''").groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= max(2.0, (good + bad) / COMMON)).collect()
    common = {r["word"]: math.log(r["n"] / pairs) for r in often if not any(g in kept for g in grams(r["word"]))}
    stem = F.regexp_extract("word", "^(" + "|".join(f"\\Q{g}\\E" for g in sorted(kept, key=len, reverse=True) if not g.endswith("*")) + ").", 1)
    longer = held.select("family", "y", stem.alias("stem")).filter("stem <> ''").distinct().groupBy("stem").agg(F.avg("y").alias("toxic")).collect()
    other = {r["stem"] for r in longer if r["toxic"] <= share}
    return Lexicon(base + shift, kept, {r["word"]: r["gram"] for r in learnt if r["gram"] in kept}, said, other, common)


def learn(docs: DataFrame, labels: DataFrame, most: int = SAMPLE) -> tuple[np.ndarray, Lexicon]:
    counts = np.zeros(SIZE**3, np.int64)
    for r in trigrams(docs).toLocalIterator():
        counts[r["code"]] = r["n"]
    model = log_model(counts)
    return model, learn_lexicon(docs, labels, model, most)


def score(docs: DataFrame, model: np.ndarray, lexicon: Lexicon, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, found (restored words of the text that stand for an entry)."""
    entries, base, common = lexicon.entries, lexicon.base, lexicon.common
    place = {g: k for k, g in enumerate(entries)}
    spell = Speller(lexicon, model)
    opens = {c for c in {*CODE, *IMITATES, *MARKS} if any(not x or x[0] in spell.heads for x, _ in readings(c))}

    def plainly(token: str) -> tuple[tuple[str, str], ...]:
        """A token less outer marks, with the most telling entry that it stands for."""
        word = token.lower().strip(_TRIM)
        of = [g for g in grams(word) if g in entries] if len(word) > 1 and word[0] in spell.heads else []
        return ((word, min(of, key=place.__getitem__)),) if of else ()

    def hidden(stretch: str, states: dict) -> tuple[tuple[str, str], ...]:
        """The entry that a stretch restores to: its word must be the likeliest reading under the model of characters or at least as likely as that, and likelier than the stretch as it stands if that has common words."""
        score, word, entry = spell.ends(states)
        if not word:
            return ()
        tokens = [t.strip(_TRIM) for t in stretch.split()]
        if not common.keys().isdisjoint(tokens) and score < sum(common.get(t) or viterbi(t, model)[0] for t in tokens):
            return ()
        other, reading = viterbi(stretch, model)
        return ((word, entry),) if reading == word or score >= other else ()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hits: dict[str, tuple] = {}  # what is found in a token
        clean: set[str] = set()  # tokens in which nothing is found
        begun: dict[str, dict] = {}  # states of tokens behind which an entry may go on
        ended: set[tuple[str, str]] = set()  # pairs of tokens of which no reading goes on
        spans: dict[str, tuple] = {}
        for b in batches:
            scores, found = [], []
            for text in b.column("text"):
                own: dict[str, str] = {}
                text = text.as_py()
                tokens = text.split()
                distinct = set(tokens)
                for w in distinct.difference(clean):
                    hit = hits.get(w)
                    if hit is None:
                        hit = plainly(w)
                        for t in dict.fromkeys((w.lower().strip(_TRIM), bare(w))):
                            states = spell.walk(spell.start, t) if t and t[0] in opens else {}
                            if states and not hit:
                                hit = hidden(t, states)
                        if states := spell.across(states, " "):
                            begun[w] = states
                        if hit:
                            hits[w] = hit
                        else:
                            clean.add(w)
                    own.update(hit)
                pieces = None
                for k in [k for k, w in enumerate(tokens) if w in begun] if not distinct.isdisjoint(begun) else ():
                    if k + 1 == len(tokens) or (pair := (tokens[k], tokens[k + 1])) in ended:
                        continue
                    if not spell.walk(begun[tokens[k]], bare(tokens[k + 1])):
                        ended.add(pair)
                        continue
                    pieces = pieces or _SPLIT.split(f" {text.strip()}")  # gap and token by turns, from index 1
                    states, stretch = spell.walk(spell.start, bare(tokens[k])), bare(tokens[k])
                    for n in range(k + 1, len(tokens)):
                        gap, w = pieces[2 * n + 1], bare(tokens[n])
                        states = spell.walk(spell.across(states, gap), w)
                        if not states:
                            break
                        stretch += gap + w
                        if spell.ends(states)[1]:
                            if stretch not in spans:
                                spans[stretch] = hidden(stretch, states)
                            own.update(spans[stretch])
                if len(hits) + len(clean) + len(ended) + len(spans) > 2 * CACHE:
                    hits.clear(), clean.clear(), begun.clear(), ended.clear(), spans.clear()
                scores.append(1 / (1 + math.exp(min(700.0, -base - math.fsum(map(entries.__getitem__, own.values()))))))
                found.append(sorted(own))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array(found, pa.list_(pa.string()))], ["doc_id", "held_out", "score", "found"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), text_of().alias("text"))
    out = rows.mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, found array<string>")
    return out.select("doc_id", "held_out", "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "found")
