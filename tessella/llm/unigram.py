"""Token counts by a unigram model over a trie of distinct pre-tokens.

Pre-tokens are the words between white space, each behind the word mark; a text has as many tokens as
the best segmentations of its pre-tokens. Per batch the distinct new pre-tokens are walked in sorted
order, which is their trie depth first: the forward scores of a shared prefix, and the vocabulary paths
open at its end, are computed once and kept on a stack; a pre-token's terminal count is stored. A pre-token
over `LONG` characters is walked by itself and only the scores that a piece can still reach back to are
kept, a longest piece's length of them, so one of ten million characters needs no more memory than itself. A worker
keeps counts of up to `CACHE` pre-tokens between batches, so memory is bounded and nothing is shuffled.

No tokenizer is trained here: the vocabulary is a public piece file's, in its order of rank, and a piece's log-probability is Zipf's for its
rank, -log(rank + 3) less the log of the sum. A character no piece covers costs one byte token per
UTF-8 byte, each less likely than any piece. Of equally good segmentations the one with fewer tokens counts.

Edge cases: null and empty text have 0 tokens; rows are counted one by one, whatever their doc_id; an
empty table gives an empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math
import os
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

MARK = "▁"
CACHE = 500_000
LONG = 1024
#: Documents whose word counts are held at once.
SLICE = 1000
_held: dict = {}


def vocabulary(model_path: str) -> tuple[dict[str, float], float]:
    """piece -> log-probability, and that of a byte token."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=model_path)
    names = [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]
    total = math.log(sum(1 / (r + 3) for r in range(len(names))))
    return {p: -math.log(r + 3) - total for r, p in enumerate(names)}, -math.log(len(names) + 3) - total - 2.0


def vocabulary_trie(pieces: dict[str, float]) -> dict:
    """Nodes are dicts by character; the empty key holds the score of a piece that ends there."""
    root: dict = {}
    for piece, score in pieces.items():
        node = root
        for c in piece:
            node = node.setdefault(c, {})
        node[""] = score
    return root


def forward_alone(word: str, root: dict, byte_score: float) -> int:
    """Tokens of a long word's best segmentation, by a window of scores."""
    score, tokens, paths = {0: 0.0}, {0: 0}, [(root, 0)]
    for depth, c in enumerate(word):
        n = len(c.encode("utf-8", "surrogatepass"))
        best, few, below = score[depth] + n * byte_score, tokens[depth] + n, []
        for node, start in paths:
            if (node := node.get(c)) is not None:
                below.append((node, start))
                if (own := node.get("")) is not None and ((s := score[start] + own) > best or s == best and tokens[start] + 1 < few):
                    best, few = s, tokens[start] + 1
        paths = [*below, (root, depth + 1)]
        score[depth + 1], tokens[depth + 1] = best, few
        if len(score) > 2 * LONG:  # paths are in order of their starts
            for old in [k for k in score if k < paths[0][1]]:
                del score[old], tokens[old]
    return tokens[len(word)]


def forward(words: Iterable[str], root: dict, byte_score: float) -> dict[str, int]:
    """Tokens of each distinct word's best segmentation."""
    counts: dict[str, int] = {}
    # by depth: score and tokens of the best segmentation of the prefix, and the vocabulary nodes open there with their starts
    score, tokens, still = [0.0], [0], [[(root, 0)]]
    last = ""
    for word in sorted(words):
        if len(word) > LONG:
            counts[word] = forward_alone(word, root, byte_score)
            continue
        shared = len(os.path.commonprefix((last, word)))
        del score[shared + 1 :], tokens[shared + 1 :], still[shared + 1 :]
        for depth in range(shared, len(word)):
            c = word[depth]
            n = len(c.encode("utf-8", "surrogatepass"))
            best, few, paths = score[depth] + n * byte_score, tokens[depth] + n, []
            for node, start in still[depth]:
                below = node.get(c)
                if below is not None:
                    paths.append((below, start))
                    own = below.get("")
                    if own is not None:
                        s, t = score[start] + own, tokens[start] + 1
                        if s > best or s == best and t < few:
                            best, few = s, t
            paths.append((root, depth + 1))
            score.append(best)
            tokens.append(few)
            still.append(paths)
        counts[word] = tokens[len(word)]
        last = word
    return counts


def count_tokens(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_words, n_tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model_path not in _held:
            pieces, byte_score = vocabulary(model_path)
            _held[model_path] = vocabulary_trie(pieces), byte_score, {}
        root, byte_score, known = _held[model_path]
        for b in (whole.slice(at, SLICE) for whole in batches for at in range(0, whole.num_rows, SLICE)):
            texts = [Counter(x.split()) for x in b.column("data").to_pylist()]
            new = {w for t in texts for w in t if w not in known}
            if len(known) + len(new) > CACHE:
                known.clear()
                new = {w for t in texts for w in t}
            fresh = {MARK + w.decode("utf-8"): w for w in new}
            known.update((fresh[w], n) for w, n in forward(fresh, root, byte_score).items())
            words = [sum(t.values()) for t in texts]
            tokens = [sum(known[w] * n for w, n in t.items()) for t in texts]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return docs.select("doc_id", text_of().cast("binary").alias("data")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_tokens long")
