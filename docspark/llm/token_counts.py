"""Token counts under a unigram model, by dynamic programming over a trie of distinct pre-tokens.

Texts are cut into words by numpy and only the distinct words of a piece are looked at. Every task inserts those it has not met into a trie and walks it depth first: a node's forward score, the best way to
cut the characters from the root to it into pieces, follows from the nodes above it and is computed once for all pre-tokens that
share the prefix. The number of pieces on that way is stored at terminals and added up per document. A task keeps at most
``KNOWN`` counts, so memory is bounded whatever the corpus, and no word is shuffled.

The vocabulary file lists pieces by rank and has no unigram probabilities; the score of a piece is -ln(rank + 3), the
Zipf law, so nothing is trained. A character without a piece is written as its UTF-8 bytes, at a score below every piece.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import ship_with_tasks

ship_with_tasks(__name__)

#: Marks the start of a word (fixed value of the vocabulary format).
START = "▁"
PENALTY = 10.0
KNOWN = 500_000
#: Rows and bytes of text handled at once.
ROWS, PIECE = 1000, 1 << 22


def piece_scores(path: str | None = None) -> dict[str, float]:
    """Pieces of a sentencepiece vocabulary file with their scores; control and byte pieces are left out."""
    import sentencepiece

    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    vocabulary = sentencepiece.SentencePieceProcessor(model_file=str(path))
    ids = range(vocabulary.get_piece_size())
    return {vocabulary.id_to_piece(i): -math.log(i + 3) for i in ids if not (vocabulary.is_byte(i) or vocabulary.is_control(i) or vocabulary.is_unknown(i))}


class Trie:
    """Distinct pre-tokens as nested nodes; ``count`` fills in the counts at the terminals."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.longest = max(map(len, scores), default=1)
        self.unknown = min(scores.values(), default=0.0) - PENALTY

    def count(self, pretokens: list[str]) -> dict[str, tuple[int, int]]:
        """(pieces, of these bytes) of every pre-token."""
        root: dict = {}
        for word in pretokens:
            node = root
            for c in word:
                node = node.setdefault(c, {})
            node[""] = word
        found, path = {}, ""
        # forward state of the nodes on the path: score, pieces, bytes; siblings start from the same state
        state = [(0.0, 0, 0)]
        stack = [(1, c, child) for c, child in root.items() if c]
        if "" in root:
            found[""] = (0, 0)
        while stack:
            depth, c, node = stack.pop()
            path = path[: depth - 1] + c
            del state[depth:]
            score, pieces, raw = state[depth - 1]
            size = len(c.encode("utf-8", "surrogatepass"))
            best = (score + self.unknown, pieces + size, raw + size)
            for begin in range(depth - 1, max(-1, depth - self.longest - 1), -1):
                own = self.scores.get(path[begin:])
                if own is not None:
                    before = state[begin]
                    if before[0] + own > best[0]:
                        best = (before[0] + own, before[1] + 1, before[2])
            state.append(best)
            if "" in node:
                found[node[""]] = best[1:]
            stack += [(depth + 1, k, child) for k, child in node.items() if k]
        return found


def words_of(np, texts: pa.StringArray) -> Iterator[tuple]:
    """Words between white space of all texts, in pieces of about ``PIECE`` bytes: the row of every word, and the words."""
    offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
    white = np.zeros(256, dtype=bool)
    white[0x20] = white[0x09:0x0E] = True
    at, last = int(offsets[0]), int(offsets[-1])
    while at < last:
        end = min(at + PIECE, last)
        while end < last and not white[data[end]]:  # a piece ends before white space
            end += 1
        blank = white[data[at:end]]
        edges = np.flatnonzero(blank[1:] != blank[:-1]) + 1 + at
        bounds = np.sort(np.concatenate((edges, offsets[(offsets > at) & (offsets < end)], [at, end])), kind="stable")
        bounds = bounds[np.concatenate(([True], bounds[1:] != bounds[:-1]))]
        parts = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), texts.buffers()[2])
        word = ~blank[bounds[:-1] - at]
        yield np.searchsorted(offsets, bounds[:-1][word], side="right") - 1, parts.filter(pa.array(word))
        at = end


def count_tokens(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, n_pretokens, n_tokens, n_byte_tokens`` of every row.

    Pre-tokens are the words between white space, each with a start mark in front. A null or empty text has none. Whole texts are
    counted; repeated rows get the same answer; an empty table gives no row. ``vocabulary`` is the path of a vocabulary
    file that the driver reads; its size bounds what is sent to tasks.
    """
    scores = piece_scores(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        trie, known = Trie(scores), {}
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            ids, texts = batch.columns
            totals = np.zeros((3, len(texts)), dtype=np.int64)
            for row, words in words_of(np, texts):
                coded = words.dictionary_encode()
                distinct = coded.dictionary.to_pylist()
                if new := [w for w in distinct if w not in known]:
                    if len(known) + len(new) > KNOWN:
                        known, new = {}, distinct
                    known |= {w[1:]: n for w, n in trie.count([START + w for w in new]).items()}
                met = np.array([known[w] for w in distinct], dtype=np.int64).reshape(-1, 2)[coded.indices.to_numpy()]
                for total, weight in zip(totals, (None, met[:, 0], met[:, 1])):
                    total += np.bincount(row, weights=weight, minlength=len(texts)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([ids, *map(pa.array, totals)], names=["doc_id", "n_pretokens", "n_tokens", "n_byte_tokens"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(task, "doc_id bigint, n_pretokens bigint, n_tokens bigint, n_byte_tokens bigint")
