"""Byte-level BPE encoding and decoding by forced boundaries.

A token never spans two neighbouring bytes that stand side by side in no vocabulary token, so merging ends there whatever
else the text holds. ``Codec`` marks all such byte pairs once, in a table of 256 x 256 flags. Texts are cut wherever the table says so,
each distinct fragment of a batch is encoded once and independently, and the fragments' ids are concatenated.

Pre-tokens are cut by a pattern before merging, and that pattern looks at its surroundings. A cut is used only where it cannot
matter: the character before it is no white space (so no run of white space is cut, nor looked ahead from, and the match that
ends there ends there in the fragment too), the one after it is no apostrophe (so no contraction can start in a fragment that did
not start in the text), and it stands between two characters. The pairs inside contractions and added tokens occur in tokens and
are never cut. A run of letters, digits or signs that is cut keeps its two parts as pre-tokens, between which no merge exists.

Cutting, finding distinct fragments and gluing ids run on whole Arrow batches in numpy; a task handles at most ``PIECE`` bytes at a
time, also within one long text, and remembers at most ``KNOWN`` fragments or those of the last piece.
"""

from __future__ import annotations

import functools
import json
import os
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import ship_with_tasks

ship_with_tasks(__name__)

FILE = "byte_bpe_50k.json"
#: Bytes handled at once: bounds the memory of a task besides its rows.
PIECE = 1 << 22
#: Ids decoded at once.
IDS = 1 << 18
#: Rows passed on at once.
ROWS = 1000
#: Fragments whose ids a worker remembers; those of one piece may be more.
KNOWN = 200_000


def byte_alphabet() -> dict[str, int]:
    """Character that stands for each byte in byte-level vocabulary files: printable ones for themselves, the others from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Codec:
    """Vocabulary, boundary table and decoder of a byte-level BPE file (``tokenizers`` format)."""

    def __init__(self, definition: str):
        import numpy as np

        self.np, self.definition = np, definition
        alphabet, parsed = byte_alphabet(), json.loads(definition)
        tokens = {i: t for t, i in parsed["model"]["vocab"].items()} | {t["id"]: t["content"] for t in parsed["added_tokens"]}
        self.tokens = [b""] * (max(tokens, default=-1) + 1)
        for i, t in tokens.items():
            self.tokens[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else t.encode()
        self.added = [t["content"].encode() for t in parsed["added_tokens"]]
        self.certain = self.boundaries()
        self.known: dict[str, list[int]] = {}
        self.sizes = np.array([len(t) for t in self.tokens], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.bytes = np.frombuffer(b"".join(self.tokens), dtype=np.uint8)

    @functools.cached_property
    def model(self):
        """The merging rules, which only encoding needs."""
        import tokenizers

        model = tokenizers.Tokenizer.from_str(self.definition)
        model.no_truncation()
        model.no_padding()
        return model

    def boundaries(self):
        """Flags over (byte, next byte): never together in a token, and harmless to the pre-token pattern as far as two bytes tell."""
        np = self.np
        inside = np.zeros((256, 256), dtype=bool)
        for t in self.tokens + self.added:
            b = np.frombuffer(t, dtype=np.uint8)
            inside[b[:-1], b[1:]] = True
        certain = ~inside
        certain[:0x21, :] = False  # white space and control characters in front
        certain[:, ord("'")] = False
        certain[:, 0x80:0xC0] = False  # inside a character
        return certain.ravel()

    def cuts(self, data):
        """Places in a byte array where a fragment ends and the next one starts."""
        np = self.np
        if len(data) < 2:
            return np.zeros(0, dtype=np.int64)
        at = np.flatnonzero(self.certain[(data[:-1].astype(np.uint16) << 8) | data[1:]]) + 1
        # white space beyond ASCII: two bytes after C2, or three with one of 80, 81, 9A in the middle
        doubtful = (data[at - 1] >= 0x80) & np.isin(data[np.maximum(at - 2, 0)], np.array([0xC2, 0x80, 0x81, 0x9A], dtype=np.uint8))
        return at[~doubtful]

    def encode(self, data: pa.Buffer, begin: int, end: int, places) -> tuple:
        """Ids of the bytes ``begin .. end - 1`` of a buffer, and the number of ids before each of ``places`` (texts start there)."""
        np = self.np
        cuts = self.cuts(np.frombuffer(data, dtype=np.uint8, count=end)[begin:]) + begin
        bounds = np.sort(np.concatenate((cuts, places, [begin, end])), kind="stable")
        bounds = bounds[np.concatenate(([True], bounds[1:] != bounds[:-1]))]
        fragments = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer(bounds.astype(np.int32)), data).dictionary_encode()
        distinct = [f.decode("utf-8", "replace") for f in fragments.dictionary.cast(pa.binary()).to_pylist()]
        if new := [f for f in distinct if f not in self.known]:
            if len(self.known) + len(new) > KNOWN:
                self.known, new = {}, distinct
            self.known.update(zip(new, [code.ids for code in self.model.encode_batch_fast(new, add_special_tokens=False)]))
        ids = [self.known[f] for f in distinct]
        sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
        flat = np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(sizes.sum()))
        index = fragments.indices.to_numpy()
        before = np.concatenate(([0], np.cumsum(sizes[index])))
        return flat[stretches(np, (np.cumsum(sizes) - sizes)[index], sizes[index])], before[np.searchsorted(bounds, places)]

    def pieces(self, data: pa.Buffer, offsets) -> Iterator[tuple[int, int]]:
        """Stretches of at most ``PIECE`` bytes that end where a text does, or inside a longer text at a certain boundary."""
        np = self.np
        at, last = int(offsets[0]), int(offsets[-1])
        while at < last:
            end = int(offsets[np.searchsorted(offsets, at + PIECE, side="right") - 1])
            if end <= at:
                text_end, size, end = int(offsets[np.searchsorted(offsets, at, side="right")]), PIECE, 0
                while not end:
                    limit = min(at + size, text_end)
                    cuts = self.cuts(np.frombuffer(data, dtype=np.uint8, count=limit)[at:])
                    end = limit if limit == text_end else at + int(cuts[-1]) if len(cuts) else 0
                    size *= 2
            yield at, end
            at = end

    def decode(self, ids, offsets) -> list[str]:
        """Texts of lists of ids, given as one array and the offsets of the lists; an id outside the vocabulary stands for nothing, broken UTF-8 becomes U+FFFD."""
        np = self.np
        known = (ids >= 0) & (ids < len(self.tokens))
        safe = np.where(known, ids, 0)
        sizes = np.where(known, self.sizes[safe], 0)
        parts = []
        for at in range(0, len(ids), IDS):
            own = slice(at, at + IDS)
            parts.append(self.bytes[stretches(np, self.starts[safe[own]], sizes[own])].tobytes())
        data = b"".join(parts)
        ends = np.concatenate(([0], np.cumsum(sizes)))[offsets]
        return [data[b:e].decode("utf-8", "replace") for b, e in zip(ends[:-1].tolist(), ends[1:].tolist())]


def stretches(np, starts, sizes):
    """The places ``start .. start + size - 1`` of all stretches, one after the other."""
    total = int(sizes.sum())
    first = np.cumsum(sizes) - sizes
    return np.repeat(starts - first, sizes) + np.arange(total)


def definition(path: str | None = None) -> str:
    """The vocabulary file that the driver reads; its size bounds what is sent to tasks."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path(FILE)
    with open(path, encoding="utf-8") as file:
        return file.read()


def _codec(shared) -> Codec:
    """The codec of this worker: built once for all tasks that it runs."""
    held = shared.value
    if "codec" not in held:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        held["codec"] = Codec(held["definition"])
    return held["codec"]


def _offsets(np, column) -> tuple:
    """Offsets of a string or list column as 64-bit numbers."""
    return np.frombuffer(column.buffers()[1], dtype=np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)


def _encode(shared):
    """Task: the last column, texts, becomes ``ids``."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = _codec(shared)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            texts = batch.column(batch.num_columns - 1)
            offsets, data = _offsets(np, texts), texts.buffers()[2] or pa.py_buffer(b"")
            ids, before, total = [np.zeros(0, dtype=np.int32)], np.zeros(len(offsets), dtype=np.int64), 0
            for begin, end in codec.pieces(data, offsets):
                inside = (offsets >= begin) & (offsets < end)
                own, counts = codec.encode(data, begin, end, offsets[inside])
                before[inside] = counts + total
                ids.append(own)
                total += len(own)
            before[offsets == offsets[-1]] = total
            lists = pa.ListArray.from_arrays(pa.array(before, type=pa.int32()), pa.array(np.concatenate(ids)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "ids"])

    return task


def _decode(shared):
    """Task: the texts of the last column, lists of ids, come behind it."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        codec = _codec(shared)
        for batch in batches:
            for part in (batch.slice(at, ROWS) for at in range(0, batch.num_rows, ROWS)):
                lists = part.column(part.num_columns - 1)
                offsets = _offsets(np, lists)
                values = lists.values.slice(int(offsets[0]), int(offsets[-1] - offsets[0])).fill_null(-1).to_numpy()
                texts = pa.array(codec.decode(values, offsets - offsets[0]), type=pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, texts], names=[*part.schema.names, "text"])

    return task


def _shared(docs: DataFrame, vocabulary: str | None):
    return docs.sparkSession.sparkContext.broadcast({"definition": definition(vocabulary)})


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids`` of every row: the token ids of its whole text, as the vocabulary's own library gives them without special tokens added.

    The string of a special token inside a text is that token, as in the library. A null or empty text has no ids. Ids of rows are whole
    numbers or null; repeated rows get equal answers; an empty table gives no row. ``vocabulary`` is the path of the vocabulary file, read by
    the driver.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_encode(_shared(docs, vocabulary)), "doc_id bigint, ids array<int>")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``doc_id, ids, text``: the text that every row's ids stand for, special tokens included.

    A null or empty list gives the empty text; a null or unknown id stands for nothing; bytes that are no UTF-8 become U+FFFD.
    """
    rows = encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    return rows.mapInArrow(_decode(_shared(encoded, vocabulary)), "doc_id bigint, ids array<int>, text string")
