"""Substring deduplication by Rabin-Karp hashes of every fixed-length word window.

Every window of ``window`` (50) words has a rolling hash (two 64-bit ones, from independent word hashes). Equal windows
contain the same smallest hash of ``anchor`` (10) consecutive words at the same offset, so the windows of a document are
handled in runs that share such an anchor. A run's region, the words its windows span, is hashed as well, and regions are
counted in Spark first: where a region occurs in an earlier document, all windows of the run do. Windows are counted one by one
only where regions differ around an anchor that several documents have, that is at the edges of repeated passages, and
only in the first document of each region. So a passage in a third of all documents costs one row per document and
edge, whole copies never unfold, and unique text is shuffled as one short row per run instead of one row per word.

Repeated windows merge into maximal intervals per document, which are cut out of the text in the last pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import LAST_ID, ship_with_tasks
from docspark.session import cut_lineage

ship_with_tasks(__name__)

WINDOW = 50
ANCHOR = 10
#: Words handled at once: bounds the memory that one long text takes.
PIECE = 200_000

RUNS = "doc bigint, text_hash bigint, anchor bigint, region bigint, first int, last int"
WINDOWS = "doc bigint, h1 bigint, h2 bigint, start int, text_hash bigint"


class Roller:
    """Rolling hashes over the words of one text, modulo 2^64; every word hash is mixed before it is used."""

    #: Odd multipliers (fixed values): of bytes, of words in the first and in the second hash.
    BYTE, FIRST, SECOND = 0x9E3779B97F4A7C1B, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F

    def __init__(self):
        import numpy as np

        self.np = np
        self.tables = {}

    def powers(self, base: int, count: int):
        """base^i and base^-i for i < count."""
        np = self.np
        have = self.tables.get(base)
        if have is None or len(have[0]) < count:
            size = 1 << max(10, (count - 1).bit_length())
            inverse = pow(base, -1, 1 << 64)
            up, down = np.full(size, base, dtype=np.uint64), np.full(size, inverse, dtype=np.uint64)
            up[0] = down[0] = 1
            have = self.tables[base] = np.multiply.accumulate(up), np.multiply.accumulate(down)
        return have[0][:count], have[1][:count]

    def mix(self, x):
        np = self.np
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))

    def words(self, text: bytes):
        """One 64-bit hash per word of the text."""
        np = self.np
        data = np.frombuffer(text, dtype=np.uint8)
        inside = np.empty(len(data) + 2, dtype=bool)
        inside[0] = inside[-1] = False
        inside[1:-1] = ~((data == 32) | ((data >= 9) & (data <= 13)))
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[::2], edges[1::2]
        up, down = self.powers(self.BYTE, len(data) + 1)
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        value = (sums[ends] - sums[starts]) * down[starts]
        return self.mix(value + (ends - starts).astype(np.uint64) * np.uint64(self.SECOND))

    def prefix(self, words, base: int):
        """Prefix sums from which the hash of any stretch follows."""
        np = self.np
        sums = np.zeros(len(words) + 1, dtype=np.uint64)
        np.cumsum(words * self.powers(base, len(words) + 1)[0][:-1], out=sums[1:])
        return sums

    def stretches(self, sums, starts, ends, base: int):
        """Mixed hash of the words ``starts .. ends - 1`` and their number."""
        np = self.np
        down = self.powers(base, len(sums))[1]
        return self.mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))

    def smallest(self, values, width: int):
        """Position of the smallest value (the leftmost) of every ``width`` consecutive ones."""
        np = self.np
        n = len(values)
        bits = np.uint64(20)
        coded = ((values >> bits) << bits) | np.arange(n, dtype=np.uint64)
        padded = np.full(-(-n // width) * width, np.uint64(0xFFFFFFFFFFFFFFFF))
        padded[:n] = coded
        blocks = padded.reshape(-1, width)
        left = np.minimum.accumulate(blocks, axis=1).ravel()
        right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
        count = n - width + 1
        return (np.minimum(right[:count], left[width - 1 : width - 1 + count]) & np.uint64((1 << 20) - 1)).astype(np.int64)


def _signed(values):
    return values.view("<i8")


def _pieces(n: int, window: int) -> Iterator[tuple[int, int]]:
    """Stretches of words that together hold every window once."""
    for begin in range(0, max(n - window + 1, 0), PIECE):
        yield begin, min(begin + PIECE + window - 1, n)


def _runs_of(window: int, anchor: int):
    """Task: texts to runs of windows that share an anchor."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        roll = Roller()
        names = ["doc", "text_hash", "anchor", "region", "first", "last"]
        for batch in batches:
            out = [[] for _ in names]
            for doc, key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                words = roll.words(text.as_buffer().to_pybytes())
                for begin, end in _pieces(len(words), window):
                    own = words[begin:end]
                    sums1, sums2 = roll.prefix(own, roll.FIRST), roll.prefix(own, roll.SECOND)
                    at = np.arange(len(own) - anchor + 1)
                    grams = roll.stretches(sums1, at, at + anchor, roll.FIRST)
                    chosen = roll.smallest(grams, window - anchor + 1)
                    heads = np.flatnonzero(np.concatenate(([True], chosen[1:] != chosen[:-1])))
                    tails = np.concatenate((heads[1:], [len(chosen)])) - 1
                    # the region's hash also tells where in it the anchor stands
                    shift = (chosen[heads] - heads).astype(np.uint64)
                    region = roll.mix(roll.stretches(sums2, heads, tails + window, roll.SECOND) + shift)
                    for column, values in zip(out, (
                        np.full(len(heads), doc), np.full(len(heads), key), _signed(grams[chosen[heads]]), _signed(region),
                        (heads + begin).astype(np.int32), (tails + begin).astype(np.int32),
                    )):
                        column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)

    return task


def _windows_of(window: int):
    """Task: texts with the first and last window of chosen runs to the hashes of all windows in them."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        roll = Roller()
        names = ["doc", "h1", "h2", "start", "text_hash"]
        for batch in batches:
            out = [[] for _ in names]
            for doc, key, text, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
                words = roll.words(text.as_buffer().to_pybytes())
                sums1, sums2 = roll.prefix(words, roll.FIRST), roll.prefix(words, roll.SECOND)
                pairs = runs.values.flatten()
                first, last = (np.asarray(x, dtype=np.int64) for x in pairs)
                counts = last - first + 1
                starts = np.repeat(first, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
                for column, values in zip(out, (
                    np.full(len(starts), doc), _signed(roll.stretches(sums1, starts, starts + window, roll.FIRST)),
                    _signed(roll.stretches(sums2, starts, starts + window, roll.SECOND)), starts.astype(np.int32), np.full(len(starts), key),
                )):
                    column.append(values)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], names=names)

    return task


def _cut_out(window: int, with_text: bool):
    """Task: texts with their repeated runs of windows to what is left."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        for batch in batches:
            out = {"text_hash": [], "n_words": [], "n_removed": [], "kept_sha256": [], "spans": [], "kept_text": []}
            for key, text, runs in zip(batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist()):
                words = text.as_buffer().to_pybytes().split()
                spans: list[list[int]] = []
                for run in sorted(runs or [], key=lambda r: r["first"]):
                    begin, end = run["first"], run["last"] + window
                    if spans and begin <= spans[-1][1]:
                        spans[-1][1] = max(end, spans[-1][1])
                    else:
                        spans.append([begin, end])
                kept, at = [], 0
                for begin, end in spans:
                    kept += words[at:begin]
                    at = end
                kept += words[at:]
                left = b" ".join(kept)
                for name, value in (("text_hash", key), ("n_words", len(words)), ("n_removed", len(words) - len(kept)), ("kept_sha256", hashlib.sha256(left).hexdigest()),
                                    ("spans", [{"begin": b, "end": e} for b, e in spans]), ("kept_text", left.decode() if with_text else None)):
                    out[name].append(value)
            yield pa.RecordBatch.from_arrays([
                batch.column(4), *[pa.array(out[n], type=t) for n, t in (
                    ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                    ("spans", pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))), ("kept_text", pa.string()))],
            ], names=["doc_id", *out])

    return task


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.xxhash64(text).alias("text_hash"), text.alias("text"), F.col(id_col).cast("long").alias("doc_id"))


def _spans(first: Column, last: Column) -> Column:
    return F.collect_set(F.struct(first.alias("first"), last.alias("last")))


def repeated_runs(rows: DataFrame, window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """``doc, text_hash, runs``: runs (first, last) of windows that also start in a document with a smaller id."""
    runs = cut_lineage(rows.select("doc", "text_hash", "text").mapInArrow(_runs_of(window, anchor), RUNS))

    met = runs.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("anchor")
    # what is joined by a hot key is written first: a join of two plain shuffles is one that Spark splits
    shared = cut_lineage(runs.join(cut_lineage(met), "anchor", "left_semi"))
    regions = cut_lineage(shared.groupBy("anchor", "region").agg(F.min("doc").alias("owner")))
    owned = cut_lineage(shared.join(regions, ["anchor", "region"]))
    whole = owned.filter("doc > owner").select("doc", "text_hash", "first", "last")

    edges = owned.filter("doc = owner")
    differing = edges.groupBy("anchor").agg(F.min("doc").alias("low"), F.max("doc").alias("high")).filter("low < high").select("anchor")
    chosen = edges.join(cut_lineage(differing), "anchor", "left_semi").groupBy("doc", "text_hash").agg(_spans(F.col("first"), F.col("last")).alias("runs"))
    texts = rows.select("doc", "text_hash", "text").join(cut_lineage(chosen).hint("shuffle_hash"), ["doc", "text_hash"])
    windows = cut_lineage(texts.select("doc", "text_hash", "text", "runs").mapInArrow(_windows_of(window), WINDOWS))
    owners = windows.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("high")).filter("owner < high").select("h1", "h2", "owner")
    single = windows.join(cut_lineage(owners), ["h1", "h2"]).filter("doc > owner").select("doc", "text_hash", F.col("start").alias("first"), F.col("start").alias("last"))
    return cut_lineage(whole.unionByName(single).groupBy("doc", "text_hash").agg(F.collect_set(F.struct("first", "last")).alias("runs")))


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = True) -> DataFrame:
    """Every row without the words of windows that also start in a document with a smaller id.

    Columns: ``doc_id, text_hash, n_words, n_removed, kept_sha256, spans, kept_text``. ``spans`` are the maximal removed intervals
    (begin, end) in words; ``kept_text`` joins the kept words by one space (null unless ``with_text``). Windows are judged on the input. A null
    text has no words. A row without an id comes after all ids; rows with equal ids do not remove words from one another,
    nor does a document from itself. An empty table gives no row.
    """
    rows = _keyed(docs, id_col, text_col)
    repeats = repeated_runs(rows, window, anchor)
    marked = rows.join(repeats.hint("shuffle_hash"), ["doc", "text_hash"], "left").select("doc", "text_hash", "text", "runs", "doc_id")
    schema = ("doc_id bigint, text_hash bigint, n_words bigint, n_removed bigint, kept_sha256 string, "
              "spans array<struct<begin:int,end:int>>, kept_text string")
    return marked.mapInArrow(_cut_out(window, with_text), schema)
