"""Ranked lexical search of items in documents by bag deduplication.

Scores depend on a document only through its counts of item terms and its length measure m. So every text is read once and
restricted to the items' vocabulary; documents with identical counts and m are one class, found by hash and verified by
grouping on the counts themselves. Each class is scored once against all items, and the documents of the few classes that can
be among the best are taken in order of their ids. A group of copies, or all documents that hold the same few item terms, is
one class, whatever its size.

A class takes part in an item's result by its smallest id: classes ordered by (score, smallest id) are cut after k, because each class ahead
has a document ahead of all of this one's. For the same reason no class needs more than its k smallest ids.

Items are handled in blocks of at most ``ITEMS`` items and about ``TERMS`` terms; these bounds hold for everything that is sent to tasks or
comes back to the driver. Tasks keep the k best classes of every item of the block.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.common import LAST_ID, NOT_ALNUM, filled, lower_ascii, ship_with_tasks, words
from docspark.session import cut_lineage

ship_with_tasks(__name__)

BEST = 50
#: Items and (item, term) pairs of a block.
ITEMS, TERMS = 2000, 500_000
#: Bytes of text, and cells of scores, that a task handles at once.
PIECE, CELLS = 1 << 22, 1 << 21
#: Weights of terms are in thousandths; a score's parts (fixed values of the scoring rule).
SCALE, GAIN = 1000, 1_000_000_000

VECTORS = "doc bigint, n bigint, terms array<int>, tfs array<bigint>"
FOUND = "item int, score bigint, first bigint, hash bigint"


def item_terms(items: DataFrame, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """``item_id, key, term``: the distinct terms of every item; rows of one id are one item, and so are those without an id. Written once."""
    terms = words(lower_ascii(F.coalesce(F.col(text_col), F.lit(""))), NOT_ALNUM)
    return cut_lineage(items.select(F.col(id_col).alias("item_id"), F.explode(terms).alias("term")).distinct().withColumn("key", filled(F.col("item_id"))))


def _split(np, data, begin: int, end: int, offsets):
    """Bounds of alternating terms and other stretches of ``data[begin:end]``, cut where texts start as well."""
    term = term_flags(np)[data[begin:end]]
    edges = np.flatnonzero(term[1:] != term[:-1]) + 1 + begin
    bounds = np.sort(np.concatenate((edges, offsets[(offsets > begin) & (offsets < end)], [begin, end])), kind="stable")
    return bounds[np.concatenate(([True], bounds[1:] != bounds[:-1]))]


def term_flags(np):
    """Flags of the bytes that terms consist of: ASCII letters and digits, and all bytes beyond ASCII."""
    flags = np.zeros(256, dtype=bool)
    flags[0x30:0x3A] = flags[0x41:0x5B] = flags[0x61:0x7B] = flags[0x80:] = True
    return flags


def _pieces(np, data, offsets) -> Iterator[tuple[int, int]]:
    """Stretches of about ``PIECE`` bytes that end where a text does, or inside a longer text where no term is cut."""
    term, at, last = term_flags(np), int(offsets[0]), int(offsets[-1])
    while at < last:
        end = int(offsets[np.searchsorted(offsets, at + PIECE, side="right") - 1])
        if end <= at:
            text_end, end = int(offsets[np.searchsorted(offsets, at, side="right")]), at + PIECE
            while end < text_end and term[data[end - 1]] and term[data[end]]:
                end += 1
        yield at, end
        at = end


def _vectors(shared):
    """Task: texts to their length in terms and their counts of vocabulary terms."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        vocabulary = pa.array(shared.value["vocabulary"], type=pa.string())
        lower = np.arange(256, dtype=np.uint8)
        lower[0x41:0x5B] += 32
        term_bytes = term_flags(np)
        for batch in batches:
            ids, texts = batch.columns
            rows = len(texts)
            if not rows:
                continue
            offsets = np.frombuffer(texts.buffers()[1], dtype=np.int32)[texts.offset : texts.offset + rows + 1].astype(np.int64)
            data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)
            n, codes, counts = np.zeros(rows, dtype=np.int64), [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
            for begin, end in _pieces(np, data, offsets):
                bounds = _split(np, data, begin, end, offsets)
                low = lower[data[begin:end]]
                parts = pa.StringArray.from_buffers(len(bounds) - 1, pa.py_buffer((bounds - begin).astype(np.int32)), pa.py_buffer(low))
                row = np.searchsorted(offsets, bounds[:-1], side="right") - 1
                n += np.bincount(row[term_bytes[low[bounds[:-1] - begin]]], minlength=rows)
                at = pc.index_in(parts, value_set=vocabulary).fill_null(-1).to_numpy()
                code, count = np.unique(row[at >= 0] * len(vocabulary) + at[at >= 0], return_counts=True)
                codes.append(code)
                counts.append(count)
            code, place = np.unique(np.concatenate(codes), return_inverse=True)
            count = np.bincount(place, weights=np.concatenate(counts), minlength=len(code)).astype(np.int64)
            own = pa.array(np.searchsorted(code, np.arange(rows + 1) * max(len(vocabulary), 1)), type=pa.int32())
            terms = pa.ListArray.from_arrays(own, pa.array(code % max(len(vocabulary), 1), type=pa.int32()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(n), terms, pa.ListArray.from_arrays(own, pa.array(count))], names=["doc", "n", "terms", "tfs"])

    return task


def stretches(np, starts, sizes):
    """The places ``start .. start + size - 1`` of all stretches, one after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


class Best:
    """The best classes of every item so far: by score, then smallest id."""

    def __init__(self, np, items: int, best: int):
        self.np, self.best = np, best
        self.least = np.ones(items, dtype=np.int64)
        self.kept = [np.zeros(0, dtype=np.int64) for _ in range(4)]
        self.new: list[tuple] = []
        self.waiting = 0

    def add(self, item, score, first, key) -> None:
        self.new.append((item, score, first, key))
        self.waiting += len(item)
        if self.waiting > CELLS:
            self.settle()

    def settle(self) -> None:
        np = self.np
        item, score, first, key = (np.concatenate(c) for c in zip(self.kept, *self.new))
        order = np.lexsort((key, first, -score, item))
        item, score, first, key = item[order], score[order], first[order], key[order]
        rank = np.arange(len(item)) - np.searchsorted(item, item)
        keep = rank < self.best
        full = rank == self.best - 1
        self.least[item[full]] = score[full]
        self.kept = [c[keep] for c in (item, score, first, key)]
        self.new, self.waiting = [], 0


def _score(shared, best: int):
    """Task: classes to the best ones of every item."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        weights, starts, sizes, posted = (np.array(shared.value[k], dtype=np.int64) for k in ("weights", "starts", "sizes", "posted"))
        items, exact = shared.value["items"], shared.value["exact"]
        top = Best(np, items, best)
        for batch in batches:
            key, m, lists, tfs, first = batch.columns
            if not len(key):
                continue
            key, m, first = (c.to_numpy() for c in (key, m, first))
            ends = np.concatenate(([0], np.cumsum(lists.value_lengths().to_numpy())))
            term, tf = lists.flatten().to_numpy().astype(np.int64), tfs.flatten().to_numpy()
            row = np.repeat(np.arange(len(key)), np.diff(ends))
            gain = weights[term] * ((GAIN * tf) // (SCALE * tf + 20 * m[row]))
            work = np.concatenate(([0], np.cumsum(sizes[term])))[ends]
            at = 0
            while at < len(key):
                to = max(at + 1, min(at + max(1, CELLS // items), int(np.searchsorted(work, work[at] + CELLS, side="right")) - 1))
                own = slice(int(ends[at]), int(ends[to]))
                size = sizes[term[own]]
                cell = np.repeat((row[own] - at) * items, size) + posted[stretches(np, starts[term[own]], size)]
                part = np.repeat(gain[own], size)
                if exact:
                    scores = np.bincount(cell, weights=part, minlength=(to - at) * items).astype(np.int64)
                else:
                    scores = np.zeros((to - at) * items, dtype=np.int64)
                    np.add.at(scores, cell, part)
                scores = scores.reshape(to - at, items)
                r, i = np.nonzero(scores >= top.least)
                top.add(i, scores[r, i], first[at:to][r], key[at:to][r])
                at = to
        top.settle()
        if len(top.kept[0]):
            item, score, first, key = top.kept
            yield pa.RecordBatch.from_arrays([pa.array(item, type=pa.int32()), pa.array(score), pa.array(first), pa.array(key)], names=["item", "score", "first", "hash"])

    return task


def term_weight(n_docs: int, df: int) -> int:
    return math.floor(SCALE * math.log((2 * n_docs + 2) / (2 * df + 1)))


def search_block(docs: DataFrame, pairs: list[tuple], id_col: str, text_col: str, best: int) -> DataFrame:
    """``item, rank, doc_id, score`` of one block of items, given as (number of the item, term)."""
    spark = docs.sparkSession
    vocabulary = sorted({t for _, t in pairs})
    number = {t: i for i, t in enumerate(vocabulary)}
    posted = defaultdict(list)
    for item, t in pairs:
        posted[number[t]].append(item)
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    shared = spark.sparkContext.broadcast({"vocabulary": vocabulary})
    vectors = cut_lineage(rows.mapInArrow(_vectors(shared), VECTORS))

    n_docs, n_terms = vectors.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    df = {r["term"]: r["df"] for r in vectors.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("df")).collect()}
    weights = [term_weight(n_docs, df.get(i, 0)) for i in range(len(vocabulary))]
    sizes = [len(posted[i]) for i in range(len(vocabulary))]
    items = 1 + max((i for i, _ in pairs), default=-1)
    sums = [0] * items
    for item, t in pairs:
        sums[item] += weights[number[t]]
    plan = {"weights": weights, "sizes": sizes, "starts": [sum_ - s for sum_, s in zip(_running(sizes), sizes)], "posted": [x for i in range(len(vocabulary)) for x in posted[i]],
            "items": items, "exact": max(sums, default=0) * (GAIN // SCALE) < 1 << 53}
    shared = spark.sparkContext.broadcast(plan)

    bag = ["hash", "m", "terms", "tfs"]
    measured = vectors.filter(F.size("terms") > 0).withColumn("m", 50 + F.expr(f"(50 * n * {n_docs}L) div {max(n_terms, 1)}L"))
    measured = measured.withColumn("hash", F.xxhash64("m", "terms", "tfs"))
    classes = cut_lineage(measured.groupBy(*bag).agg(F.min("doc").alias("first")))
    scored = classes.select(*bag, "first").mapInArrow(_score(shared, best), FOUND)
    ahead = W.partitionBy("item").orderBy(F.desc("score"), "first", "hash")
    chosen = cut_lineage(scored.withColumn("place", F.row_number().over(ahead)).filter(F.col("place") <= best).drop("place"))
    # at most ITEMS * best classes
    winners = cut_lineage(classes.join(F.broadcast(chosen.select("hash", "first").distinct()), ["hash", "first"], "left_semi"))
    by_id = W.partitionBy("hash", "first").orderBy("doc")
    members = measured.select(*bag, "doc").join(F.broadcast(winners), bag).select("hash", "first", "doc")
    members = members.withColumn("place", F.row_number().over(by_id)).filter(F.col("place") <= best).drop("place")
    ranked = W.partitionBy("item").orderBy(F.desc("score"), "doc")
    found = chosen.join(members, ["hash", "first"]).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= best)
    return found.select("item", "rank", F.nullif("doc", F.lit(LAST_ID).cast("long")).alias("doc_id"), "score")


def _running(sizes: list[int]) -> list[int]:
    out, total = [], 0
    for s in sizes:
        total += s
        out.append(total)
    return out


def search(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
           best: int = BEST) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``best`` documents with the highest scores above 0 of every item.

    Terms are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased; a null text has none. Documents of equal score are
    ranked by id, those without an id last; every row is a document, so repeated rows are ranked one after the other. Ids of documents are whole numbers.
    Rows of equal item id are one item with the terms of all. Items or documents without terms give no row. One item's terms must fit in a task.
    """
    pairs = item_terms(items, item_col, item_text_col)
    total, distinct = pairs.agg(F.count(F.lit(1)), F.count_distinct("key")).first()
    blocks = max(1, math.ceil(total / TERMS), math.ceil(distinct / ITEMS))
    kind = pairs.schema["item_id"].dataType.simpleString()
    blocked: Column = F.pmod(F.xxhash64("key"), F.lit(blocks))
    out = []
    for block in range(blocks):
        rows = pairs.filter(blocked == block).collect() if total else []
        names = {key: i for i, key in enumerate(sorted({r["key"] for r in rows}))}
        ids = {names[r["key"]]: r["item_id"] for r in rows}
        found = search_block(docs, [(names[r["key"]], r["term"]) for r in rows], id_col, text_col, best)
        named = docs.sparkSession.createDataFrame(list(ids.items()), f"item int, item_id {kind}")
        out.append(found.join(F.broadcast(named), "item").select("item_id", "rank", "doc_id", "score"))
    result = out[0]
    for more in out[1:]:
        result = result.unionByName(more)
    return result
