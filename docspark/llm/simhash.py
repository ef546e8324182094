"""SimHash near-duplicates by segment popcounts.

A fingerprint has one bit per majority among the 64-bit hashes of the document's word shingles. Two
fingerprints are linked when at most two bits differ.

The bits fall into 16 segments of four and each segment's number of set bits is a coordinate. Flipping a bit
moves one coordinate by one, so the Manhattan distance of two such vectors never exceeds the bits in which the
fingerprints differ. Vectors at most 2 apart have a common grid cell at most 1 away from both: every
fingerprint enters its own cell and the cells one step away, and only cells that two or more fingerprints
enter are looked at again. There the fingerprints are verified exactly: in a cell a fingerprint stands for the
values that lie in that cell and differ from it in one bit at most, and two fingerprints are linked if and only
if they share such a value. At most 65 fingerprints share a value; its smallest one is their centre. So a
dense group of g fingerprints gives at most 65 g links, never g * g.

Fingerprints are grouped before anything else, so a group of copies is one node, whatever its size. Components
come from large-star and small-star rounds over the links, each written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.llm.common import LAST_ID, fresh
from docspark.session import cut_lineage

BITS = 64
SEGMENT = 4
SHINGLE = 3
SEED = 42
CHUNK = 20_000


def simhash(text: Column, shingle: int = SHINGLE) -> Column:
    """SimHash of a text (A-Z lower-cased) as a signed 64-bit number.

    Shingles are ``shingle`` consecutive words joined by a space, repeats included; a text of fewer words is one
    shingle; a text without words, or null, has fingerprint 0. Shingles are hashed in pieces, so memory stays near
    the size of one text.
    """

    @F.pandas_udf("bigint")
    def fingerprint(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        import xxhash

        digest = xxhash.xxh64_intdigest

        def one(value: str | None) -> int:
            parts = (value or "").encode().lower().split()
            if not parts:
                return 0
            size = min(shingle, len(parts))
            total, counts = len(parts) - size + 1, np.zeros(BITS, dtype=np.int64)
            for start in range(0, total, CHUNK):
                piece = parts[start : start + CHUNK + size - 1]
                grams = map(b" ".join, zip(*(piece[k:] for k in range(size))))
                hashes = np.fromiter((digest(g, SEED) for g in grams), dtype="<u8")
                bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
                counts += bits.sum(axis=0, dtype=np.int64)
            return int(np.packbits(2 * counts > total, bitorder="little").view("<i8")[0])

        for series in batches:
            yield pd.Series([one(v) for v in series], dtype="int64")

    return fingerprint(text)


def hexadecimal(fp: Column) -> Column:
    """16 lower-case hex digits of a signed 64-bit number."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _set_bits(fp: Column, segment: int) -> Column:
    return F.bit_count(F.shiftright(fp, segment * SEGMENT).bitwiseAND(F.lit((1 << SEGMENT) - 1)))


def grid_cells(distinct: DataFrame) -> DataFrame:
    """Every fingerprint with its own cell and those one step away: ``fp, at, step, cell``.

    A cell is the vector of counts, four bits each in one 64-bit number; ``at`` is the segment of the step (-1: none).
    """
    segments = range(BITS // SEGMENT)
    counts = [_set_bits(F.col("fp"), s).cast("bigint") for s in segments]
    cell = sum((c * F.lit(1 << SEGMENT * s).cast("bigint") for s, c in enumerate(counts[1:], 1)), counts[0])
    own = F.struct(F.lit(-1).alias("at"), F.lit(0).alias("step"), F.lit(0).cast("bigint").alias("move"))
    up = [F.when(counts[s] < SEGMENT, F.struct(F.lit(s).alias("at"), F.lit(1).alias("step"), F.lit(1 << SEGMENT * s).cast("bigint").alias("move"))) for s in segments]
    down = [F.when(counts[s] > 0, F.struct(F.lit(s).alias("at"), F.lit(-1).alias("step"), F.lit(-(1 << SEGMENT * s)).cast("bigint").alias("move"))) for s in segments]
    entered = distinct.select("fp", cell.alias("own"), F.explode(F.array_compact(F.array(own, *up, *down))).alias("m"))
    return entered.select("fp", F.col("m.at").alias("at"), F.col("m.step").alias("step"), (F.col("own") + F.col("m.move")).alias("cell"))


def links(distinct: DataFrame) -> DataFrame:
    """Links ``a, b`` (a > b) that connect exactly the fingerprints at most two bits apart; written once."""
    cells = grid_cells(distinct)
    shared = cells.groupBy("cell").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("cell")
    near = cells.join(shared, "cell", "left_semi")
    places = F.sequence(F.col("at") * SEGMENT, F.col("at") * SEGMENT + SEGMENT - 1)
    free = F.filter(places, lambda b: F.call_function("shiftright", F.col("fp"), b).bitwiseAND(F.lit(1)) == F.when(F.col("step") > 0, F.lit(0)).otherwise(F.lit(1)))
    values = F.when(F.col("at") < 0, F.array("fp")).otherwise(
        F.transform(free, lambda b: F.col("fp").bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("bigint"), b))))
    met = near.select("fp", F.explode(values).alias("value")).groupBy("value").agg(F.collect_set("fp").alias("fps")).filter(F.size("fps") > 1)
    pairs = met.select(F.explode("fps").alias("a"), F.array_min("fps").alias("b")).filter("a > b")
    return cut_lineage(pairs.distinct())


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(edges: DataFrame) -> DataFrame:
    """``node, root`` of every linked node: the smallest node that can be reached."""
    state = _state(edges)
    while state[0]:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            least.filter("m < a").select("a", F.col("m").alias("b")))
        large = cut_lineage(large.filter("a > b").distinct())
        root = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(root, "a").filter("b > m").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(
            root.select("a", F.col("m").alias("b")))
        edges = cut_lineage(small.filter("a > b").distinct())
        previous, state = state, _state(edges)
        if state == previous:
            break
    return edges.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")


def group_fingerprints(rows: DataFrame) -> DataFrame:
    """``fp, component_id, root`` of every distinct fingerprint of ``rows`` (``doc, fp``).

    ``component_id`` is the smallest ``doc`` among the fingerprints that can be reached.
    """
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min("doc").alias("doc")))
    found = components(links(distinct))
    rooted = cut_lineage(distinct.join(found, distinct["fp"] == found["node"], "left").select("fp", "doc", F.coalesce("root", "fp").alias("root")))
    smallest = rooted.groupBy("root").agg(F.min("doc").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id", "root")


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return cut_lineage(docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc"), simhash(F.col(text_col)).alias("fp")))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fingerprint, component_id`` of every row.

    Texts without words, and null ones, share fingerprint zero and are linked like any others. Rows without an id come
    after all ids; a component of such rows only has a null component. Repeated rows appear as often as they are given.
    An empty table gives no row.
    """
    rows = _rows(docs, id_col, text_col)
    real = lambda c: F.nullif(F.col(c), F.lit(LAST_ID).cast("long"))
    return rows.join(cut_lineage(group_fingerprints(rows)), "fp").select(
        real("doc").alias("doc_id"), hexadecimal(F.col("fp")).alias("fingerprint"), real("component_id").alias("component_id"))


def unique_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` per component: the one with the smallest id. Of repeated rows with that id and fingerprint one stays.

    Texts are read for their fingerprints once; the rows that stay are chosen by id and text hash, and texts move once, to meet these. Only
    where such a row is given several times are its copies folded.
    """
    doc, key = F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    rows = cut_lineage(docs.select(doc.alias("doc"), key.alias("text_hash"), simhash(F.col(text_col)).alias("fp")))
    least = rows.groupBy("fp").agg(F.min(F.struct("doc", "text_hash")).alias("least"))
    first = least.join(cut_lineage(group_fingerprints(rows)), "fp").filter("least.doc = component_id")
    first = cut_lineage(first.groupBy("root").agg(F.min_by("least", F.struct("least.doc", "fp")).alias("least")).select("least.*"))
    repeated = cut_lineage(rows.join(first, ["doc", "text_hash"], "left_semi").groupBy("doc", "text_hash").count().filter("count > 1").drop("count"))
    names = {c: fresh(f"simhash_{c}", docs.columns) for c in ("doc", "text_hash")}
    marked = docs.withColumns({names["doc"]: doc, names["text_hash"]: key})
    chosen = lambda keys: marked.join(keys.withColumnsRenamed(names), list(names.values()), "left_semi")
    if repeated.isEmpty():
        return chosen(first).drop(*names.values())
    once = chosen(repeated).dropDuplicates(list(names.values()))
    return chosen(cut_lineage(first.join(repeated, ["doc", "text_hash"], "left_anti"))).unionByName(once).drop(*names.values())
