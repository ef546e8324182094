"""Benchmark decontamination with a distributed positional inverted index.

A test window is ``window`` (13) consecutive words of an item. The corpus is counted for every test word; each window
is then looked up by its two rarest words, so only postings (document, word, position) of those are stored.
Posting lists are shifted by the word's offset in the window and intersected from the rarest word on: what is
left names a place in a document where the window may stand. Places are verified against the document's own words:
exactly for phrase matches, and for proximity matches by finding all words of the window at most ``slop`` words outside it.

Equal windows of several items are one window with many holders, looked up and verified once. A common test word or passage
is a hot key of plain equi-joins only; nothing is gathered by word. A document gathers the words of each of its windows
once, and one number for each place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.expr import let
from docspark.llm.common import LAST_ID, NOT_ALNUM, fresh, lower_ascii, words
from docspark.session import cut_lineage

WINDOW = 13
SLOP = 5
#: A document is contaminated from this share of hit words on (one in ...).
ONE_IN = 20


def _tokens(text: Column) -> Column:
    return words(lower_ascii(text), NOT_ALNUM)


def _doc(id_col: str) -> Column:
    return F.coalesce(F.col(id_col).cast("long"), F.lit(LAST_ID)).alias("doc")


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash")


def item_windows(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``item, start, parts``: every window of every item; an item of fewer words is one window, one without words has none."""
    items = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("item"), _tokens(F.col(text_col)).alias("ws")).filter(F.size("ws") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("ws") - window, F.lit(0)))
    return items.select("item", "ws", F.explode(starts).alias("start")).select("item", "start", F.slice("ws", F.col("start") + 1, window).alias("parts"))


def rarest_words(windows: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Distinct windows all of whose words occur in the corpus, with their holders and two rarest words.

    Columns: ``win`` (digest of the words), ``parts, holders`` (item, start) and ``t1, o1, t2, o2``; of equally rare words the first is taken.
    """
    holders = F.sort_array(F.collect_set(F.struct("item", "start"))).alias("holders")
    windows = cut_lineage(windows.groupBy("parts").agg(holders).withColumn("win", F.md5(F.array_join("parts", " "))))
    terms = cut_lineage(windows.select(F.explode("parts").alias("term")).distinct())
    seen = docs.select(F.explode(_tokens(F.col(text_col))).alias("term")).join(terms, "term").groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    placed = windows.select("win", F.posexplode("parts").alias("o", "term")).join(cut_lineage(seen), "term")
    ordered = placed.groupBy("win").agg(F.sort_array(F.collect_set(F.struct("n", "o", "term"))).alias("by_rarity"))
    ordered = ordered.join(windows, "win").filter(F.size("by_rarity") == F.size("parts"))
    first, second = F.get("by_rarity", F.lit(0)), F.coalesce(F.get("by_rarity", F.lit(1)), F.get("by_rarity", F.lit(0)))
    return cut_lineage(ordered.select(
        "win", "parts", "holders", first["term"].alias("t1"), first["o"].alias("o1"), second["term"].alias("t2"), second["o"].alias("o2")))


def postings(docs: DataFrame, terms: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index of the corpus for ``terms``: ``doc, text_hash, term, pos``; repeated rows are one document; written once."""
    tokens = docs.select(_doc(id_col), F.col(text_col).alias("text"), _text_hash(text_col))
    placed = tokens.select("doc", "text_hash", F.posexplode(_tokens(F.col("text"))).alias("pos", "term"))
    return cut_lineage(placed.join(terms, "term").select("doc", "text_hash", "term", "pos").distinct())


def places(index: DataFrame, probes: DataFrame, window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Places where a window may stand, exactly or nearly: ``doc, text_hash, win, begin, exact``.

    The rarest word's postings give the place; the second list is met within the window's span and ``slop``. Positions
    are cut into spans as wide as that, so one word repeated through a long text meets its neighbours only.
    """
    width = window + 2 * slop
    lists = probes.select(F.col("t1").alias("term"), "o1", "t2", "o2", "win", F.size("parts").alias("n"))
    begun = index.join(lists, "term").select("doc", "text_hash", (F.col("pos") - F.col("o1")).alias("begin"), F.col("t2").alias("term"), "o2", "win", "n")
    low, high = F.col("begin") - slop, F.col("begin") + F.col("n") + slop - 1
    spans = F.array_distinct(F.array(F.floor(low / width), F.floor(high / width)))
    begun = begun.withColumn("span", F.explode(spans))
    second = index.select("doc", "text_hash", "term", "pos", F.floor(F.col("pos") / width).alias("span"))
    met = begun.join(second, ["doc", "text_hash", "term", "span"]).filter((F.col("pos") >= low) & (F.col("pos") <= high))
    return met.groupBy("doc", "text_hash", "win", "begin").agg(F.max((F.col("pos") == F.col("begin") + F.col("o2")) & (F.col("begin") >= 0)).alias("exact"))


def find_items(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
               item_text_col: str = "text", window: int = WINDOW, slop: int = SLOP) -> DataFrame:
    """Phrase and proximity matches of every row.

    Columns: ``doc_id, text_hash, n_words, n_hit, items, near_items, phrases``. ``phrases`` lists (item, start, begin) of windows
    that stand in the document word for word; ``n_hit`` counts its words inside any of them, ``items`` names their items
    (sorted as strings). ``near_items`` names further items with a proximity match: a window's rarest word (by its count in ``docs``,
    then its place in the window) stands somewhere, and all its other words stand within the window's span around it, widened by
    ``slop`` words on both sides. A null or empty text has no words and no match; an item without words matches nothing; an item
    without an id is named by the empty string. Repeated rows get the same answer. Without documents there is no row, without
    items no match.
    """
    probes = rarest_words(item_windows(benchmark, item_col, item_text_col, window), docs, text_col)
    terms = cut_lineage(probes.select(F.explode(F.array("t1", "t2")).alias("term")).distinct())
    spots = places(postings(docs, terms, id_col, text_col), probes, window, slop)
    spots = spots.groupBy("doc", "text_hash", "win").agg(F.collect_list(F.struct("begin", "exact")).alias("spots"))
    found = spots.join(probes.select("win", "parts", "holders"), "win")
    found = cut_lineage(found.groupBy("doc", "text_hash").agg(F.collect_list(F.struct("parts", "holders", "spots")).alias("places")))

    place = "array<struct<parts:array<string>,holders:array<struct<item:string,start:int>>,spots:array<struct<begin:int,exact:boolean>>>>"
    rows = docs.select(_doc(id_col), _text_hash(text_col), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.join(found.hint("shuffle_hash"), ["doc", "text_hash"], "left")

    def verified(t: Column) -> Column:
        given = F.coalesce(F.col("places"), F.array().cast(place))

        def judged(w: Column) -> Column:
            n, low = F.size(w["parts"]), lambda s: F.greatest(s["begin"] - slop, F.lit(0))
            begins = F.transform(F.filter(w["spots"], lambda s: s["exact"] & (F.slice(t, F.greatest(s["begin"], F.lit(0)) + 1, n) == w["parts"])), lambda s: s["begin"])
            around = lambda s: F.slice(t, low(s) + 1, s["begin"] + n + slop - low(s))
            near = F.exists(w["spots"], lambda s: F.size(F.array_intersect(w["parts"], around(s))) == F.size(F.array_distinct(w["parts"])))
            return F.struct(n.alias("n"), w["holders"].alias("holders"), begins.alias("begins"), near.alias("near"))

        return F.struct(F.size(t).cast("long").alias("n_words"), F.transform(given, judged).alias("met"))

    names = lambda met: F.flatten(F.transform(met, lambda w: w["holders"]["item"]))
    judged = rows.select("doc_id", "text_hash", let(_tokens(F.col("text")), verified).alias("m"))
    judged = judged.select("doc_id", "text_hash", "m.n_words", F.filter("m.met", lambda w: F.size(w["begins"]) > 0).alias("exact"), F.filter("m.met", lambda w: w["near"]).alias("near"))
    covered = F.flatten(F.transform("exact", lambda w: F.flatten(F.transform(w["begins"], lambda b: F.sequence(b, b + w["n"] - 1)))))
    phrases = F.flatten(F.transform("exact", lambda w: F.flatten(F.transform(
        w["holders"], lambda h: F.transform(w["begins"], lambda b: F.struct(h["item"].alias("item"), h["start"].alias("start"), b.alias("begin")))))))
    return judged.select(
        "doc_id", "text_hash", "n_words", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(names(F.col("exact")))).alias("items"),
        F.array_sort(F.array_except(names(F.col("near")), names(F.col("exact")))).alias("near_items"), phrases.alias("phrases"),
    )


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (ONE_IN * n_hit >= n_words)


def clean_documents(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not contaminated, with their columns."""
    bad = find_items(docs, benchmark, id_col, text_col).filter(contaminated(F.col("n_hit"), F.col("n_words")))
    doc, text_hash = fresh("hit_doc", docs.columns), fresh("hit_text", docs.columns)
    bad = cut_lineage(bad.select(_doc("doc_id").alias(doc), F.col("text_hash").alias(text_hash)).distinct())
    same = (F.coalesce(docs[id_col].cast("long"), F.lit(LAST_ID)) == bad[doc]) & (F.xxhash64(F.coalesce(docs[text_col], F.lit(""))) == bad[text_hash])
    return docs.join(bad, same, "left_anti")
