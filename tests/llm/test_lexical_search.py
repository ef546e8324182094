"""Ranked lexical search against plain Python."""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import pytest

from docspark.llm import lexical_search as search
from docspark.llm.common import LAST_ID
from tests.llm.brute import low, order
from tests.llm.conftest import prose

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute(docs, items, best=search.BEST, weigh=lambda n, df: math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))):
    """(item_id, rank, doc_id, score) for (doc_id, text) and (item_id, text)."""
    wanted = defaultdict(set)
    for i, t in items:
        wanted[i] |= set(TERM.findall(low(t)))
    bags = [(d, Counter(TERM.findall(low(t)))) for d, t in docs]
    n_docs, n_terms = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    weight = {t: weigh(n_docs, n) for t, n in df.items()}
    out = []
    for i, terms in wanted.items():
        scored = []
        for d, b in bags:
            m = 100 - 50 + (50 * b.total() * n_docs) // max(n_terms, 1)
            score = sum(weight[t] * ((1000000000 * b[t]) // (1000 * b[t] + 20 * m)) for t in terms if t in b)
            if score > 0:
                scored.append((-score, order(d)))
        out += [(i, r, None if d == LAST_ID else d, -s) for r, (s, d) in enumerate(sorted(scored)[:best], 1)]
    return sorted(out, key=repr)


def found(docs, items, **more):
    return sorted((tuple(r) for r in search.search(docs, items, **more).collect()), key=repr)


ITEMS = [(1, prose(1, 30)), (2, prose(2, 12)), (3, "Two WORDS two-words, la"), (4, None), (5, "... \n"), (None, "mit license cookie"), (6, "nowhere unheard"), (7, "é Ör 日本"),
         (8, prose(7, 9)), (8, prose(12, 20)), (9, prose(3, 30)), (9, prose(3, 30)), (None, "la")]


def planted():
    """Groups of copies, of equal bags in other order, and documents that share a few terms only."""
    docs = [(i, "the same " + prose(1, 25)) for i in range(300, 100, -1)]
    docs += [(1000 + i, " ".join(sorted(prose(2, 12).split(), reverse=i % 2 == 0))) for i in range(150)]
    docs += [(2000 + i, f"{prose(i, 20)} unheard{i}") for i in range(200)] + [(None, prose(2, 12)), (None, prose(2, 12)), (5, prose(2, 12)), (5, prose(2, 40)), (5, prose(2, 40))]
    return docs


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in ITEMS], "item_id bigint, text string, term string, item int, rank int").repartition(3)


def test_planted_documents(spark, items):
    docs = spark.createDataFrame(planted(), "doc_id bigint, text string").repartition(6)
    assert found(docs, items) == brute(planted(), ITEMS)
    assert found(docs, items, best=3) == brute(planted(), ITEMS, 3)


def test_small_blocks_and_pieces(spark, items, monkeypatch):
    docs = spark.createDataFrame(planted(), "doc_id bigint, text string").repartition(2)
    monkeypatch.setattr(search, "ITEMS", 3)
    monkeypatch.setattr(search, "PIECE", 50)
    monkeypatch.setattr(search, "CELLS", 40)
    assert found(docs, items) == brute(planted(), ITEMS)


def test_scores_beyond_doubles(spark, items, monkeypatch):
    docs = spark.createDataFrame(planted(), "doc_id bigint, text string")
    def weigh(n_docs, df):
        return 10**10 + df

    monkeypatch.setattr(search, "term_weight", weigh)
    got = found(docs, items)
    assert got == brute(planted(), ITEMS, weigh=weigh) and max(r[3] for r in got) > 1 << 53


def test_awkward_rows(awkward, given, nothing, items, spark):
    rows = [(d, t) for d, t, _ in given]
    assert found(awkward, items) == brute(rows, ITEMS)
    assert found(nothing, items) == [] and found(awkward, items.limit(0)) == []
    text = spark.createDataFrame([(str(i), t) for i, t in ITEMS[:3]], "item_id string, text string")
    assert found(awkward, text) == brute(rows, [(str(i), t) for i, t in ITEMS[:3]])


def test_more_copies_than_best_of_all_items(spark):
    docs = [(i, "alpha beta") for i in range(500)] + [(i, "alpha") for i in range(500, 900)]
    got = found(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(1, "alpha beta gamma"), (2, "alpha")], "item_id int, text string"))
    assert got == brute(docs, [(1, "alpha beta gamma"), (2, "alpha")])
    assert [r[2] for r in sorted(got)[:50]] == list(range(50))
