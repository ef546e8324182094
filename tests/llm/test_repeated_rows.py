"""Thousands of equal rows, with and without ids: their cost grows with their number only, and they get equal answers."""

from __future__ import annotations

import pytest

from docspark.llm import decontamination, substring_dedup
from tests.llm import brute
from tests.llm.conftest import prose

COPIES = 10_000


@pytest.mark.parametrize("doc_id", [2, None])
def test_substring_dedup(spark, doc_id):
    a, b, c = (prose(i, 60) for i in (501, 502, 503))
    rows = [(1, "\n".join((a, b, c))), (doc_id, "\n".join((c, a, b)))]
    docs = spark.createDataFrame([rows[0]] + [rows[1]] * COPIES, "doc_id long, text string").repartition(8)
    got = substring_dedup.remove_repeats(docs, with_text=False).groupBy("doc_id", "n_words", "n_removed", "kept_sha256").count().collect()
    want = [(d, *w) for (d, _), w in zip(rows, brute.substring_dedup(rows))]
    assert sorted((tuple(r) for r in got), key=lambda r: r[-1]) == [(*want[0], 1), (*want[1], COPIES)]


@pytest.mark.parametrize("doc_id", [2, None])
def test_decontamination(spark, doc_id):
    item = prose(504, 40)
    rows = [(1, prose(505, 80)), (doc_id, prose(506, 30) + " " + item + " " + prose(507, 30) + " " + item)]
    docs = spark.createDataFrame([rows[0]] + [rows[1]] * COPIES, "doc_id long, text string").repartition(8)
    found = decontamination.find_items(docs, spark.createDataFrame([("i", item)], "item_id string, text string"))
    got = found.groupBy("doc_id", "n_words", "n_hit", "items").count().collect()
    want = [(d, *w) for (d, _), w in zip(rows, brute.decontaminate(rows, [("i", item)]))]
    assert sorted((tuple(r) for r in got), key=lambda r: r[-1]) == [(*want[0], 1), (*want[1], COPIES)]
