"""Strings in a text by rolling hashes, against plain search."""

import random
import time

from pyspark.sql import functions as F

from docspark.functions import containment
from docspark.functions.containment import missing
from docspark.operators import redact


def judged(spark, rows, **bounds):
    df = spark.createDataFrame(rows, "i int, needles array<string>, text string")
    return {r.i: r.m for r in df.select("i", missing(F.col("needles"), F.col("text"), **bounds).alias("m")).collect()}


def test_every_length_against_plain_search(spark):
    rng = random.Random(5)
    rows = []
    for i in range(60):
        text = "".join(rng.choice("ab\n é😀") for _ in range(rng.randrange(0, 300)))
        cut = [text[a : a + rng.randrange(1, 9)] for a in (rng.randrange(max(1, len(text))) for _ in range(40))]
        made = ["".join(rng.choice("ab é😀") for _ in range(rng.randrange(0, 9))) for _ in range(40)]
        rows.append((i, cut + made + [text], text))
    want = {i: [n not in text for n in needles] for i, needles, text in rows}
    assert judged(spark, rows) == want
    assert judged(spark, rows, piece=16, few=0) == want


def test_repeated_strings_that_defeat_sums_of_powers_of_two(spark):
    swapped = str.maketrans("ab", "ba")
    word = "a"
    for _ in range(11):
        word += word.translate(swapped)
    text = "x" + word + "y" + word[:1024]
    needles = [word.translate(swapped), word, word.translate(swapped)[:1024], word[:1024]]
    assert judged(spark, [(0, needles, text)], few=0)[0] == [n not in text for n in needles]


def test_nulls_and_empty(spark):
    rows = [(0, None, "a"), (1, ["a", None, ""], "a"), (2, ["a"], None), (3, [], "a"), (4, ["a", ""], "")]
    assert judged(spark, rows) == {0: None, 1: [False, None, False], 2: None, 3: [], 4: [True, False]}


def test_removed_lines_of_one_long_document(spark):
    """20,000 lines of which none stays as it was: half of them still stand inside longer lines."""
    lines = [f"line {i:06d} of the file" for i in range(20_000)]
    after = "\n".join(f"[{x}]" if i % 2 else f"[{x[:-1]}]" for i, x in enumerate(lines))
    df = spark.createDataFrame([(1, "\n".join(lines), after), (2, None, "a"), (3, "a", None), (4, " \n b \nc", "cb")], "doc_id int, text string, kept string")
    began = time.monotonic()
    got = redact.removed_lines(df, "text", "kept").collect()
    assert time.monotonic() - began < 30
    assert [r.line for r in got if r.doc_id == 1] == [x for i, x in enumerate(lines) if i % 2 == 0]
    assert [r.pos for r in got if r.doc_id == 1] == list(range(10_000))
    assert not [r for r in got if r.doc_id != 1]


def test_one_row_at_a_time_is_python():
    import tracemalloc

    import pyarrow as pa

    texts = [f"{i} " + "words of a line\n" * 400 for i in range(1500)]
    lists = [[f"{i} words of a line", "words of a line", "absent"] for i in range(1500)]
    arrays = pa.array(lists), pa.array(texts)
    work = containment._absent(containment.PIECE, containment.FEW)
    tracemalloc.start()
    got = work(*arrays).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == [[False, False, True]] * 1500 and peak < arrays[1].nbytes / 4
