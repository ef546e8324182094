import pytest

NAMES = ("doc_id", "text", "lang", "source", "n_chars", "key", "src", "doc", "hash", "text_hash", "fp", "size", "lines", "runs", "bucket", "term", "places")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, " + ", ".join(f"{n} string" for n in NAMES[5:])

WORDS = [a + b for a in ("al", "be", "co", "du", "en", "fi", "go", "hu") for b in ("ra", "se", "ti", "mo", "ku", "na", "pel", "xi", "Ör", "zz")]


def prose(seed: int, n: int) -> str:
    """Invented words without much repetition."""
    out, x = [], seed * 7919 + 17
    for i in range(n):
        x = (x * 1103515245 + 12345) % (1 << 31)
        out.append(WORDS[(x >> 8) % len(WORDS)] + (".\n" if i % 11 == 10 else ""))
    return " ".join(out)


def awkward_rows() -> list[tuple]:
    """Nulls in every column, empty and long texts, ties, repeated rows, copies, shared passages."""
    passage, near = prose(1, 70), prose(2, 400).split(" ")
    rows = [
        (1, prose(3, 90) + " " + passage + " " + prose(4, 60), "en", "a"),
        (2, prose(5, 40) + " " + passage + " " + prose(6, 60), "en", "a"),
        (2, prose(7, 40) + " " + passage + " " + prose(8, 10), "en", "b"),
        (3, prose(9, 20) + " " + passage, None, None),
        (4, None, "en", "a"), (4, None, "en", "a"), (5, "", None, "b"), (6, " \t\n ", "de", None),
        (None, prose(10, 80) + " " + passage, "de", "a"), (None, prose(10, 80) + " " + passage, "de", "a"), (None, None, None, None),
        (7, prose(11, 60), "de", "Z"), (8, prose(11, 60), "de", "é"), (9, prose(11, 60), "de", "Z"), (9, prose(11, 60), "de", "Z"),
        (10, "two words", "fr", "b"), (11, "Two  Words", "fr", "b"), (12, "###", "fr", "b"),
        (13, " ".join(near), "en", "b"), (14, " ".join(near[:200] + ["changed"] + near[200:]), "en", "b"), (15, " ".join(near[:-1]), "en", "a"),
        (16, "la " * 300, "es", "b"), (17, ("la la le lu " * 20 + "\n") * 9, "es", "b"),
        (18, prose(12, 9000), "en", "a"), (19, prose(13, 55) + "\nReleased under the MIT License.\n" + prose(14, 5), "en", "a"),
        (20, "Licensed under CC BY-NC 4.0.\nlicensed under the apache license version 2\nGNU General Public License mit-LICENSE", "en", "c"),
        (21, prose(15, 5000) + " " + passage + passage + " " + prose(15, 500), "en", "c"),
    ]
    rows += [(30 + i, prose(40 + i, 60) + "\nCookie  notice: we use COOKIES\n" + (prose(77, 176) if i % 5 else ""), "en", "h") for i in range(30)]
    return [(*r, None if r[0] is None else len(r[1] or ""), *[None if i % 2 else "x" for i in range(len(NAMES) - 5)]) for r in rows]


@pytest.fixture(scope="session")
def awkward(spark):
    return spark.createDataFrame(awkward_rows(), SCHEMA).repartition(4).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def given(awkward):
    """The rows as (doc_id, text, source)."""
    return [(r["doc_id"], r["text"], r["source"]) for r in awkward.collect()]
