"""Who keeps a common line, on planted hosts against the rule followed document by document."""

from __future__ import annotations

import corpus_pipeline
from docspark.llm import quality
from tests.llm import brute
from tests.llm.conftest import WORDS

SCHEMA = "doc_id bigint, text string, source string"


def line(tag: str, n: int = 8) -> str:
    return " ".join(f"{tag}{WORDS[i]}" for i in range(n))


def own(i: int, n: int, per_line: int = 6) -> list[str]:
    names = [f"own{i}x{j}" for j in range(n)]
    return [" ".join(names[k : k + per_line]) for k in range(0, n, per_line)]


def judged(spark, rows):
    got = quality.judge_quality(spark.createDataFrame(rows, SCHEMA).repartition(3))
    return sorted(tuple(r) for r in got.select("doc_id", "n_common_words", "kept").collect())


def by_rule(rows):
    return sorted((d, gone, kept) for (d, *_), (gone, _, _, kept) in zip(rows, brute.line_fates(rows)))


def test_a_rejected_document_keeps_no_line(spark):
    shared = [line(f"s{k}") for k in range(6)]
    rows = [(1, "\n".join(shared), "h")]
    rows += [(i, "\n".join(shared + own(i, 6)), "h") for i in range(2, 31)]
    rows += [(i, "\n".join(own(i, 60)), "h") for i in range(31, 531)]
    got = judged(spark, rows)
    assert got == by_rule(rows)
    assert got[:3] == [(1, 0, False), (2, 0, True), (3, 48, False)]
    assert sum(k for *_, k in got) == 501


def test_no_line_is_lost_with_depleted_documents(spark):
    a, b, c = ([line(f"{t}{k}") for k in range(6)] for t in "abc")
    rows = [(1, "\n".join(a), "h"), (2, "\n".join(a + own(2, 12)), "h")]
    rows += [(3, "\n".join(a + b[:1] + own(3, 6)), "h")]  # depleted by 2, though the first holder of a line of b
    rows += [(4, "\n".join(b + own(4, 1)), "i"), (5, "\n".join(b + own(5, 8)), "h"), (6, "\n".join(b + c[:1] + own(6, 2)), "h")]
    rows += [(i, "\n".join((a, b, c, a[:3] + b[3:] + c[:2], b[:4] + c[2:])[i % 5] + own(i, i % 16 + 1)), "h") for i in range(7, 130)]
    got = judged(spark, rows)
    assert got == by_rule(rows)
    assert [k for *_, k in got[:6]] == [False, True, False, False, True, False]
    held = {x for (_, t, _), g in zip(rows, got) if g[2] for x in t.split("\n")}
    assert set(a + b + c) <= held


def rolling(n: int):
    """Pages of a feed that moves on by one line."""
    feed = [line(f"f{k}x", 6) for k in range(n + 12)]
    return [(i, "\n".join(feed[i : i + 12] + own(i, 3)), "feed") for i in range(1, n + 1)]


def test_a_rolling_feed_takes_a_fixed_number_of_tables(spark, monkeypatch):
    written = []
    monkeypatch.setattr(quality, "cut_lineage", lambda df, cut=quality.cut_lineage: written.append(df) or cut(df))
    tables = []
    for n in (20, 80):
        rows, before = rolling(n), len(written)
        got = judged(spark, rows)
        assert got == by_rule(rows)
        tables.append(len(written) - before)
        common = {x for x in (f for _, t, _ in rows for f in t.split("\n")[:12]) if sum(x in t.split("\n") for _, t, _ in rows) > quality.LINE_DOCS}
        kept = {d for d, _, k in got if k}
        assert common <= {x for d, t, _ in rows if d in kept for x in t.split("\n")}
        assert len(kept) < 20 + n / 4
    assert tables[0] == tables[1]


def test_the_limit_is_the_same_in_a_large_host(spark):
    shared = [line(f"s{k}") for k in range(6)]
    rows = [(i, "\n".join(shared + own(i, 6)), host) for host, at in (("small", 0), ("large", 1000)) for i in range(at + 1, at + 16)]
    fill = spark.range(2000, 22000).selectExpr("id AS doc_id", "concat('filler ', id) AS text", "'large' AS source")
    got = quality.judge_quality(spark.createDataFrame(rows, SCHEMA).unionByName(fill)).filter("doc_id < 2000")
    assert sorted((r["doc_id"], r["n_common_words"]) for r in got.collect()) == [(d, 0 if d in (1, 1001) else 48) for d, *_ in rows]


def test_common_lines_leave_the_texts(spark):
    rows = [(i, "\n".join(own(i, 54) + [" Cookie\tNOTICE: x" if i % 2 else "cookie notice:  X ", "", "last  Line"] + own(-i, 6)), "h") for i in range(1, 21)]
    rows += [(2, rows[1][1], "h"), (30, "too short\ncookie notice: x", "h"), (31, rows[2][1], "other"), (None, None, "h")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], SCHEMA + ", n_chars int")
    got = corpus_pipeline.quality_rules(spark, docs, "")
    assert got.schema.names == docs.schema.names and got.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    want = [rows[0], rows[22]] + [(d, "\n".join(own(d, 54) + [""] + own(-d, 6)), "h") for d, *_ in rows[1:21]]
    assert sorted(map(tuple, got.collect())) == sorted((*r, len(r[1])) for r in want)
    assert quality.kept_documents(docs).filter("text LIKE '%ookie%'").count() == 22


def test_every_place_of_a_common_line_counts(spark):
    a, b = line("a", 9), [line(f"b{k}") for k in range(3)]
    rows = [(i, "\n".join([a] * (5 if i > 12 else 1) + b + own(i, 54 if i <= 12 else 24)), "h") for i in range(1, 14)]
    got = {r["doc_id"]: (r["n_words"], r["n_common_words"], r["kept"]) for r in quality.judge_quality(spark.createDataFrame(rows + rows[12:], SCHEMA)).collect()}
    assert (got[1], got[2], got[13]) == ((87, 0, True), (87, 33, True), (93, 69, False))
