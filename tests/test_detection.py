"""Detection against plain-Python brute force and its own invariants."""

import math
import re
import statistics

import pytest
from pyspark.sql import functions as F

from docspark.functions import fixed, labels, stylometry
from docspark.functions.expr import prefix_sums
from docspark.operators import cross_perplexity, detect, evaluate, segment

TEXTS = {
    1: "The cat sat on the mat. The cat sat on the mat! Did the cat sit? Yes, it's there.",
    2: "x" * 1500,
    3: "One two three.\n\nShort.\n\n" + "This paragraph is long enough to be kept by the rule. " * 40,
    4: "",
    5: "NO lower HERE; 123 456. " * 80,
    6: "été être à là. " * 100,
}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(TEXTS.items()), "doc_id bigint, text string")


def brute_windows(text):
    if len(text) <= 800:
        return [text]
    step = max(1, (len(text) - 800) // 5)
    return [text[i:i + 800] for i in range(0, len(text) - 799, step)][:6]


def brute_features(window):
    words = [w.lower() for w in re.findall(r"[A-Za-z']+", window)]
    n = len(words) or 1
    lens = [len(re.findall(r"[A-Za-z']+", s)) for s in re.split(r"(?<=[.!?])\s+", window) if s.strip()] or [n]
    grams = list(zip(words, words[1:], words[2:]))
    return {
        "ttr": len(set(words)) / n,
        "avg_word_len": sum(map(len, words)) / n,
        "stop_ratio": sum(w in fixed.STOPWORDS for w in words) / n,
        "mean_len": statistics.fmean(lens),
        "var_len": statistics.pvariance(lens),
        "punct_density": len(re.findall(r"[.,;:!?]", window)) / max(1, len(window)),
        "upper_ratio": sum(c.isupper() for c in window) / max(1, len(window)),
        "rep_ratio": 1 - len(set(grams)) / len(grams) if grams else 0.0,
    }


def test_features_match_brute_force(docs):
    for row in detect.document_features(docs).collect():
        text = TEXTS[row.doc_id]
        rows = [brute_features(text[i:i + 800]) for i in range(0, max(1, len(text)), 800)]
        for name in stylometry.FEATURES:
            assert row[name] == pytest.approx(statistics.fmean(r[name] for r in rows), abs=1e-9), (row.doc_id, name)
        assert 0.15 <= row.ai_likeness <= 0.85


def test_windows_and_chunks_rebuild_text(docs):
    chunks = segment.chunk_text(docs).orderBy("doc_id", "pos").collect()
    for doc_id, text in TEXTS.items():
        mine = [c for c in chunks if c.doc_id == doc_id]
        assert "".join(c.segment for c in mine) == text
        assert all(text[c.start_index:c.end_index] == c.segment for c in mine)
    for row in segment.sample_windows(docs).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("pos", "segment"))).alias("w")).collect():
        assert "".join(w.segment for w in row.w) == TEXTS[row.doc_id] and all(len(w.segment) <= 800 for w in row.w)
    for row in segment.sample_windows(docs, max_windows=6).groupBy("doc_id").agg(F.collect_list("segment").alias("w")).collect():
        assert sorted(row.w) == sorted(brute_windows(TEXTS[row.doc_id]))


def test_report_offsets_and_weights(docs):
    for row in detect.detect_paragraphs(docs).collect():
        cursor, weighted, size = 0, 0.0, 0
        for s in row.segments:
            assert (s.start_index, s.end_index) == (cursor, cursor + len(s.text))
            cursor = s.end_index + 2
            weighted += s.ai_score * len(s.text)
            size += len(s.text)
            assert s.ai_percentage + s.human_percentage == 100
        assert row.overall_score == pytest.approx(weighted / size if size else 0.5)


def test_offsets_across_blocks(spark):
    lengths = [(i * 5) % 17 + 1 for i in range(50)]
    df = spark.createDataFrame([(1, i, "x" * n) for i, n in enumerate(lengths)], "doc_id bigint, pos int, segment string")
    for block in (1, 7, 1024):
        got = segment.segment_offsets(df, 2, block=block).orderBy("pos").collect()
        assert [r.start_index for r in got] == [sum(lengths[:i]) + 2 * i for i in range(50)]
        assert all(r.end_index - r.start_index == len(r.segment) for r in got)


def test_orientation(docs):
    plain = {r.doc_id: r for r in detect.fast_detect(docs).collect()}
    flipped = {r.doc_id: r for r in detect.fast_detect(docs, inverted_output=True).collect()}
    for doc_id, row in plain.items():
        assert row.score == pytest.approx(1 - flipped[doc_id].score, abs=2e-4)
        assert row.is_ai_generated == (row.ai_likeness > 0.5)


def test_true_zero_is_kept(spark):
    df = spark.createDataFrame([(0.0,), (None,)], "s double")
    assert [r.x for r in df.select(labels.neutral(F.col("s")).alias("x")).collect()] == [0.0, 0.5]


def test_label_shares_sum_to_hundred(docs):
    for r in detect.classify_sentences(docs).collect():
        total = sum(r[c] for c in detect.LABEL_COLUMNS)
        assert total == pytest.approx(100.0, abs=0.04) if r.n_sentences else total == 0


ODD_SENTENCES = [
    None, "", " ", ". . .", "Yes. No!  Maybe?\nSo.", "a a a a a. b b b b b b, b! c c c d d d c c c d d d?", "日本 是. Привет, мир! 12 34.",
    "the cat sat on the mat. The cat sat on the mat, THE CAT SAT ON THE MAT!!!! it's it's it's", "\u0130stanbul \u212aelvin K k K k K k. I\u0130 i.",
    "word " * 159 + "wor. next", "a " * 900 + ". a b a b a b a b a b a b a b", "\u0130" * 801 + ". ,,,,,,", " ".join("abcdefghi") * 4 + "!",
]


@pytest.mark.parametrize("threshold", [0.1, 0.5, 0.6, 0.66, 0.675, 0.8])
def test_labels_settled_early_are_those_of_the_score(spark, docs, threshold):
    odd = spark.createDataFrame([(-1 - i, x) for i, x in enumerate(ODD_SENTENCES)], "doc_id long, text string")
    both = docs.select("doc_id", "text").unionByName(odd)
    settled = detect.classify_sentences(both, threshold=threshold).orderBy("doc_id").collect()
    scored = detect.classify_sentences(both, scorer=stylometry.fast_score, threshold=threshold).orderBy("doc_id").collect()
    assert settled == scored


def test_sentences_are_not_measured_for_unscored_features(docs):
    plan = detect.classify_sentences(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert r"\p{Lu}" not in plan and "(lambda" in plan
    assert "lower(lambda" not in plan and "lower(array_join" not in plan


def test_missing_text_has_no_sentences(spark):
    df = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert [tuple(r)[1:] for r in detect.classify_sentences(df).orderBy("doc_id").collect()] == [(0, 0.0, 0.0, 0.0, 0.0)] * 2


def test_lowered_text_keeps_its_length_and_words(spark):
    letters = " ".join(chr(c) for c in range(1, 0x110000) if not 0xD800 <= c < 0xE000)
    df = spark.createDataFrame([(letters,), ("\u0130a\u212ab It's",)], "t string")
    low = stylometry.lowered(F.col("t"))
    for r in df.select(
        F.length("t").alias("n"), F.length(low).alias("m"), stylometry.lowered_words(F.col("t")).alias("w"), stylometry.words_of(low).alias("v")
    ).collect():
        assert r.n == r.m and r.w == r.v


def test_prefix_sums(spark):
    for n in (0, 1, 255, 256, 257, 1000):
        values = [(i * 7) % 13 for i in range(n)]
        df = spark.createDataFrame([(values,)], "v array<bigint>")
        assert df.select(prefix_sums(F.col("v")).alias("p")).first().p == [sum(values[:i]) for i in range(n)]


def test_evaluation_on_known_scores(spark):
    human = spark.createDataFrame([(0.9,), (0.8,), (0.8,), (0.3,)], "score double")
    machine = spark.createDataFrame([(0.1,), (0.2,), (0.8,), (0.95,)], "score double")
    scores = evaluate.union_scores(human, machine)
    report = evaluate.evaluate_detector(scores, threshold=0.5).first()
    assert (report.tp, report.fp, report.fn, report.tn) == (2, 1, 2, 3)
    assert report.f1 == pytest.approx(4 / 7)
    pairs = [(m < h) + 0.5 * (m == h) for m in (0.1, 0.2, 0.8, 0.95) for h in (0.9, 0.8, 0.8, 0.3)]
    assert report.auc == pytest.approx(sum(pairs) / 16)
    assert report.tpr_at_fpr == pytest.approx(0.5)
    for bins in (1, 3, 1000):
        roc = evaluate.roc_curve(evaluate.score_groups(scores), bins).orderBy("score").collect()
        assert [(r.tp, r.fp) for r in roc] == [(1, 0), (2, 0), (2, 1), (3, 3), (3, 4), (4, 4)]


def test_word_ngrams_are_folded_in_small_tasks(spark):
    """Also where the input has many splits, which are not dealt out otherwise."""
    from docspark.plans import QUERIES
    from tests.conftest import SMALL

    spark.conf.set("spark.sql.files.maxPartitionBytes", "10k")
    try:
        splits = spark.read.parquet(f"{SMALL}/documents.parquet").rdd.getNumPartitions()
        counted = QUERIES["word_ngrams"](spark, SMALL)
        plan = counted._jdf.queryExecution().optimizedPlan().toString()
        assert splits >= 2 * spark.sparkContext.defaultParallelism and f"Repartition {8 * splits}, " in plan
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_cross_perplexity_brute_force(spark):
    observer = ["a b a b c", "b c"]
    performer = {1: "a b c a b", 2: "c", 3: ""}
    docs = spark.createDataFrame(list(performer.items()), "doc_id bigint, text string")
    obs = spark.createDataFrame([(t,) for t in observer], "text string")
    words = sorted({w for t in [*observer, *performer.values()] for w in t.split()})

    def counts(texts):
        out = {}
        for t in texts:
            ws = t.split()
            for pair in zip(ws, ws[1:]):
                out[pair] = out.get(pair, 0) + 1
        return out

    for temperature in (1.0, 2.0):
        def prob(table, ctx):
            raw = [(table.get((ctx, w), 0) + 1.0) ** (1 / temperature) for w in words]
            return [r / sum(raw) for r in raw]

        p, q = counts(observer), counts(performer.values())
        got = {r.doc_id: r for r in cross_perplexity.cross_perplexity(
            docs, obs, temperature=temperature, min_tokens=2).collect()}
        ws = performer[1].split()
        nll = [-math.log(prob(q, a)[words.index(b)]) for a, b in zip(ws, ws[1:])]
        xs = [-sum(pp * math.log(qq) for pp, qq in zip(prob(p, w), prob(q, w))) for w in ws]
        assert got[1].ppl == pytest.approx(statistics.fmean(nll))
        assert got[1].x_ppl == pytest.approx(statistics.fmean(xs))
        assert got[1].score == pytest.approx(statistics.fmean(nll) / statistics.fmean(xs))
        assert not got[2].scorable and got[2].score is None and got[3].n_tokens == 0


def _bytes_shuffled(spark):
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def _random_texts(n, words, vocabulary, seed):
    import random

    rng = random.Random(seed)
    names = ["".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(vocabulary)]
    return [" ".join(rng.choices(names, k=words)) for _ in range(n)]


def test_cross_perplexity_shuffles_places_once(spark, tmp_path):
    texts = _random_texts(400, 300, 5000, 1)
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs").repartition(8)
    obs = spark.createDataFrame([(texts[0],)], "text string")
    before = _bytes_shuffled(spark)
    cross_perplexity.cross_perplexity(docs, obs).collect()
    assert _bytes_shuffled(spark) - before < 50 * 400 * 300


def test_cross_perplexity_of_common_bigrams(spark):
    """Bigrams spread over partitions give what one partition gives, for every kind of performer."""
    rows = [(i, "the same words the same words " * 5 + t) for i, t in enumerate(_random_texts(60, 20, 300, 2))] + [(None, "the same"), (3, "the same words"), (99, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    obs = spark.createDataFrame([("the same words are here the same",)], "text string")
    other = docs.filter("doc_id < 20").select("text")
    kept = spark.conf.get("spark.sql.shuffle.partitions")
    for ways in ({}, {"median": True}, {"max_tokens": 17}, {"performer": other}, {"performer": other, "max_tokens": 9, "median": True}):
        got = []
        for partitions in (1, 40):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            scores = cross_perplexity.cross_perplexity(docs, obs, min_tokens=2, **ways)
            got.append(sorted(([(x if x is None or isinstance(x, (int, bool)) else round(x, 9)) for x in r] for r in scores.collect()), key=repr))
        spark.conf.set("spark.sql.shuffle.partitions", kept)
        assert got[0] == got[1] and len(got[0]) == len(rows)


def test_scorer_failures_are_isolated(spark):
    from docspark.operators import scorers

    def load():
        def score(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return [len(t) / 10 for t in texts]

        return score

    df = spark.createDataFrame([(i, "bad" if i == 3 else "x" * i) for i in range(9)], "doc_id bigint, text string")
    got = {r.doc_id: (r.score, r.error) for r in scorers.score_with(df.coalesce(1), load).collect()}
    assert got[3] == (None, "scoring_failed")
    assert all(got[i] == (i / 10, None) for i in range(9) if i != 3)
    assert scorers.score_by("stylometric", df).filter("score is null").count() == 0


def test_a_batch_that_fails_half_way(spark):
    from docspark.operators import scorers

    df = spark.createDataFrame([(i, str(i)) for i in range(6)], "doc_id bigint, text string").coalesce(1)
    load = lambda: lambda texts: [None if t == "1" else int(t) / 10 for t in texts]
    got = {r.doc_id: (r.score, r.error) for r in scorers.score_with(df, load).collect()}
    assert got == {i: ((None, "scoring_failed") if i == 1 else (i / 10, None)) for i in range(6)}
    short = {r.doc_id: r.error for r in scorers.score_with(df, lambda: lambda texts: [0.5] * min(len(texts), 1)).collect()}
    assert short == dict.fromkeys(range(6))


def test_table_function_in_sql(spark):
    from docspark.operators import scorers

    df = spark.createDataFrame([(i, None if i == 5 else str(i), "x") for i in range(9)], "doc_id bigint, text string, score string")

    def load():
        def score(texts):
            if "3" in texts:
                raise ValueError("refused")
            return [int(t) / 10 for t in texts]

        return score

    scorers.register_table_function(spark, "tenth", load)
    for rows in (df, df.coalesce(1), df.repartition(4)):
        got = {r.doc_id: (r.score, r.error) for r in spark.sql("SELECT * FROM tenth(TABLE(SELECT * FROM {rows}))", rows=rows).collect()}
        assert got == {i: (None, "no_text") if i == 5 else (None, "scoring_failed") if i == 3 else (i / 10, None) for i in range(9)}
    over = spark.sql("SELECT count(*) AS n, count(error) AS failed FROM tenth(TABLE(SELECT * FROM {rows})) WHERE doc_id > 2", rows=df).first()
    assert (over.n, over.failed) == (6, 2)
    assert spark.sql("SELECT * FROM tenth(TABLE(SELECT * FROM {rows}))", rows=df.limit(0)).collect() == []
