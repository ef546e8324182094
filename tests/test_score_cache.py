"""Score store across runs: what is scored, what is read, how the store is joined."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from docspark.operators import score_cache
from docspark.operators.score_cache import ScoreStore, cached_scores


def texts(spark, numbers):
    return spark.createDataFrame([(i, f"Text number {n}. It has two sentences.") for i, n in enumerate(numbers)], "doc_id bigint, text string")


def stored(spark, store):
    return spark.read.parquet(store.location)


def counting(spark):
    """A scorer that counts the texts it sees."""
    seen = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def score(text):
        seen.add(1)
        return float(len(text))

    return seen, score


def test_second_run_scores_new_texts_only(spark, tmp_path):
    store, (seen, scorer) = ScoreStore(str(tmp_path), "length", 8), counting(spark)
    first = cached_scores(texts(spark, [n % 100 for n in range(250)]), store, scorer).collect()
    assert seen.value == 100 and stored(spark, store).count() == 100
    assert len(first) == 250 and not any(r.known for r in first) and {r.copies for r in first} == {2, 3}
    second = cached_scores(texts(spark, range(10, 110)), store, scorer).collect()
    assert seen.value == 110 and stored(spark, store).count() == 110
    assert sorted(r.doc_id for r in second if not r.known) == list(range(90, 100))
    assert all(r.ai_likeness == len(f"Text number {r.doc_id + 10}. It has two sentences.") for r in second)


def test_a_new_session_finds_the_store(spark, tmp_path):
    store, (seen, scorer) = ScoreStore(str(tmp_path), "length", 4), counting(spark)
    cached_scores(texts(spark, range(20)), store, scorer).count()
    spark.sql(f"DROP TABLE {store.name}")  # what another application starts with: the folder alone
    assert all(r.known for r in cached_scores(texts(spark, range(20)), store, scorer).collect())
    assert seen.value == 20


def test_versions_and_bucket_counts_are_kept_apart(spark, tmp_path):
    seen, scorer = counting(spark)
    for store in (ScoreStore(str(tmp_path), "a", 4), ScoreStore(str(tmp_path), "b", 4), ScoreStore(str(tmp_path), "a", 8)):
        assert not any(r.known for r in cached_scores(texts(spark, range(5)), store, scorer).collect())
    assert seen.value == 15


def test_nulls_repeats_and_nothing(spark, tmp_path):
    store, (seen, scorer) = ScoreStore(str(tmp_path), "length", 4), counting(spark)
    rows = [(1, None), (1, None), (None, "x"), (None, "x"), (2, ""), (3, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("text_hash", F.lit("mine")).withColumn("copies", F.lit(-1))
    got = cached_scores(df, store, scorer).collect()
    assert sorted((r.doc_id or 0, r.copies, r.ai_likeness) for r in got if r.text_hash) == [(0, 3, 1.0), (0, 3, 1.0), (2, 1, 0.0), (3, 3, 1.0)]
    assert [(r.doc_id, r.copies, r.known, r.ai_likeness) for r in got if not r.text_hash] == [(1, 0, False, None)] * 2
    assert seen.value == 2
    assert cached_scores(df.limit(0), store, scorer).collect() == []


def test_store_is_not_shuffled(spark, tmp_path):
    store = ScoreStore(str(tmp_path), "length", 8)
    store.append(texts(spark, range(50)).select(F.sha2("text", 256).alias("text_hash"), F.lit(0.5).alias("ai_likeness")))
    needed = texts(spark, range(70)).select(F.sha2("text", 256).alias("text_hash")).distinct()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = needed.join(store.open(spark), "text_hash", "left_anti")
        plan = left._jdf.queryExecution().executedPlan().toString()
        assert left.count() == 20
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    run_side, stored_side = plan.split("ExistingRDD")
    assert "Exchange" in run_side and "Exchange" not in stored_side and "Bucketed: true" in stored_side


def test_equal_rows_of_two_runs_count_once(spark, tmp_path):
    store = ScoreStore(str(tmp_path), "length", 4)
    for _ in range(2):
        store.open(spark)
        store.append(texts(spark, [1]).select(F.sha2("text", 256).alias("text_hash"), F.lit(0.25).alias("ai_likeness")))
    got = cached_scores(texts(spark, [1, 1]), store, counting(spark)[1]).collect()
    assert [(r.copies, r.known, r.ai_likeness) for r in got] == [(2, True, 0.25)] * 2
    assert any(f.endswith(".parquet") for f in os.listdir(store.location)) and score_cache.BUCKETS == 256
