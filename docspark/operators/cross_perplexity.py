"""Cross-perplexity score from two smoothed bigram models fitted by Spark.

score = L / X, where L is a text's mean negative log-likelihood under the performer model
and X its mean cross-entropy between the observer and the performer model. Both models
share the vocabulary of the two corpora and add ``add_k`` to every count, so the terms a
context never saw have a closed form and no vocabulary-sized row is ever built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.functions import stylometry
from docspark.functions.expr import let
from docspark.operators.skew import hot_keys
from docspark.session import cut_lineage

END = ""
#: Hash buckets of bigrams whose sizes tell where a bigram owns a large share of the places.
BUCKETS = 1 << 16


def bigrams_of(text: Column, max_tokens: int | None = None) -> Column:
    """(ctx, tok) pairs of a text; the last token is a context followed by END."""
    words = stylometry.lowered_words(text)
    if max_tokens is not None:
        words = F.slice(words, 1, max_tokens)
    none = F.array().cast("array<struct<ctx:string,tok:string>>")

    def pairs(ws: Column) -> Column:
        following = F.concat(F.slice(ws, F.lit(2), F.greatest(F.size(ws), F.lit(0))), F.array(F.lit(END)))
        return F.when(F.size(ws) > 0, F.arrays_zip(ws.alias("ctx"), following.alias("tok"))).otherwise(none)

    return let(words, pairs)


def bigram_rows(df: DataFrame, key: str, text_col: str = "text", max_tokens: int | None = None) -> DataFrame:
    exploded = df.select(F.col(key), F.explode(bigrams_of(F.col(text_col), max_tokens)).alias("b"))
    return exploded.select(key, "b.ctx", "b.tok")


def fit_counts(observer: DataFrame, performer: DataFrame, text_col: str = "text") -> DataFrame:
    """Bigram counts of both corpora side by side: (ctx, tok, np, nq)."""
    def rows(df: DataFrame, p: int, q: int) -> DataFrame:
        pairs = df.select(F.explode(bigrams_of(F.col(text_col))).alias("b"))
        return pairs.select("b.ctx", "b.tok", F.lit(p).alias("p"), F.lit(q).alias("q"))

    both = rows(observer, 1, 0).unionByName(rows(performer, 0, 1))
    return both.groupBy("ctx", "tok").agg(
        F.sum("p").cast("bigint").alias("np"), F.sum("q").cast("bigint").alias("nq")
    )


def context_table(counts: DataFrame, add_k: float = 1.0, temperature: float = 1.0) -> DataFrame:
    """Normaliser and cross-entropy per context: (ctx, zq, x)."""
    a, k = 1.0 / temperature, add_k
    is_term = F.col("tok") != END

    def above_floor(n: Column) -> Column:
        return F.pow(n + k, F.lit(a)) - k**a

    per_ctx = counts.groupBy("ctx").agg(
        F.coalesce(F.sum(F.when(is_term, above_floor(F.col("np")))), F.lit(0.0)).alias("zp_seen"),
        F.coalesce(F.sum(F.when(is_term, above_floor(F.col("nq")))), F.lit(0.0)).alias("zq_seen"),
        F.coalesce(
            F.sum(F.when(is_term & (F.col("nq") > 0), F.pow(F.col("np") + k, F.lit(a)) * F.log((F.col("nq") + k) / k))),
            F.lit(0.0),
        ).alias("gain"),
    )
    per_ctx = cut_lineage(per_ctx)
    vocabulary = per_ctx.agg(F.count("*")).scalar()
    sized = per_ctx.withColumn("_floor", vocabulary * F.lit(k**a))
    zp, zq = F.col("_floor") + F.col("zp_seen"), F.col("_floor") + F.col("zq_seen")
    return sized.select("ctx", zq.alias("zq"), (F.log(zq) - a * F.log(F.lit(k)) - a * F.col("gain") / zp).alias("x"))


def _deal(stream: DataFrame, folded: DataFrame, key: str) -> DataFrame:
    """Every bigram place with the counts of its bigram: the rows of ``stream`` and ``folded`` with np, nq, ``_first`` and ``_salted``.

    Places are shuffled once, to the task that counts their bigram; sorted first, because equal strings next to each other pack well.
    A bigram may own any share of the places, so hash buckets with more than a partition's fair share are spread over several
    partitions by key (``_salted``): there, counts are those of one part. ``_first`` marks one row of each bigram (and part).
    """
    bucket = F.pmod(F.xxhash64("ctx", "tok"), F.lit(BUCKETS)).cast("int")
    sizes = cut_lineage(stream.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("n")))
    hot = F.broadcast(hot_keys(sizes, ["_bucket"]))
    rows = stream.unionByName(folded).withColumn("_bucket", bucket).join(hot, "_bucket", "left")
    salted = rows.withColumn("_salted", F.col("_salts").isNotNull()).withColumn(
        "_salt", F.when(F.col("_salted"), F.pmod(F.xxhash64(key), F.col("_salts")).cast("int")).otherwise(F.lit(0))
    ).drop("_bucket", "_salts")
    dealt = salted.sortWithinPartitions("ctx", "tok").repartition("ctx", "tok", "_salt")
    one = W.partitionBy("ctx", "tok", "_salt").orderBy("ctx")
    whole = one.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return cut_lineage(dealt.select(
        key, "ctx", "tok", "scored", "_salted", F.sum("p").over(whole).alias("np"), F.sum("q").over(whole).alias("nq"),
        (F.row_number().over(one) == 1).alias("_first"),
    ))


def cross_perplexity(docs: DataFrame, observer: DataFrame, performer: DataFrame | None = None,
                     key: str = "doc_id", add_k: float = 1.0, temperature: float = 1.0,
                     min_tokens: int = 64, max_tokens: int | None = None, median: bool = False) -> DataFrame:
    """Score every document; ``performer`` defaults to the scored documents themselves.

    Places and fitted counts share one shuffle, written once; the terms per context are joined to it, which the optimizer broadcasts
    when their size allows that. Documents below ``min_tokens`` are marked not scorable and get a null score.
    """
    same = performer is None and max_tokens is None

    def fitted(df: DataFrame, p: int, q: int) -> DataFrame:
        counts = df.select(F.explode(bigrams_of(F.col("text"))).alias("b")).groupBy("b.ctx", "b.tok").agg(F.count("*").alias("n"))
        return counts.select(
            F.lit(None).cast(docs.schema[key].dataType).alias(key), "ctx", "tok", (F.col("n") * p).alias("p"),
            (F.col("n") * q).alias("q"), F.lit(False).alias("scored"),
        )

    folded = fitted(observer, 1, 0)
    if not same:
        folded = folded.unionByName(fitted(docs if performer is None else performer, 0, 1))
    stream = bigram_rows(docs, key, max_tokens=max_tokens).select(
        key, "ctx", "tok", F.lit(0).cast("bigint").alias("p"), F.lit(int(same)).cast("bigint").alias("q"), F.lit(True).alias("scored")
    )
    rows = _deal(stream, folded, key)
    parts = rows.filter("_salted and _first").groupBy("ctx", "tok").agg(F.sum("np").alias("np"), F.sum("nq").alias("nq"))
    counts = rows.filter("not _salted and _first").select("ctx", "tok", "np", "nq").unionByName(parts).filter("np + nq > 0")
    places = rows.filter("scored and not _salted").select(key, "ctx", "tok", "np", "nq").unionByName(
        rows.filter("scored and _salted").select(key, "ctx", "tok").join(parts, ["ctx", "tok"])
    )
    known = F.col("np") + F.col("nq") > 0
    termed = places.join(context_table(counts, add_k, temperature), "ctx", "left").select(
        key, F.when(known & (F.col("tok") != END), F.col("nq")).alias("nq"), "zq", F.when(known, F.col("x")).alias("x")
    )
    if median:  # needs every value of a document; equal terms next to each other pack well
        termed = termed.sortWithinPartitions("zq", "x", "nq", key).repartition(key)
    scored = termed.select(key, (F.log("zq") - F.log(F.col("nq") + add_k) / temperature).alias("nll"), "x")
    middle = F.median if median else F.avg
    per_doc = scored.groupBy(key).agg(
        F.count("*").alias("n_tokens"), middle("nll").alias("ppl"), middle("x").alias("x_ppl")
    )
    everyone = docs.select(key).join(per_doc, key, "left").withColumn(
        "n_tokens", F.coalesce("n_tokens", F.lit(0).cast("bigint"))
    )
    scorable = F.col("n_tokens") >= min_tokens
    return everyone.withColumn("scorable", scorable).withColumn(
        "score", F.when(scorable, F.col("ppl") / F.col("x_ppl"))
    )
