"""Language identification: averaged hashed subword embeddings under a linear softmax, with calibrated rejection.

A text is the average of the embeddings of its hashed character n-grams; a linear layer scores the languages. The model is
trained by stochastic gradient descent in numpy on at most ``sample`` labelled texts per language, chosen by hash.
Texts become bucket counts on the executors, so the driver holds counts and never texts. Because the average is linear,
embedding and layer fold into one score per bucket and language for prediction, which reads whole texts in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docspark.llm.common import ship_with_tasks
from docspark.session import cut_lineage

ship_with_tasks(__name__)

UNKNOWN = "und"
#: Bound of the training sample: texts per language; a fifth of them calibrates.
SAMPLE = 500
BUCKETS = 1 << 16
SIZES = (1, 2, 3, 4)
DIMENSIONS = 16
EPOCHS = 12
RATE = 0.5
#: A bucket's share of a text is small; its embedding moves by so many times its share.
SPREAD = 10
SEED = 5
#: Accepted predictions are right this often on the calibration texts.
PRECISION = 0.995
#: Characters handled at once.
PIECE = 1 << 20


class Features:
    """Hash buckets of the character n-grams of a text; what is not a letter separates words."""

    def __init__(self):
        self.letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)

    def buckets(self, text: str) -> Iterator[np.ndarray]:
        """Arrays of buckets, one per piece of the text and n-gram size. A text without letters has none."""
        for begin in range(0, len(text), PIECE):
            points = np.frombuffer(text[begin : begin + PIECE].lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
            inside = self.letter[points]
            if not inside.any():
                continue
            points = np.where(inside, points, 32)
            space = points == 32
            points = points[~(space & np.concatenate(([False], space[:-1])))]  # one space between words
            points = np.concatenate(([32], points, [32])).astype(np.uint64)
            for size in SIZES:
                if len(points) < size:
                    continue
                code = np.full(len(points) - size + 1, size, dtype=np.uint64)
                for k in range(size):
                    code = (code ^ points[k : len(points) - size + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
                    code ^= code >> np.uint64(29)
                yield (code & np.uint64(BUCKETS - 1)).astype(np.int64)


@dataclass
class Model:
    """Languages, score per bucket and language, bias, temperature and the score below which a prediction is rejected."""

    languages: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float
    threshold: float

    def probabilities(self, mean: np.ndarray) -> np.ndarray:
        z = (mean + self.bias) / self.temperature
        z = np.exp(z - z.max())
        return z / z.sum()


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo 3, is 1. A missing id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE) -> list:
    """At most ``sample`` rows per language as (lang, draw, buckets, counts).

    A hash draw with a margin thins each language before its rows are ranked by the draw, so the ranking sees few rows.
    """
    rows = docs.filter(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    # written, so that its size is known and the texts are thinned before any shuffle by language
    sizes = cut_lineage(rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")))
    draw = F.pmod(F.xxhash64(F.lit(SEED), F.col(id_col)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), draw.alias("draw")).join(sizes, "lang")
    drawn = drawn.filter(F.col("draw") * F.col("n") < F.lit(1.3 * sample + 20)).drop("n")
    order = W.partitionBy("lang").orderBy("draw", F.xxhash64("text"))
    chosen = drawn.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= sample).drop("rank")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            keep, buckets, counts = [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                total = np.zeros(BUCKETS, dtype=np.int64)
                for found in features.buckets(text):
                    total += np.bincount(found, minlength=BUCKETS)
                filled = np.flatnonzero(total)
                if len(filled):
                    keep.append(i)
                    buckets.append(filled.astype(np.int32))
                    counts.append((total[filled] / total.sum()).astype(np.float32))
            part = batch.take(pa.array(keep, type=pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(buckets, type=pa.list_(pa.int32())), pa.array(counts, type=pa.list_(pa.float32()))],
                names=["lang", "draw", "buckets", "shares"])

    table = chosen.select("lang", "text", "draw").mapInArrow(counted, "lang string, draw double, buckets array<int>, shares array<float>").toArrow()
    rows = zip(table.column("lang").to_pylist(), table.column("draw").to_pylist(), table.column("buckets"), table.column("shares"))
    out = [(lang, d, b.values.to_numpy(), s.values.to_numpy()) for lang, d, b, s in rows]
    return sorted(out, key=lambda r: (r[1], r[0], len(r[2]), float(r[3][0])))


def train(sample: list, epochs: int = EPOCHS, rate: float = RATE) -> Model:
    """Fit embeddings and layer on four fifths of the sample; choose temperature and rejection threshold on the rest.

    Languages weigh alike, however often they were drawn. Without a sample the model knows no language.
    """
    languages = sorted({r[0] for r in sample})
    if not languages:
        return Model([], np.zeros((BUCKETS, 1), dtype=np.float32), np.zeros(1), 1.0, 0.0)
    number = {lang: i for i, lang in enumerate(languages)}
    groups = {lang: [r for r in sample if r[0] == lang] for lang in languages}
    fit = [r for g in groups.values() for i, r in enumerate(g) if i % 5 != 4]
    check = [r for g in groups.values() for i, r in enumerate(g) if i % 5 == 4] or fit
    weight = {lang: len(fit) / (len(languages) * max(1, sum(r[0] == lang for r in fit))) for lang in languages}

    rng = np.random.default_rng(SEED)
    embedding = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = rng.normal(0, 0.1, (DIMENSIONS, len(languages))).astype(np.float32)
    bias = np.zeros(len(languages), dtype=np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(fit)):
            lang, _, buckets, shares = fit[i]
            hidden = shares @ embedding[buckets]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[number[lang]] -= 1
            p *= weight[lang] * step
            back = layer @ p
            layer -= np.outer(hidden, p)
            bias -= 0.1 * p
            embedding[buckets] -= np.outer(SPREAD * shares, back)

    table = (embedding @ layer).astype(np.float32)
    z = np.array([r[3] @ table[r[2]] + bias for r in check])
    truth = np.array([number[r[0]] for r in check])

    def shares_at(temperature: float) -> np.ndarray:
        e = np.exp((z - z.max(axis=1, keepdims=True)) / temperature)
        return e / e.sum(axis=1, keepdims=True)

    loss = lambda t: -np.log(np.maximum(shares_at(t)[np.arange(len(truth)), truth], 1e-12)).mean()
    temperature = float(min(np.geomspace(0.1, 10, 41), key=loss))
    p = shares_at(temperature)
    best, right = p.max(axis=1), p.argmax(axis=1) == truth
    order = np.argsort(-best)
    precision = np.cumsum(right[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(precision >= PRECISION)
    threshold = float(best[order][good[-1]]) if len(good) else 1.0
    return Model(languages, table, bias.astype(np.float64), temperature, min(threshold, 0.999))


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, held_out, lang_pred, score, rejected`` of every row.

    ``score`` is the calibrated probability of the predicted language, ``rejected`` tells that it is below the model's threshold. A
    text that is null or has no letter is ``und`` with score 0, and so is every text under a model without languages. Only the text
    decides. Repeated rows get the same answer; an empty table gives no row.
    """

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            names, scores = [], []
            for text in batch.column(2).to_pylist():
                total, count = np.zeros(model.table.shape[1]), 0
                for found in features.buckets(text or ""):
                    total += model.table[found].sum(axis=0, dtype=np.float64)
                    count += len(found)
                if not count or not model.languages:
                    names.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                p = model.probabilities(total / count)
                names.append(model.languages[int(p.argmax())])
                scores.append(float(min(1.0, p.max())))
            rejected = [s < model.threshold for s in scores]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(names, type=pa.string()), pa.array(scores, type=pa.float64()), pa.array(rejected, type=pa.bool_())],
                names=["doc_id", "held_out", "lang_pred", "score", "rejected"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(task, "doc_id bigint, held_out boolean, lang_pred string, score double, rejected boolean")
