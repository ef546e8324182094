"""Pluggable scorers: a registry, and a batch runner for external models."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.functions import stylometry

SCORERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def scorer(name: str):
    """Register ``Callable[[DataFrame], DataFrame]`` that adds ``score`` to rows with ``text``."""
    def register(fn: Callable[[DataFrame], DataFrame]):
        SCORERS[name] = fn
        return fn

    return register


@scorer("stylometric")
def stylometric(df: DataFrame) -> DataFrame:
    return df.withColumn("score", stylometry.fast_score(F.col("text")))


def score_by(name: str, df: DataFrame) -> DataFrame:
    return SCORERS[name](df)


def _guarded(load_model: Callable[[], Callable[[list[str]], list[float]]], batch: int):
    """``texts -> [(score, error)]`` in batches; a failing batch is retried text by text."""
    def start():
        model = load_model()

        def one(text):
            try:
                return float(model([text])[0]), None
            except Exception:  # noqa: BLE001 - reported in the error column
                return None, "scoring_failed"

        def score(texts):
            results = []
            for i in range(0, len(texts), batch):
                group = texts[i:i + batch]
                try:
                    scored = [(float(s), None) for s in model(group)]
                    if len(scored) != len(group):
                        raise ValueError("as many scores as texts are needed")
                    results.extend(scored)
                except Exception:  # noqa: BLE001
                    results.extend(one(t) for t in group)
            return results

        return score

    return start


def score_with(df: DataFrame, load_model: Callable[[], Callable[[list[str]], list[float]]], key: str = "doc_id",
               text_col: str = "text", batch: int = 4) -> DataFrame:
    """(key, score, error) from an external model, loaded once per task.

    Texts go to the model in batches; a failing batch is retried text by text, and a text
    that still fails gets a null score and ``scoring_failed`` instead of failing the job.
    """
    key_type = dict(df.dtypes)[key]
    start = _guarded(load_model, batch)

    def run(frames):
        import pandas as pd

        score = start()
        for frame in frames:
            results = score(frame["text"].tolist())
            scores, errors = zip(*results) if results else ((), ())
            yield pd.DataFrame(
                {
                    key: frame[key],
                    "score": pd.array(scores, dtype="Float64"),
                    "error": pd.array(errors, dtype="string"),
                }
            )

    return df.select(key, F.col(text_col).alias("text")).mapInPandas(
        run, f"`{key}` {key_type}, score double, error string"
    )


def register_table_function(spark: SparkSession, name: str, load_model: Callable[[], Callable[[list[str]], list[float]]],
                            key: str = "doc_id", key_type: str = "bigint", batch: int = 4) -> None:
    """Make a model callable from SQL: ``SELECT * FROM name(TABLE(SELECT doc_id, text FROM documents))``.

    The table needs the columns ``key`` and ``text``; others are ignored. Result and errors are those of ``score_with``, but a
    null text is not shown to the model: it gets a null score and ``no_text``. Rows are scored in the partitions they lie in.
    """
    start = _guarded(load_model, batch)

    class Score:
        def __init__(self):
            self.score = None

        def eval(self, rows):
            import pyarrow as pa

            if self.score is None:
                self.score = start()
            texts = rows.column("text").to_pylist()
            given = iter(self.score([t for t in texts if t is not None]))
            results = [(None, "no_text") if t is None else next(given) for t in texts]
            yield pa.table(
                {
                    key: rows.column(key),
                    "score": pa.array([s for s, _ in results], pa.float64()),
                    "error": pa.array([e for _, e in results], pa.string()),
                }
            )

    spark.udtf.register(name, F.arrow_udtf(Score, returnType=f"`{key}` {key_type}, score double, error string"))
