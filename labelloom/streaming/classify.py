"""Contracts classified as they arrive. No step keeps state, so no watermark is needed."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.ml import Model
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from labelloom.functions.prompts import label_name
from labelloom.functions.wording import LABEL_NAMES, LONG, UNKNOWN_NAME, Wording
from labelloom.operators.classify import Scorer, classify_table, classify_with_model
from labelloom.operators.clean import drop_blank


def classify_stream(
    stream: DataFrame,
    scorer: Callable[[], Scorer] | Model,
    code: str = "code",
    wording: Wording = LONG,
    names: Mapping[int, str] = LABEL_NAMES,
    default: str = UNKNOWN_NAME,
) -> DataFrame:
    """Rows with code, plus ``prediction`` and ``name`` (NULL where there is no answer).

    The answers come from a scorer or from a fitted model.
    """
    rows = drop_blank(stream, code)
    if isinstance(scorer, Model):
        answered = classify_with_model(rows, scorer, "prediction", code)
    else:
        answered = classify_table(rows, scorer, code, "prediction", wording)
    named = F.when(F.col("prediction") >= 0, label_name(F.col("prediction"), names, default))
    return answered.withColumn("name", named)


def with_figures(classified: DataFrame, name: str = "classified") -> DataFrame:
    """The stream, counting as it goes: rows, answered and failed ones of each micro-batch.

    They come with the query's progress (``observedMetrics``) under ``name``; no
    batch is read again for them.
    """
    answered = F.col("prediction") >= 0
    return classified.observe(
        name,
        F.count("*").alias("rows"),
        F.count_if(answered).alias("answered"),
        F.count_if(~F.coalesce(answered, F.lit(False))).alias("failed"),
    )


def figures_of(query: StreamingQuery, name: str = "classified") -> dict[str, int]:
    """The figures of all micro-batches whose progress the query still has, added up."""
    totals: dict[str, int] = {}
    for progress in query.recentProgress:
        found = progress.observedMetrics.get(name)
        for key, value in found.asDict().items() if found is not None else ():
            totals[key] = totals.get(key, 0) + value
    return totals


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Start a query that appends everything available now to ``path`` and then ends.

    The checkpoint and the file sink's log together write each row once, also
    after a restart.
    """
    return (
        stream.writeStream.format("parquet")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
