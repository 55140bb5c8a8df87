"""Accuracy of a classified table."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions.prompts import label_name
from labelloom.functions.wording import LABEL_NAMES, UNKNOWN_NAME

NO_ANSWER = -1


def _correct(label: str, prediction: str) -> Column:
    return F.coalesce(F.col(prediction) == F.col(label), F.lit(False))


def _percent(correct: str, total: str) -> Column:
    return F.try_divide(F.lit(100.0) * F.col(correct), F.col(total))


def accuracy_all(
    df: DataFrame, label: str = "label_encoded", prediction: str = "prediction"
) -> DataFrame:
    """One row: correct answers over all rows; no answer counts as wrong."""
    return df.agg(
        F.count("*").alias("total"), F.count_if(_correct(label, prediction)).alias("correct")
    ).select("total", "correct", _percent("correct", "total").alias("percent"))


def accuracy_answered(
    df: DataFrame, label: str = "label_encoded", prediction: str = "prediction"
) -> DataFrame:
    """One row: correct answers over the rows with an answer; a missing label counts as wrong."""
    answered = df.where(F.col(prediction) != NO_ANSWER)
    return accuracy_all(answered, label, prediction)


def accuracy_by_class(
    df: DataFrame,
    label: str = "label_encoded",
    prediction: str = "prediction",
    names: Mapping[int, str] = LABEL_NAMES,
    default: str = UNKNOWN_NAME,
) -> DataFrame:
    """Per true class: total, correct, percent to one decimal. Classes without rows are left out."""
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"))
        .agg(F.count("*").alias("total"), F.count_if(_correct(label, prediction)).alias("correct"))
        .select(
            "label",
            label_name(F.col("label"), names, default).alias("name"),
            "total",
            "correct",
            F.bround(_percent("correct", "total"), 1).alias("percent"),
        )
        .orderBy("label")
    )


def evaluate(
    df: DataFrame,
    label: str = "label_encoded",
    prediction: str = "prediction",
    names: Mapping[int, str] = LABEL_NAMES,
    default: str = UNKNOWN_NAME,
) -> DataFrame:
    """Per class and overall (label and name NULL), with and without unanswered rows, in one pass."""
    name = F.when(F.col("label").isNotNull(), label_name(F.col("label"), names, default))
    answers = df.select(
        F.col(label).alias("label"),
        F.col(prediction).alias("prediction"),
        _correct(label, prediction).alias("is_correct"),
    )
    return (
        answers.rollup("label")
        .agg(
            F.grouping("label").alias("overall"),
            F.count("*").alias("total"),
            F.count_if(F.col("prediction") != NO_ANSWER).alias("answered"),
            F.count_if("is_correct").alias("correct"),
        )
        .where("overall = 1 OR label IS NOT NULL")
        .select(
            "label",
            name.alias("name"),
            "total",
            "answered",
            "correct",
            _percent("correct", "total").alias("percent_all"),
            _percent("correct", "answered").alias("percent_answered"),
        )
    )
