"""Profiles of a table. Each is one partial-then-final aggregation over one scan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelloom.functions.prompts import label_name
from labelloom.functions.wording import LABEL_NAMES, UNKNOWN_NAME


def profile_rows(df: DataFrame) -> DataFrame:
    """One row: row count, column count, column names."""
    return df.agg(F.count("*").alias("n_rows")).select(
        "n_rows",
        F.lit(len(df.columns)).alias("n_columns"),
        F.lit(", ".join(df.columns)).alias("columns"),
    )


def label_distribution(df: DataFrame, label: str = "label_encoded") -> DataFrame:
    """Rows per label, labels ascending; rows without a label are not counted."""
    if label not in df.columns:
        raise ValueError(f"no column {label!r} to count")
    return (
        df.where(F.col(label).isNotNull())
        .groupBy(F.col(label).alias("label"))
        .agg(F.count("*").alias("n"))
        .orderBy("label")
    )


def label_distribution_named(
    df: DataFrame,
    label: str = "label_encoded",
    names: Mapping[int, str] | DataFrame = LABEL_NAMES,
    default: str = UNKNOWN_NAME,
    strict: bool = False,
) -> DataFrame:
    """Rows per label with class names, from a mapping or a table (label, name)."""
    counts = label_distribution(df, label)
    if isinstance(names, DataFrame):
        joined = counts.join(names.select("label", "name"), "label", "left")
        if strict:
            unknown = F.raise_error(F.concat(F.lit("label without a name: "), F.col("label").cast("string")))
            name = F.coalesce("name", unknown.cast("string"))
        else:
            name = F.coalesce("name", F.lit(default))
        return joined.select("label", name.alias("name"), "n").orderBy("label")
    return counts.select(
        "label", label_name(F.col("label"), names, default, strict).alias("name"), "n"
    )


def missing_values(df: DataFrame) -> DataFrame:
    """(column, n_missing) for the columns with at least one NULL, in one pass over all columns."""
    nulls = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    return (
        df.agg(*nulls)
        .unpivot([], df.columns, "column", "n_missing")
        .where("n_missing > 0")
    )


def validate_dataset(
    df: DataFrame,
    required: Sequence[str] = ("code", "label_encoded"),
    label: str = "label_encoded",
) -> DataFrame:
    """Report (item, detail, n): required columns present, row count, rows per label.

    Counts follow only if all required columns are there. The grand total is a
    second grouping set of the same aggregation, so the table is read once.
    """
    columns = df.sparkSession.createDataFrame(
        [("column", name, int(name in df.columns)) for name in required],
        "item string, detail string, n bigint",
    )
    if not set(required) <= set(df.columns):
        return columns
    counts = (
        df.rollup(label)
        .agg(F.count("*").alias("n"), F.grouping(label).alias("is_total"))
        .where((F.col("is_total") == 1) | F.col(label).isNotNull())
        .select(
            F.when(F.col("is_total") == 1, "rows").otherwise("label").alias("item"),
            F.coalesce(F.col(label).cast("string"), F.lit("")).alias("detail"),
            "n",
        )
    )
    return columns.unionByName(counts)


def split_sizes(df: DataFrame) -> DataFrame:
    """Rows per part of a split table."""
    return df.groupBy("split").agg(F.count("*").alias("n"))


def training_steps(
    df: DataFrame, epochs: int = 3, batch_size: int = 4, accumulation: int = 4
) -> DataFrame:
    """Optimiser steps for each part: rows * epochs over rows per step, rounded down."""
    steps = F.expr(f"n * {int(epochs)} div {int(batch_size) * int(accumulation)}")
    return split_sizes(df).select("split", "n", steps.alias("steps"))
