"""Cleaning of labelled text. Every operator is one narrow step: no shuffle, no Python."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from labelloom.functions import text as tx
from labelloom.functions.wording import LABEL_NAMES, MISSING_MARKERS

RULES = ("missing", "blank", "bad_label", "out_of_domain")
LEVELS = ("strict", "domain", "tolerant")
DOMAIN = tuple(LABEL_NAMES)


def nullify_markers(
    df: DataFrame, cols: Sequence[str] | None = None, markers: Sequence[str] = MISSING_MARKERS
) -> DataFrame:
    """Missing-value markers become NULL, in all text columns if ``cols`` is none."""
    if cols is None:
        cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: tx.nullify(F.col(c), markers) for c in cols})


def drop_missing(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(cols))


def drop_blank(df: DataFrame, col: str) -> DataFrame:
    return df.where(tx.is_not_blank(F.col(col)))


def number_of(df: DataFrame, col: str) -> Column:
    """The column as DOUBLE: text is coerced, numbers are taken as they are."""
    if isinstance(df.schema[col].dataType, T.StringType):
        return tx.to_number(F.col(col))
    return F.nanvl(F.col(col).cast("double"), F.lit(None).cast("double"))


def coerce_label(df: DataFrame, label: str) -> DataFrame:
    """Label to INT by truncation; rows whose label is no number are dropped."""
    number = number_of(df, label)
    return df.where(number.isNotNull()).withColumn(label, tx.to_label(number))


def keep_domain(df: DataFrame, col: str, domain: Sequence[int] = DOMAIN) -> DataFrame:
    return df.where(F.col(col).isin(*domain))


def with_reject(
    df: DataFrame,
    code: str = "code",
    label: str = "label_encoded",
    domain: Sequence[int] = DOMAIN,
) -> DataFrame:
    """``df`` plus ``reject``: the first tolerant rule the row breaks, NULL if none."""
    number = number_of(df, label)
    missing, blank, bad_label, out_of_domain = RULES
    reject = (
        F.when(F.col(code).isNull() | F.col(label).isNull(), missing)
        .when(~tx.is_not_blank(F.col(code)), blank)
        .when(number.isNull(), bad_label)
        .when(~F.coalesce(tx.to_label(number).isin(*domain), F.lit(False)), out_of_domain)
    )
    return df.withColumn("reject", reject)


def clean(
    df: DataFrame,
    level: str = "tolerant",
    code: str = "code",
    label: str = "label_encoded",
    domain: Sequence[int] = DOMAIN,
) -> DataFrame:
    """Rows fit for use, with an INT label.

    ``strict`` drops missing cells and raises on a label that is no whole number;
    ``domain`` also drops labels outside ``domain``; ``tolerant`` drops every row
    that breaks a rule and cuts fractions off labels.
    """
    if level not in LEVELS:
        raise ValueError(f"level must be one of {LEVELS}, not {level!r}")
    if level == "tolerant":
        kept = with_reject(df, code, label, domain).where("reject IS NULL").drop("reject")
        return kept.withColumn(label, tx.to_label(number_of(df, label)))
    # Catalyst may evaluate the cast before the filter, so it looks at the code too:
    # a bad label does no harm on a row that is dropped anyway.
    whole = tx.to_label_or_raise(number_of(df, label), F.col(label).cast("string"))
    present = F.when(F.col(code).isNotNull(), whole)
    labelled = drop_missing(df, [code, label]).withColumn(label, present)
    return keep_domain(labelled, label, domain) if level == "domain" else labelled


def clean_report(
    df: DataFrame,
    code: str = "code",
    label: str = "label_encoded",
    domain: Sequence[int] = DOMAIN,
) -> DataFrame:
    """One row: rows in, rows dropped by each rule, kept, removed. One scan."""
    return with_reject(df, code, label, domain).agg(*reject_counts())


def reject_counts() -> list[Column]:
    """Aggregates over rows with ``reject``: rows in, dropped by each rule, kept, removed."""
    return [
        F.count("*").alias("rows_in"),
        *[F.count_if(F.col("reject") == rule).alias(rule) for rule in RULES],
        F.count_if(F.col("reject").isNull()).alias("kept"),
        F.count_if(F.col("reject").isNotNull()).alias("removed"),
    ]
