"""Token tables for training."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from labelloom.functions import tokens as tk


def tokenise(
    df: DataFrame,
    text: str,
    max_length: int,
    tokenizer: Callable[[], tk.EncodeBatch] | None = None,
    keep: Sequence[str] = (),
) -> DataFrame:
    """``input_ids`` of at most ``max_length`` and ``n_tokens`` of the whole text.

    Input columns not in ``keep`` are removed. Without a ``tokenizer`` each code
    point is a token.
    """
    if tokenizer is None:
        ids = tk.code_points(F.col(text), max_length).alias("input_ids")
        return df.select(*keep, ids, tk.token_count(F.col(text)).alias("n_tokens"))
    tokens = df.select(*keep, tk.encoded(F.col(text), tokenizer, max_length).alias("_tokens"))
    return tokens.select(*keep, "_tokens.*")


def training_rows(
    df: DataFrame,
    text: str,
    max_length: int,
    pad: int,
    tokenizer: Callable[[], tk.EncodeBatch] = tk.CodePoints(),
    keep: Sequence[str] = (),
) -> DataFrame:
    """``input_ids``, ``attention_mask``, ``labels`` and ``n_tokens`` together, from one pass over the texts."""
    rows = df.select(*keep, tk.training_arrays(F.col(text), tokenizer, max_length, pad).alias("_arrays"))
    return rows.select(*keep, "_arrays.*")


def padded_rows(df: DataFrame, max_length: int, pad: int) -> DataFrame:
    """``df`` with ``input_ids`` filled up to ``max_length``, plus ``attention_mask`` and ``labels``."""
    return _padded(df, max_length, pad, labels=True)


def _padded(df: DataFrame, max_length: int, pad: int, labels: bool) -> DataFrame:
    others = [name for name in df.columns if name != "input_ids"]
    arrays = tk.padded_arrays(F.col("input_ids"), max_length, pad, labels)
    return df.select(*others, arrays.alias("_arrays")).select(*others, "_arrays.*")


def pad_mask(df: DataFrame, max_length: int, pad: int) -> DataFrame:
    """``input_ids`` filled up to ``max_length``, and ``attention_mask``."""
    rows = _padded(df, max_length, pad, labels=False)
    return rows.select(*df.columns, "attention_mask")


def lm_labels(df: DataFrame, pad: int) -> DataFrame:
    """``labels``: the padded ids, with -100 where the loss ignores them."""
    return df.withColumn("labels", tk.training_labels(F.col("input_ids"), pad))


def token_batches(df: DataFrame, key: str, size: int, pad: int, bucket: int = 64) -> DataFrame:
    """Batches as a trainer reads them: keys, length, and ``input_ids``, ``attention_mask`` and ``labels`` as matrices.

    ``df`` has unpadded ``input_ids``. A batch holds at most ``size`` rows, whose
    lengths lie within the same ``bucket`` tokens, and is padded to the longest of
    them only. Rows are ordered by length within their task and go nowhere else; a
    task leaves at most one batch short for each bucket. Rows without ids are left out.
    """
    bucketed = F.ceil(F.size("input_ids") / bucket).cast("int").alias("bucket")
    rows = df.where("input_ids IS NOT NULL").select(F.col(key).alias("key"), "input_ids", bucketed)
    ordered = rows.sortWithinPartitions("bucket", "key")
    kind = rows.schema["key"].dataType
    matrix = ", ".join(f"{name} array<array<int>>" for name in ("input_ids", "attention_mask", "labels"))
    schema = f"keys array<{kind.simpleString()}>, length int, {matrix}"
    return ordered.mapInArrow(tk.in_batches(size, pad, to_arrow_type(kind)), schema)


def truncation_report(
    df: DataFrame,
    text: str,
    max_length: int,
    tokenizer: Callable[[], tk.EncodeBatch] | None = None,
) -> DataFrame:
    """One row: rows, rows longer than ``max_length`` (which lose their answer cue), tokens cut off."""
    n = tk.token_count(F.col(text), tokenizer).cast("bigint")
    return df.select(n.alias("n")).agg(
        F.count("*").alias("total"),
        F.count_if(F.col("n") > max_length).alias("cut_rows"),
        F.coalesce(
            F.sum(F.greatest(F.col("n") - max_length, F.lit(0).cast("bigint"))), F.lit(0)
        ).alias("cut_tokens"),
        F.max("n").alias("longest"),
    )
