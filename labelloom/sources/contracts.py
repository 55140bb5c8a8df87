"""Reading CSV files whose quoted cells may hold newlines.

Everything is read as text; casts are the cleaning step's work. Spark's own reader
takes such a file in one task, and turns CRLFs inside cells into LFs; so files of
every size go through ``sources.records``, which reads them in splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.text import is_not_blank
from labelloom.functions.wording import MISSING_MARKERS
from labelloom.operators.clean import nullify_markers
from labelloom.sources.csv_format import CORRUPT, more_fields_than
from labelloom.sources.records import MAX_RECORD_BYTES, read_records


def _keep(columns: Sequence[str], on_bad_lines: str) -> Column:
    """Which parsed records stay.

    Spark marks every record as corrupt that has not exactly one field per
    column. Of these, blank lines go, short records stay, padded with NULL, and
    records with a surplus field are dropped or end the query. The first column
    takes part only because Spark refuses filters on the corrupt text alone.
    """
    first, corrupt = F.col(f"`{columns[0]}`"), F.col(CORRUPT)
    surplus = corrupt.rlike(more_fields_than(len(columns)))
    if on_bad_lines == "skip":
        fits = ~surplus
    else:
        message = F.concat(F.lit(f"more than {len(columns)} fields in: "), corrupt)
        fits = F.when(surplus, F.raise_error(message).cast("boolean")).otherwise(True)
    filled = is_not_blank(F.concat(corrupt, F.coalesce(first, F.lit(""))))
    return F.when(corrupt.isNull(), True).when(~filled, False).otherwise(fits)


def read_contracts(
    spark: SparkSession,
    path: str,
    on_bad_lines: str = "error",
    encoding: str = "UTF-8",
    markers: Sequence[str] = MISSING_MARKERS,
    row_id: str | None = None,
    max_record_bytes: int = MAX_RECORD_BYTES,
) -> DataFrame:
    """All columns of a CSV file or folder as text, missing-value markers as NULL.

    ``on_bad_lines`` says what becomes of records with surplus fields: 'error'
    or 'skip'. ``encoding`` 'auto' reads UTF-8 and falls back to Latin-1 for
    each file that is not valid UTF-8; other encodings must write a newline as one
    byte. ``row_id`` adds a BIGINT made of the file's place among the files and the
    record's line: the same in every reading of the same files. A record of over
    ``max_record_bytes`` ends the query, with its file and place.
    """
    if on_bad_lines not in ("error", "skip"):
        raise ValueError(f"on_bad_lines must be 'error' or 'skip', not {on_bad_lines!r}")
    try:
        columns, rows = read_records(spark, path, encoding, row_id, max_record_bytes)
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            raise FileNotFoundError(f"no such file: {path}") from error
        raise ValueError(f"cannot read {path} as CSV: {error}") from error
    kept = rows.where(_keep(columns, on_bad_lines)).drop(CORRUPT)
    return nullify_markers(kept, columns, markers)
