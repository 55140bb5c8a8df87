"""Scalar expressions on text cells. All stay inside the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from labelloom.functions.wording import MISSING_MARKERS

# Unicode whitespace plus the four ASCII separators U+001C to U+001F.
_NOT_BLANK = r"(?U)[^\s\x1c-\x1f]"
_EDGES = r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$"

# Spark would also take Java's number suffixes ("3d"), so the shape is checked first.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def nullify(col: Column, markers: Sequence[str] = MISSING_MARKERS) -> Column:
    """The cell, or NULL where it holds a missing-value marker."""
    return F.when(~col.isin(*markers), col)


def is_not_blank(col: Column) -> Column:
    return col.rlike(_NOT_BLANK)


def strip(col: Column) -> Column:
    return F.regexp_replace(col, _EDGES, "")


def to_number(col: Column) -> Column:
    """Text to DOUBLE; NULL where it is not a plain decimal number."""
    return F.when(col.rlike(_NUMBER), col.try_cast("double"))


def to_label(number: Column) -> Column:
    """Number to INT, cutting the fraction off towards zero."""
    return number.try_cast("int")


def to_label_or_raise(number: Column, cell: Column) -> Column:
    """Number to INT; a cell that is there but is no whole number ends the query with an error."""
    message = F.concat(F.lit("not a whole label: "), cell)
    broken = cell.isNotNull() & ~F.coalesce(number == F.floor(number), F.lit(False))
    return F.when(broken, F.raise_error(message).cast("int")).otherwise(to_label(number))


def first_label(response: Column) -> Column:
    """First digit 0 to 8 of a response; -1 where there is none."""
    digit = F.regexp_substr(response, F.lit("[0-8]"))
    return F.coalesce(digit.try_cast("int"), F.lit(-1))


def generated_part(decoded: Column, prompt: Column) -> Column:
    """What follows the prompt in a decoded text, cut off by position."""
    return strip(F.substr(decoded, F.length(prompt) + F.lit(1)))
