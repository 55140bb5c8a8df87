"""The CSV dialect: comma, double quote, a quote inside a cell doubled."""

from __future__ import annotations

from collections.abc import Sequence

CORRUPT = "_corrupt"

# Spark's own default escape is the backslash, which breaks cells holding "".
CSV_OPTIONS = {"quote": '"', "escape": '"', "multiLine": "true", "lineSep": "\n"}

# The inside of a quoted cell, and one whole field: quoted (with anything up to
# the next comma after it), plain, or empty. The quantifiers are possessive, so
# long cells are matched without recursion.
QUOTED = r'[^"]*+(?:""[^"]*+)*+'
FIELD = rf'(?:"{QUOTED}"[^,]*+|[^,"][^,]*+|)'


def more_fields_than(n: int) -> str:
    """Pattern of a record with a field after its n-th."""
    return rf"^(?:{FIELD},){{{n}}}"


def text_schema(columns: Sequence[str]) -> str:
    """All columns as text, and the corrupt-record column."""
    return ", ".join(f"`{name}` string" for name in [*columns, CORRUPT])
