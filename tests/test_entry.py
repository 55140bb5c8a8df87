"""The entry without packages that only optional queries need."""

from __future__ import annotations

import os
import subprocess
import sys

import pytest

from labelloom.queries import QUERIES

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.mark.parametrize("missing", ["xxhash", "tokenizers", "labelloom.llm", "corpus_pipeline"])
def test_the_other_queries_stay(missing):
    code = (
        f"import sys; sys.modules[{missing!r}] = None; import __spark_entry__ as entry;"
        "print(len(entry.queries()), set(entry.oracle_sql()) <= set(entry.queries()))"
    )
    done = subprocess.run([sys.executable, "-W", "ignore", "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert done.returncode == 0, done.stderr
    count, whole = done.stdout.split()
    assert int(count) >= len(QUERIES) and whole == "True"


def test_broken_parts_are_not_hidden_as_missing(tmp_path):
    """Only import errors leave a part out."""
    code = "import __spark_entry__ as entry; entry._module('broken')"
    (tmp_path / "broken.py").write_text("1 / 0")
    path = f"{ROOT}:{tmp_path}"
    done = subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": path}, capture_output=True, text=True)
    assert "ZeroDivisionError" in done.stderr
