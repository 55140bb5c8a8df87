"""Every registered query against its oracle on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
import check

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return check.connection(SF)


# A sample of 500 and caps of 600 to 800 exceed the smallest tables, and the
# trained models have no SQL form.
@pytest.mark.parametrize("name", entry.queries())
def test_query(spark, con, name):
    assert check.compare(spark, con, SF, name).split(" ")[0] in ("ok", "rows")


def test_entry(spark):
    assert entry.entry(spark).columns == ["doc_id", "label_encoded", "split", "text"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
