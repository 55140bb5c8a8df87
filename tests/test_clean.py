from __future__ import annotations

import pytest
from pyspark.errors import PySparkException

from labelloom.operators import clean as cl
from labelloom.operators import profile as pf
from labelloom.queries import contracts
from tests.conftest import plan

ROWS = [
    ("a", "x", "5"),
    ("b", None, "1"),
    ("c", "x", None),
    ("d", "  ", "1"),
    ("e", "x", "abc"),
    ("f", "x", "3.7"),
    ("g", "x", "9"),
    ("h", "x", "-0.5"),
    ("i", None, "abc"),
]
SCHEMA = "filename string, code string, label_encoded string"


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


def test_tolerant(rows):
    kept = cl.clean(rows).select("filename", "label_encoded").collect()
    assert sorted(map(tuple, kept)) == [("a", 5), ("f", 3), ("h", 0)]


def test_report_adds_up(rows):
    report = cl.clean_report(rows).first().asDict()
    assert report == {
        "rows_in": 9, "missing": 3, "blank": 1, "bad_label": 1, "out_of_domain": 1, "kept": 3, "removed": 6,
    }


@pytest.mark.parametrize("bad", ["abc", "3.7", "inf"])
def test_strict_raises_on_malformed_label(spark, bad):
    rows = spark.createDataFrame([("a", "x", "1"), ("b", "y", bad)], SCHEMA)
    with pytest.raises(PySparkException, match="not a whole label"):
        cl.clean(rows, "strict").collect()


def test_strict_and_domain_ignore_rows_dropped_as_missing(spark):
    rows = spark.createDataFrame(
        [("a", "x", "3.0"), ("b", None, "abc"), ("c", "y", None), ("d", " ", "11")], SCHEMA
    )
    strict = cl.clean(rows, "strict").select("filename", "label_encoded").collect()
    assert sorted(map(tuple, strict)) == [("a", 3), ("d", 11)]
    domain = cl.clean(rows, "domain").select("filename", "label_encoded").collect()
    assert sorted(map(tuple, domain)) == [("a", 3)]


def test_numeric_labels_need_no_text(spark):
    rows = spark.createDataFrame([("a", "x", 1.0), ("b", "x", float("nan")), ("c", "x", 8.9)], "filename string, code string, label_encoded double")
    kept = cl.clean(rows).select("filename", "label_encoded").collect()
    assert sorted(map(tuple, kept)) == [("a", 1), ("c", 8)]


def test_unknown_level(rows):
    with pytest.raises(ValueError):
        cl.clean(rows, "loose")


def test_cleaning_is_narrow_and_stays_in_the_jvm(spark):
    text = plan(cl.clean(contracts(spark, "/root/testdata/sf0.001")))
    assert "Exchange" not in text and "Python" not in text


def test_missing_values_only_lists_columns_with_some(rows):
    assert sorted(map(tuple, pf.missing_values(rows).collect())) == [("code", 2), ("label_encoded", 1)]
    assert pf.missing_values(rows.select("filename")).collect() == []


def test_distribution_names(spark):
    rows = spark.createDataFrame([(1,), (1,), (99,), (None,)], "label_encoded int")
    named = pf.label_distribution_named(rows).collect()
    assert [tuple(r) for r in named] == [(1, "Dangerous delegatecall (DE)", 2), (99, "Inconnu", 1)]
    with pytest.raises(PySparkException, match="label without a name: 99"):
        pf.label_distribution_named(rows, strict=True).collect()
    names = spark.createDataFrame([(1, "one")], "label int, name string")
    assert [tuple(r) for r in pf.label_distribution_named(rows, names=names).collect()] == [(1, "one", 2), (99, "Inconnu", 1)]
    with pytest.raises(PySparkException, match="label without a name: 99"):
        pf.label_distribution_named(rows, names=names, strict=True).collect()
    with pytest.raises(ValueError):
        pf.label_distribution(rows, "absent")


def test_validation_stops_at_missing_columns(rows):
    report = pf.validate_dataset(rows.drop("code"))
    assert sorted(map(tuple, report.collect())) == [("column", "code", 0), ("column", "label_encoded", 1)]
    full = {(r.item, r.detail): r.n for r in pf.validate_dataset(rows).collect()}
    assert full[("rows", "")] == 9 and full[("label", "1")] == 2
