from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.functions.wording import MISSING_MARKERS


def evaluated(spark, cells, expression):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("c"))).collect()]


def test_missing_markers(spark):
    cells = ["NA", "null", "None", "#N/A", "-nan", "", "Nan", " NA", "x", None]
    assert evaluated(spark, cells, tx.nullify) == [None] * 6 + ["Nan", " NA", "x", None]
    assert len(MISSING_MARKERS) == 19


def test_blank_is_python_strip(spark):
    cells = [" ", "\t\n", " ", " ", "\u001c", "", "​", "x", " x "]
    expected = [bool(c.strip()) for c in cells]
    assert evaluated(spark, cells, tx.is_not_blank) == expected
    assert evaluated(spark, cells, tx.strip) == [c.strip() for c in cells]


@pytest.mark.parametrize(
    "cells, number, label",
    [
        (["3", "3.0", " 3 "], 3.0, 3),
        (["3.7"], 3.7, 3),
        (["8.999"], 8.999, 8),
        (["-0.5"], -0.5, 0),
        (["1e0"], 1.0, 1),
        (["+4"], 4.0, 4),
        (["abc", "3d", "3f", "3L", "0x1F", "NaN", "True", "1_000", "1,000", "1e", "-", "٣", "", "inf"], None, None),
    ],
)
def test_coercion(spark, cells, number, label):
    assert evaluated(spark, cells, tx.to_number) == [number] * len(cells)
    assert evaluated(spark, cells, lambda c: tx.to_label(tx.to_number(c))) == [label] * len(cells)


def test_first_label(spark):
    cells = ["5", "9 5", "10", "-1", "²5", "  7.", "", "abc", "٣", None]
    assert evaluated(spark, cells, tx.first_label) == [5, 5, 1, 1, 5, 7, -1, -1, -1, -1]


def test_generated_part_is_cut_by_position(spark):
    rows = spark.createDataFrame(
        [("a😀b", "a😀b \n 5.\t"), ("abc", "xyz 7"), ("longer than", "short")], "p string, d string"
    )
    got = [r[0] for r in rows.select(tx.generated_part(F.col("d"), F.col("p"))).collect()]
    assert got == [d[len(p):].strip() for p, d in rows.collect()]
