"""Reports that a write or a stream takes by itself: right, and without another scan."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from labelloom.operators.clean import clean_report
from labelloom.operators.profile import training_steps
from labelloom.plans.flows import Settings, land_with_report, prepare, prepare_with_report, train_and_evaluate
from labelloom.queries import DOCUMENT_SCORER
from labelloom.sources.write import land_with_figures
from labelloom.streaming.classify import classify_stream, figures_of, with_figures, write_available


@pytest.fixture
def rows(spark):
    cells = [(i, None if i % 7 == 0 else " " if i % 11 == 0 else f"code {i}", ["1", "2", "x", "12", None][i % 5]) for i in range(300)]
    return spark.createDataFrame(cells, "id bigint, code string, label_encoded string").repartition(4)


def counting(spark, rows):
    """The rows, and how often one was read."""
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            seen.add(len(batch))
            yield batch

    return rows.mapInArrow(count, rows.schema), seen


def test_landing_reports_from_one_scan(spark, rows, tmp_path):
    counted, seen = counting(spark, rows)
    landed, report = land_with_report(counted, str(tmp_path / "landed"))
    assert seen.value == 300
    assert report.asDict() == clean_report(rows).first().asDict()
    assert landed.columns == rows.columns and landed.count() == 300


def test_preparing_reports_what_the_parts_hold(rows, tmp_path):
    settings = Settings(max_samples=20)
    landed, report = prepare_with_report(rows, "id", str(tmp_path / "prepared"), settings)
    steps = {r.split: (r.n, r.steps) for r in training_steps(prepare(rows, "id", settings)).collect()}
    longest = {r.split: r.n for r in landed.groupBy("split").agg(F.max(F.length("text")).alias("n")).collect()}
    for name in ("train", "test"):
        assert (report[f"{name}_rows"], report[f"{name}_steps"]) == steps[name]
        assert report[f"{name}_longest"] == longest[name]
    assert steps["train"][0] == 20


def test_nothing_to_land(spark, rows, tmp_path):
    landed, report = land_with_figures(rows.where("false"), str(tmp_path / "none"), [F.count("*").alias("n"), F.max("id").alias("last")])
    assert (report["n"], report["last"], landed.count()) == (0, None, 0)


def test_the_config_of_a_run_holds_its_figures(spark, tmp_path):
    cells = [(i, f"word{i % 3} text", str(i % 3)) for i in range(90)]
    rows = spark.createDataFrame(cells, "id bigint, code string, label_encoded string")
    train_and_evaluate(rows, "id", str(tmp_path / "run"), num_features=64, max_iter=2).collect()
    config = json.loads(spark.read.text(str(tmp_path / "run" / "config")).first().value)
    assert (config["n"], config["steps"]) == (72, 72 * 3 // 16)


def test_a_stream_counts_as_it_goes(spark, tmp_path):
    rows = [(i, None if i % 5 == 0 else "the end" if i % 2 else "?") for i in range(60)]
    source = str(tmp_path / "source")
    spark.createDataFrame(rows, "id int, code string").repartition(3).write.parquet(source)
    stream = spark.readStream.schema("id int, code string").option("maxFilesPerTrigger", 1).parquet(source)
    classified = with_figures(classify_stream(stream, DOCUMENT_SCORER))
    query = write_available(classified, str(tmp_path / "out"), str(tmp_path / "checkpoint"))
    query.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    want = {"rows": out.count(), "answered": out.where("prediction >= 0").count()}
    got = figures_of(query)
    assert got == {**want, "failed": want["rows"] - want["answered"]} and want["rows"] == 48
