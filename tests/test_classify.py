from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from labelloom.functions.wording import LONG, SHORT, Wording
from labelloom.operators import evaluate as ev
from labelloom.operators.classify import CONTRACT_RULES, classify_by_rules, classify_table, classify_with_model
from labelloom.operators.model import fit_classifier, load_model, save_model, select_model
from labelloom.plans.flows import Settings, classify_file, prepare, read_and_land, train_and_evaluate
from labelloom.sources.contracts import read_contracts
from labelloom.sources.write import write_csv
from labelloom.streaming.classify import classify_stream, write_available
from tests.conftest import plan

# Calls an external address before it updates a balance: class 5.
REENTRANT = """pragma solidity ^0.4.0;
contract Bank {
    mapping(address => uint) funds;
    function take() public {
        uint sum = funds[msg.sender];
        msg.sender.call.value(sum)();
        funds[msg.sender] = 0;
    }
}"""


class Echo:
    """A scorer that returns prompt and answer together, as a language model's decoder does."""

    def __call__(self):
        return lambda prompts: [p + " \n 10" for p in prompts]


ECHO = Echo()


def test_known_answer(spark):
    rows = spark.createDataFrame([(1, REENTRANT), (2, None), (3, "no such thing")], "id int, code string")
    got = {r.id: r.llm_prediction for r in classify_table(rows, CONTRACT_RULES).collect()}
    assert got == {1: 5, 2: -1, 3: -1}


@pytest.mark.parametrize("wording", [LONG, SHORT])
def test_rules_answer_under_any_wording(spark, wording):
    codes = [REENTRANT, None, "unknown", "now", "no such thing", "contract{", "x.call(y)", "a7"]
    rows = spark.createDataFrame(list(enumerate(codes)), "id int, code string")
    asked = {r.id: r.llm_prediction for r in classify_table(rows, CONTRACT_RULES, wording=wording).collect()}
    ruled = classify_by_rules(rows, CONTRACT_RULES)
    assert "Python" not in plan(ruled).replace("applySchemaToPythonRDD", "")
    assert {r.id: r.llm_prediction for r in ruled.collect()} == asked
    assert asked == {0: 5, 1: -1, 2: -1, 3: 6, 4: -1, 5: 8, 6: 7, 7: -1}


def test_echoed_prompt_is_cut_off(spark):
    rows = spark.createDataFrame([("a 7 😀",)], "code string")
    assert classify_table(rows, ECHO, echoes_prompt=True).first().llm_prediction == 1


def test_only_the_prompt_travels_and_the_scorer_runs_once(spark):
    rows = spark.createDataFrame([(1, "x", "big")], "id int, code string, payload string")
    used_twice = classify_table(rows, CONTRACT_RULES).where("llm_prediction <> -1").select("payload", "llm_prediction")
    text = plan(used_twice)
    assert text.count("ArrowEvalPython") == 1
    assert "MapInPandas" not in text and "payload" not in text.split("ArrowEvalPython")[1].split("\n")[0]


def test_accuracies(spark):
    rows = spark.createDataFrame([(1, 1), (1, -1), (2, 1), (2, 2), (None, 3)], "label_encoded int, prediction int")
    assert tuple(ev.accuracy_all(rows).first()) == (5, 2, 40.0)
    assert tuple(ev.accuracy_answered(rows).first()) == (4, 2, 50.0)
    by_class = [(r.label, r.total, r.correct, r.percent) for r in ev.accuracy_by_class(rows).collect()]
    assert by_class == [(1, 2, 1, 50.0), (2, 2, 1, 50.0)]
    both = {r.label: (r.total, r.answered, r.correct, r.percent_all, r.percent_answered) for r in ev.evaluate(rows).collect()}
    assert [r.name for r in ev.evaluate(rows).orderBy("label").collect()][0] is None
    assert both == {1: (2, 1, 1, 50.0, 100.0), 2: (2, 2, 1, 50.0, 50.0), None: (5, 4, 2, 40.0, 50.0)}


def test_empty_tables_have_no_accuracy(spark):
    rows = spark.createDataFrame([], "label_encoded int, prediction int")
    assert tuple(ev.accuracy_all(rows).first()) == (0, 0, None)
    assert ev.accuracy_by_class(rows).collect() == []


def test_percent_to_one_decimal(spark):
    rows = spark.range(16).select(F.lit(0).alias("label_encoded"), F.when(F.col("id") == 0, 0).otherwise(1).alias("prediction"))
    assert ev.accuracy_by_class(rows).first().percent == float(f"{100 / 16:.1f}")


def test_classify_file(spark, tmp_path):
    rows = spark.createDataFrame([("a", REENTRANT, "5"), ("b", "contract", "1"), ("c", "?", "2"), ("d", "contract", "8.0")], "filename string, code string, label_encoded string")
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    write_csv(rows, source)
    accuracy = classify_file(spark, source, output, CONTRACT_RULES)
    assert tuple(accuracy.first())[:2] == (3, 2)
    back = {r.filename: r.llm_prediction for r in read_contracts(spark, output).collect()}
    assert back == {"a": "5", "b": "8", "c": "-1", "d": "8"}
    write_csv(rows.drop("label_encoded"), str(tmp_path / "in2"))
    assert classify_file(spark, str(tmp_path / "in2"), str(tmp_path / "out2"), CONTRACT_RULES) is None


def test_land_and_prepare(spark, tmp_path):
    rows = spark.range(300).select(
        F.concat(F.lit("f"), "id").alias("filename"),
        F.concat(F.lit("contract "), "id").alias("code"),
        (F.col("id") % 10).cast("string").alias("label_encoded"),
    )
    write_csv(rows, str(tmp_path / "in"))
    landed = read_and_land(spark, [str(tmp_path / "none"), str(tmp_path / "in")], str(tmp_path / "landed"))
    sampled = prepare(landed, "row_id", Settings(max_samples=100, test_size=0.3))
    sizes = {r.split: r["count"] for r in sampled.groupBy("split").count().collect()}
    assert sizes == {"train": 100, "test": 81}
    assert sampled.where("label_encoded = 9").isEmpty()
    capped = prepare(landed, "row_id", Settings(max_samples=90, per_class=True))
    train = capped.where("split = 'train'").groupBy("label_encoded").count().collect()
    assert [r["count"] for r in train] == [10] * 9
    assert capped.where("split = 'test'").count() == 54
    assert {"code", "text", "split"} <= set(capped.columns)


def test_stream(spark, tmp_path):
    source, sink, checkpoint = (str(tmp_path / name) for name in ("source", "sink", "checkpoint"))
    schema = "id int, code string"

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = classify_stream(spark.readStream.schema(schema).parquet(source), CONTRACT_RULES)
        write_available(stream, sink, checkpoint).awaitTermination()
        got = spark.read.schema("id int, code string, prediction int, name string").parquet(sink).collect()
        return sorted((r.id, r.prediction, r.name) for r in got)

    assert arrive([(1, REENTRANT), (2, " \n"), (3, "?")]) == [(1, 5, "Reentrancy (RE)"), (3, -1, None)]
    # A restart goes on from the checkpoint: earlier rows are not written again.
    assert arrive([(4, "contract")]) == [(1, 5, "Reentrancy (RE)"), (3, -1, None), (4, 8, "Normal")]


@pytest.fixture(scope="module")
def learnable(spark):
    words = F.array(*map(F.lit, ("alpha beta", "gamma delta", "kappa sigma")))
    label = (F.col("id") % 3).cast("int")
    return spark.range(150).select(
        "id", F.concat(F.element_at(words, label + 1), F.lit(" common "), "id").alias("code"), label.alias("label_encoded")
    )


def test_model_learns_and_survives_saving(learnable, tmp_path):
    model = fit_classifier(learnable, num_features=256, partitions=2, max_iter=10)
    path = str(tmp_path / "model")
    save_model(model, path)
    rows = classify_with_model(learnable, load_model(path))
    assert rows.columns == ["id", "code", "label_encoded", "prediction"]
    assert ev.accuracy_all(rows).first().percent == 100.0


def test_models_on_odd_rows_files_and_streams(spark, learnable, tmp_path):
    model = fit_classifier(learnable, num_features=256, partitions=2, max_iter=10)
    rows = spark.createDataFrame([(1, "alpha beta", 7), (2, None, 8), (3, "", 9)], "id int, code string, prediction int")
    got = {r.id: (r.code, r.prediction, r.answer) for r in classify_with_model(rows, model, "answer").collect()}
    assert got[1] == ("alpha beta", 7, 0) and got[2] == (None, 8, -1) and got[3][:2] == ("", 9)
    source, output = str(tmp_path / "in"), str(tmp_path / "out")
    write_csv(learnable, source)
    assert tuple(classify_file(spark, source, output, model).first())[:2] == (150, 150)
    rows.select("id", "code").write.parquet(str(tmp_path / "source"))
    stream = classify_stream(spark.readStream.schema("id int, code string").parquet(str(tmp_path / "source")), model)
    write_available(stream, str(tmp_path / "sink"), str(tmp_path / "checkpoint")).awaitTermination()
    assert [tuple(r) for r in spark.read.parquet(str(tmp_path / "sink")).select("id", "prediction").collect()] == [(1, 0)]


def test_train_and_evaluate(spark, learnable, tmp_path):
    settings = Settings(eval_samples=10, test_size=0.2)
    output = str(tmp_path / "run")
    result = train_and_evaluate(learnable, "id", output, settings, num_features=256, max_iter=10)
    overall = result.where("label IS NULL").first()
    assert (overall.total, overall.percent_all) == (10, 100.0)
    config = spark.read.json(f"{output}/config").first()
    assert (config.n, config.steps, config.random_state, config.max_samples) == (120, 120 * 3 // 16, 42, None)
    assert Wording(**json.loads(config.wording)) == LONG
    assert read_contracts(spark, f"{output}/predictions-csv").count() == 10
    assert spark.read.parquet(f"{output}/text").columns == ["text", "split"]
    assert classify_with_model(learnable, load_model(f"{output}/model")).count() == 150


def test_selection_takes_the_least_loss(learnable):
    model, losses = select_model(learnable, [{"max_iter": 0}, {"max_iter": 10}], 1, "id", num_features=256)
    assert losses[1] < losses[0]
    assert ev.accuracy_all(classify_with_model(learnable, model)).first().percent == 100.0
