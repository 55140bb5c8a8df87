from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from labelloom.functions import prompts as pr
from labelloom.functions.wording import LONG, SHORT, SYSTEM, Wording
from tests.conftest import plan

CODE = 'contract A {\n  string s = "{x}";\n}'


def rendered(spark, column):
    return spark.createDataFrame([(CODE, 5)], "code string, label int").select(column).first()[0]


def test_label_lines():
    lines = pr.label_lines().split("\n")
    assert len(lines) == 9
    assert lines[5].startswith("- 5 ") and lines[5].endswith('"Reentrancy (RE)"')
    assert lines[8].startswith("- 8 ") and "Normal" not in lines[8]


def test_training_prompt_is_the_inference_prompt_with_the_answer(spark):
    asked = rendered(spark, pr.prompt(F.col("code")))
    trained = rendered(spark, pr.prompt(F.col("code"), F.col("label")))
    assert trained == asked + " 5"
    assert asked == LONG.before.replace("{labels}", pr.label_lines()) + CODE + LONG.after


def test_short_prompt_counts_code_points(spark):
    rows = spark.createDataFrame([("😀" * 999 + "ab", 3)], "code string, label int")
    text = rows.select(pr.prompt(F.col("code"), F.col("label"), SHORT)).first()[0]
    assert text == SHORT.before + "😀" * 999 + "a" + SHORT.after + " 3"


def test_own_wording_and_names(spark):
    wording = Wording(
        before="Pick:\n{labels}\n\n", after="\n=>", fault_line="{label}: {name}", normal_line="{label}: none", normal_label=0
    )
    text = rendered(spark, pr.prompt(F.col("code"), wording=wording, names={0: "fine", 8: "broken"}))
    assert text == "Pick:\n0: none\n8: broken\n\n" + CODE + "\n=>"


def test_a_bounded_prompt_keeps_its_cue(spark):
    rows = spark.createDataFrame([("x" * 5000, 5), ("short", 5)], "code string, label int")
    texts = rows.select(
        pr.prompt(F.col("code"), max_length=2000).alias("asked"),
        pr.prompt(F.col("code"), F.col("label"), max_length=2000).alias("trained"),
    ).collect()
    assert len(texts[0].asked) == len(texts[0].trained) == 2000
    assert texts[0].asked.endswith(LONG.after) and texts[0].trained.endswith(LONG.after + " 5")
    assert texts[1].trained == texts[1].asked + " 5"
    with pytest.raises(ValueError):
        pr.prompt(F.col("code"), max_length=100)


def test_null_code_gives_no_prompt(spark):
    rows = spark.createDataFrame([(None,)], "code string")
    assert rows.select(pr.prompt(F.col("code"))).first()[0] is None


def test_chat(spark):
    text = rendered(spark, pr.chat_prompt(F.col("code")))
    assert text.startswith(pr.opening(wording=SYSTEM)) and CODE in text
    turns = rendered(spark, pr.chat_messages(F.col("code"), F.col("label")))
    assert [(t.role, t.content) for t in turns] == [("system", pr.opening(wording=SYSTEM)), ("user", CODE), ("assistant", "5")]


def test_prompts_stay_in_the_jvm(spark):
    rows = spark.createDataFrame([(CODE, 5)], "code string, label int")
    assert "Python" not in plan(rows.select(pr.prompt(F.col("code"), F.col("label")))).replace("applySchemaToPythonRDD", "")
