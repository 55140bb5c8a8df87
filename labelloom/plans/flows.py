"""Flows from source to sink."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from dataclasses import asdict, dataclass

from pyspark.ml import Model
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from labelloom.functions.prompts import prompt
from labelloom.functions.tokens import CodePoints, EncodeBatch
from labelloom.functions.wording import LABEL_NAMES, LONG, SHORT, Wording
from labelloom.operators.classify import Scorer, classify_table, classify_with_model
from labelloom.operators.clean import clean, number_of, reject_counts, with_reject
from labelloom.operators.evaluate import accuracy_answered, evaluate
from labelloom.operators.model import MODEL_SETTINGS, NUM_FEATURES, fit_classifier, save_model
from labelloom.operators.sampling import (
    cap_per_class,
    eval_subset,
    part,
    sample_exact,
    stratified_split,
)
from labelloom.operators.tokenise import padded_rows, tokenise
from labelloom.sources.contracts import read_contracts
from labelloom.sources.resolve import require_columns, resolve_source
from labelloom.sources.write import (
    config_table,
    export_split_text,
    land,
    land_with_figures,
    write_config,
    write_csv,
)


@dataclass(frozen=True)
class Settings:
    """How a table is prepared, trained on and evaluated.

    ``max_samples`` bounds the training rows only; the test part stays whole.
    ``eval_samples`` evaluates on so many of its rows, for a quick look.
    """

    level: str = "tolerant"
    max_samples: int | None = None
    per_class: bool = False
    test_size: float = 0.2
    random_state: int = 42
    wording: Wording = LONG
    max_length: int = 2048
    num_train_epochs: int = 3
    per_device_train_batch_size: int = 4
    gradient_accumulation_steps: int = 4
    eval_samples: int | None = None


# The settings of the five usual runs, from all rows to small memory.
PRESETS = {
    "all_strict": Settings(level="strict"),
    "low_memory": Settings(
        level="strict",
        max_samples=500,
        max_length=1024,
        num_train_epochs=2,
        per_device_train_batch_size=1,
        gradient_accumulation_steps=16,
    ),
    "least_memory": Settings(
        level="domain",
        max_samples=800,
        per_class=True,
        wording=SHORT,
        max_length=512,
        per_device_train_batch_size=1,
        gradient_accumulation_steps=16,
    ),
    "notebook": Settings(max_samples=1000, max_length=1024),
    "all_tolerant": Settings(),
}


def prepare(
    rows: DataFrame,
    key: str,
    settings: Settings = Settings(),
    code: str = "code",
    label: str = "label_encoded",
    names: Mapping[int, str] = LABEL_NAMES,
) -> DataFrame:
    """Clean, split, sample or cap the training part, and add the training ``text``.

    The prompt is made last, on the rows that are left; ``code`` stays for the
    evaluation of the test part.
    """
    cleaned = clean(require_columns(rows, [code, label]), settings.level, code, label, tuple(names))
    split = stratified_split(cleaned, settings.test_size, settings.random_state, label, key)
    if settings.max_samples:
        train, test = split.where("split = 'train'"), split.where("split = 'test'")
        if settings.per_class:
            train = cap_per_class(
                train, settings.max_samples, label, settings.random_state, key, len(names)
            )
        else:
            train = sample_exact(train, settings.max_samples, settings.random_state, key)
        split = train.unionByName(test)
    return split.withColumn("text", prompt(F.col(code), F.col(label), settings.wording, names))


def prepare_tokens(
    rows: DataFrame,
    key: str,
    output: str,
    settings: Settings = Settings(),
    tokenizer: Callable[[], EncodeBatch] = CodePoints(),
    pad: int = 0,
    **columns: object,
) -> DataFrame:
    """Prepare, and write token ids, one folder for each part; returned padded, with masks and training labels.

    What is written takes as much room as there are tokens, at most
    ``settings.max_length`` a row; padding, masks and labels are made when the rows
    are read (``padded_rows``, or ``token_batches`` for a trainer). ``n_tokens`` is the
    whole text's number. ``columns`` are those of ``prepare``.
    """
    prepared = prepare(rows, key, settings, **columns)
    ids = tokenise(prepared, "text", settings.max_length, tokenizer, keep=(key, "split"))
    ids.write.partitionBy("split").parquet(output)
    return padded_rows(rows.sparkSession.read.schema(ids.schema).parquet(output), settings.max_length, pad)


def read_and_land(
    spark: SparkSession,
    candidates: Sequence[str],
    landed: str,
    on_bad_lines: str = "skip",
    encoding: str = "auto",
) -> DataFrame:
    """First existing CSV, read tolerantly and landed once as Parquet with a lasting ``row_id``."""
    source = resolve_source(spark, candidates)
    return land(read_contracts(spark, source, on_bad_lines, encoding, row_id="row_id"), landed)


def land_with_report(
    rows: DataFrame, landed: str, code: str = "code", label: str = "label_encoded", names: Mapping[int, str] = LABEL_NAMES
) -> tuple[DataFrame, Row]:
    """All ``rows`` landed as Parquet, and what cleaning will keep and drop of them, from the same scan."""
    judged = with_reject(require_columns(rows, [code, label]), code, label, tuple(names))
    return land_with_figures(judged, landed, reject_counts(), drop=("reject",))


def prepare_with_report(
    rows: DataFrame, key: str, landed: str, settings: Settings = Settings(), **columns: object
) -> tuple[DataFrame, Row]:
    """Rows of ``prepare`` landed, and rows, steps and longest text of the parts, from the same scan."""
    prepared = prepare(rows, key, settings, **columns)
    per_step = settings.per_device_train_batch_size * settings.gradient_accumulation_steps
    figures = []
    for name in ("train", "test"):
        n = F.count_if(F.col("split") == name)
        steps = F.floor(n * settings.num_train_epochs / per_step).cast("bigint")
        longest = F.max(F.when(F.col("split") == name, F.length("text")))
        figures += [n.alias(f"{name}_rows"), steps.alias(f"{name}_steps"), longest.alias(f"{name}_longest")]
    return land_with_figures(prepared, landed, figures)


def train_and_evaluate(
    rows: DataFrame,
    key: str,
    output: str,
    settings: Settings = Settings(),
    code: str = "code",
    label: str = "label_encoded",
    names: Mapping[int, str] = LABEL_NAMES,
    **model_settings: object,
) -> DataFrame:
    """Prepare, train, classify the test part; returns its accuracy per class and overall.

    Leaves ``rows``, ``text``, ``model``, ``predictions`` and ``config`` in the
    ``output`` folder; the config holds the wording, which later classification
    must share. Each step reads what the one before it wrote.
    """
    columns = {"code": code, "label": label, "names": names}
    prepared, report = prepare_with_report(rows, key, f"{output}/rows", settings, **columns)
    export_split_text(prepared, f"{output}/text")
    figures = {"n": report["train_rows"], "steps": report["train_steps"]}
    # The model's own settings are part of the run as well.
    config = asdict(settings) | {"wording": json.dumps(asdict(settings.wording), ensure_ascii=False)}
    config |= {"num_features": NUM_FEATURES, **MODEL_SETTINGS, **model_settings}
    write_config(config_table(rows.sparkSession, config | figures), f"{output}/config")
    model = fit_classifier(part(prepared, "train"), code, label, **model_settings)
    save_model(model, f"{output}/model")
    test = part(prepared, "test")
    if settings.eval_samples:
        test = eval_subset(test, settings.eval_samples, settings.random_state, key)
    predictions = land(classify_with_model(test, model), f"{output}/predictions")
    write_csv(predictions, f"{output}/predictions-csv")
    return evaluate(predictions, label)


def classify_file(
    spark: SparkSession,
    path: str,
    output: str,
    scorer: Callable[[], Scorer] | Model,
    wording: Wording = LONG,
    label: str = "label_encoded",
) -> DataFrame | None:
    """Classify a CSV into a CSV, by a scorer or a fitted model.

    Returns the accuracy, or none if the file has no labels.
    """
    rows = read_contracts(spark, path)
    if isinstance(scorer, Model):
        classified = classify_with_model(rows, scorer, "llm_prediction")
    else:
        classified = classify_table(rows, scorer, wording=wording)
    if label in classified.columns:
        classified = classified.withColumn(label, number_of(classified, label))
    write_csv(classified, output)
    if label not in classified.columns:
        return None
    answers = read_contracts(spark, output).select(
        F.col(label).cast("double"), F.col("llm_prediction").cast("int")
    )
    return accuracy_answered(answers, label, "llm_prediction")
