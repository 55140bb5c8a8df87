"""A text classifier trained by Spark ML on the training part.

Training passes over the rows many times, so the word counts are made once and
stored; all passes read those. Their width is fixed, and with it the model's
size, whatever the data's.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import IDF, HashingTF, RegexTokenizer
from pyspark.sql import DataFrame

from labelloom.operators.sampling import part, stratified_split
from labelloom.shared import stored

NUM_FEATURES = 1 << 16
PARALLEL = 4
MODEL_SETTINGS = {"max_iter": 50, "reg_param": 0.01}


def _word_counts(text: str, num_features: int) -> PipelineModel:
    return PipelineModel(
        stages=[
            RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"),
            HashingTF(inputCol="_words", outputCol="_counts", numFeatures=num_features),
        ]
    )


def _counted(
    rows: DataFrame, counter: PipelineModel, text: str, label: str, partitions: int | None
) -> DataFrame:
    texts = rows.select(text, label)
    spread = texts.repartition(partitions) if partitions else texts
    return stored(counter.transform(spread).select(label, "_counts"), "word-counts")


def _weighted_regression(label: str, **settings: object) -> Pipeline:
    chosen = MODEL_SETTINGS | settings
    return Pipeline(
        stages=[
            IDF(inputCol="_counts", outputCol="_features"),
            LogisticRegression(
                featuresCol="_features",
                labelCol=label,
                maxIter=chosen["max_iter"],
                regParam=chosen["reg_param"],
                family="multinomial",
                aggregationDepth=3,
            ),
        ]
    )


def fit_classifier(
    train: DataFrame,
    text: str = "code",
    label: str = "label_encoded",
    num_features: int = NUM_FEATURES,
    partitions: int | None = None,
    **settings: object,
) -> PipelineModel:
    """Hashed word counts, weighted by rarity, and multinomial logistic regression.

    ``settings`` are ``max_iter`` and ``reg_param``. ``partitions`` spreads the
    texts evenly, for a table with fewer splits than there are cores.
    """
    counter = _word_counts(text, num_features)
    counts = _counted(train, counter, text, label, partitions)
    fitted = _weighted_regression(label, **settings).fit(counts)
    return PipelineModel(stages=[*counter.stages, *fitted.stages])


def select_model(
    train: DataFrame,
    candidates: Sequence[Mapping[str, object]],
    seed: int,
    key: str,
    validation_size: float = 0.2,
    text: str = "code",
    label: str = "label_encoded",
    num_features: int = NUM_FEATURES,
    partitions: int | None = None,
) -> tuple[PipelineModel, list[float]]:
    """The candidate settings with the least log-loss on rows cut from ``train``, and all losses.

    The model returned is fitted with them on all of ``train``; candidates are
    fitted at the same time, ``PARALLEL`` at most. The test part is never seen,
    so its accuracy stays an honest figure.
    """
    rows = stratified_split(train, validation_size, seed, label, key, step="validation")
    counter = _word_counts(text, num_features)
    fitting = _counted(part(rows, "train"), counter, text, label, partitions)
    validation = _counted(part(rows, "test"), counter, text, label, partitions)
    log_loss = MulticlassClassificationEvaluator(metricName="logLoss", labelCol=label)

    def loss(settings: Mapping[str, object]) -> float:
        model = _weighted_regression(label, **settings).fit(fitting)
        return log_loss.evaluate(model.transform(validation))

    with ThreadPoolExecutor(PARALLEL) as pool:
        losses = list(pool.map(inheritable_thread_target(train.sparkSession)(loss), candidates))
    best = candidates[losses.index(min(losses))]
    fitted = _weighted_regression(label, **best).fit(fitting.unionByName(validation))
    return PipelineModel(stages=[*counter.stages, *fitted.stages]), losses


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
