"""A linear text classifier trained in epochs of mini-batches, judged after each of them.

The rows are read once: the hashed words of each text are stored in ``steps``
mini-batches by hash of the key. A step is one Spark job over one of them: tasks add
up the gradient of their rows, Spark adds up the tasks', and the driver moves the
weights (Adagrad). After each epoch the loss on the validation rows is taken and a
checkpoint written; the weights of the epoch with the least loss are the model. A
training that finds checkpoints in its folder goes on after the last one.

What a row adds to a gradient or a loss is rounded to a whole number of 2^-24, so
sums do not depend on the order of rows: another partitioning, a lost executor or a
restart gives the same model.

Driver and tasks hold one number for each hashed word and class, however many rows
there are. Rows without text or label are not learned from; validation rows whose
label was not in training are left out of the losses. Without validation rows the
training loss chooses. Labels are whole numbers.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.shared import new_path, stored

NO_ANSWER = -1
MOST_CLASSES = 1000
#: Gradients and losses are summed as whole numbers of 1 / SCALE.
SCALE = 1 << 24
_SLICE = 64
_LOSS, _ROWS, _RIGHT = -1, -2, -3


def word_slots(text: Column, num_features: int) -> Column:
    """The hashed words of a text, repeats included."""
    words = F.filter(F.split(F.lower(text), r"\W+"), lambda word: word != "")
    return F.transform(words, lambda word: F.pmod(F.xxhash64(word), F.lit(num_features)).cast("int"))


def _entries(slots: pa.ListArray, num_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, slot and value of each different slot of each row; the last slot is 1 in all rows."""
    n, width = len(slots), num_features + 1
    rows = np.repeat(np.arange(n), pc.list_value_length(slots).to_numpy(zero_copy_only=False))
    codes = np.concatenate([rows * width + slots.flatten().to_numpy(), np.arange(n) * width + num_features])
    codes, counts = np.unique(codes, return_counts=True)
    row, slot = np.divmod(codes, width)
    always = slot == num_features
    value = np.where(always, 0.0, np.log1p(counts))
    length = np.sqrt(np.bincount(row, value * value, n))
    value = value / np.where(length > 0, length, 1.0)[row]
    value[always] = 1.0
    return row, slot, value


def _shares(row: np.ndarray, slot: np.ndarray, value: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Likelihood of each class for each row."""
    starts = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
    logits = np.add.reduceat(value[:, None] * weights[slot], starts)
    likely = np.exp(logits - logits.max(axis=1, keepdims=True))
    return likely / likely.sum(axis=1, keepdims=True)


def _whole(values: np.ndarray) -> np.ndarray:
    return np.rint(values * SCALE).astype(np.int64)


def _summed(rows: DataFrame, weights: np.ndarray, with_gradient: bool) -> dict[int, int]:
    """Loss, rows, right answers and, by slot and class, the gradient over ``rows`` (_slots, _class)."""
    num_features, n_classes = weights.shape[0] - 1, weights.shape[1]
    shared = rows.sparkSession.sparkContext.broadcast(weights)

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current = shared.value
        total = np.zeros(current.shape if with_gradient else (0, 0), np.int64)
        figures = np.zeros(3, np.int64)
        for batch in (b.slice(i, _SLICE) for b in batches for i in range(0, len(b), _SLICE)):
            row, slot, value = _entries(batch.column(0), num_features)
            truth = batch.column(1).to_numpy()
            shares = _shares(row, slot, value, current)
            at = np.arange(len(truth)), truth
            right = int((shares.argmax(axis=1) == truth).sum())
            figures += [int(_whole(-np.log(np.maximum(shares[at], 1e-15))).sum()), len(truth), right]
            if with_gradient:
                shares[at] -= 1.0
                order = np.argsort(slot, kind="stable")
                parts = _whole(value[:, None] * shares[row])[order]
                starts = np.flatnonzero(np.append(True, np.diff(slot[order]) != 0))
                total[slot[order][starts]] += np.add.reduceat(parts, starts)
        places = np.flatnonzero(total)
        names = np.concatenate([[_LOSS, _ROWS, _RIGHT], places]).astype(np.int64)
        sums = np.concatenate([figures, total.ravel()[places]])
        yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(sums)], names=["_at", "_sum"])

    parts = rows.select("_slots", "_class").mapInArrow(added, "_at bigint, _sum bigint")
    table = parts.groupBy("_at").agg(F.sum("_sum").alias("_sum")).toArrow()
    shared.destroy()
    return dict(zip(table.column("_at").to_pylist(), table.column("_sum").to_pylist()))


@dataclass(frozen=True)
class Epoch:
    """Figures after an epoch; the training loss is the mean over its steps, each before it moved the weights."""

    epoch: int
    train_loss: float
    validation_loss: float
    validation_accuracy: float
    rows: int
    validation_rows: int


_EPOCHS = (
    "epoch int, train_loss double, validation_loss double, validation_accuracy double, rows bigint,"
    " validation_rows bigint, settings string"
)


@dataclass(frozen=True)
class LinearModel:
    """Weights by slot (the last is the constant) and class."""

    classes: tuple[int, ...]
    weights: np.ndarray

    def classify(self, text: Column) -> Column:
        """The likeliest class of a text, ties to the lowest; -1 for a missing one."""
        model, num_features = self, self.weights.shape[0] - 1

        @F.arrow_udf("int")
        def answered(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            names = np.array(model.classes, np.int32)
            for slots in batches:
                found = [
                    names[_shares(*_entries(some, num_features), model.weights).argmax(axis=1)]
                    for some in (slots.slice(i, _SLICE) for i in range(0, len(slots), _SLICE))
                ]
                yield pa.array(np.concatenate(found) if found else np.empty(0, np.int32), pa.int32())

        words = F.coalesce(word_slots(text, num_features), F.array().cast("array<int>"))
        return F.when(text.isNull(), F.lit(NO_ANSWER)).otherwise(answered(words))


@dataclass(frozen=True)
class Trained:
    """The model of the best epoch, and the figures of all."""

    model: LinearModel
    best: int
    epochs: tuple[Epoch, ...]


class _Checkpoints:
    """One table with a row for each finished epoch, and the weights after each.

    The weights are written before the row, so an epoch with a row is whole.
    """

    def __init__(self, spark: SparkSession, folder: str, settings: dict[str, object]) -> None:
        self.spark, self.folder, self.settings = spark, folder, json.dumps(settings, sort_keys=True)

    def epochs(self) -> list[Epoch]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/epochs")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        rows = self.spark.read.schema(_EPOCHS).parquet(f"{self.folder}/epochs").orderBy("epoch").collect()
        if any(row.settings != self.settings for row in rows):
            raise ValueError(f"{self.folder} has checkpoints of a training with other settings or classes")
        return [Epoch(*row[:-1]) for row in rows]

    def save(self, epoch: Epoch, weights: np.ndarray, squares: np.ndarray) -> None:
        places = np.flatnonzero(squares.ravel())
        state = pa.table({"at": places, "weight": weights.ravel()[places], "square": squares.ravel()[places]})
        self.spark.createDataFrame(state).write.mode("overwrite").parquet(f"{self.folder}/weights-{epoch.epoch}")
        row = [(*vars(epoch).values(), self.settings)]
        self.spark.createDataFrame(row, _EPOCHS).coalesce(1).write.mode("append").parquet(f"{self.folder}/epochs")

    def load(self, epoch: int, shape: tuple[int, int]) -> tuple[np.ndarray, np.ndarray]:
        state = self.spark.read.parquet(f"{self.folder}/weights-{epoch}").toArrow()
        weights, squares = np.zeros(shape), np.zeros(shape)
        places = state.column("at").to_numpy()
        weights.ravel()[places] = state.column("weight").to_numpy()
        squares.ravel()[places] = state.column("square").to_numpy()
        return weights, squares


def _prepared(df: DataFrame, classes: tuple[int, ...], key: str, text: str, label: str, num_features: int) -> DataFrame:
    """_key, _slots and _class of the rows with a text and a known label."""
    numbers = F.create_map(*[F.lit(x) for i, one in enumerate(classes) for x in (one, i)])
    known = F.col(label).isin(*classes) & F.col(text).isNotNull()
    return df.where(known).select(
        F.xxhash64(F.col(key)).alias("_key"),
        word_slots(F.col(text), num_features).alias("_slots"),
        F.element_at(numbers, F.col(label).cast("int")).alias("_class"),
    )


def train_by_epochs(
    train: DataFrame,
    validation: DataFrame,
    folder: str,
    key: str,
    text: str = "code",
    label: str = "label_encoded",
    epochs: int = 5,
    steps: int = 4,
    rate: float = 0.5,
    patience: int | None = None,
    num_features: int = 1 << 16,
    seed: int = 42,
) -> Trained:
    """The model with the least validation loss of at most ``epochs`` epochs.

    ``folder`` holds the checkpoints and must be shared by all machines. With
    ``patience``, training ends after so many epochs without a lower loss.
    """
    spark = train.sparkSession
    labels = train.where(F.col(text).isNotNull() & F.col(label).isNotNull()).select(F.col(label).cast("int"))
    classes = tuple(sorted(row[0] for row in labels.distinct().limit(MOST_CLASSES + 1).collect()))
    if not classes:
        raise ValueError("no row has both a text and a label")
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"{label} has more than {MOST_CLASSES} classes")
    settings = {"classes": classes, "steps": steps, "rate": rate, "num_features": num_features, "seed": seed}
    checkpoints = _Checkpoints(spark, folder, settings)
    done = checkpoints.epochs()
    shape = (num_features + 1, len(classes))
    weights, squares = checkpoints.load(done[-1].epoch, shape) if done else (np.zeros(shape), np.zeros(shape))

    def ended() -> bool:
        losses = [one.validation_loss for one in done]
        waited = len(losses) - 1 - losses.index(min(losses)) if losses else 0
        return len(done) >= epochs or (patience is not None and waited >= patience)

    if not ended():
        rows = _prepared(train, classes, key, text, label, num_features)
        step = F.pmod(F.xxhash64("_key", F.lit(seed)), F.lit(steps)).cast("int").alias("_step")
        path = new_path(spark, "mini-batches")
        rows.select("_slots", "_class", step).write.partitionBy("_step").parquet(path)
        batches = spark.read.schema("_slots array<int>, _class int, _step int").parquet(path)
        judged = stored(_prepared(validation, classes, key, text, label, num_features), "validation-words")
    while not ended():
        epoch = len(done) + 1
        loss = seen = 0
        for one in np.random.default_rng([seed, epoch]).permutation(steps).tolist():
            sums = _summed(batches.where(F.col("_step") == one), weights, with_gradient=True)
            if not (n := sums.get(_ROWS, 0)):
                continue
            loss, seen = loss + sums[_LOSS], seen + n
            gradient = np.zeros(shape)
            places = np.array([at for at in sums if at >= 0], np.int64)
            gradient.ravel()[places] = np.array([sums[at] for at in places.tolist()]) / (SCALE * n)
            squares = squares + gradient * gradient
            weights = weights - rate * gradient / np.sqrt(np.where(squares > 0, squares, 1.0))
        found = _summed(judged, weights, with_gradient=False)
        n = found.get(_ROWS, 0)
        figures = (found[_LOSS] / SCALE / n, found[_RIGHT] / n) if n else (loss / SCALE / seen, 0.0)
        done.append(Epoch(epoch, loss / SCALE / seen, *figures, seen, n))
        checkpoints.save(done[-1], weights, squares)
    best = min(done, key=lambda one: (one.validation_loss, one.epoch)).epoch
    return Trained(LinearModel(classes, checkpoints.load(best, shape)[0]), best, tuple(done))
