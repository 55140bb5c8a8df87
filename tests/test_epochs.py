"""Training by epochs against plain Python, restarts and partitionings."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from labelloom.operators import epochs as ep

FEATURES = 32


def rows(n=240, seed=1):
    draw = random.Random(seed)
    words = {0: "alpha beta gamma".split(), 4: "delta eps beta".split(), 7: "zeta eta gamma".split()}
    out = [(i, " ".join(draw.choices(words[label], k=draw.randint(1, 9))), label) for i, label in enumerate(draw.choices([0, 4, 7], k=n))]
    return out + [(n, None, 0), (n + 1, "alpha", None), (n + 2, "", 4), (n + 3, " ?! ", 7)]


def table(spark, data):
    return spark.createDataFrame(data, "id bigint, code string, label_encoded int")


def trained(spark, train, validation, folder, **settings):
    return ep.train_by_epochs(train, validation, str(folder), "id", num_features=FEATURES, **{"epochs": 3, "steps": 3} | settings)


def by_hand(spark, train, validation, n_epochs, steps, rate=0.5, seed=42):
    """Losses and weights, one row after another."""
    classes = sorted({r[2] for r in train if r[1] is not None and r[2] is not None})

    def read(data):
        df = table(spark, data).where("code IS NOT NULL").where(F.col("label_encoded").isin(*classes))
        step = F.pmod(F.xxhash64(F.xxhash64("id"), F.lit(seed)), F.lit(steps))
        out = []
        for slots, label, at in df.select(ep.word_slots(F.col("code"), FEATURES), "label_encoded", step).collect():
            values = {s: math.log1p(slots.count(s)) for s in slots}
            length = math.sqrt(sum(v * v for v in values.values()))
            out.append(({s: v / length for s, v in values.items()} | {FEATURES: 1.0}, classes.index(label), at))
        return out

    def shares(x, weights):
        logits = [sum(v * weights[s][k] for s, v in x.items()) for k in range(len(classes))]
        likely = [math.exp(one) for one in logits]
        return [one / sum(likely) for one in likely]

    fit, judged = read(train), read(validation)
    weights, squares = np.zeros((FEATURES + 1, len(classes))), np.zeros((FEATURES + 1, len(classes)))
    losses = []
    for epoch in range(1, n_epochs + 1):
        for step in np.random.default_rng([seed, epoch]).permutation(steps):
            some = [one for one in fit if one[2] == step]
            gradient = np.zeros_like(weights)
            for x, truth, _ in some:
                p = shares(x, weights)
                for s, v in x.items():
                    for k in range(len(classes)):
                        gradient[s, k] += v * (p[k] - (k == truth)) / len(some)
            squares += gradient**2
            weights -= np.divide(rate * gradient, np.sqrt(squares), out=np.zeros_like(weights), where=squares > 0)
        losses.append(-sum(math.log(shares(x, weights)[truth]) for x, truth, _ in judged) / len(judged))
    return losses, weights


def test_epochs_against_plain_python(spark, tmp_path):
    train, validation = rows(), [(9000 + i, text, label) for i, text, label in rows(80, 2)] + [(1, "alpha", 99)]
    found = trained(spark, table(spark, train), table(spark, validation), tmp_path / "a")
    losses, weights = by_hand(spark, train, validation, 3, 3)
    assert [one.validation_loss for one in found.epochs] == pytest.approx(losses, abs=1e-4)
    assert found.best == losses.index(min(losses)) + 1 == 3
    assert np.allclose(found.model.weights, weights, atol=1e-3)
    assert {(one.rows, one.validation_rows) for one in found.epochs} == {(242, 82)}
    assert found.epochs[0].train_loss < math.log(3) + 0.05


def test_restart_and_partitioning_give_the_same_model(spark, tmp_path):
    train, validation = table(spark, rows()), table(spark, rows(80, 2))
    whole = trained(spark, train, validation, tmp_path / "whole")
    first = trained(spark, train.repartition(5), validation, tmp_path / "parts", epochs=1)
    assert len(first.epochs) == 1
    parts = trained(spark, train.repartition(2), validation.repartition(7), tmp_path / "parts")
    assert parts.epochs == whole.epochs and parts.best == whole.best
    assert (parts.model.weights == whole.model.weights).all()
    assert trained(spark, train, validation, tmp_path / "parts").epochs == whole.epochs
    with pytest.raises(ValueError, match="other settings"):
        trained(spark, train, validation, tmp_path / "parts", rate=0.1)


def test_the_best_epoch_is_kept(spark, tmp_path):
    train = table(spark, rows())
    # Labels of the validation rows are wrong, so that the loss rises with every epoch.
    wrong = train.withColumn("label_encoded", F.expr("CASE label_encoded WHEN 0 THEN 4 WHEN 4 THEN 7 ELSE 0 END"))
    found = trained(spark, train, wrong, tmp_path / "a", epochs=6, patience=2)
    assert found.best == 1 and len(found.epochs) == 3


def test_classify(spark, tmp_path):
    train = table(spark, rows())
    found = trained(spark, train, train.where("false"), tmp_path / "a")
    answers = train.select("id", "code", "label_encoded", found.model.classify(F.col("code")).alias("answer")).collect()
    assert [r.answer for r in answers if r.code is None] == [-1]
    known = [r for r in answers if r.code is not None]
    slots = dict(train.where("code IS NOT NULL").select("id", ep.word_slots(F.col("code"), FEATURES)).collect())
    for row in known:
        values = {one: math.log1p(slots[row.id].count(one)) for one in slots[row.id]}
        length = math.sqrt(sum(v * v for v in values.values())) or 1.0
        logits = found.model.weights[FEATURES] + sum(found.model.weights[s] * v / length for s, v in values.items())
        assert row.answer == found.model.classes[int(np.argmax(logits))]
    own = {0: {"alpha"}, 4: {"delta"}, 7: {"zeta"}}
    sure = [r for r in known if r.id < 240 and own[r.label_encoded] & set(r.code.split())]
    assert len(sure) > 100 and np.mean([r.answer == r.label_encoded for r in sure]) > 0.9
    with pytest.raises(ValueError, match="no row"):
        trained(spark, train.where("false"), train, tmp_path / "none")
