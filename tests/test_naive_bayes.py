"""The model of counts against plain Python."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import pytest

from labelloom.operators.naive_bayes import SCALE, fit_word_counts


def whole(x):
    return math.floor(abs(math.log(x)) * SCALE + 0.5) * (1 if x >= 1 else -1)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def by_hand(train, texts):
    classes = sorted({label for _, text, label in train if text is not None and label is not None})
    rows, counts = Counter(), {label: Counter() for label in classes}
    for _, text, label in train:
        if text is not None and label is not None:
            rows[label] += 1
            counts[label].update(words(text))
    vocabulary = set().union(*counts.values())
    out = {}
    for key, text in texts:
        if text is None:
            out[key] = -1
            continue
        scores = {}
        for label in classes:
            total = sum(counts[label].values()) + len(vocabulary)
            scores[label] = whole(rows[label] / sum(rows.values())) + sum(
                whole((counts[label][w] + 1) / total) for w in words(text) if w in vocabulary
            )
        out[key] = max(classes, key=lambda label: (scores[label], -label))
    return out


def test_against_plain_python(spark):
    draw = random.Random(4)
    topics = {0: "uint owner call", 2: "mint token call", 7: "time block now"}
    train = [(i, " ".join(draw.choices(topics[label].split() + ["the"], k=draw.randint(0, 9))), label)
             for i, label in enumerate(draw.choices([0, 0, 0, 2, 7], k=200))]
    train += [(900, None, 0), (901, "owner", None)]
    texts = [(i, " ".join(draw.choices("uint owner call mint token time block now the unknown".split(), k=draw.randint(0, 7)))) for i in range(150)]
    texts += [(500, None), (501, ""), (502, " \n"), (503, "never met"), (504, "the " * 5000 + "mint")]
    fitted = fit_word_counts(spark.createDataFrame(train, "id int, code string, label_encoded int").repartition(5))
    asked = spark.createDataFrame(texts, "id int, code string").repartition(3)
    got = {r.id: r.prediction for r in fitted.classify(asked, "id", "code").collect()}
    assert got == by_hand(train, texts)
    assert fitted.vocabulary == len({w for _, t, c in train if t and c is not None for w in words(t)})


def test_ties_go_to_the_lowest_class(spark):
    rows = spark.createDataFrame([(1, "a", 5), (2, "a", 3)], "id int, code string, label_encoded int")
    assert fit_word_counts(rows).classify(rows, "id", "code").select("prediction").distinct().collect() == [(3,)]
    with pytest.raises(ValueError, match="no rows"):
        fit_word_counts(rows.where("false"))
