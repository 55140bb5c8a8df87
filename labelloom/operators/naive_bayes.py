"""A text classifier made of counts alone: multinomial naive Bayes in whole numbers.

Fitting is two aggregations: rows and words of each class, and how often each word
occurs in each class. The second table has a row for each word, so it is as long as
the vocabulary and stays distributed. A word's weight in a class is the rounded,
scaled logarithm of its smoothed share, so sums of weights are exact, do not depend
on their order, and ties go to the lowest class.

Classifying joins the words of a text, counted once each, with their weights: words
of a large share of all rows are broadcast or salted, the others shuffled, and what
comes back for each text is one sum for each class. Words that fitting has not met
say nothing. Texts must have a unique key.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.shared import stored, with_group_values

WORD = r"[^\x20\x09-\x0D]+"
SCALE = 1 << 20
#: One column of sums for each class goes through the aggregation.
MOST_CLASSES = 1000
NO_ANSWER = -1


def _words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def _whole(value: Column) -> Column:
    """A logarithm as a whole number."""
    return F.round(F.ln(value) * SCALE).cast("bigint")


@dataclass(frozen=True)
class WordCounts:
    """``classes``: label, rows and words of each; ``words``: _group (the word), _rows, and its count in each class."""

    classes: tuple[tuple[int, int, int], ...]
    words: DataFrame
    vocabulary: int

    def _weights(self) -> DataFrame:
        """_group, _rows, and per class what the word adds to the weight of a word never met in it."""
        counts = F.col("_counts")
        deltas = []
        for label, _, total in self.classes:
            n = F.coalesce(F.element_at(counts, F.lit(label)), F.lit(0))
            deltas.append(_whole((n + 1) / F.lit(total + self.vocabulary)))
        return self.words.select("_group", "_rows", F.array(*deltas).alias("_weights"))

    def classify(self, df: DataFrame, key: str, text: str, output: str = "prediction") -> DataFrame:
        """``key`` and ``output``: the likeliest class of each text; -1 for a missing one."""
        rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
        words = rows.select("_key", F.explode(_words(F.col("_text"))).alias("_word"))
        counted = words.groupBy("_key", "_word").agg(F.count("*").alias("_n"))
        met = with_group_values(counted, "_word", stored(self._weights(), "word-weights")).where("_weights IS NOT NULL")
        sums = [F.sum(F.col("_n") * F.get("_weights", F.lit(i))).alias(f"_{i}") for i in range(len(self.classes))]
        scored = met.groupBy(F.col("_key").alias("_of")).agg(*sums)
        total = sum(rows for _, rows, _ in self.classes)
        scores = [
            F.struct(
                (F.coalesce(f"_{i}", F.lit(0)) + _whole(F.lit(n) / F.lit(total))).alias("score"),
                F.lit(-label).alias("label"),
            )
            for i, (label, n, _) in enumerate(self.classes)
        ]
        best = (-F.array_max(F.array(*scores))["label"]).cast("int")
        answer = F.when(F.col("_text").isNull(), NO_ANSWER).otherwise(best)
        joined = rows.join(scored, F.col("_key") == F.col("_of"), "left")
        return joined.select(F.col("_key").alias(key), answer.alias(output))


def fit_word_counts(train: DataFrame, text: str = "code", label: str = "label_encoded") -> WordCounts:
    """Counts of the rows with a text and a label. Labels are whole numbers."""
    rows = train.where(F.col(text).isNotNull() & F.col(label).isNotNull())
    rows = rows.select(F.col(label).cast("int").alias("_label"), _words(F.col(text)).alias("_words"))
    sizes = rows.groupBy("_label").agg(F.count("*").alias("rows"), F.sum(F.size("_words")).cast("bigint").alias("words"))
    classes = sizes.orderBy("_label").limit(MOST_CLASSES + 1).collect()
    if len(classes) > MOST_CLASSES:
        raise ValueError(f"more than {MOST_CLASSES} classes")
    if not classes:
        raise ValueError("no rows to fit on")
    each = rows.select("_label", F.explode("_words").alias("_group")).groupBy("_group", "_label").agg(F.count("*").alias("_n"))
    counts = F.map_from_entries(F.collect_list(F.struct("_label", "_n")))  # at most one entry a class
    words = stored(each.groupBy("_group").agg(F.sum("_n").alias("_rows"), counts.alias("_counts")), "word-counts")
    return WordCounts(tuple((r["_label"], r["rows"], r["words"]) for r in classes), words, words.count())
