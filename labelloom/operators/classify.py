"""Classification of a whole table with a scorer.

A scorer maps a list of prompts to a list of response texts. Only the prompt
column travels to the Python workers and only the response comes back; all other
columns stay in the JVM, so a prediction is attached to its row and never
matched up by position.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.ml import Model
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelloom.functions import text as tx
from labelloom.functions.prompts import prompt
from labelloom.functions.wording import LONG, Wording
from labelloom.functions.workers import built

Scorer = Callable[[Sequence[str]], Sequence[str]]


@dataclass(frozen=True)
class KeywordScorer:
    """Factory of a rule scorer: the answer of the first rule whose word the code holds.

    ``rules`` is a tuple of (word, label); with ``whole_words``, a letter or digit
    at a word's end must end there in the code too. The code is what stands
    between the prompt's ``before`` and ``after``, those of the wording that
    ``classify_table`` asks with. Without a match the answer has no digit.
    """

    rules: tuple[tuple[str, int], ...]
    before: str = LONG.before.rsplit("{labels}")[-1]
    after: str = LONG.after
    whole_words: bool = False

    def with_wording(self, wording: Wording) -> KeywordScorer:
        return replace(self, before=wording.before.rsplit("{labels}")[-1], after=wording.after)

    def pattern(self, word: str) -> str:
        """A regular expression that Python and Spark read alike."""
        quoted = re.sub(r"([^\w\s])", r"\\\1", word)
        if not self.whole_words:
            return quoted
        start = r"(?<![A-Za-z0-9_])" if re.match(r"[A-Za-z0-9_]", word) else ""
        end = r"(?![A-Za-z0-9_])" if re.search(r"[A-Za-z0-9_]$", word) else ""
        return start + quoted + end

    def label(self, code: Column) -> Column:
        """The same answer as an expression of Spark's own: the label, -1 without a match or code."""
        found = F.when(code.isNull(), F.lit(-1))
        for word, label in self.rules:
            matches = code.rlike(self.pattern(word)) if self.whole_words else F.contains(code, F.lit(word))
            found = found.when(matches, F.lit(label))
        return found.otherwise(F.lit(-1)).cast("int")

    def __call__(self) -> Scorer:
        return self.answers

    def answers(self, prompts: Sequence[str]) -> list[str]:
        return [self.answer(one) for one in prompts]

    def answer(self, text: str) -> str:
        code = text.partition(self.before)[2].rpartition(self.after)[0]
        for word, label in self.rules:
            if re.search(self.pattern(word), code) if self.whole_words else word in code:
                return f" {label}"
        return ""


# First match wins, so the more particular words come first.
CONTRACT_RULES = KeywordScorer(
    rules=(
        ("delegatecall", 1),
        (".call.value", 5),
        ("block.number", 0),
        ("block.timestamp", 6),
        ("now", 6),
        ("this.balance ==", 3),
        (".send(", 7),
        (".call(", 7),
        ("payable", 2),
        ("+=", 4),
        ("contract", 8),
    ),
    whole_words=True,
)


def responses(prompts: Column, scorer: Callable[[], Scorer]) -> Column:
    """Response text for each prompt; NULL for a NULL prompt.

    The function counts as non-deterministic, which keeps Spark from calling the
    scorer again for every use of its answer, as in a filter on the prediction.
    """

    @F.pandas_udf("string")
    def respond(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        score = built(scorer)
        for batch in batches:
            present = batch.notna()
            answers = pd.Series([None] * len(batch), index=batch.index, dtype=object)
            answers[present] = list(score(batch[present].tolist()))
            yield answers

    return respond.asNondeterministic()(prompts)


def classify_table(
    df: DataFrame,
    scorer: Callable[[], Scorer],
    code: str = "code",
    output: str = "llm_prediction",
    wording: Wording = LONG,
    echoes_prompt: bool = False,
    max_length: int | None = None,
) -> DataFrame:
    """``df`` plus an INT prediction, -1 where the scorer gave none or the code is NULL.

    Set ``echoes_prompt`` for scorers whose response starts with the prompt, and
    ``max_length`` for those that take no longer prompts: the code is cut then.
    """
    if isinstance(scorer, KeywordScorer):
        scorer = scorer.with_wording(wording)
    asked = prompt(F.col(code), wording=wording, max_length=max_length)
    answer = responses(asked, scorer)
    if echoes_prompt:
        answer = tx.generated_part(answer, asked)
    return df.withColumn(output, tx.first_label(answer))


def classify_by_rules(
    df: DataFrame, scorer: KeywordScorer, code: str = "code", output: str = "llm_prediction"
) -> DataFrame:
    """``df`` plus the prediction of a rule scorer, as an expression; no prompt and no Python."""
    return df.withColumn(output, scorer.label(F.col(code)))


def classify_with_model(
    df: DataFrame, model: Model, output: str = "prediction", code: str = "code"
) -> DataFrame:
    """``df`` plus the INT prediction of a fitted Spark ML model, -1 where the code is NULL.

    ``code`` is the column that the model was fitted on.
    """
    filled = df.withColumn("_code", F.col(code)).withColumn(code, F.coalesce(F.col(code), F.lit("")))
    predicted = F.when(F.col("_code").isNull(), F.lit(-1)).otherwise(F.col("prediction").cast("int"))
    # A column of the table may itself be called as one of the model's.
    kept = [F.col("_code") if name == code else F.col(f"_kept.`{name}`") for name in df.columns]
    whole = F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("_kept")
    scored = model.transform(filled.select(code, "_code", whole))
    return scored.select(*[c.alias(n) for c, n in zip(kept, df.columns)], predicted.alias(output))
