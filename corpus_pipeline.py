"""A corpus pipeline: five stages, each written as Parquet and read again by the next.

toxicity (rejected documents go), exact dedup, SimHash near-dedup (one document
of each group stays), mixing sources to target weights, best-fit packing. The
first four return the columns of ``documents``; packing returns one row for each
piece of a document.

Defined results: those of the operators. A table without rows passes through
empty; columns beside doc_id, text and source are carried along, whatever their
names; ``n_chars``, if there, follows a text that mixing has cut.
"""

from __future__ import annotations

import os
import sys
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

import labelloom
from labelloom.llm.common import table
from labelloom.llm.exact_dedup import drop_exact_copies
from labelloom.llm.mixing import mixed_rows
from labelloom.llm.packing import pack
from labelloom.llm.simhash import drop_near_copies
from labelloom.llm.toxicity import drop_toxic
from labelloom.shared import stored

# Workers started from another folder cannot import the package.
cloudpickle.register_pickle_by_value(labelloom)

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_exact_copies(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixed_rows(docs, length="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("simhash_dedup", simhash_dedup),
    ("source_mix", source_mix),
    ("packing", packing),
]

# Learned scores, fingerprints and best fit have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The packed corpus of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
