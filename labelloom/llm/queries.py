"""One registered query per operator, over the whole of its table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from labelloom.llm.common import table
from labelloom.llm.conversations import audit_conversations, damage_conversations
from labelloom.llm.exact_dedup import exact_groups
from labelloom.llm.language import identify_languages
from labelloom.llm.mixing import mix_plan
from labelloom.llm.packing import pack
from labelloom.llm.shuffling import record_size, shuffle_into_shards
from labelloom.llm.simhash import near_duplicates
from labelloom.llm.token_blocks import read_token_files, write_token_files
from labelloom.llm.token_counts import fit_budget, token_prefixes
from labelloom.llm.topk import top_k
from labelloom.llm.toxicity import score_toxicity
from labelloom.llm.url_filter import Rule, filter_urls
from labelloom.llm.whitening import whiten

BYTE_TOKENS = public_tokenizers.path("byte_bpe_50k.json")
WORD_TOKENS = public_tokenizers.path("word_bpe_49k.json")
TOKEN_LIMIT = 2048
URL_RULES = (
    Rule("net/", "block"),
    Rule("example.net/en/", "allow"),
    Rule("example.com/de/", "block"),
    Rule("org/fr/", "allow"),
)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write_token_files(table(spark, sf_dir, "documents"), BYTE_TOKENS)
    return read_token_files(manifest)


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_languages(table(spark, sf_dir, "documents"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_plan(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    prefixes = token_prefixes(table(spark, sf_dir, "documents"), WORD_TOKENS)
    return fit_budget(prefixes, TOKEN_LIMIT).select(
        "doc_id",
        "n_bytes",
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
        "fit_bytes",
        "fit_tokens",
    )


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared deviations as BIGINT; NULL where one is beyond 64 bits."""
    rows = whiten(table(spark, sf_dir, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("bigint"))


def op12_external_shuffle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = shuffle_into_shards(table(spark, sf_dir, "documents"))
    text = F.col("row.text")
    return rows.select(
        F.col("row.doc_id").alias("doc_id"),
        record_size(text).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    damaged = damage_conversations(table(spark, sf_dir, "conversations"))
    return audit_conversations(damaged, present="present")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_token_blocks": op2_token_blocks,
    "op3_url_filter": op3_url_filter,
    "op4_language_id": op4_language_id,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_packing": op6_packing,
    "op7_simhash_dedup": op7_simhash_dedup,
    "op8_top_k": op8_top_k,
    "op9_source_mix": op9_source_mix,
    "op10_token_counts": op10_token_counts,
    "op11_whitening": op11_whitening,
    "op12_external_shuffle": op12_external_shuffle,
    "op13_conversation_repair": op13_conversation_repair,
}
