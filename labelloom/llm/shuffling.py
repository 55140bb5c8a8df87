"""Two-pass external shuffle into shards, in Spark's own expressions.

A first pass keeps a seeded hash and the size of every row. From the sizes follows
how many buckets there must be for each to fit into memory; from the hashes, how
many rows each will hold, and which rows are repeated so often that they would
fill a bucket. The second pass scatters the records: one exchange, in which the
bucket of a row is its partition. Each bucket then gets a Fisher-Yates permutation
(``shuffle`` of the numbers of its rows, seeded by seed and bucket) that says which
place each record takes; the task sorts by place and writes.

As buckets are drawn by hash and permuted each by itself, buckets one after the
other are a random order of all rows. Shards are equal parts of that order: their
counts are at most one apart, a bucket adds to one or two of them (to more only if
there are fewer buckets than shards), and a file belongs to one shard.

The hash is of the row's whole contents, so the shards do not depend on how the
input is partitioned, and a task that is run again scatters alike. Rows that are
alike in all columns can change places unseen. Where so many are alike that they
crowd a bucket, the table is written first and they are scattered by row number.

Defined results: a NULL text has no bytes; NULL, empty and long texts, NULL or
repeated ids and repeated rows are shuffled like any others; rows alike need not
stay together. A text larger than a bucket is one record of a larger bucket. An
empty table gives no rows. The columns that came in lie in the struct ``row``, so
that none can clash with ``shard`` and ``slot``. Columns of map type cannot be
hashed and end the query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from labelloom.shared import BROADCAST_BYTES, new_path, stored

SHARDS = 24
#: What a record takes beside its text.
RECORD_BYTES = 8
#: Bytes of the records of one bucket; a task holds its row numbers and sorts the rest.
BUCKET_BYTES = 128 * 1024 * 1024
#: Rows alike beyond this part of a bucket are scattered by number.
_CROWDING = 4
_LEAST_CROWD = 1_000
_PRINT_BYTES = 32


def record_size(text: Column) -> Column:
    """Bytes of the text in UTF-8, none for NULL, and of the record around it."""
    return (F.coalesce(F.octet_length(text), F.lit(0)) + RECORD_BYTES).cast("bigint")


def row_hash(df: DataFrame, seed: int) -> Column:
    return F.xxhash64(F.lit(seed), *[F.col(f"`{name}`") for name in df.columns])


def _bucket(buckets: int) -> Column:
    """Bucket of a row from ``_hash``, and from ``_number`` where too many rows have that hash."""
    drawn = F.when(F.col("_crowd"), F.xxhash64("_hash", "_number")).otherwise(F.xxhash64("_hash"))
    return F.pmod(drawn, F.lit(buckets)).cast("int").alias("_bucket")


def _marked(rows: DataFrame, crowds: DataFrame | None) -> DataFrame:
    """``rows`` plus ``_number`` and BOOLEAN ``_crowd``."""
    if crowds is None:
        return rows.withColumns({"_number": F.lit(0).cast("bigint"), "_crowd": F.lit(False)})
    numbered = rows.withColumn("_number", F.monotonically_increasing_id())
    joined = numbered.join(F.broadcast(crowds), F.col("_hash") == F.col("_crowded"), "left")
    return joined.withColumn("_crowd", F.col("_crowded").isNotNull()).drop("_crowded")


def shuffled(
    df: DataFrame,
    text: str = "text",
    shards: int = SHARDS,
    seed: int = 42,
    bucket_bytes: int = BUCKET_BYTES,
    least_crowd: int = _LEAST_CROWD,
) -> DataFrame:
    """``row``, ``slot`` and ``shard`` of every row, each bucket a partition, in order of shard and slot."""

    def prints_of(rows: DataFrame) -> DataFrame:
        return rows.select(row_hash(df, seed).alias("_hash"), record_size(F.col(f"`{text}`")).alias("_size"))

    prints = stored(prints_of(df), "shard-prints")
    rows, size = prints.agg(F.count("*"), F.sum("_size")).first()
    buckets = max(shards, -(-(size or 0) // bucket_bytes))
    # At least so many rows alike that their list is within the bound of a broadcast.
    crowd = max(least_crowd, rows // (_CROWDING * buckets), rows * _PRINT_BYTES // BROADCAST_BYTES)
    alike = prints.groupBy(F.col("_hash").alias("_crowded")).agg(F.count("*").alias("_rows"))
    crowds: DataFrame | None = stored(alike.where(F.col("_rows") > crowd).select("_crowded"), "shard-crowds")
    if crowds.isEmpty():
        crowds = None
    else:
        # Row numbers must be the same in both passes.
        df = stored(df, "shard-input")
        prints = prints_of(df)

    counts = _marked(prints, crowds).groupBy(_bucket(buckets)).agg(F.count("*").alias("_rows"))
    starts = stored(counts, "shard-buckets")
    # One row for each bucket.
    before = F.expr("SUM(_rows) OVER (ORDER BY _bucket) - _rows")
    # The seed of a permutation is that of the partition, which is the bucket.
    placed = starts.select(F.col("_bucket").alias("_of"), "_rows", before.alias("_before")).repartitionById(buckets, "_of")
    numbers = F.sequence(F.lit(0), (F.col("_rows") - 1).cast("int"))
    permuted = placed.select("_of", "_before", F.shuffle(numbers, seed=seed).alias("_places"))

    whole = F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("row")
    records = _marked(df.select(row_hash(df, seed).alias("_hash"), whole), crowds)
    scattered = records.select("_hash", "row", _bucket(buckets)).repartitionById(buckets, "_bucket")
    index = F.expr("ROW_NUMBER() OVER (PARTITION BY _bucket ORDER BY _hash)").cast("int")
    indexed = scattered.select("_bucket", "row", index.alias("_index"))
    joined = indexed.join(permuted.hint("shuffle_hash"), F.col("_bucket") == F.col("_of"))
    place = joined.select("row", (F.col("_before") + F.get("_places", F.col("_index") - 1)).alias("_place"))
    numbered = place.withColumn("shard", F.expr(f"_place * {shards} div {max(rows, 1)}").cast("int"))
    # The first place of a shard is its share of all rows, rounded up.
    slot = F.col("_place") - F.expr(f"(shard * {rows}L + {shards - 1}) div {shards}")
    return numbered.select("row", slot.alias("slot"), "shard").sortWithinPartitions("shard", "slot")


def shuffle_into_shards(
    df: DataFrame,
    text: str = "text",
    shards: int = SHARDS,
    seed: int = 42,
    bucket_bytes: int = BUCKET_BYTES,
    path: str | None = None,
    least_crowd: int = _LEAST_CROWD,
) -> DataFrame:
    """Write ``df`` in random order as one folder per shard; returns ``row``, ``slot`` and ``shard`` as read back.

    ``slot`` is a row's place in its shard, from 0; files hold their rows in that
    order. The same rows, seed, shards and ``bucket_bytes`` give the same shards.
    """
    spark = df.sparkSession
    path = path or new_path(spark, "shards")
    result = shuffled(df, text, shards, seed, bucket_bytes, least_crowd)
    result.write.partitionBy("shard").option("compression", "zstd").parquet(path)
    schema = StructType(
        [StructField("row", df.schema), StructField("slot", LongType()), StructField("shard", IntegerType())]
    )
    return spark.read.schema(schema).parquet(path)
