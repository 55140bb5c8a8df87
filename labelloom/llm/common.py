"""What several operators share: words, landed tables, running totals, worker objects."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterator, Sequence
from typing import Any
from uuid import uuid4

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

from labelloom.shared import new_path, stored

#: Runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

UID, PART, ROW = "_uid", "_part", "_row"
_ROW_BITS = 33  # of monotonically_increasing_id()
_CHUNK = 4096


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def id_fold(key: Column, folds: int) -> Column:
    """crc32 of the key written as text, modulo ``folds``; NULL for a NULL key."""
    return F.crc32(key.cast("string").cast("binary")) % folds


def per_worker(name: object, make: Callable[[], Any]) -> Any:
    """The object of this name in this Python worker, made at its first use.

    A worker runs many tasks, and functions that travel with a task are new in
    each; what takes long to build is kept in a module of its own instead.
    """
    module = sys.modules.setdefault("labelloom_worker_objects", types.ModuleType("labelloom_worker_objects"))
    objects = module.__dict__.setdefault("objects", {})
    if name not in objects:
        objects[name] = make()
    return objects[name]


#: Bytes of the input that one bucket of a landed table holds, about.
BUCKET_BYTES = 512 * 1024 * 1024
_UNKNOWN = 1 << 60


def bucket_count(df: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> int:
    """Buckets for the rows of ``df``: by the bytes of the tables it reads, as Spark's statistics have them.

    At least as many as a shuffle has partitions, at most as many as the session
    allows. Every task fills one bucket, so more of them are no more files.
    """
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size())]
    read = sum(size for size in sizes if size < _UNKNOWN)
    least = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    most = int(spark.conf.get("spark.sql.sources.bucketing.maxBuckets"))
    return min(max(least, -(-read // bucket_bytes)), most)


class Landed:
    """A table written once, whose rows can then be picked without moving them.

    ``rows`` has the columns of the input inside the struct ``_row``, where none
    can clash, beside ``_uid`` (unique), ``_part`` and the columns of ``extra``.
    The files are bucketed by ``_part``, the task that wrote them: a join on it
    leaves the rows where they are, whatever their width. What is computed from
    a landed table survives the loss of any executor, and its ids never change.
    """

    def __init__(self, df: DataFrame, extra: dict[str, Column], name: str) -> None:
        spark = df.sparkSession
        self.spark = spark
        self.schema = df.schema
        path = new_path(spark, name)
        self.table = f"{name.replace('-', '_')}_{uuid4().hex}"
        buckets = bucket_count(df)
        whole = F.struct(*[F.col(f"`{c}`") for c in df.columns])
        numbered = df.select(whole.alias(ROW), *[c.alias(n) for n, c in extra.items()])
        numbered = numbered.withColumn(UID, F.monotonically_increasing_id())
        numbered = numbered.withColumn(PART, F.shiftright(UID, _ROW_BITS).cast("int"))
        # Whole texts lie here once more, so they are packed tighter than by default.
        writer = numbered.write.format("parquet").bucketBy(buckets, PART).option("path", path)
        writer = writer.option("compression", "zstd")
        writer.saveAsTable(self.table)

    @property
    def rows(self) -> DataFrame:
        return self.spark.table(self.table)

    def close(self) -> None:
        """Forget the table's name; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")

    def bitmaps(self, uids: DataFrame) -> DataFrame:
        """Per part, a bit for each of its rows whose ``_uid`` is in ``uids``, in chunks of 4,096."""
        parts = uids.select(F.shiftright(UID, _ROW_BITS).cast("int").alias("_of"), UID)
        bitmaps = parts.groupBy("_of").applyInArrow(_bitmap, "_of int, _bits array<binary>")
        return stored(bitmaps, "row-bitmaps")

    def marked(self, bitmaps: DataFrame, picked: bool, rows: DataFrame | None = None) -> DataFrame:
        """The rows whose bit is set, or the others.

        A join on the bucketing column alone, the bitmaps being the hashed side:
        one bit a row is all that moves.
        """
        rows = self.rows if rows is None else rows
        place = F.col(UID).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        chunk = F.try_element_at("_bits", (F.floor(place / _CHUNK) + 1).cast("int"))
        byte = F.substring(chunk, (F.floor(place % _CHUNK / 8) + 1).cast("int"), F.lit(1))
        bit = F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int"))
        on = (F.col(PART) == F.col("_of")) & (F.coalesce(bit, F.lit(0)) == 1)
        return rows.join(bitmaps.hint("shuffle_hash"), on, "left_semi" if picked else "left_anti")

    def with_numbers(self, numbers: DataFrame, name: str, rows: DataFrame | None = None) -> DataFrame:
        """The rows (or others of this table) plus BIGINT ``name``, from ``numbers`` (``_uid``, ``_number`` from 0 on); NULL for other rows.

        As with bitmaps, the numbers of a part go to where its rows lie.
        """
        parts = numbers.select(F.shiftright(UID, _ROW_BITS).cast("int").alias("_of"), UID, "_number")
        values = parts.groupBy("_of").applyInArrow(_numbers, "_of int, _values array<array<bigint>>")
        place = F.col(UID).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
        chunk = F.try_element_at("_values", (F.floor(place / _CHUNK) + 1).cast("int"))
        number = F.try_element_at(chunk, (place % _CHUNK + 1).cast("int"))
        rows = self.rows if rows is None else rows
        joined = rows.join(
            stored(values, "row-numbers").hint("shuffle_hash"), F.col(PART) == F.col("_of"), "left"
        )
        return joined.select(*rows.columns, number.alias(name))

    def whole(self, rows: DataFrame) -> DataFrame:
        """Landed rows with the columns that the table came with."""
        return rows.select(*[F.col(f"{ROW}.`{f.name}`").alias(f.name) for f in self.schema])


def _bitmap(group: pa.Table) -> pa.Table:
    places = group[UID].to_numpy() & ((1 << _ROW_BITS) - 1)
    chunks = int(places.max()) // _CHUNK + 1
    bits = np.zeros(chunks * _CHUNK, np.uint8)
    bits[places] = 1
    packed = np.packbits(bits, bitorder="little").reshape(chunks, -1)
    return pa.table(
        {
            "_of": group["_of"][:1],
            "_bits": pa.array([[row.tobytes() for row in packed]], pa.list_(pa.binary())),
        }
    )


def _numbers(group: pa.Table) -> pa.Table:
    places = group[UID].to_numpy() & ((1 << _ROW_BITS) - 1)
    numbers = np.full((int(places.max()) // _CHUNK + 1) * _CHUNK, -1, np.int64)
    numbers[places] = group["_number"].to_numpy()
    chunks = numbers.reshape(-1, _CHUNK)
    lists = [pa.array(chunk, mask=chunk < 0) for chunk in chunks]
    return pa.table(
        {
            "_of": group["_of"][:1],
            "_values": pa.array([[one.to_pylist() for one in lists]], pa.list_(pa.list_(pa.int64()))),
        }
    )


def running_totals(
    df: DataFrame, group: str, order: Sequence[str], value: str, name: str
) -> DataFrame:
    """``df`` plus BIGINT ``name``: the sum of ``value`` over the rows before, in the same group.

    The rows are ranged over (group, order), so that a group of any size is
    spread over many tasks; each task sums what it has, and one row for each
    group and task says what lay before it. Rows equal in group and order follow
    each other in no defined order. ``value`` must not be NULL.
    """
    schema = StructType([*df.schema.fields, StructField("_before", LongType()), StructField("_at", IntegerType())])
    keys = [F.col(group), *[F.col(c) for c in order]]
    ranged = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = ranged.withColumn("_at", F.spark_partition_id())
    columns = df.columns

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: Any = ()
        total = 0
        for batch in batches:
            n = len(batch)
            if not n:
                continue
            groups = batch.column(columns.index(group)).to_pylist()
            values = batch.column(columns.index(value)).to_numpy(zero_copy_only=False).astype(np.int64)
            before = np.cumsum(values) - values
            starts = [i for i in range(n) if i == 0 or groups[i] != groups[i - 1]]
            base = np.zeros(n, np.int64)
            for start, end in zip(starts, [*starts[1:], n]):
                carried = total if start == 0 and groups[0] == last else 0
                base[start:end] = carried - before[start]
            last = groups[-1]
            before += base
            total = int(before[-1] + values[-1])
            arrays = [batch.column(i) for i in range(len(columns))]
            at = batch.column(len(columns))
            yield pa.RecordBatch.from_arrays(
                [*arrays, pa.array(before), at], names=[*columns, "_before", "_at"]
            )

    landed = stored(placed.mapInArrow(sums, schema), "running")
    totals = landed.groupBy(F.col(group).alias("_of"), F.col("_at").alias("_in")).agg(
        F.sum(value).alias("_sum")
    )
    # At most one row for each group and task.
    window = "SUM(_sum) OVER (PARTITION BY _of ORDER BY _in) - _sum"
    offsets = stored(totals.select("_of", "_in", F.expr(window).alias("_offset")), "offsets")
    joined = landed.join(offsets, F.col(group).eqNullSafe(F.col("_of")) & (F.col("_at") == F.col("_in")))
    return joined.select(*columns, (F.col("_before") + F.col("_offset")).alias(name))
