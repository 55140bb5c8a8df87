"""Small tables kept in the cluster's shared folder, and joins with them."""

from __future__ import annotations

import tempfile
import warnings
from collections.abc import Sequence
from uuid import uuid4

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
HOT_SHARES = 10_000


_runs: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The checkpoint folder set by the user or by ``spark.checkpoint.dir``; a temporary one in local mode only."""
    named = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    is_local = spark.sparkContext.master.startswith("local")
    if named:
        if named.startswith("file:") and not is_local:
            warnings.warn(f"{named} must be a folder that all machines share", stacklevel=2)
        return named.rstrip("/")
    if not is_local:
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors reach")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="labelloom-"))
    return spark.sparkContext.getCheckpointDir()


def run_folder(spark: SparkSession) -> str:
    """The one folder that holds all intermediate tables of this application."""
    app = spark.sparkContext.applicationId
    if app not in _runs:
        _runs[app] = f"{shared_dir(spark)}/labelloom-{uuid4().hex}"
    return _runs[app]


def clean_up(spark: SparkSession) -> None:
    """Remove the folder of this application; results not yet written are lost with it."""
    folder = _runs.pop(spark.sparkContext.applicationId, None)
    if folder is not None:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, name: str) -> str:
    return f"{run_folder(spark)}/{name}-{uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write a table and read it back, so that it outlives the executors that made it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stored_with_figures(df: DataFrame, name: str, figures: Sequence[Column]) -> tuple[DataFrame, Row]:
    """``stored``, and aggregates over the rows, taken while they are written: no scan of their own."""
    observation = Observation()
    table = stored(df.observe(observation, *figures), name)
    return table, Row(**observation.get)


def measured(table: DataFrame) -> tuple[int, int]:
    """Bytes of a stored table once in memory, and the rows its groups hold (``_rows``)."""
    widths = [F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) + 16 for c in table.columns]
    size, rows = table.agg(F.sum(sum(widths, F.lit(0))), F.sum("_rows")).first()
    return size or 0, rows or 0


def with_group_values(
    df: DataFrame,
    group: str,
    table: DataFrame,
    measure: tuple[int, int] | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``df`` with the columns of its rows' groups, from a table with one row per group.

    ``table`` has ``_group``, ``_rows`` (how many rows the group has) and others;
    it is stored, or comes with the ``measure`` of a stored table of its size.
    Within ``broadcast_bytes`` it is broadcast. Of a larger one only the groups
    holding at least 1/10,000 of all rows are, and there cannot be more than
    10,000 of those. The other groups are small by the same bound, so an
    ordinary shuffle on the group spreads them evenly. Where even the hot groups
    are too wide (their values may be whole texts), all rows are shuffled, those of
    hot groups under a salt, and the groups' values as often as there are salts.
    """
    values = [name for name in table.columns if name != "_group"]
    size, rows = measure or measured(table)
    table = table.withColumnRenamed("_group", "_its_group")
    same = F.col(group).eqNullSafe(F.col("_its_group"))
    if size <= broadcast_bytes:
        joined = df.join(F.broadcast(table), same, "left")
        return joined.select(*df.columns, *values)
    is_hot = F.col("_rows") >= F.lit(rows / HOT_SHARES)
    hot = stored(table.where(is_hot), "hot-groups")
    if measured(hot)[0] <= max(broadcast_bytes, _LEAST_BROADCAST):
        joined = (
            df.join(F.broadcast(hot), same, "inner")
            .unionByName(df.join(F.broadcast(hot), same, "left_anti").join(table.where(~is_hot), same, "left"))
        )
        return joined.select(*df.columns, *values)
    return _with_salted_values(df, group, table, hot, rows / HOT_SHARES).select(*df.columns, *values)


#: Hot groups of no more bytes than this are broadcast whatever the bound is.
_LEAST_BROADCAST = 1 << 16


def _with_salted_values(
    df: DataFrame, group: str, table: DataFrame, hot: DataFrame, share: float
) -> DataFrame:
    """``df`` joined with ``table``, a hot group in as many parts as it has ``share`` rows.

    Only hashes of the hot groups are broadcast: 16 bytes for each of at most 10,000.
    A group that only has the hash of a hot one is salted like it on both sides. The
    salt is a hash of the row, so that a task that is run again gives the same ones.
    """
    parts = F.ceil(F.max("_rows") / share).cast("int").alias("_parts")
    salted = F.broadcast(stored(hot.groupBy(F.xxhash64("_its_group").alias("_print")).agg(parts), "hot-prints"))

    def with_parts(rows: DataFrame, key: str) -> DataFrame:
        marked = rows.withColumn("_of", F.xxhash64(F.col(key)))
        return marked.join(salted, F.col("_of") == F.col("_print"), "left").drop("_print")

    drawn = F.pmod(F.xxhash64(*[F.col(f"`{name}`") for name in df.columns]), F.coalesce("_parts", F.lit(1))).cast("int")
    rows = with_parts(df, group).withColumn("_salt", drawn)
    salts = F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1)
    replicas = with_parts(table, "_its_group").withColumn("_its_salt", F.explode(salts)).drop("_of", "_parts")
    same = F.col(group).eqNullSafe(F.col("_its_group")) & (F.col("_salt") == F.col("_its_salt"))
    return rows.join(replicas, same, "left")


def ranked(df: DataFrame, order: Sequence[Column], name: str) -> DataFrame:
    """``df`` plus BIGINT ``name``: its place, from 1, in the order given.

    The rows are sorted over all tasks and written with their place in their
    task; how many rows the tasks before have is one small row for each task.
    """
    placed = stored(df.orderBy(*order).withColumn("_place", F.monotonically_increasing_id()), "ranked")
    part, place = F.shiftright("_place", 33), F.col("_place").bitwiseAND((1 << 33) - 1)
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = counts.select("_part", F.expr("SUM(_n) OVER (ORDER BY _part) - _n").alias("_before"))
    joined = placed.join(F.broadcast(before), part == F.col("_part"))
    return joined.select(*df.columns, (F.col("_before") + place + 1).alias(name))
