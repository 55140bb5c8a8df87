"""Writing results. Every sink writes a folder, one file per task."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with header that ``read_contracts`` reads back unchanged; blanks at cell edges are kept."""
    (
        df.write.mode(mode)
        .option("header", True)
        .option("quote", '"')
        .option("escape", '"')
        .option("ignoreLeadingWhiteSpace", False)
        .option("ignoreTrailingWhiteSpace", False)
        .csv(path)
    )


def land(df: DataFrame, path: str) -> DataFrame:
    """Write a table as Parquet and read it back, to be worked on instead of its CSV."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def land_with_figures(
    df: DataFrame, path: str, figures: Sequence[Column], drop: Sequence[str] = (), partition: Sequence[str] = ()
) -> tuple[DataFrame, Row]:
    """``land``, and aggregates over the rows that the write itself takes; columns in ``drop`` only serve those."""
    observation = Observation()
    rows = df.observe(observation, *figures).drop(*drop)
    rows.write.partitionBy(*partition).parquet(path)
    return df.sparkSession.read.schema(rows.schema).parquet(path), Row(**observation.get)


def export_split_text(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Only ``text``, as Parquet, one folder per part of a split table."""
    df.select("split", "text").write.mode(mode).partitionBy("split").parquet(path)


_CONFIG_TYPES = ((bool, T.BooleanType()), (int, T.LongType()), (float, T.DoubleType()))


def config_type(value: object) -> T.DataType:
    if isinstance(value, (list, tuple)):
        return T.ArrayType(T.StringType())
    for python_type, spark_type in _CONFIG_TYPES:
        if isinstance(value, python_type):
            return spark_type
    return T.StringType()


def config_table(spark: SparkSession, config: Mapping[str, object]) -> DataFrame:
    """One row, one column per setting. A setting without a value is a NULL string."""
    schema = T.StructType([T.StructField(name, config_type(value)) for name, value in config.items()])
    return spark.createDataFrame([tuple(config.values())], schema)


def with_config(figures: DataFrame, config: Mapping[str, object]) -> DataFrame:
    """A table of figures with the settings that led to them as leading columns."""
    settings = [
        (F.array(*map(F.lit, value)) if isinstance(value, (list, tuple)) else F.lit(value))
        .cast(config_type(value))
        .alias(name)
        for name, value in config.items()
    ]
    return figures.select(*settings, *figures.columns)


def write_config(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A one-row table as JSON; settings without a value are kept as null."""
    df.coalesce(1).write.mode(mode).option("ignoreNullFields", False).json(path)
