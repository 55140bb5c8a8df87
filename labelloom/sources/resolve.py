"""Finding a source and checking its columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession


def path_exists(spark: SparkSession, path: str) -> bool:
    """Asks the path's own file system, so any store Spark reads will do."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return file_system.exists(hadoop_path)


def path_size(spark: SparkSession, path: str) -> int:
    """Bytes of a file or of all files in a folder."""
    hadoop_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    file_system = hadoop_path.getFileSystem(spark._jsc.hadoopConfiguration())
    return file_system.getContentSummary(hadoop_path).getLength()


def resolve_source(spark: SparkSession, candidates: Sequence[str]) -> str:
    """The first candidate that exists."""
    for path in candidates:
        if path_exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these exists: {', '.join(candidates)}")


def first_csv(names: Sequence[str]) -> str:
    """The first CSV among offered files."""
    for name in names:
        if name.endswith(".csv"):
            return name
    raise FileNotFoundError("no CSV file among: " + ", ".join(names))


def require_columns(
    df: DataFrame, columns: Sequence[str] = ("code", "label_encoded")
) -> DataFrame:
    """``df`` itself; raises if a column is missing. Runs no job."""
    missing = [name for name in columns if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; present columns {df.columns}")
    return df
