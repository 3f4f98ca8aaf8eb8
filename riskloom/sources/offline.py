"""Batch reads of the stored layers, with distinct errors."""

from __future__ import annotations

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from riskloom.operators.training import TrainingDataError
from riskloom.schemas import BRONZE, LABEL, WINDOWED


class MissingDataError(TrainingDataError):
    """The path does not exist."""


class UnreadableDataError(TrainingDataError):
    """The path exists but cannot be read as expected."""


class EmptyDataError(TrainingDataError):
    """The path was read and holds no row."""


# Without a format the JSON writer keeps milliseconds only.
BRONZE_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"

LABEL_TABLE = T.StructType(LABEL.fields + [T.StructField("label_time", T.TimestampType(), True)])


def _read(spark: SparkSession, path: str, load, required: bool) -> DataFrame:
    try:
        df = load()
        empty = required and df.isEmpty()
    except AnalysisException as exc:
        if exc.getCondition() == "PATH_NOT_FOUND":
            raise MissingDataError(f"offline data not found: {path}") from exc
        raise UnreadableDataError(f"could not read {path}: {exc}") from exc
    except PySparkException as exc:
        raise UnreadableDataError(f"could not read {path}: {exc}") from exc
    except Exception as exc:  # the JVM side reports bad files as plain Java errors
        raise UnreadableDataError(f"could not read {path}: {exc}") from exc
    if empty:
        raise EmptyDataError(f"no rows yet in {path}")
    return df


def read_bronze(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """All part files of the raw log; files without rows add nothing."""
    return _read(
        spark, path,
        lambda: spark.read.schema(BRONZE).option("pathGlobFilter", "part-*.json")
        .option("timestampFormat", BRONZE_TIME).json(path),
        required,
    )


def read_labels(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    return _read(spark, path, lambda: spark.read.schema(LABEL_TABLE).parquet(path), required)


def read_silver(spark: SparkSession, path: str, required: bool = True) -> DataFrame:
    """Closed windows. Files of a failed or replayed batch are not in the sink's
    log and are not read."""
    return _read(spark, path, lambda: spark.read.schema(WINDOWED).parquet(path), required)
