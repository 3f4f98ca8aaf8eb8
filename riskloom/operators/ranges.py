"""Rows of a key laid out in time over as many tasks as they need."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from riskloom.session import shared_dir


def in_ranges(rows: DataFrame, key: str, time: str, *ties: str | Column) -> DataFrame:
    """Add ``_range``: numbers of about equal parts of the rows in order of key and time.

    A key with few rows lies in one range; a busy key, even a busy minute of
    one, is cut at instants (and, with ``ties``, inside an instant). The limits
    come from a sample, so a second evaluation would cut elsewhere: the rows are
    checkpointed, and whatever is derived from them sees the same ranges.
    """
    shared_dir(rows.sparkSession)
    return rows.repartitionByRange(key, time, *ties).withColumn(
        "_range", F.spark_partition_id()
    ).checkpoint()


def earlier_ranges(key: str) -> WindowSpec:
    """The window over a key's ranges before the current one."""
    return Window.partitionBy(key).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)


def with_start(ranged: DataFrame, starts: DataFrame, key: str) -> DataFrame:
    """Attach what earlier ranges hand over; null is a key like any other.

    Only a key cut by a limit has something to hand over, so ``starts`` holds at
    most one row per range.
    """
    renamed = starts.withColumnsRenamed({key: "_start_key", "_range": "_start_range"})
    same = (F.col("_range") == F.col("_start_range")) & F.col(key).eqNullSafe(F.col("_start_key"))
    return ranged.join(renamed, same, "left").drop("_start_key", "_start_range")
