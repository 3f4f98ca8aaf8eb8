"""Closed dates of a stored layer, rewritten into few large files.

The streams write a file per task and micro-batch. A daily job rewrites dates that
get no more rows; readers take those from the rewritten table and the rest from
the layer.
"""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _closed(date: str | Column, before: datetime.date) -> Column:
    """Rows without a date are never closed."""
    return F.coalesce((F.col(date) if isinstance(date, str) else date) < F.lit(before), F.lit(False))


def compact_dates(
    layer: DataFrame, target: str, before: datetime.date,
    since: datetime.date | None = None, date: str | Column = "event_date",
) -> None:
    """Write the layer's rows of ``[since, before)`` to ``target``, by ``event_date``.

    AQE merges small parts of a date and splits large ones, so files come out near
    ``spark.sql.adaptive.advisoryPartitionSizeInBytes``. A date that is there
    already is replaced, so a run that was cut short is simply repeated.
    """
    day = F.col(date) if isinstance(date, str) else date
    rows = layer.where(_closed(date, before)).withColumn("event_date", day)
    if since is not None:
        rows = rows.where(F.col("event_date") >= F.lit(since))
    (
        rows.hint("rebalance", "event_date")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        .partitionBy("event_date").parquet(target)
    )


def read_compacted(
    layer: DataFrame, target: str, before: datetime.date, date: str | Column = "event_date"
) -> DataFrame:
    """The layer's rows, those dated before ``before`` from the rewritten table."""
    schema = layer.schema
    if "event_date" not in schema.names:
        schema = T.StructType([*schema.fields, T.StructField("event_date", T.DateType())])
    rewritten = layer.sparkSession.read.schema(schema).parquet(target).where(_closed("event_date", before))
    return rewritten.select(*layer.columns).unionByName(layer.where(~_closed(date, before)))
