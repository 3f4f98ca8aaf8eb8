"""Quarantine of invalid rows with their errors."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from riskloom.schemas import QUARANTINE
from riskloom.session import read_file, write_file

logger = logging.getLogger(__name__)


class QuarantineCounter:
    """Invalid rows by kind as they are met, and those that could not be written anywhere.

    Holds totals and the last batch, which a replay replaces, so it stays small however
    long a stream runs. With ``path`` a kind's numbers are stored after each batch that had
    any, and a counter of the same path goes on from there after a restart. A kind belongs
    to one stream.
    """

    def __init__(self, path: str | None = None) -> None:
        self.path = path
        self._kinds: dict[str, dict] = {}

    def add(self, kind: str, batch_id: int | None, n: int, written: bool, spark: SparkSession | None = None) -> None:
        own = self._own(kind, spark)
        if batch_id is None or batch_id != own["batch_id"]:
            for name in ("met", "lost"):
                own[name] += own["last_" + name]
            own |= {"batch_id": batch_id, "last_met": 0, "last_lost": 0}
        changed = (n, 0 if written else n) != (own["last_met"], own["last_lost"])
        own |= {"last_met": n, "last_lost": 0 if written else n}
        if self.path and spark is not None and changed:
            write_file(spark, self._file(kind), json.dumps(own).encode())

    def met(self, kind: str, spark: SparkSession | None = None) -> int:
        own = self._own(kind, spark)
        return own["met"] + own["last_met"]

    def lost(self, kind: str, spark: SparkSession | None = None) -> int:
        own = self._own(kind, spark)
        return own["lost"] + own["last_lost"]

    def _file(self, kind: str) -> str:
        return f"{self.path}/{kind}.json"

    def _own(self, kind: str, spark: SparkSession | None) -> dict:
        if kind not in self._kinds:
            held = read_file(spark, self._file(kind)) if self.path and spark is not None else None
            empty = {"met": 0, "lost": 0, "batch_id": None, "last_met": 0, "last_lost": 0}
            if held is None and self.path and spark is None:
                return empty
            self._kinds[kind] = json.loads(held) if held else empty
        return self._kinds[kind]


def quarantine_records(invalid: DataFrame, kind: str, batch_id: int | None = None) -> DataFrame:
    """Invalid rows as quarantine records: the whole row as JSON, nulls included."""
    fields = [c for c in invalid.columns if c != "errors"]
    return invalid.select(
        F.lit(kind).alias("kind"),
        F.lit(batch_id).cast("bigint").alias("batch_id"),
        "errors",
        F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("record"),
        F.current_timestamp().alias("quarantined_at"),
    )


def write_quarantine(
    invalid: DataFrame,
    path: str,
    kind: str,
    batch_id: int | None = None,
    fallback: str | None = None,
    counter: QuarantineCounter | None = None,
) -> bool:
    """Write a batch of invalid rows below ``path``, else below ``fallback``.

    A numbered batch has its own folder and replaces it when replayed. Failing to
    quarantine is logged, with each record where it lies, and reported as False; it never
    raises. ``counter`` counts the rows whether or not they could be written; the job that
    writes them does the counting.
    """
    spark = invalid.sparkSession
    n = _written(invalid, path, kind, batch_id, fallback)
    written = n is not None
    try:
        if not written:
            n = invalid.count()
            quarantine_records(invalid, kind, batch_id).foreachPartition(_log_lost)
        if counter is not None:
            counter.add(kind, batch_id, n, written, spark)
    except Exception as exc:
        logger.warning("counting of %s batch %s failed: %s", kind, batch_id, exc)
    return written


def _log_lost(records) -> None:
    for r in records:
        logger.error("lost record of kind %s, errors %s: %s", r["kind"], r["errors"], r["record"])


def _written(invalid, path, kind, batch_id, fallback) -> int | None:
    """How many rows the place that took them was given, None if no place took them."""
    for root in filter(None, (path, fallback)):
        observed = Observation()
        try:
            records = quarantine_records(invalid, kind, batch_id).observe(observed, F.count(F.lit(1)).alias("n"))
            if batch_id is None:
                records.write.mode("append").partitionBy("kind", "batch_id").json(root)
            else:
                # Dynamic overwrite replaces this kind's batch and nothing else.
                (
                    records.write.mode("overwrite")
                    .option("partitionOverwriteMode", "dynamic")
                    .partitionBy("kind", "batch_id").json(root)
                )
            return observed.get["n"]
        except Exception as exc:
            logger.warning("quarantine of %s batch %s to %s failed: %s", kind, batch_id, root, exc)
    return None


def read_quarantine(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(QUARANTINE).json(path)


def quarantine_counts(records: DataFrame) -> DataFrame:
    return records.groupBy("kind").agg(F.count(F.lit(1)).alias("n"))
