"""Materialisation of closed windows into an online table, run by run.

A run takes the windows that ended since the last committed run. Its rows are written
first, then a mark that says up to which end they reach. A run that dies in between
leaves rows without a mark: readers don't see them, and the next run writes its own in
their place. So every window is taken once, by whichever run commits it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.online import materialize
from riskloom.schemas import USER_FEATURES_TTL
from riskloom.streaming.online import USER_ROWS, OnlineTable


@dataclass(frozen=True)
class MaterializedTable(OnlineTable):
    """The newest closed window of each user, as of the last committed run."""

    def stored(self, spark: SparkSession) -> DataFrame:
        run = self.last_run(spark)
        return super().stored(spark).where(F.col("batch_id") <= (-1 if run is None else run))

    def last_run(self, spark: SparkSession) -> int | None:
        return max(self._batches(spark, "marks"), default=None)

    def mark(self, spark: SparkSession):
        """The end up to which windows have been taken, null before the first run."""
        run = self.last_run(spark)
        if run is None:
            return None
        return spark.read.schema("upto timestamp").parquet(f"{self.path}/marks/batch_id={run}").first()["upto"]

    def advance(self, windows: DataFrame, upto: Column | None = None) -> int:
        """Take the windows that ended after the mark, up to ``upto`` (default: all); the run's number.

        ``windows`` are closed ones. An ``upto`` that is not after the mark takes nothing
        and leaves the mark where it is.
        """
        spark = windows.sparkSession
        run, since = self.last_run(spark), self.mark(spark)
        if upto is None:
            upto = windows.agg(F.max("window_end")).scalar()
        # Written out once: both the rows and the mark go by the same end.
        end = spark.range(1).select(upto.alias("upto")).first()["upto"]
        if end is None or (since is not None and end <= since):
            return -1 if run is None else run
        run = 0 if run is None else run + 1
        start = F.lit(since) if since is not None else F.lit("0001-01-01").cast("timestamp")
        self.write_rows(windows, run, start, F.lit(end))
        self.commit(spark, run, F.lit(end))
        return run

    def write_rows(self, windows: DataFrame, run: int, start: Column, end: Column) -> None:
        rows = materialize(windows, start, end)
        self.write_batch(rows.drop("expires_at", "updated_at"), run, F.col("window_end"))

    def commit(self, spark: SparkSession, run: int, upto: Column) -> None:
        spark.range(1).select(upto.alias("upto")).write.mode("overwrite").parquet(f"{self.path}/marks/batch_id={run}")

    def compact(self, spark: SparkSession, batch_id: int, as_of: Column | None = None) -> None:
        """Merge committed runs into a base; nothing expires here, what expired is for readers to say."""
        super().compact(spark, min(batch_id, self.last_run(spark) or 0), F.lit("0001-01-01").cast("timestamp") if as_of is None else as_of)


def materialized_table(path: str) -> MaterializedTable:
    return MaterializedTable(path, USER_ROWS, USER_FEATURES_TTL, ("user_id",))
