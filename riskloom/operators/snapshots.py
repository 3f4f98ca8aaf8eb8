"""The as-of join period by period: new entity rows meet new feature rows and one snapshot.

A snapshot holds, for every key, the last feature row before a period's end. What an
entity row of the next period needs is either a feature row of that period or the
snapshot's, so a run reads one period of both tables and one snapshot however long the
history is, and the runs together give what one join over everything gives.

Periods are run in order; a run again replaces what it wrote. Feature rows that come
after their period was run are not seen by it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.asof import pit_join
from riskloom.operators.windows import newest
from riskloom.schemas import USER_VIEW, FeatureView
from riskloom.session import read_file


@dataclass(frozen=True)
class PeriodicJoin:
    """Joined rows and snapshots below ``path``; periods are numbered from the epoch."""

    path: str
    view: FeatureView = USER_VIEW
    time: str = "event_timestamp"
    seconds: int = 86_400

    def run(self, entities: DataFrame, features: DataFrame, number: int) -> None:
        """Join the entity rows of a period, then store the snapshot at its end.

        Rows without a time belong to no period. A column ``event_date`` on either side
        prunes the dates that the period doesn't touch.
        """
        spark, view = entities.sparkSession, self.view
        known = features.select(view.entity, view.timestamp, *view.fields, *(["event_date"] if "event_date" in features.columns else []))
        new = self._inside(known, view.timestamp, number).drop("event_date").where(F.col(view.entity).isNotNull())
        seen = new
        if read_file(spark, f"{self.path}/snapshots/period={number - 1}/_SUCCESS") is not None:
            seen = new.unionByName(spark.read.schema(new.schema).parquet(f"{self.path}/snapshots/period={number - 1}"))
        joined = pit_join(self._inside(entities, self.time, number), seen, view, self.time, keep_timestamp=True)
        joined.write.mode("overwrite").parquet(f"{self.path}/joined/period={number}")
        newest(seen, [view.entity], view.timestamp).select(*new.columns).write.mode("overwrite").parquet(
            f"{self.path}/snapshots/period={number}")

    def joined(self, spark: SparkSession) -> DataFrame:
        return spark.read.parquet(f"{self.path}/joined")

    def number(self, time: Column) -> Column:
        return F.floor(F.unix_seconds(time) / self.seconds)

    def _inside(self, rows: DataFrame, time: str, number: int) -> DataFrame:
        start, end = (F.timestamp_seconds(F.lit(n * self.seconds)) for n in (number, number + 1))
        inside = rows.where((F.col(time) >= start) & (F.col(time) < end))
        if "event_date" in rows.columns:
            last = F.timestamp_seconds(F.lit((number + 1) * self.seconds - 1))
            inside = inside.where((F.col("event_date") >= F.to_date(start)) & (F.col("event_date") <= F.to_date(last)))
        return inside
