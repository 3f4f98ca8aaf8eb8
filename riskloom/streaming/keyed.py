"""Online user features out of keyed state: one row a user and batch, redeliveries counted once.

A stream of transactions is dealt by user and, so that a busy user is not one task's
work, by a hash of the transaction id into ``splits`` parts of each user. Every part
keeps in its state

* the slide intervals (panes) the trailing window can still need, aggregated,
* the ids met in intervals the watermark has not passed, and
* a timer for the instant at which the watermark makes both useless.

A batch gives one row for each part it touched, with all the part's panes. The online
table keeps the newest row of a part, and reading adds up the parts of a user, so what a
lookup reads does not grow with the windows a batch touched.

An id that comes again within the watermark counts once, in whichever batch; later
than that the event itself is late and left out, as in any watermarked aggregation.
Rows without event time belong to no pane. A null user or id is one like any other.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.online import newest_per_key, with_expiry
from riskloom.operators.validation import valid_rows
from riskloom.operators.windows import merged_panes, trailing_of_panes, watermarked
from riskloom.schemas import SLIDING, USER_FEATURES_TTL, SlidingSpec
from riskloom.streaming import panes
from riskloom.streaming.online import OnlineTable

# The process that prepares the state on the driver gets no archive of the package.
cloudpickle.register_pickle_by_value(panes)

SPLITS = 8

PANE = T.StructType([
    T.StructField("pane", T.LongType()),
    T.StructField("n", T.LongType()),
    T.StructField("n_amounts", T.LongType()),
    T.StructField("total", T.DecimalType(38, 18)),
    T.StructField("lost", T.LongType()),
    T.StructField("largest", T.DoubleType()),
])
KEYED_ROWS = T.StructType([
    T.StructField("user_id", T.StringType()),
    T.StructField("split", T.IntegerType()),
    T.StructField("panes", T.ArrayType(PANE)),
    T.StructField("updated_at", T.TimestampType()),
])
# Panes leave the state as JSON, which costs a part one text instead of a row for each pane.
EMITTED = "user_id string, split int, panes string"


def user_panes(transactions: DataFrame, spec: SlidingSpec = SLIDING, splits: int = SPLITS) -> DataFrame:
    """One row for each part of a user that a batch touched, with its panes."""
    rows = watermarked(transactions, spec).where(F.col("event_time").isNotNull()).select(
        "user_id",
        F.pmod(F.xxhash64("transaction_id"), F.lit(splits)).cast("int").alias("split"),
        F.floor(F.unix_seconds("event_time") / spec.slide).alias("pane"),
        "transaction_id",
        "amount",
        F.col("amount").try_cast("decimal(38,18)").alias("exact"),
        "event_time",
    )
    processor = panes.TrailingPanes(spec.slide, spec.panes)
    given = rows.groupBy("user_id", "split").transformWithState(processor, EMITTED, "Update", "EventTime")
    return given.withColumn("panes", F.from_json("panes", T.ArrayType(PANE)))


def trailing_of_parts(parts: DataFrame, spec: SlidingSpec = SLIDING) -> DataFrame:
    """The trailing window of each user out of the newest row of each of its parts."""
    exploded = parts.select("user_id", "updated_at", F.explode("panes").alias("p")).select("user_id", "p.*", "updated_at")
    return trailing_of_panes(merged_panes(exploded, ["updated_at"]), spec, ["updated_at"])


@dataclass(frozen=True)
class KeyedFeatureTable(OnlineTable):
    """The newest row of every part; reading adds up the parts of a user."""

    spec: SlidingSpec = SLIDING

    def merged(self, spark: SparkSession, keys: DataFrame | str | None = None) -> DataFrame:
        parts = newest_per_key(self._of(spark, keys), ["user_id", "split"]).drop("batch_id")
        rows = trailing_of_parts(parts, self.spec)
        return with_expiry(valid_rows(rows, "user_features"), self.ttl)

    def _still_needed(self, rows: DataFrame, as_of: Column) -> DataFrame:
        # As for windows: by event time, or because a reader still sees the row.
        kept = newest_per_key(rows, ["user_id", "split"])
        newest = F.array_max(F.transform("panes", lambda p: p["pane"]))
        last = rows.agg(F.max(newest)).scalar()
        reach = -(-(self.spec.size + self.spec.watermark) // self.spec.slide) + 1
        fresh = F.col("updated_at") + F.expr(f"interval {self.ttl} seconds") > as_of
        return kept.where((newest > last - reach) | fresh)


def keyed_feature_table(path: str, spec: SlidingSpec = SLIDING) -> KeyedFeatureTable:
    return KeyedFeatureTable(path, KEYED_ROWS, USER_FEATURES_TTL, ("user_id",), spec=spec)
