"""Events of a key in the trailing minute, compared with a limit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from riskloom.operators.joins import many_to_one
from riskloom.operators.ranges import earlier_ranges, in_ranges, with_start
from riskloom.schemas import REQUESTS_PER_MINUTE


def trailing_counts(
    events: DataFrame, key: str = "user_id", time: str = "event_time", seconds: int = 60
) -> DataFrame:
    """Per key and instant, the events in ``(t - seconds, t]``.

    Events of one instant are counted first. An instant adds its events when it
    comes and takes them back ``seconds`` later, so the count at any time is a
    running sum; a sliding frame would be added up anew for every row. The sum
    is built inside ranges of about equal size and starts with what the ranges
    before add up to, so a key that is busy even within a minute is spread.
    """
    at, n = F.col("_at"), F.col("n_events")

    def change(when, by, comes):
        return F.struct(when.alias("at"), by.alias("by"), F.lit(comes).alias("comes"))

    changes = F.array(change(at, n, True), change(at + seconds * 1_000_000, -n, False))
    ranged = in_ranges(
        events.where(F.col(time).isNotNull())
        .groupBy(key, time)
        .agg(F.count(F.lit(1)).alias("n_events"))
        .withColumn("_at", F.unix_micros(time))
        .select(key, time, "n_events", F.inline(changes)),
        key, "at",
    )
    totals = ranged.groupBy(key, "_range").agg(F.sum("by").alias("_total"))
    starts = totals.select(
        key, "_range", F.sum("_total").over(earlier_ranges(key)).alias("_before")
    ).where(F.col("_before") != 0)
    running = (
        Window.partitionBy("_range", key).orderBy("at")
        .rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    summed = ranged.withColumn("_sum", F.sum("by").over(running)).where("comes")
    return with_start(summed, starts, key).select(
        key, time, "n_events", (F.col("_sum") + F.coalesce("_before", F.lit(0))).alias("n_trailing")
    )


def flag_over_limit(
    events: DataFrame,
    key: str = "user_id",
    time: str = "event_time",
    limit: int = REQUESTS_PER_MINUTE,
    seconds: int = 60,
) -> DataFrame:
    """Every event with its trailing count and whether that exceeds the limit.

    Events without a key count together as one key, as in SQL. An event without a
    time has no trailing minute: its count is 0 and it exceeds nothing.
    """
    counts = trailing_counts(events, key, time, seconds).drop("n_events")
    counted = many_to_one(events, counts, [key, time], null_safe=True)
    return counted.withColumn("n_trailing", F.coalesce("n_trailing", F.lit(0))).withColumn(
        "over_limit", F.col("n_trailing") > limit
    )
