"""What the streams hold in their state, read back from the checkpoints."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from riskloom.operators.windows import window_columns
from riskloom.schemas import SLIDING, SlidingSpec

# The buffers of the window aggregation, in the order of its measures.
_BUFFERS = (
    "struct<n: bigint, n_amounts: bigint, total: decimal(38,18), none: boolean, lost: bigint, largest: double>"
)


def open_windows(spark: SparkSession, checkpoint: str, spec: SlidingSpec = SLIDING) -> DataFrame:
    """The windows that a stopped ``start_silver`` (exact sums) has not closed, as of its last batch.

    Together with the closed ones in the windowed layer these are all windows.
    """
    held = spark.read.format("statestore").load(checkpoint)
    rows = held.select(
        F.col("key.window.end").alias("end"), F.col("key.user_id").alias("user_id"), F.col("value").cast(_BUFFERS).alias("v")
    ).select("end", "user_id", "v.n", "v.n_amounts", F.when(~F.col("v.none"), F.col("v.total")).alias("total"), "v.lost", "v.largest")
    return rows.select(*window_columns(F.col("end"), spec))


def dropped_by_watermark(*queries: StreamingQuery) -> int:
    """Rows (of a window aggregation: a user's windows in a batch) that came behind the watermark.

    Of the batches whose progress the session still holds.
    """
    return sum(
        state["numRowsDroppedByWatermark"] for q in queries for p in q.recentProgress for state in p["stateOperators"])
