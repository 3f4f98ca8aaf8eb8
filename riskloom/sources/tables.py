"""Transactions, labels and their faulty variants derived from the ``events`` table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schemas import TRANSACTION
from riskloom.session import stream_partitions

EVENTS = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])

# The events span 30 days; dividing time by SPEED brings a user's events close
# enough for five-minute windows to hold several.
ORIGIN = 1704067200000000
SPEED = 360

CATEGORY_OF = {
    "click": "groceries", "view": "restaurants", "purchase": "electronics",
    "signup": "travel", "error": "gas_station",
}
ABROAD = ["NG", "RU", "CN", "BR", "IN"]
HOME_SHARE = 85


def read_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.schema(EVENTS).parquet(f"{sf_dir}/events.parquet")


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same table as a file stream."""
    reader = spark.readStream.schema(EVENTS).option("pathGlobFilter", "events.parquet")
    return reader.parquet(sf_dir)


# Events of one file of a batch.
ROWS_PER_FILE = 500_000


def write_batches(
    spark: SparkSession, sf_dir: str, folder: str, batches: int, late_seconds: int,
    again: int = 0, which: range | None = None,
) -> int:
    """Write the table as ``batches`` batches of files to ``folder``; how many files a batch has.

    Every tenth event arrives ``late_seconds`` of transaction time after its own
    time, so windows are touched again by later batches. With ``again`` every event
    whose number it divides is delivered once more, a batch later. ``which`` names the
    batches to write, for a stream that is to be stopped in between.
    """
    events = read_events(spark, sf_dir)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    late = F.when(F.col("event_id") % 10 == 0, late_seconds * 1_000_000 * SPEED).otherwise(0)
    span = events.agg(F.min(micros).alias("first"), F.max(micros).alias("last"), F.count("*").alias("n")).first()
    first = span["first"] or 0
    step = max(1, -(-((span["last"] or 0) - first + 1) // batches))
    place = F.least(F.floor((micros + late - F.lit(first)) / step), F.lit(batches - 1))
    files = max(1, -(-span["n"] // (batches * ROWS_PER_FILE)))
    for i in which or range(batches):
        rows = events.where(place == i)
        if again:
            rows = rows.unionByName(events.where((F.col("event_id") % again == 0) & (F.least(place + 1, F.lit(batches - 1)) == i)))
        # The file source goes by age, so batches are written one after the other.
        rows.repartition(files).write.mode("append").parquet(folder)
    return files


def batch_stream(spark: SparkSession, folder: str, files: int = 1) -> DataFrame:
    """What ``write_batches`` wrote, a batch of files to a micro-batch.

    A batch has few files; its rows are dealt out, so that all cores work on them.
    """
    rows = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files).parquet(folder)
    return rows.repartition(stream_partitions(spark))


def batched_events(spark: SparkSession, sf_dir: str, folder: str, batches: int, late_seconds: int) -> DataFrame:
    """The table as a stream of ``batches`` micro-batches, written to ``folder``."""
    return batch_stream(spark, folder, write_batches(spark, sf_dir, folder, batches, late_seconds))


def _uuid(number: Column) -> Column:
    # The digest stands there once; where a filter uses the id nothing merges copies of it.
    digest = F.md5(number.cast("string"))
    for place in (21, 17, 13, 9):
        digest = F.overlay(digest, F.lit("-"), F.lit(place), F.lit(0))
    return F.coalesce(digest, F.lit(""))


def _category(kind: Column) -> Column:
    chosen = F.lit(None).cast("string")
    for event_type, category in CATEGORY_OF.items():
        chosen = F.when(kind == event_type, category).otherwise(chosen)
    return chosen


def transactions(events: DataFrame) -> DataFrame:
    """One transaction per event, with ``event_id`` kept as the row's number."""
    # A projection of its own, so the JSON is read once per row.
    events = events.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    k = F.col("k")
    abroad = F.element_at(F.array(*[F.lit(c) for c in ABROAD]), (k - HOME_SHARE) % len(ABROAD) + 1)
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    return events.select(
        "event_id",
        _uuid(F.col("event_id")).alias("transaction_id"),
        F.concat(F.lit("user_"), F.lpad(F.col("user_id").cast("string"), 4, "0")).alias("user_id"),
        F.round(F.col("value") * 10, 2).alias("amount"),
        _category(F.col("event_type")).alias("merchant_category"),
        F.when(k < HOME_SHARE, "US").otherwise(abroad).alias("merchant_country"),
        F.concat(F.lit("shop "), k.cast("string")).alias("merchant_name"),
        F.lpad((F.col("event_id") % 10000).cast("string"), 4, "0").alias("card_last4"),
        F.timestamp_micros(
            F.lit(ORIGIN) + F.floor((micros - ORIGIN) / SPEED)
        ).alias("event_time"),
    )


def iso_text(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def with_time_text(txns: DataFrame) -> DataFrame:
    return txns.withColumn("timestamp", iso_text(F.col("event_time")))


def labels(txns: DataFrame) -> DataFrame:
    """Most transactions get a label, some a second, later and opposite one."""
    fraud = F.col("merchant_country").isin("NG", "RU", "CN") & (F.col("amount") > 300)
    wrong = F.col("event_id") % 50 == 0
    first = txns.where(F.col("event_id") % 7 != 0).select(
        "event_id", "transaction_id", "user_id",
        F.when(wrong, ~fraud).otherwise(fraud).alias("is_fraud"),
        (F.col("event_time") + F.expr("interval 30 seconds")).alias("label_time"),
    )
    revised = F.when(F.col("event_id") % 10 == 0, F.array(F.lit(0), F.lit(1))).otherwise(
        F.array(F.lit(0))
    )
    return (
        first.withColumn("_again", F.explode(revised))
        .withColumns({
            "is_fraud": F.when(F.col("_again") == 1, ~F.col("is_fraud")).otherwise(F.col("is_fraud")),
            "label_time": F.when(F.col("_again") == 1, F.col("label_time") + F.expr("interval 1 hour"))
            .otherwise(F.col("label_time")),
        })
        .drop("_again", "event_id")
    )


def dirty_transactions(txns: DataFrame) -> DataFrame:
    """The transactions with faults of every kind the rules know, as typed text rows."""
    n = F.col("event_id")

    def every(step: int) -> Column:
        return n % step == 0

    faulty = with_time_text(txns)
    return faulty.withColumns({
        "user_id": F.when(every(71), F.lit(None)).when(every(97), "bad").otherwise(F.col("user_id")),
        "amount": F.when(every(89), F.lit(None)).when(every(83), -F.col("amount"))
        .otherwise(F.col("amount")),
        "merchant_country": F.when(every(79), "XX").otherwise(F.col("merchant_country")),
        "timestamp": F.when(every(73), "garbage").otherwise(F.col("timestamp")),
    }).withColumn("event_time", F.try_to_timestamp("timestamp"))


def messages(txns: DataFrame) -> DataFrame:
    """JSON message bytes of the transactions; some are cut off in the middle."""
    text = F.to_json(F.struct(*TRANSACTION.names))
    broken = F.col("event_id") % 61 == 0
    return with_time_text(txns).select(
        "event_id",
        F.when(broken, F.concat(F.lit("{bad "), F.col("transaction_id"))).otherwise(text)
        .cast("binary").alias("value"),
    )


def requests(txns: DataFrame) -> DataFrame:
    """Scoring requests with stray blanks, empty fields and amounts out of range."""
    n = F.col("event_id")
    return txns.select(
        "event_id",
        F.when(n % 41 == 0, "   ").otherwise(F.concat(F.lit("  "), "user_id", F.lit(" ")))
        .alias("user_id"),
        F.when(n % 43 == 0, F.col("amount") * 1000).when(n % 47 == 0, -F.col("amount"))
        .when(n % 53 == 0, F.lit(float("nan"))).otherwise(F.col("amount")).alias("amount"),
        F.when(n % 59 == 0, "").otherwise(F.col("merchant_category")).alias("merchant_category"),
        F.concat("merchant_country", F.lit(" ")).alias("merchant_country"),
    )
