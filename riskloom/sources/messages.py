"""Message sources and the way from bytes to typed columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.schemas import LABEL, TRANSACTION

TRANSACTION_TOPIC = "raw_transactions"
LABEL_TOPIC = "fraud_labels"


def kafka_messages(
    spark: SparkSession, topic: str, servers: str, starting: str = "latest", **options: str
) -> DataFrame:
    """A topic as a stream with the binary column ``value``.

    Needs the Kafka connector package on the session. ``starting`` counts only
    on the first run; afterwards the checkpoint does.
    """
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting)
    )
    return reader.options(**options).load()


def file_messages(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """Files of one message per line as a stream with the column ``value``."""
    reader = spark.readStream.format("text")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(path)


def parse(messages: DataFrame, schema: T.StructType, text_time: str, time: str) -> DataFrame:
    """JSON messages to the schema's columns, the parsed time and the raw text.

    Malformed text gives a row of nulls with ``corrupt`` true; a time that
    cannot be read gives null instead of an error.
    """
    keep = [c for c in messages.columns if c != "value"]
    body = F.from_json(
        F.col("raw"),
        T.StructType(schema.fields + [T.StructField("_corrupt", T.StringType(), True)]),
        {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"},
    )
    return (
        messages.withColumn("raw", F.col("value").cast("string"))
        .withColumn("_body", body)
        .select(
            *keep,
            *[F.col(f"_body.{c}").alias(c) for c in schema.names],
            "raw",
            F.col("_body._corrupt").isNotNull().alias("corrupt"),
        )
        .withColumn(time, F.try_to_timestamp(text_time))
    )


def parse_transactions(messages: DataFrame) -> DataFrame:
    return parse(messages, TRANSACTION, "timestamp", "event_time")


def parse_labels(messages: DataFrame) -> DataFrame:
    return parse(messages, LABEL, "label_timestamp", "label_time")
