"""The streaming queries that fill the raw, windowed, online and label layers."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQuery

from riskloom.functions.flags import flag_rows
from riskloom.operators.scoring import score
from riskloom.operators.validation import clean_requests, invalid_rows, is_valid, valid_rows
from riskloom.operators.windows import select_trailing_window, watermarked, windowed_features
from riskloom.schemas import BRONZE, SLIDING, SlidingSpec
from riskloom.session import shuffled_into
from riskloom.sources.offline import BRONZE_TIME
from riskloom.streaming.keyed import SPLITS, keyed_feature_table, trailing_of_parts, user_panes
from riskloom.streaming.online import OnlineTable, flag_table, user_feature_table
from riskloom.streaming.quarantine import QuarantineCounter, write_quarantine

logger = logging.getLogger(__name__)

# Seconds between micro-batches.
TRIGGERS = {"bronze": 30, "user_features": 30, "flags": 10, "silver": 30, "labels": 30,
            "rejected": 30, "scores": 10, "keyed_features": 30}


@dataclass(frozen=True)
class Layers:
    """Where the layers live. All paths must be reachable by every executor."""

    root: str
    checkpoints: str
    quarantine_fallback: str | None = None
    spec: SlidingSpec = SLIDING
    triggers: dict[str, int] = field(default_factory=lambda: dict(TRIGGERS), hash=False)
    # Write out what is there and stop, instead of running on.
    once: bool = False
    # Merge the online batches into a base every so many batches; 0 means never.
    compact_every: int = 100
    # Partitions of the state and of the work on a batch; None means what the session shuffles into.
    partitions: int | None = None
    # Invalid rows met by these streams, also where the quarantine can't be written.
    rejected: QuarantineCounter = field(default_factory=QuarantineCounter, hash=False, compare=False)

    @property
    def bronze(self) -> str:
        return f"{self.root}/bronze/raw_transactions"

    @property
    def silver(self) -> str:
        return f"{self.root}/windowed_features"

    @property
    def labels(self) -> str:
        return f"{self.root}/labels"

    @property
    def quarantine(self) -> str:
        return f"{self.root}/quarantine/invalid_records"

    @property
    def scores(self) -> str:
        return f"{self.root}/scores"

    @property
    def online(self) -> str:
        return f"{self.root}/online"

    def _start(self, spark: SparkSession, writer: DataStreamWriter, name: str) -> StreamingQuery:
        writer = writer.option("checkpointLocation", f"{self.checkpoints}/{name}").queryName(name)
        if self.once:
            writer = writer.trigger(availableNow=True)
        else:
            writer = writer.trigger(processingTime=f"{self.triggers[name]} seconds")
        # A query keeps the settings it was started with.
        with shuffled_into(spark, self.partitions):
            return writer.start()

    # Raw log ----------------------------------------------------------------

    def start_bronze(self, transactions: DataFrame) -> StreamingQuery:
        """Every parsed message as JSON, valid or not, by event date.

        ``raw`` and ``corrupt`` are written too when the frame has them, so no
        malformed message is lost. Rows without event time get the null date.
        """
        extra = [c for c in ("raw", "corrupt") if c in transactions.columns]
        rows = transactions.select(*BRONZE.names, *extra).withColumn(
            "event_date", F.to_date("event_time")
        )
        return self._start(
            transactions.sparkSession, rows.writeStream.outputMode("append").format("json")
            .option("timestampFormat", BRONZE_TIME).partitionBy("event_date").option("path", self.bronze),
            "bronze",
        )

    # Windowed features --------------------------------------------------------

    def start_silver(
        self, transactions: DataFrame, cents: bool = True, deduplicate: bool = False
    ) -> StreamingQuery:
        """Each window once, after the watermark has passed its end."""
        if deduplicate:
            transactions = watermarked(transactions, self.spec).dropDuplicatesWithinWatermark(
                ["transaction_id"]
            )
        rows = windowed_features(
            transactions, self.spec, cents, has_watermark=deduplicate
        ).withColumn("event_date", F.to_date("window_end"))
        return self._start(
            transactions.sparkSession, rows.writeStream.outputMode("append").format("parquet")
            .partitionBy("event_date").option("path", self.silver),
            "silver",
        )

    def start_user_features(self, transactions: DataFrame, cents: bool = True) -> StreamingQuery:
        """Every window a batch touched goes to the online table, valid or not.

        Which of them is served is chosen on reading, and only then validated: an
        invalid trailing window is not replaced by an older one.
        """
        table = user_feature_table(f"{self.online}/user_features", self.spec)

        def write(batch: DataFrame, batch_id: int) -> None:
            def store(rows):
                table.write_batch(rows, batch_id)
                chosen = select_trailing_window(rows, self.spec)
                self._quarantine(invalid_rows(chosen, "user_features"), "user_features", batch_id)
                self._maintain(table, rows.sparkSession, batch_id)

            _with_batch(batch, store)

        return self._start(
            transactions.sparkSession,
            windowed_features(transactions, self.spec, cents)
            .writeStream.outputMode("update").foreachBatch(write),
            "user_features",
        )

    def start_keyed_features(self, transactions: DataFrame, splits: int = SPLITS) -> StreamingQuery:
        """As ``start_user_features``, but out of keyed state: a row for each part of a
        user that a batch touched, and events delivered again count once."""
        table = keyed_feature_table(f"{self.online}/keyed_features", self.spec)

        def write(batch: DataFrame, batch_id: int) -> None:
            def store(rows):
                table.write_batch(rows, batch_id)
                chosen = trailing_of_parts(rows.withColumn("updated_at", F.current_timestamp()), self.spec)
                self._quarantine(invalid_rows(chosen, "user_features"), "user_features", batch_id)
                self._maintain(table, rows.sparkSession, batch_id)

            _with_batch(batch, store)

        return self._start(
            transactions.sparkSession,
            user_panes(transactions, self.spec, splits).writeStream.outputMode("update").foreachBatch(write),
            "keyed_features",
        )

    # Transaction flags ----------------------------------------------------------

    def start_flags(self, transactions: DataFrame) -> StreamingQuery:
        table = flag_table(f"{self.online}/transaction_flags")

        def write(batch: DataFrame, batch_id: int) -> None:
            def store(rows):
                table.write_batch(valid_rows(rows, "transaction_flags"), batch_id)
                self._quarantine(
                    invalid_rows(rows, "transaction_flags"), "transaction_flags", batch_id
                )
                self._maintain(table, rows.sparkSession, batch_id)

            _with_batch(batch, store)

        return self._start(
            transactions.sparkSession,
            flag_rows(transactions).writeStream.outputMode("append").foreachBatch(write), "flags"
        )

    # Scores -----------------------------------------------------------------------

    def start_scores(
        self,
        requests: DataFrame,
        online: Callable[[DataFrame], DataFrame],
        probability: Callable[[DataFrame], DataFrame],
    ) -> StreamingQuery:
        """Score a stream of requests against the online table as it is at each batch.

        ``online`` is asked in every batch for the live rows of the users in it (a
        frame with ``user_id``). Requests that break
        a rule go to the quarantine. A replayed batch replaces its scores.
        """

        def write(batch: DataFrame, batch_id: int) -> None:
            def store(rows):
                checked = clean_requests(rows)
                users = checked.where(is_valid()).select("user_id").distinct()
                scored = score(checked.where(is_valid()).drop("errors"), online(users), probability)
                scored.write.mode("overwrite").parquet(f"{self.scores}/batch_id={batch_id}")
                self._quarantine(checked.where(~is_valid()), "request", batch_id)

            _with_batch(batch, store)

        return self._start(requests.sparkSession, requests.writeStream.outputMode("append").foreachBatch(write), "scores")

    # Labels -----------------------------------------------------------------------

    def start_labels(self, labels: DataFrame) -> StreamingQuery:
        rows = labels.select("transaction_id", "user_id", "is_fraud", "label_timestamp", "label_time")
        return self._start(
            labels.sparkSession,
            rows.writeStream.outputMode("append").format("parquet").option("path", self.labels),
            "labels",
        )

    # Rejected messages --------------------------------------------------------------

    def start_rejected(self, transactions: DataFrame) -> StreamingQuery:
        """Transactions that break a rule, with their errors."""

        def write(batch: DataFrame, batch_id: int) -> None:
            _with_batch(batch, lambda rows: self._quarantine(rows, "transaction", batch_id))

        bad = invalid_rows(transactions, "transaction")
        return self._start(transactions.sparkSession, bad.writeStream.outputMode("append").foreachBatch(write), "rejected")

    def _maintain(self, table: OnlineTable, spark: SparkSession, batch_id: int) -> None:
        if self.compact_every and batch_id and batch_id % self.compact_every == 0:
            table.compact(spark, batch_id)
            table.vacuum(spark)

    def _quarantine(self, invalid: DataFrame, kind: str, batch_id: int) -> None:
        write_quarantine(
            invalid, self.quarantine, kind, batch_id, self.quarantine_fallback, self.rejected)

    def start_all(
        self,
        transactions: DataFrame,
        labels: DataFrame,
        validate: bool = True,
        deduplicate: bool = False,
    ) -> dict[str, StreamingQuery]:
        """Start the five queries; with ``validate`` also one for rejected messages.

        The raw log takes every message. With ``validate`` windows and flags see
        valid transactions only, so one malformed message stops nothing. With
        ``deduplicate`` repeated deliveries inside the watermark count once in the
        closed windows (update mode allows no second stateful step).
        """
        clean = valid_rows(transactions, "transaction") if validate else transactions
        queries = {
            "bronze": self.start_bronze(transactions),
            "user_features": self.start_user_features(clean),
            "flags": self.start_flags(clean),
            "silver": self.start_silver(clean, deduplicate=deduplicate),
            "labels": self.start_labels(labels),
        }
        if validate:
            queries["rejected"] = self.start_rejected(transactions)
        return queries


def _with_batch(batch: DataFrame, store: Callable[[DataFrame], None]) -> None:
    """Run ``store`` on a batch that is computed once; an empty batch is skipped."""
    batch.persist()
    try:
        if not batch.isEmpty():
            store(batch)
    finally:
        batch.unpersist()


def wait_for_any(spark: SparkSession, queries: dict[str, StreamingQuery], timeout: float = float("inf")) -> None:
    """Block until one of the queries ends, stop the others, and raise what ended it."""
    deadline = time.monotonic() + timeout
    try:
        while all(q.isActive for q in queries.values()) and time.monotonic() < deadline:
            # Other queries of the session may have ended before; forget those.
            spark.streams.resetTerminated()
            spark.streams.awaitAnyTermination(1)
    finally:
        for query in queries.values():
            if query.isActive:
                query.stop()
    for query in queries.values():
        if query.exception() is not None:
            raise query.exception()


def wait_for_all(queries: dict[str, StreamingQuery], timeout: int | None = None) -> None:
    """Wait for queries started with ``once``; with ``timeout`` raise when one does not finish in so many seconds."""
    for name, query in queries.items():
        # Without a timeout there is no answer: it returns at the end or raises.
        if query.awaitTermination(timeout) is False:
            query.stop()
            raise TimeoutError(f"streaming query {name} did not finish in {timeout} s")
