"""The online table: keyed rows written per micro-batch and read as of a time."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskloom.operators.online import (
    current_windows, live, merge_user_windows, newest_per_key, with_expiry,
)
from riskloom.operators.validation import valid_rows
from riskloom.schemas import FLAGS_TTL, SLIDING, USER_FEATURES_TTL, WINDOWED, SlidingSpec

USER_ROWS = T.StructType(WINDOWED.fields + [T.StructField("updated_at", T.TimestampType())])
FLAG_ROWS = T.StructType([
    T.StructField("transaction_id", T.StringType()),
    T.StructField("user_id", T.StringType()),
    T.StructField("amount", T.DoubleType()),
    T.StructField("is_foreign", T.IntegerType()),
    T.StructField("is_high_amount", T.IntegerType()),
    T.StructField("is_suspicious", T.IntegerType()),
    T.StructField("updated_at", T.TimestampType()),
])


# So many keys are named to the scan; all are joined.
FEW_KEYS = 200


@dataclass(frozen=True)
class OnlineTable:
    """Parquet folders, one per micro-batch, plus merged bases.

    A replayed batch replaces its own folder, so writing twice changes nothing.
    Readers take the newest finished base and the batches after it. Rows lie in
    ``buckets`` by a hash of their first key, sorted by it and with a Bloom filter, so a
    lookup reads the buckets of its keys only, and of those the row groups that may hold them.
    """

    path: str
    schema: T.StructType
    ttl: int
    keys: tuple[str, ...]
    buckets: int = 8

    def write_batch(self, rows: DataFrame, batch_id: int, now: Column | None = None) -> None:
        stamped = rows.withColumn("updated_at", F.current_timestamp() if now is None else now)
        self._write(stamped, f"deltas/batch_id={batch_id}")

    def _write(self, rows: DataFrame, folder: str) -> None:
        key = self.keys[0]
        (
            rows.select(*self.schema.names, self._bucket(F.col(key)).alias("bucket"))
            .repartition(self.buckets, "bucket").sortWithinPartitions("bucket", key)
            .write.mode("overwrite").partitionBy("bucket")
            .option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{self.path}/{folder}")
        )

    def _bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def stored(self, spark: SparkSession) -> DataFrame:
        """All stored rows that can still matter, with the batch they came from and their bucket."""
        base = self._newest_base(spark)
        rows = self._read(spark, "deltas", "batch_id bigint, bucket int")
        rows = rows.where(F.col("batch_id") > (-1 if base is None else base))
        if base is not None:
            rows = rows.unionByName(
                self._read(spark, f"base/batch_id={base}", "bucket int").withColumn("batch_id", F.lit(base).cast("bigint")))
        return rows

    def merged(self, spark: SparkSession, keys: DataFrame | str | None = None) -> DataFrame:
        """One current row per key, expired or not; with ``keys`` (a frame of them, or one) of those only."""
        return with_expiry(
            newest_per_key(self._of(spark, keys), list(self.keys)).drop("batch_id"), self.ttl
        )

    def _of(self, spark: SparkSession, keys: DataFrame | str | None) -> DataFrame:
        """The stored rows of some keys, before anything is merged."""
        rows, key = self.stored(spark), F.col(self.keys[0])
        if keys is None:
            return rows.drop("bucket")
        if isinstance(keys, str):
            return rows.where((F.col("bucket") == self._bucket(F.lit(keys))) & (key == keys)).drop("bucket")
        # At most as many numbers as there are buckets.
        found = keys.agg(F.collect_set(self._bucket(key)).alias("buckets"), F.count(key).alias("n")).first()
        rows = rows.where(F.col("bucket").isin(found["buckets"])).drop("bucket")
        if found["n"] <= FEW_KEYS:
            # Named keys reach the scan.
            rows = rows.where(key.isin([r[0] for r in keys.where(key.isNotNull()).select(key).collect()]))
        return rows.join(keys, list(self.keys), "left_semi")

    def read(self, spark: SparkSession, as_of: Column | None = None) -> DataFrame:
        """The rows that are live at ``as_of`` (default: now)."""
        return self._live(self.merged(spark), as_of)

    def get(self, spark: SparkSession, key: str, as_of: Column | None = None) -> DataFrame:
        """The live row of one key; key and bucket reach the Parquet scan."""
        return self._live(self.merged(spark, key), as_of)

    @staticmethod
    def _live(rows: DataFrame, as_of: Column | None) -> DataFrame:
        return live(rows, F.current_timestamp() if as_of is None else as_of)

    def compact(self, spark: SparkSession, batch_id: int, as_of: Column | None = None) -> None:
        """Merge all batches up to ``batch_id`` into a base. Called by the one writer."""
        rows = self.stored(spark).where(F.col("batch_id") <= batch_id)
        kept = self._still_needed(rows, F.current_timestamp() if as_of is None else as_of)
        self._write(kept, f"base/batch_id={batch_id}")

    def _still_needed(self, rows: DataFrame, as_of: Column) -> DataFrame:
        return live(with_expiry(newest_per_key(rows, list(self.keys)), self.ttl), as_of)

    def _read(self, spark: SparkSession, part: str, folders: str) -> DataFrame:
        schema = T.StructType(self.schema.fields + T.StructType.fromDDL(folders).fields)
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{part}")
        except AnalysisException as exc:
            if exc.getCondition() != "PATH_NOT_FOUND":
                raise
            return spark.createDataFrame([], schema)

    def vacuum(self, spark: SparkSession, keep_bases: int = 2) -> None:
        """Delete batches and bases that no reader of the newest ``keep_bases`` bases needs."""
        bases = self._batches(spark, "base")
        if len(bases) < keep_bases:
            return
        oldest = bases[-keep_bases]
        spent = [("base", b) for b in bases if b < oldest]
        spent += [("deltas", b) for b in self._batches(spark, "deltas") if b <= oldest]
        for part, batch_id in spent:
            folder = self._hadoop_path(spark, f"{part}/batch_id={batch_id}")
            folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)

    def _newest_base(self, spark: SparkSession) -> int | None:
        return max(self._batches(spark, "base"), default=None)

    def _batches(self, spark: SparkSession, part: str) -> list[int]:
        """Batches of ``part`` whose write was completed, oldest first."""
        pattern = self._hadoop_path(spark, f"{part}/batch_id=*/_SUCCESS")
        found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
        return sorted(int(s.getPath().getParent().getName().split("=")[1]) for s in found or [])

    def _hadoop_path(self, spark: SparkSession, below: str):
        return spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{below}")


@dataclass(frozen=True)
class UserFeatureTable(OnlineTable):
    """Stores every window a batch touched; the trailing one is chosen on reading.

    The chosen row must be valid to be served.
    """

    spec: SlidingSpec = SLIDING

    def merged(self, spark: SparkSession, keys: DataFrame | str | None = None) -> DataFrame:
        chosen = merge_user_windows(self._of(spark, keys), self.spec)
        return with_expiry(valid_rows(chosen, "user_features"), self.ttl)

    def _still_needed(self, rows: DataFrame, as_of: Column) -> DataFrame:
        # By event time: an event that is not late lies after the newest event less
        # the watermark, and neither it nor the choice it leads to needs a window
        # that ended before. Wall-clock time only says what readers still see.
        newest_end = rows.agg(F.max("window_end")).scalar()
        reach = self.spec.size + self.spec.watermark + self.spec.slide
        kept = current_windows(rows)
        return kept.where(
            (F.col("window_end") > newest_end - self._seconds(reach))
            | (F.col("updated_at") + self._seconds(self.ttl) > as_of)
        )

    @staticmethod
    def _seconds(n: int) -> Column:
        return F.expr(f"interval {n} seconds")


def user_feature_table(path: str, spec: SlidingSpec = SLIDING) -> UserFeatureTable:
    return UserFeatureTable(path, USER_ROWS, USER_FEATURES_TTL, ("user_id",), spec=spec)


def flag_table(path: str) -> OnlineTable:
    return OnlineTable(path, FLAG_ROWS, FLAGS_TTL, ("transaction_id",))


def put_hashes(hashes: DataFrame, connect: Callable[[], object]) -> None:
    """Send text rows to an external key/value store from the executors.

    ``connect()`` is called once per partition and returns an object with
    ``put(key, fields, ttl)`` and ``close()``. Puts overwrite, so a retried task
    leaves the same state.
    """

    def send(rows):
        store = connect()
        try:
            for row in rows:
                store.put(row["key"], row["fields"], row["ttl"])
        finally:
            store.close()

    hashes.foreachPartition(send)
