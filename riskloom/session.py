"""Session settings the library relies on, and the shared folder it may write to."""

from __future__ import annotations

import atexit
import hashlib
import io
import os
import re
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Runtime settings every entry point needs. Timestamps are UTC and Parquet
# files carry microseconds, so other readers see the same instants.
RUNTIME_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Window state on disk, so it is not bounded by the executors' heap, and
    # checkpoints of a batch that hold its changes only.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to a session someone else created."""
    for key, value in RUNTIME_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    ship(spark)
    return spark


# Applications whose Python workers have been sent the package.
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the application's Python workers, once.

    Workers import the functions they run, and neither the driver's folder nor its
    search path reaches them. The archive lies in the shared folder; without one
    (an error on a cluster as soon as something has to be stored) nothing is sent.
    """
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    try:
        root = shared_dir(spark)
    except RuntimeError:
        return
    archive = _archive()
    path = os.path.join(root, "riskloom", f"riskloom-{hashlib.md5(archive).hexdigest()}.zip")
    if read_file(spark, path) is None:
        write_file(spark, path, archive)
    context.addPyFile(path)


def _place(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def write_file(spark: SparkSession, path: str, content: bytes) -> None:
    """Write a small file anywhere Spark can write. It is there as a whole or not at all."""
    target, files = _place(spark, path)
    part, _ = _place(spark, os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}"))
    out = files.create(part)
    out.write(content)
    out.close()
    files.delete(target, False)
    if not files.rename(part, target):
        files.delete(part, False)


def read_file(spark: SparkSession, path: str) -> bytes | None:
    """The content of a small file, None if there is none."""
    target, files = _place(spark, path)
    if not files.exists(target):
        return None
    held = files.open(target)
    try:
        return bytes(held.readAllBytes())
    finally:
        held.close()


def _archive() -> bytes:
    """The package's modules, alike for equal contents."""
    package = os.path.dirname(os.path.abspath(__file__))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, folders, names in os.walk(package):
            folders.sort()
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    inside = os.path.join(os.path.basename(package), os.path.relpath(full, package))
                    with open(full, "rb") as source:
                        archive.writestr(zipfile.ZipInfo(inside), source.read())
    return held.getvalue()


def build_session(
    app: str = "riskloom",
    master: str | None = None,
    shuffle_partitions: int | None = None,
    conf: dict[str, str] | None = None,
) -> SparkSession:
    """Create a session. On a cluster leave ``master`` to spark-submit.

    ``shuffle_partitions`` is the number before AQE coalesces: size it so that
    one reduce partition of the largest shuffle is 100-200 MB. Streaming
    queries keep the number their checkpoint was started with.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = dict(RUNTIME_CONF)
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    # Files of a checkpoint go when nothing refers to it any more.
    settings["spark.cleaner.referenceTracking.cleanCheckpoints"] = "true"
    settings.update(conf or {})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return configure(builder.getOrCreate())


def stream_partitions(spark: SparkSession) -> int:
    """As many partitions as the session shuffles into, but at most two for each core.

    A micro-batch opens and stores the state of every partition and starts a task for it in each
    of its jobs, however few rows there are, and nothing merges small partitions of a stream.
    """
    return min(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)


@contextmanager
def shuffled_into(spark: SparkSession, partitions: int | None) -> Iterator[None]:
    """Within it the session shuffles into so many partitions; None changes nothing."""
    if partitions is None:
        yield
        return
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        yield
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as named by ``spark.checkpoint.dir``.

    Only a local session (one JVM) without that setting gets a folder of its own,
    which goes when the process ends; on a cluster a missing setting is an error.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        root = tempfile.mkdtemp(prefix="riskloom-")
        atexit.register(shutil.rmtree, root, ignore_errors=True)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(root)
    return root


# Work folders handed out and not removed yet.
_handed_out: list[str] = []


def work_dir(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, for what this process needs for a while."""
    path = os.path.join(shared_dir(spark), "riskloom", f"{name}-{uuid.uuid4().hex}")
    _handed_out.append(path)
    return path


def remove_work(spark: SparkSession) -> None:
    """Remove the work folders of this process. Frames that read them end with that."""
    hadoop = spark.sparkContext._jsc.hadoopConfiguration()
    while _handed_out:
        folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_handed_out.pop())
        folder.getFileSystem(hadoop).delete(folder, True)
