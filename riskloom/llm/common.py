"""What several operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.operators.joins import many_to_one
from riskloom.session import configure, work_dir

# Rows and bytes of one Arrow batch: long texts must not fill a Python worker.
ARROW_CONF = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(32 << 20),
}

# Values of a hash that is to choose rows evenly.
_EVENLY = 1 << 30

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def prepare(spark: SparkSession) -> SparkSession:
    """Runtime settings of the library, and batches of bounded size."""
    configure(spark)
    for key, value in ARROW_CONF.items():
        if spark.conf.get(key, None) != value:
            spark.conf.set(key, value)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


# Folders to remove at the end of each open ``scratch``, the innermost last.
_open: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove what ``stored`` writes in here, but for tables written with ``leave``."""
    _open.append([])
    try:
        yield
    finally:
        files = spark.sparkContext._jvm.org.apache.hadoop.fs
        for path in _open.pop():
            target = files.Path(path)
            target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def stored(df: DataFrame, name: str, leave: bool = False, **options: str) -> DataFrame:
    """Write to the shared folder and go on from there: cuts the lineage.

    Any executor can read the files again, so losing one costs a re-read. With
    ``leave`` the table outlives the innermost ``scratch``. ``options`` go to the writer.
    """
    path = work_dir(df.sparkSession, name)
    outer = _open[:-1] if leave else _open
    if outer:
        outer[-1].append(path)
    df.write.option("compression", "zstd").options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


# Rows of a few whole numbers that may go to every task.
FEW = 500_000


def look_up(many: DataFrame, one: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join with a stored table that has at most one row per key.

    The table is counted: up to ``FEW`` rows it is broadcast and ``many`` stays
    where it is, beyond that both are shuffled and hot keys split.
    """
    if one.count() <= FEW:
        return many.join(F.broadcast(one), keys, how)
    return many_to_one(many, one, keys, how)


def row_key(*columns: str) -> Column:
    """A 64-bit key of a row's contents: equal rows have equal keys."""
    return F.xxhash64(*[F.col(c) for c in columns], F.lit(29))


def chosen(key: Column, rate: Column) -> Column:
    """Whether a key belongs to an even share of all keys; the same on every run."""
    return F.pmod(F.xxhash64(key, F.lit(31)), F.lit(_EVENLY)) / F.lit(float(_EVENLY)) < rate


def once(rows: DataFrame, key: str) -> DataFrame:
    """One of the rows of each value of ``key``, of which there are few.

    A task passes a key on once, so however many copies a key has, no more rows than keys
    leave a task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set = set()
        for batch in batches:
            new = []
            for i, k in enumerate(batch[key].to_pylist()):
                if k not in seen:
                    seen.add(k)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    return rows.mapInArrow(run, rows.schema).dropDuplicates([key])


def unused(df: DataFrame, name: str) -> str:
    """``name``, lengthened until no column of ``df`` starts with it in any letter case."""
    while any(c.lower().startswith(name.lower()) for c in df.columns):
        name += "_"
    return name


def whole_text(column: str = "text") -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def held_out(modulus: int, column: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, modulo.

    A null id counts as held out, so that nothing is learned from it.
    """
    rest = F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)
    return F.coalesce(rest == 0, F.lit(True))


def words_of(text: str) -> list[bytes]:
    """Runs of anything but ASCII white space, A-Z lower-cased, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()
