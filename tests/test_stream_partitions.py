"""How many partitions a stream works in, and how long it is waited for."""

from __future__ import annotations

import pytest

from riskloom.plans import queries
from riskloom.session import shuffled_into, stream_partitions, work_dir
from riskloom.sources import tables
from riskloom.streaming.layers import Layers, wait_for_all


@pytest.fixture
def default_partitions(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", before)


def test_the_state_of_a_query_goes_with_the_cores(spark, small_dir, default_partitions):
    cores = spark.sparkContext.defaultParallelism
    assert stream_partitions(spark) == min(200, 2 * cores)
    layers = queries._layers(spark, "partitions")
    query = layers.start_user_features(tables.transactions(tables.stream_events(spark, small_dir)))
    wait_for_all({"q": query})
    assert query.lastProgress["stateOperators"][0]["numShufflePartitions"] == 2 * cores
    assert spark.conf.get("spark.sql.shuffle.partitions") == "200"


def test_layers_without_a_number_keep_that_of_the_session(spark, small_dir, tmp_path):
    layers = Layers(root=str(tmp_path / "out"), checkpoints=str(tmp_path / "c"), once=True)
    with shuffled_into(spark, 3):
        query = layers.start_user_features(tables.transactions(tables.stream_events(spark, small_dir)))
    wait_for_all({"q": query})
    assert query.lastProgress["stateOperators"][0]["numShufflePartitions"] == 3


def test_a_smaller_number_of_the_session_is_kept(spark):
    with shuffled_into(spark, 1):
        assert stream_partitions(spark) == 1


def test_the_rows_of_a_batch_are_dealt_out(spark, small_dir, tmp_path):
    folder, seen = work_dir(spark, "dealt"), []
    files = tables.write_batches(spark, small_dir, folder, 3, 0)
    assert files == 1
    writer = tables.batch_stream(spark, folder, files).writeStream.trigger(availableNow=True)
    query = writer.option("checkpointLocation", str(tmp_path / "c")).foreachBatch(
        lambda batch, _: seen.append((batch.rdd.getNumPartitions(), batch.count()))).start()
    wait_for_all({"q": query})
    assert [parts for parts, _ in seen] == [stream_partitions(spark)] * 3
    assert sum(n for _, n in seen) == tables.read_events(spark, small_dir).count()


class Waiting:
    def __init__(self, answer):
        self.answer, self.asked, self.stopped = answer, [], False

    def awaitTermination(self, timeout=None):
        self.asked.append(timeout)
        return None if timeout is None else self.answer

    def stop(self):
        self.stopped = True


def test_a_query_is_waited_for_to_its_end():
    query = Waiting(False)
    wait_for_all({"q": query})
    assert query.asked == [None] and not query.stopped
    with pytest.raises(TimeoutError):
        wait_for_all({"q": query}, timeout=5)
    assert query.stopped
