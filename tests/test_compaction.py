"""Closed dates rewritten into few files: same rows, fewer files, repeatable."""

from __future__ import annotations

import datetime
import os

import pytest
from pyspark.sql import functions as F

from riskloom import session
from riskloom.sources.compaction import compact_dates, read_compacted


def files(path, day):
    return len(list((path / f"event_date={day}").glob("*.parquet")))


@pytest.fixture
def layer(spark, tmp_path):
    """Three dates and rows without one, 24 files a date."""
    i = F.col("id")
    rows = spark.range(0, 2400, 1, 24).select(
        i, F.when(i % 4 < 3, F.date_add(F.lit("2024-01-01").cast("date"), (i % 4).cast("int"))).alias("event_date"),
        F.md5(i.cast("string")).alias("value"))
    rows.write.partitionBy("event_date").parquet(str(tmp_path / "layer"))
    return spark.read.schema(rows.schema).parquet(str(tmp_path / "layer"))


def test_closed_dates_are_rewritten_and_nothing_is_lost(layer, tmp_path):
    before, target = datetime.date(2024, 1, 3), tmp_path / "compacted"
    for _ in range(2):
        compact_dates(layer, str(target), before)
        assert files(tmp_path / "layer", "2024-01-01") == 24 and files(target, "2024-01-01") == 1
        assert not (target / "event_date=2024-01-03").exists()
        got = read_compacted(layer, str(target), before)
        assert got.columns == layer.columns
        assert sorted(map(tuple, got.select("id", "value").collect())) == sorted(
            map(tuple, layer.select("id", "value").collect()))


def test_later_dates_join_those_already_rewritten(layer, tmp_path):
    target = tmp_path / "compacted"
    compact_dates(layer, str(target), datetime.date(2024, 1, 2))
    compact_dates(layer, str(target), datetime.date(2024, 1, 4), since=datetime.date(2024, 1, 2))
    got = read_compacted(layer, str(target), datetime.date(2024, 1, 4))
    assert got.count() == 2400 and got.where("event_date IS NULL").count() == 600


def test_layer_without_a_date_column(layer, tmp_path):
    labels = layer.select("id", F.col("event_date").cast("timestamp").alias("label_time"))
    day, before = F.to_date("label_time"), datetime.date(2024, 1, 3)
    compact_dates(labels, str(tmp_path / "labels"), before, date=day)
    got = read_compacted(labels, str(tmp_path / "labels"), before, date=day)
    assert got.columns == labels.columns and got.exceptAll(labels).isEmpty() and got.count() == 2400


def test_empty_layer(layer, tmp_path):
    empty = layer.where("id < 0")
    compact_dates(empty, str(tmp_path / "none"), datetime.date(2024, 1, 3))
    assert read_compacted(empty, str(tmp_path / "none"), datetime.date(2024, 1, 3)).isEmpty()


def test_work_folders_go(spark, monkeypatch):
    monkeypatch.setattr(session, "_handed_out", [])
    path = session.work_dir(spark, "gone")
    spark.range(3).write.parquet(path)
    session.remove_work(spark)
    assert not os.path.exists(path)
