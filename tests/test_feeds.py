"""Recorded tables as feeds: files in order, whatever the partitions of the table."""

import os

import pytest
from pyspark.sql import functions as F

from tests.test_fixtures import tape
from tickloom.catalog import streams
from tickloom.streaming import steps, windows


@pytest.fixture
def scattered(spark):
    """Trades of an hour in six partitions with a bit of everything in each; a second lap of the same hour follows."""
    rows = [(n * 1.0, 5, 100 + n % 7, 1 + n % 3, "BSU"[n % 3]) for n in range(3600)]
    once = tape(spark, rows)
    return once.unionByName(once.withColumn("seq", F.col("seq") + 3600)).repartition(6)


@pytest.mark.parametrize("order", ["seq", "ts"])
def test_files_arrive_in_order(spark, scattered, order, tmp_path):
    stream = streams.feed(spark, f"{tmp_path}", "scattered", scattered, order)
    folder = streams._feeds[(spark.sparkContext.applicationId, f"{tmp_path}", "scattered", order)][0]
    files = sorted((f for f in os.scandir(folder) if f.name.endswith(".parquet")), key=lambda f: f.stat().st_mtime_ns)
    spans = [spark.read.parquet(f.path).agg(F.min(order), F.max(order), F.count(order)).first() for f in files]
    assert len(files) >= streams.PARTS and sum(s[2] for s in spans) == scattered.count()
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    assert stream.isStreaming


def test_bars_of_a_scattered_table(spark, scattered, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 900)  # eight files, two micro-batches of four
    bars = streams.ran(spark, lambda path: steps.stream_threshold_bars(
        streams.feed(spark, f"{tmp_path}", "bars", scattered), path, "tick", 50), "test-bars")
    assert [r.first_seq for r in bars.orderBy("first_seq").collect()] == [r.seq for r in scattered.orderBy("seq").collect()[::50]]


def test_windows_lose_no_earlier_hour(spark, scattered, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 450)  # sixteen files, four micro-batches
    by_time = streams.feed(spark, f"{tmp_path}", "laps", scattered, "ts")
    out = streams.appended(spark, windows.stream_time_bars(by_time), "test-laps")
    rows = out.collect()
    assert len(rows) == 59 and {r.trades for r in rows} == {120}


def test_sums_of_an_earlier_date_go_on(spark, tmp_path):
    dated = [[(d * 86_400.0 + n, 5, 100, 1, "B") for n in range(3)] for d in (0, 20, 0)]
    step, state, cvd = steps.cvd_vwap_step(None), None, []
    for k, rows in enumerate(dated):
        batch = tape(spark, rows).withColumn("seq", F.col("seq") + 10 * k)
        out, after = step(batch, state)
        cvd.append([r.cvd for r in out.orderBy("seq").collect()])
        after["sums"].write.parquet(f"{tmp_path}/{k}")
        state = {"sums": spark.read.parquet(f"{tmp_path}/{k}")}
    assert cvd == [[1, 2, 3], [1, 2, 3], [4, 5, 6]]


def test_a_feed_of_many_files_reads_its_table_no_oftener(spark, scattered, tmp_path, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 300)  # 24 files
    read = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    table = scattered.mapInArrow(passed, scattered.schema)
    by_seq = streams.feed(spark, f"{tmp_path}", "oftener", table)
    assert read.value <= 4 * scattered.count()
    fed = spark.read.schema(by_seq.schema).parquet(streams._feeds[(spark.sparkContext.applicationId, f"{tmp_path}", "oftener", "seq")][0])
    assert len(fed.inputFiles()) >= 20 and fed.exceptAll(scattered).count() == 0 and scattered.exceptAll(fed).count() == 0
