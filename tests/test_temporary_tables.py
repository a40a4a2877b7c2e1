"""Tables stored on the way go with their scope."""

import os
import sys
import tempfile

import pytest
from pyspark.sql import functions as F

from tickloom.plans import materialize
from tickloom.plans.materialize import temporary_tables
from tickloom.streaming import carry, steps


@pytest.fixture
def folder(monkeypatch):
    with tempfile.TemporaryDirectory(dir="/tmp") as place:
        monkeypatch.setattr(sys.modules["tickloom.plans.materialize"], "shared_folder", lambda spark: place)
        yield place


def stored(folder):
    return sorted(n.split("-")[1] for n in os.listdir(folder) if n.startswith("tickloom-"))


def test_scopes(spark, folder):
    one = spark.range(3)
    materialize(one, "outside")
    with temporary_tables():
        materialize(one, "a")
        with temporary_tables(keep_last=True):
            materialize(one, "b")
            kept = materialize(one, "c")
        assert stored(folder) == ["a", "c", "outside"] and kept.count() == 3
    assert stored(folder) == ["outside"]
    with pytest.raises(ValueError), temporary_tables():
        materialize(one, "d")
        raise ValueError
    assert stored(folder) == ["outside"]


def test_a_stream_leaves_no_tables(spark, folder):
    table = spark.range(40).select(
        F.lit(1).alias("instrument_id"), F.col("id").alias("seq"), F.timestamp_micros(F.col("id") * 1000).alias("ts"), F.lit(5).alias("type"),
        F.lit(100).cast("long").alias("price_ticks"), F.lit(3).cast("long").alias("quantity"), F.lit(1).alias("aggressor"))
    for i in (0, 1):
        table.where(f"seq div 20 = {i}").coalesce(1).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    steps.stream_threshold_bars(stream, f"{folder}/s", "volume", 10).trigger(availableNow=True).start().awaitTermination()
    assert carry.output(spark, f"{folder}/s").count() == 10
    assert stored(folder) == []
