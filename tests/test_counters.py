"""Observed counters of a stream: per batch, by listener, and added up."""

import tempfile
import time

from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators import quality
from tickloom.streaming import counters


def test_counters_of_every_batch(spark):
    rows = []
    for i in range(300):
        sequence = i + (3 if i > 120 else 0) - (5 if i in (50, 200) else 0)
        rows.append((1 + i % 2, i, 2 * sequence, (S.TRADE, S.BID_UPDATE, S.ASK_UPDATE, S.BOOK_CLEAR)[i % 4], 5, S.HAS_SEQUENCE if i % 7 else 0, i * 1000))
    names = "instrument_id int, seq long, sequence long, type int, quantity long, flags int, ts_us long"
    table = spark.createDataFrame(rows, names).withColumn("ts", F.timestamp_micros("ts_us"))
    seen, listener = [], counters.FeedCounters()
    spark.streams.addListener(listener)
    try:
        with tempfile.TemporaryDirectory(dir="/tmp") as folder:
            for part in range(3):
                table.where((F.col("seq") >= part * 100) & (F.col("seq") < part * 100 + 100)).coalesce(1).write.mode("append").parquet(f"{folder}/in")
                # a new run each time: sequences go on from the state, batches from the checkpoint
                stream = spark.readStream.schema(table.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
                counters.stream_diagnostics(stream, f"{folder}/s", "sequence", report=seen.append).trigger(availableNow=True).start().awaitTermination()
            got = sorted(map(tuple, counters.diagnostics(spark, f"{folder}/s").collect()))
            by_batch = spark.read.parquet(f"{folder}/s/out").groupBy("batch_id").agg(*[F.sum(c).alias(c) for c in counters.TOTALS]).orderBy("batch_id").collect()
        want = quality.pipeline_diagnostics(table, "sequence")
        assert got == sorted(map(tuple, want.collect()))
        end = time.time() + 20
        while time.time() < end and (len(listener.rows()) < 3 or len(seen) < 3):
            time.sleep(0.2)
        assert [r[2:5] for r in sorted(listener.rows(), key=lambda r: r[1])] == [(100, 25, 50)] * 3
        assert listener.table(spark).agg(F.sum("events"), F.sum("unsequenced"), F.max("newest_us")).first()[:] == (300, 43, 299_000)
        # what was observed while a batch was written is what was written
        assert sorted(tuple(r[c] for c in counters.TOTALS) for r in by_batch) == sorted(tuple(s[c] for c in counters.TOTALS) for s in seen)
    finally:
        spark.streams.removeListener(listener)
