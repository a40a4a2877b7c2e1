"""Alarms of silent feeds: a feed that never resumes, restart from the checkpoint, order inside a batch."""

import random
import tempfile

import numpy as np
from pyspark.sql import functions as F

from tickloom.streaming import alarms

SECOND = 1_000_000
SCHEMA = "instrument_id int, ts_us long, ts timestamp"


def test_stretches_in_any_order():
    rng = random.Random(1)
    for _ in range(200):
        times = [rng.randrange(200) for _ in range(rng.randrange(1, 60))]
        threshold = rng.randrange(1, 12)
        cuts = sorted(times)
        want, first = [], cuts[0]
        for a, b in zip(cuts, cuts[1:] + [10**6]):
            if b - a > threshold:
                want.append((first, a))
                first = b
        parts = [np.array(times[i::3]) for i in range(3)]
        assert alarms.active_stretches(iter(parts), threshold) == want


def run(spark, source, place):
    with alarms.keyed_state(spark):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
        found = alarms.stale_alarms(stream, 5 * SECOND, "1 second")
        q = found.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/checkpoint").trigger(availableNow=True).start()
        q.awaitTermination()
    rows = spark.read.schema(found.schema).parquet(f"{place}/out").collect()
    return sorted((r.instrument_id, r.last_activity_us // SECOND, r.alarm_us // SECOND) for r in rows)


def write(spark, source, rows):
    frame = spark.createDataFrame([(k, t * SECOND) for k, t in rows], "instrument_id int, ts_us long").withColumn("ts", F.timestamp_micros("ts_us"))
    frame.coalesce(1).write.mode("append").parquet(source)


def test_a_feed_that_never_resumes_and_a_restart(spark):
    with tempfile.TemporaryDirectory(dir="/tmp") as folder:
        source = f"{folder}/in"
        write(spark, source, [(1, 0), (2, 0), (1, 3), (2, 2)])
        assert run(spark, source, folder) == []
        # two goes silent while one goes on; rows of a file come in no order
        write(spark, source, [(1, 9), (1, 6), (1, 8), (1, 4)])
        assert run(spark, source, folder) == [(2, 2, 7)]
        # the same again tells nothing new; state is that of the checkpoint
        write(spark, source, [(1, 12), (1, 13)])
        assert run(spark, source, folder) == [(2, 2, 7)]
        # two resumes, falls silent again within one file, and one ends for good
        write(spark, source, [(2, 14), (2, 15), (2, 30), (2, 31)])
        assert run(spark, source, folder) == [(1, 13, 18), (2, 2, 7), (2, 15, 20)]
