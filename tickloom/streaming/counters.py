"""Running counters of a stream.

Counters are observed on the way through: Spark collects them while it runs a
micro-batch and reports them with the batch's progress, no pass is made for
them.  What depends on the order of events (gaps, duplicates) is observed on
the audited micro-batch; a listener sees what is observed on the stream itself.
"""

from __future__ import annotations

import threading

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StreamingQueryListener

from tickloom import schema as S
from tickloom.operators import quality
from tickloom.streaming.carry import Step, carried

FEED = "feed"
FEED_SCHEMA = "run_id string, batch_id bigint, events bigint, trades bigint, depth_updates bigint, unsequenced bigint, newest_us bigint"
TOTALS = ("ingested", "processed", "gaps", "duplicates", "invalidations", "trades", "depth_updates")


def counted(stream: DataFrame) -> DataFrame:
    """The stream, its events counted by kind in every micro-batch."""
    return stream.observe(
        FEED, F.count(F.lit(1)).alias("events"), F.count_if(F.col("type") == S.TRADE).alias("trades"),
        F.count_if(F.col("type").isin(S.BID_UPDATE, S.ASK_UPDATE)).alias("depth_updates"),
        F.count_if(~quality.has_flag(S.HAS_SEQUENCE)).alias("unsequenced"), F.max(F.unix_micros("ts")).alias("newest_us"),
    )


class FeedCounters(StreamingQueryListener):
    """What ``counted`` streams report, one row per run and micro-batch; add it to ``spark.streams``."""

    def __init__(self) -> None:
        self._rows: dict[tuple[str, int], tuple] = {}
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        seen = (event.progress.observedMetrics or {}).get(FEED)
        if seen is not None:
            slot = (str(event.progress.runId), event.progress.batchId)
            with self._lock:
                self._rows[slot] = (*slot, *(seen[c] for c in ("events", "trades", "depth_updates", "unsequenced", "newest_us")))

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass

    def rows(self) -> list[tuple]:
        with self._lock:
            return sorted(self._rows.values())

    def table(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows(), FEED_SCHEMA)


def diagnostics_step(sequence: str = "seq", arrival: str = "seq", report=None) -> Step:
    """Counters of each micro-batch per instrument; the last sequence of each is the state.

    ``report`` is called with the totals of the batch, observed while it was
    written.
    """
    def step(batch, before):
        known = before["sequences"] if before else None
        audited = quality.sequence_audit(batch, sequence, arrival, known)
        counters = quality.diagnostic_counters(sequence)
        totals = Observation()
        observed = audited.observe(totals, *[counters[n].alias(n) for n in TOTALS])
        out = observed.groupBy(S.KEY).agg(*[c.alias(n) for n, c in counters.items()])
        accepted = F.max(F.when(quality.has_flag(S.HAS_SEQUENCE), F.col(sequence))).alias("last_sequence")
        after = batch.groupBy(S.KEY).agg(accepted)
        if known is not None:
            after = after.unionByName(known).groupBy(S.KEY).agg(F.max("last_sequence").alias("last_sequence"))
        if report is not None:
            # the observation is complete once the output is written
            threading.Thread(target=lambda: report(totals.get), daemon=True).start()
        return out, {"sequences": after}

    return step


def stream_diagnostics(stream: DataFrame, path: str, sequence: str = "seq", arrival: str = "seq", report=None) -> DataStreamWriter:
    """Writer of the counters of every micro-batch; ``diagnostics`` adds them up."""
    return carried(counted(stream), diagnostics_step(sequence, arrival, report), path)


def diagnostics(spark: SparkSession, path: str) -> DataFrame:
    """Counters per instrument over all micro-batches so far."""
    return spark.read.parquet(f"{path}/out").groupBy(S.KEY).agg(
        *[F.sum(n).alias(n) for n in TOTALS], F.max("last_sequence").alias("last_sequence")
    )
