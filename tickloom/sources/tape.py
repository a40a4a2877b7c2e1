"""A market tape derived from a generic activity log (event_id, ts, user_id, event_type, value, props).

Clicks, views and errors become trades (buy, sell, unknown aggressor),
purchases and sign-ups become bid and ask updates.  The price walks with the
accumulated activity, so neighbouring events have neighbouring prices.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.plans import materialize, running, sum_, whole

FAST_OPEN_US = 1_717_421_400_000_000  # 2024-06-03 13:30:00 UTC
FAST_RATE = 240  # the log's month squeezed into three hours
LOG_START_US = 1_704_067_200_000_000  # 2024-01-01 00:00:00 UTC


def utc_micros(ntz: str) -> F.Column:
    """Microseconds since 1970 of a zone-less timestamp column, whatever the session zone."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', cast({ntz} as timestamp_ntz))")


def activity_tape(log: DataFrame, pace: str = "fast") -> DataFrame:
    """``pace='fast'`` squeezes the log into three hours; ``'days'`` keeps its own clock."""
    base = log.select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 2 + 1).cast("int").alias("instrument_id"),
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.floor("value").cast("long").alias("v"),
        F.expr("CASE event_type WHEN 'purchase' THEN 6 WHEN 'signup' THEN 7 ELSE 5 END").alias("type"),
        F.expr("CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END").alias("aggressor"),
        utc_micros("ts").alias("log_us"),
    )
    us = F.col("log_us")
    if pace == "fast":
        us = F.lit(FAST_OPEN_US) + whole(us - F.lit(LOG_START_US), FAST_RATE)
    walked = running(base, [S.KEY], ref=sum_(F.col("v") % 5 - 2)).withColumn("ts_us", us)
    is_trade = F.col("type") == S.TRADE
    step = 1 + F.col("k") % 5
    root = F.when(F.col(S.KEY) == 1, "NQ").otherwise("ES")
    return walked.select(
        "instrument_id",
        root.alias("root"),
        F.concat(root, F.lit("M4")).alias("contract"),
        F.lit("CME").alias("exchange"),
        "type",
        F.timestamp_micros("ts_us").alias("ts"),
        F.timestamp_micros(F.col("ts_us") + F.col("k")).alias("receive_ts"),
        "seq",
        F.when(is_trade, S.NO_SIDE).otherwise(F.col("type") - 5).cast("int").alias("side"),
        (80000 + F.col("ref")
         + F.when(is_trade, F.lit(0)).when(F.col("type") == S.BID_UPDATE, -step).otherwise(step)
         ).cast("long").alias("price_ticks"),
        F.when(~is_trade & (F.col("k") % 4 == 0), F.lit(0)).otherwise(1 + F.col("v")).cast("long").alias("quantity"),
        F.lit(0).cast("long").alias("order_id"),
        F.when(is_trade, F.col("seq")).otherwise(F.lit(0)).cast("long").alias("trade_id"),
        F.when(is_trade, F.col("aggressor")).otherwise(F.lit(0)).cast("int").alias("aggressor"),
        (F.lit(S.HAS_SEQUENCE | S.HAS_TIMESTAMP)
         + F.when(is_trade & (F.col("aggressor") > 0) & (F.col("k") % 3 == 0), S.AGGRESSOR_INFERRED)
         .when(is_trade & (F.col("aggressor") > 0), S.AGGRESSOR_SUPPLIED).otherwise(0)
         ).cast("int").alias("flags"),
        F.lit(1).alias("source"),
        "ts_us",
    )


_recorded: dict[tuple[str, str, str], DataFrame] = {}


def recorded_tape(spark: SparkSession, sf_dir: str, pace: str = "fast") -> DataFrame:
    """The tape of ``sf_dir``, recorded once per application and shared by all queries."""
    slot = (spark.sparkContext.applicationId, sf_dir, pace)
    if slot not in _recorded:
        tape = activity_tape(spark.read.parquet(f"{sf_dir}/events.parquet"), pace)
        _recorded[slot] = materialize(tape, f"tape-{pace}")
    return _recorded[slot]
