"""Event-time windows on Spark's own streaming state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tickloom import schema as S
from tickloom.operators.flow import signed_quantity
from tickloom.operators.quality import trades
from tickloom.sources.recording import PARTITIONS, as_recorded


def stream_time_bars(stream: DataFrame, interval: str = "1 minute", delay: str = "10 seconds") -> DataFrame:
    """Tumbling bars.  A trade later than the watermark is dropped, where the batch operator folds it in."""
    qty = F.col("quantity")
    return (
        trades(stream).withWatermark("ts", delay)
        .groupBy(S.KEY, F.window("ts", interval))
        .agg(
            F.min_by("price_ticks", "seq").alias("open"), F.max("price_ticks").alias("high"),
            F.min("price_ticks").alias("low"), F.max_by("price_ticks", "seq").alias("close"),
            F.sum(qty).alias("volume"), F.sum(signed_quantity()).alias("delta"), F.count(F.lit(1)).alias("trades"),
        )
        .select(
            S.KEY, F.unix_micros("window.start").alias("start_us"), F.unix_micros("window.end").alias("end_us"),
            "open", "high", "low", "close", "volume", "delta", "trades",
        )
    )


def stream_profile(stream: DataFrame, interval: str = "1 hour", delay: str = "10 seconds") -> DataFrame:
    """Growing volume profile per window; run in update mode."""
    qty, zero = F.col("quantity"), F.lit(0).cast("long")
    return (
        trades(stream).withWatermark("ts", delay)
        .groupBy(S.KEY, F.window("ts", interval), "price_ticks")
        .agg(
            F.sum(F.when(F.col("aggressor") == S.BUY, qty).otherwise(zero)).alias("buy"),
            F.sum(F.when(F.col("aggressor") == S.SELL, qty).otherwise(zero)).alias("sell"),
            F.sum(F.when(F.col("aggressor") == S.UNKNOWN, qty).otherwise(zero)).alias("unknown"),
        )
        .select(S.KEY, F.unix_micros("window.start").alias("start_us"), "price_ticks", "buy", "sell", "unknown")
    )


def stream_tape_speed(stream: DataFrame, long: int = 60, short: int = 5, delay: str = "10 seconds") -> DataFrame:
    """Tape speed every ``short`` seconds: rates of the last ``short`` and the last ``long`` seconds."""
    qty = F.col("quantity")
    windowed = trades(stream).withWatermark("ts", delay).withColumn(
        "_w", F.window("ts", f"{long} seconds", f"{short} seconds")
    )
    is_late = F.unix_micros("ts") >= F.unix_micros("_w.end") - F.lit(short * 1_000_000)
    counted = windowed.groupBy(S.KEY, "_w").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(is_late).alias("_short_n"),
        F.sum(F.when(is_late, qty).otherwise(F.lit(0).cast("long"))).alias("_short_q"),
    )
    return counted.select(
        S.KEY, F.unix_micros("_w.start").alias("start_us"), F.unix_micros("_w.end").alias("end_us"),
        (F.col("_short_n") / F.lit(float(short))).alias("trades_per_second"),
        (F.col("_short_q") / F.lit(float(short))).alias("contracts_per_second"),
        (F.col("_n") / F.lit(float(long))).alias("trades_per_second_long"),
    ).withColumn("acceleration", F.col("trades_per_second") / F.col("trades_per_second_long"))


def stream_activity_sessions(stream: DataFrame, gap: str = "5 seconds", delay: str = "10 seconds") -> DataFrame:
    """Stretches of activity separated by silence of at least ``gap``."""
    return (
        stream.withWatermark("ts", delay).groupBy(S.KEY, F.session_window("ts", gap))
        .agg(F.count(F.lit(1)).alias("events"))
        .select(S.KEY, F.unix_micros("session_window.start").alias("start_us"),
                F.unix_micros("session_window.end").alias("end_us"), "events")
    )


def stream_record(stream: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Record a live stream in session layout, each event exactly once."""
    return (
        as_recorded(stream).writeStream.format("parquet").partitionBy(*PARTITIONS)
        .option("path", path).option("checkpointLocation", checkpoint)
    )
