"""Gaps, daily ranges and opening ranges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.plans.lookback import lookback


def fair_value_gap(bars: DataFrame, min_ticks: int = 1) -> DataFrame:
    """Price bands skipped between a bar and the one two before it."""
    least = max(1, min_ticks)
    seen = lookback(
        bars, [S.KEY], 2,
        lambda df, w: df.withColumns({"_high": F.lag("high", 2).over(w), "_low": F.lag("low", 2).over(w)}),
    )
    up = F.col("low") - F.col("_high") >= least
    down = F.col("_low") - F.col("high") >= least
    return seen.where(up | down).select(
        S.KEY, "bar_id", "end_us",
        F.when(up, "Bullish").otherwise("Bearish").alias("direction"),
        F.when(up, F.col("low")).otherwise(F.col("_low")).alias("top"),
        F.when(up, F.col("_high")).otherwise(F.col("high")).alias("bottom"),
    ).withColumn("size", F.col("top") - F.col("bottom"))


def daily_bars(dated_trades: DataFrame) -> DataFrame:
    """One bar per trading date."""
    return dated_trades.groupBy(S.KEY, "trading_date").agg(
        F.min_by("price_ticks", "seq").alias("open"),
        F.max("price_ticks").alias("high"),
        F.min("price_ticks").alias("low"),
        F.max_by("price_ticks", "seq").alias("close"),
        F.sum("quantity").alias("volume"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    )


def session_gap(daily: DataFrame, min_ticks: int = 1) -> DataFrame:
    """Open against the previous close; ``daily`` is indexed (``idx``)."""
    least = max(1, min_ticks)
    gap = F.col("open") - F.col("previous_close")
    seen = lookback(daily, [S.KEY], 1, lambda df, w: df.withColumn("previous_close", F.lag("close").over(w)))
    size = F.abs(gap)
    return seen.where(F.col("previous_close").isNotNull()).select(
        S.KEY, "trading_date", "previous_close", "open",
        F.when(size < least, "None").when(gap > 0, "Bullish").otherwise("Bearish").alias("direction"),
        F.when(size < least, 0).otherwise(size).cast("long").alias("size"),
    )


def average_daily_range(daily: DataFrame, n: int = 14) -> DataFrame:
    """Mean of the last ``n`` daily ranges at most, and targets half of it away from the open."""
    spread = F.greatest(F.col("high") - F.col("low"), F.lit(0))
    seen = lookback(
        daily, [S.KEY], n - 1,
        lambda df, w: df.withColumn("adr", F.avg(spread).over(w.rowsBetween(1 - n, 0))),
    )
    half = F.bround(F.col("adr") / 2.0, 0).cast("long")
    return seen.select(
        S.KEY, "trading_date", "adr", (F.col("open") + half).alias("up_target"), (F.col("open") - half).alias("down_target")
    )


def opening_range(trades: DataFrame, end_us: Column, keys: list[str]) -> DataFrame:
    """High and low of the trades before ``end_us``."""
    early = F.col("ts_us") < end_us
    return trades.groupBy(*keys).agg(
        F.max(F.when(early, F.col("price_ticks"))).alias("or_high"),
        F.min(F.when(early, F.col("price_ticks"))).alias("or_low"),
    ).withColumn("is_established", F.col("or_high").isNotNull())


def opening_range_breakout(trades: DataFrame, end_us: Column, keys: list[str]) -> DataFrame:
    """First trade after the range that leaves it, per session."""
    ranges = opening_range(trades, end_us, keys).where("is_established")
    outside = F.when(F.col("price_ticks") > F.col("or_high"), "Bullish").when(
        F.col("price_ticks") < F.col("or_low"), "Bearish"
    )
    late = trades.where(F.col("ts_us") >= end_us).select(*keys, "seq", "ts_us", "price_ticks")
    broken = late.join(ranges, keys).withColumn("direction", outside).where(F.col("direction").isNotNull())
    first = F.min(F.struct("seq", "ts_us", "price_ticks", "direction")).alias("_f")
    return broken.groupBy(*keys, "or_high", "or_low").agg(first).select(
        *keys, "or_high", "or_low", "_f.seq", "_f.ts_us", "_f.price_ticks", "_f.direction"
    )
