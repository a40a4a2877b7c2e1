"""Bars: assign trades to bars, then aggregate natively."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators.quality import trades
from tickloom.plans import last_, max_, numbered, running, whole
from tickloom.plans.resets import RangeLimit, VolumeLimit, restarting

TRADE_COLUMNS = ["instrument_id", "seq", "ts_us", "price_ticks", "quantity", "aggressor"]


def trade_columns(df: DataFrame, *extra: str) -> DataFrame:
    """The pruned trade rows bars need."""
    if "ts_us" not in df.columns:
        df = df.withColumn("ts_us", F.unix_micros("ts"))
    return trades(df).select(*TRADE_COLUMNS, *extra)


# ``session`` names a column whose change force-closes bars, in all four kinds.

def assign_time(df: DataFrame, interval_us: int, extra: Sequence[str] = (), session: str | None = None) -> DataFrame:
    """A trade older than the open bar still belongs to the open bar."""
    own = [session] if session else []
    bucketed = trade_columns(df, *extra, *own).withColumn("_bucket", whole("ts_us", interval_us))
    return running(bucketed, [S.KEY, *own], bar_id=max_("_bucket")).drop("_bucket")


def assign_ticks(df: DataFrame, n: int, extra: Sequence[str] = (), session: str | None = None) -> DataFrame:
    """Numbered from 0; with sessions, named by their first sequence."""
    own = [session] if session else []
    counted = numbered(trade_columns(df, *extra, *own), [S.KEY, *own], name="_n")
    if session:
        first = F.when(F.pmod("_n", F.lit(n)) == 0, F.col("seq"))
        return running(counted, [S.KEY, session], bar_id=last_(first)).drop("_n")
    return counted.withColumn("bar_id", whole("_n", n)).drop("_n")


def assign_volume(df: DataFrame, volume: int, session: str | None = None) -> DataFrame:
    """Bars by traded volume."""
    extra = [session] if session else []
    return restarting(trade_columns(df, *extra), [S.KEY, *extra], VolumeLimit(volume))


def assign_range(df: DataFrame, ticks: int, session: str | None = None) -> DataFrame:
    extra = [session] if session else []
    return restarting(trade_columns(df, *extra), [S.KEY, *extra], RangeLimit(ticks))


def build_bars(assigned: DataFrame, kind: str, session: str | None = None) -> DataFrame:
    """OHLCV of trades carrying a ``bar_id`` that grows with time (within ``session`` if given)."""
    qty = F.col("quantity")
    return assigned.groupBy(S.KEY, *([session] if session else []), "bar_id").agg(
        F.lit(kind).alias("kind"),
        F.min_by("ts_us", "seq").alias("start_us"),
        F.max_by("ts_us", "seq").alias("end_us"),
        F.min_by("price_ticks", "seq").alias("open"),
        F.max("price_ticks").alias("high"),
        F.min("price_ticks").alias("low"),
        F.max_by("price_ticks", "seq").alias("close"),
        F.sum(qty).alias("volume"),
        F.sum(F.when(F.col("aggressor") == S.BUY, qty).otherwise(0)).alias("buy"),
        F.sum(F.when(F.col("aggressor") == S.SELL, qty).otherwise(0)).alias("sell"),
        F.count(F.lit(1)).alias("trades"),
        F.min("seq").alias("first_seq"),
        F.max("seq").alias("last_seq"),
    ).withColumn("delta", F.col("buy") - F.col("sell"))


def _closed(bars: DataFrame, full: Column) -> DataFrame:
    """A bar is closed when it is full, or when a later bar of its instrument has begun."""
    newest = bars.groupBy(S.KEY).agg(F.max("last_seq").alias("_newest"))
    return bars.join(newest, S.KEY).withColumn("is_closed", full | (F.col("last_seq") < F.col("_newest"))).drop("_newest")


def time_bars(df: DataFrame, interval_us: int, session: str | None = None) -> DataFrame:
    """Bars of the clock; one ended by its session ends at its last trade, not at the interval's end."""
    bars = _closed(build_bars(assign_time(df, interval_us, session=session), "time", session), F.lit(False))
    ended = F.col("is_closed")
    if session:
        last = bars.groupBy(S.KEY, session).agg(F.max("bar_id").alias("_last"))
        bars = bars.join(last, [S.KEY, session])
        ended = F.col("bar_id") < F.col("_last")
    start = F.col("bar_id") * F.lit(interval_us)
    return bars.withColumn("start_us", start).withColumn(
        "end_us", F.when(ended, start + F.lit(interval_us)).otherwise(F.col("end_us"))
    ).drop("_last")


def tick_bars(df: DataFrame, n: int, session: str | None = None) -> DataFrame:
    return _closed(build_bars(assign_ticks(df, n, session=session), "tick", session), F.col("trades") >= n)


def volume_bars(df: DataFrame, volume: int, session: str | None = None) -> DataFrame:
    return _closed(build_bars(assign_volume(df, volume, session), "volume", session), F.col("volume") >= volume)


def range_bars(df: DataFrame, ticks: int, session: str | None = None) -> DataFrame:
    return _closed(build_bars(assign_range(df, ticks, session), "range", session), F.col("high") - F.col("low") >= ticks)


def close_current(bars: DataFrame) -> DataFrame:
    """Force-close at the end of the tape: the developing bar becomes final."""
    return bars.withColumn("is_closed", F.lit(True))


def developing(bars: DataFrame) -> DataFrame:
    """The bar still open, ending at its latest trade."""
    return bars.where(~F.col("is_closed"))


def bar_index(bars: DataFrame) -> DataFrame:
    """Dense position of each bar in its series."""
    return numbered(bars, [S.KEY], order="last_seq", name="idx")


def bar_volume_strip(bars: DataFrame) -> DataFrame:
    """Volume per bar with its direction, scaled to the largest bar of the series."""
    top = bars.groupBy(S.KEY).agg(F.max("volume").alias("_top"))
    return bars.join(top, S.KEY).select(
        S.KEY, "bar_id", "start_us", "volume",
        (F.col("close") >= F.col("open")).alias("is_up"),
        (F.col("volume") / F.greatest(F.col("_top"), F.lit(1))).alias("height"),
    )


def resample_bars(bars: DataFrame, interval_us: int) -> DataFrame:
    """Merge bars into a longer timeframe."""
    bucket = whole("start_us", interval_us)
    merged = bars.groupBy(S.KEY, bucket.alias("bar_id")).agg(
        F.min_by("open", "first_seq").alias("open"),
        F.max("high").alias("high"),
        F.min("low").alias("low"),
        F.max_by("close", "last_seq").alias("close"),
        F.sum("volume").alias("volume"),
        F.sum("buy").alias("buy"),
        F.sum("sell").alias("sell"),
        F.sum("delta").alias("delta"),
        F.sum("trades").alias("trades"),
        F.min("first_seq").alias("first_seq"),
        F.max("last_seq").alias("last_seq"),
    )
    return merged.withColumn("start_us", F.col("bar_id") * F.lit(interval_us))
