"""Time and sales."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators.bars import trade_columns
from tickloom.plans import count_, running, sum_
from tickloom.plans.sliding import before_window


def time_and_sales(
    df: DataFrame, n: int, min_size: int = 0, sides: Sequence[int] = (S.UNKNOWN, S.BUY, S.SELL), large: int = 50
) -> DataFrame:
    """Latest ``n`` prints passing the filter, newest first."""
    shown = trade_columns(df).where((F.col("quantity") >= min_size) & F.col("aggressor").isin(*sides))
    return shown.withColumn("is_large", F.col("quantity") >= large).orderBy(
        F.col("ts_us").desc(), F.col("seq").desc(), S.KEY
    ).limit(n)


def running_volume(df: DataFrame) -> DataFrame:
    """Volume so far of all trades, filtered or not."""
    return running(trade_columns(df), [S.KEY], running_volume=sum_("quantity"))


def tape_speed(df: DataFrame, short_us: int = 5_000_000, long_us: int = 60_000_000) -> DataFrame:
    """Prints and contracts per second over a short and a long window, at every trade."""
    if long_us <= short_us:
        raise ValueError("the long window must exceed the short one")
    trades = trade_columns(df)
    one = F.lit(1).cast("long")
    before = before_window(
        trades, [S.KEY], long_us, sums={"_ln": one, "_sn": one, "_sq": F.col("quantity")},
        widths={"_sn": short_us, "_sq": short_us},
    )
    at = running(trades, [S.KEY, "ts_us"], _n=count_(), _q=sum_("quantity"))
    s, l = short_us / 1e6, long_us / 1e6
    both = at.join(before, [S.KEY, "ts_us"])
    return both.select(
        S.KEY, "seq", "ts_us",
        ((F.col("_sn") + F.col("_n")) / F.lit(s)).alias("trades_per_second"),
        ((F.col("_sq") + F.col("_q")) / F.lit(s)).alias("contracts_per_second"),
        ((F.col("_ln") + F.col("_n")) / F.lit(l)).alias("trades_per_second_long"),
    ).withColumn("acceleration", F.coalesce(F.try_divide("trades_per_second", "trades_per_second_long"), F.lit(0.0)))
