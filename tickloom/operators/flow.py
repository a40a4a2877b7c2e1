"""Cumulative delta and volume-weighted average price."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.plans import last_, max_, min_, previous, running, sum_

# Sums of price * price * size outgrow a bigint on long tapes.
WIDE = "decimal(38,0)"


def signed_quantity() -> Column:
    """Buys count up, sells down, unknown aggressors not at all."""
    return (
        F.when(F.col("aggressor") == S.BUY, F.col("quantity"))
        .when(F.col("aggressor") == S.SELL, -F.col("quantity"))
        .otherwise(F.lit(0).cast("long"))
    )


def cvd(trades: DataFrame, reset: Sequence[str] = ()) -> DataFrame:
    """Running delta; ``reset`` names columns (trading date, ...) that restart it."""
    return running(trades, [S.KEY, *reset], cvd=sum_(signed_quantity()))


def cvd_extremes(trades: DataFrame, reset: Sequence[str] = ()) -> DataFrame:
    """Furthest excursions of the running delta so far, both starting at zero."""
    zero = F.lit(0).cast("long")
    out = running(cvd(trades, reset), [S.KEY, *reset], _top=max_("cvd"), _bottom=min_("cvd"))
    return out.withColumns(
        {"max_positive": F.greatest(zero, "_top"), "max_negative": F.least(zero, "_bottom")}
    ).drop("_top", "_bottom")


def cvd_bars(assigned: DataFrame, reset: Sequence[str] = ()) -> DataFrame:
    """Delta candles; each opens where the one before closed."""
    key = [S.KEY, *reset]
    bars = cvd(assigned, reset).groupBy(*key, "bar_id").agg(
        F.max("cvd").alias("_high"),
        F.min("cvd").alias("_low"),
        F.max_by("cvd", "seq").alias("close"),
        F.max("seq").alias("last_seq"),
    )
    chained = previous(bars, key, order="last_seq", _open="close")
    opened = F.coalesce("_open", F.lit(0).cast("long"))
    return chained.select(
        *key, "bar_id", opened.alias("open"),
        F.greatest(opened, "_high").alias("high"), F.least(opened, "_low").alias("low"), "close",
    )


def _sums() -> dict[str, Column]:
    price, size = F.col("price_ticks").cast(WIDE), F.col("quantity")
    return {
        "_v": size,
        "_pv": (F.col("price_ticks") * size).cast(WIDE),
        "_ppv": (price * price * size).cast(WIDE),
    }


def _finish(df: DataFrame, bands: Sequence[float]) -> DataFrame:
    v = F.col("_v").cast("double")
    mean = F.try_divide(F.col("_pv").cast("double"), v)
    spread = F.try_divide(F.col("_ppv").cast("double"), v) - F.col("vwap") * F.col("vwap")
    out = df.withColumn("vwap", mean).withColumn("sd", F.sqrt(F.greatest(F.lit(0.0), spread)))
    for k in bands:
        out = out.withColumns(
            {f"upper_{k:g}": F.col("vwap") + k * F.col("sd"), f"lower_{k:g}": F.col("vwap") - k * F.col("sd")}
        )
    return out.drop("_v", "_pv", "_ppv")


def vwap(trades: DataFrame, reset: Sequence[str] = (), bands: Sequence[float] = ()) -> DataFrame:
    """Running VWAP and its volume-weighted standard deviation."""
    sums = {name: sum_(value) for name, value in _sums().items()}
    return _finish(running(trades, [S.KEY, *reset], **sums), bands)


def vwap_total(trades: DataFrame, keys: Sequence[str]) -> DataFrame:
    """VWAP of whole groups."""
    return _finish(trades.groupBy(*keys).agg(*[F.sum(c).alias(n) for n, c in _sums().items()]), ())


PERIODS = {
    "day": lambda: F.col("trading_date").cast("string"),
    "week": lambda: F.concat_ws("-W", F.expr("extract(yearofweek from trading_date)"), F.expr("extract(week from trading_date)")),
    "month": lambda: F.date_format("trading_date", "yyyy-MM"),
}


def with_period(df: DataFrame, period: str) -> DataFrame:
    """Reset key of a VWAP: ``day``, ``week`` (ISO) or ``month`` of the trading date."""
    return df.withColumn("period", PERIODS[period]())


def periodic_vwap(trades: DataFrame, period: str, bands: Sequence[float] = ()) -> DataFrame:
    return vwap(with_period(trades, period), ["period"], bands)


def vwap_anchored(trades: DataFrame, anchors: DataFrame) -> DataFrame:
    """VWAP from the latest anchor (instrument_id, anchor_seq) on; earlier trades are left out."""
    marks = anchors.select(S.KEY, F.col("anchor_seq").alias("seq"), F.lit(True).alias("_is_mark"))
    union = trades.unionByName(marks.distinct(), allowMissingColumns=True).withColumn(
        "_order", 2 * F.col("seq") + F.when(F.col("_is_mark"), 0).otherwise(1)
    )
    anchored = running(union, [S.KEY], order="_order", anchor_seq=last_(F.when(F.col("_is_mark"), F.col("seq"))))
    kept = anchored.where(F.col("_is_mark").isNull() & F.col("anchor_seq").isNotNull())
    return vwap(kept.drop("_is_mark", "_order"), ["anchor_seq"])


def vwap_by_bar(assigned: DataFrame, reset: Sequence[str] = ()) -> DataFrame:
    """The running VWAP as it stood at each bar's close."""
    return vwap(assigned, reset).groupBy(S.KEY, "bar_id").agg(F.max_by("vwap", "seq").alias("vwap"))
