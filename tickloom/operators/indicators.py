"""Technical indicators over bar series.

Bars carry ``idx``, their dense position in the series of their instrument.
Finite look-backs run on slices with a copied tail (``plans.lookback``);
exponential averages on discounted blocks (``plans.decay``).  A value is NULL
until enough bars have been seen.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.plans import running, sum_
from tickloom.plans.decay import averages, ema as ema_, rma as rma_
from tickloom.plans.lookback import lookback

AT = F.col


def price_source(source: str) -> Column:
    """One price of a bar; ``typical`` and ``hlc3`` are the same."""
    o, h, l, c = (F.col(n).cast("double") for n in ("open", "high", "low", "close"))
    return {
        "close": c, "open": o, "high": h, "low": l,
        "hl2": (h + l) / 2.0, "hlc3": (h + l + c) / 3.0, "typical": (h + l + c) / 3.0,
        "ohlc4": (o + h + l + c) / 4.0, "weighted_close": (h + l + 2.0 * c) / 4.0,
    }[source.lower()]


def with_price(bars: DataFrame, source: str = "close", name: str = "price") -> DataFrame:
    return bars.withColumn(name, price_source(source))


def _last(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1 - n, 0)


def _ready(value: Column, first: int) -> Column:
    return F.when(F.col("idx") >= first, value)


def _with(bars: DataFrame, depth: int, columns) -> DataFrame:
    """Add windowed columns; ``columns(w)`` is a list of stages computed in order."""

    def compute(df: DataFrame, w: WindowSpec) -> DataFrame:
        for stage in columns(w):
            df = df.withColumns(stage)
        return df

    return lookback(bars, [S.KEY], depth, compute)


def _weighted(value: Column, w: WindowSpec, p: int) -> Column:
    """Linear weights 1..p, the newest heaviest."""
    recent = F.collect_list(value).over(_last(w, p))
    weighted = F.transform(recent, lambda x, i: x * (i + 1))
    return F.aggregate(weighted, F.lit(0.0), lambda a, x: a + x) / F.lit(p * (p + 1) / 2.0)


def sma(bars: DataFrame, col: str | Column, p: int, name: str = "sma") -> DataFrame:
    x = F.col(col) if isinstance(col, str) else col
    return _with(bars, p - 1, lambda w: [{name: _ready(F.avg(x.cast("double")).over(_last(w, p)), p - 1)}])


def wma(bars: DataFrame, col: str | Column, p: int, name: str = "wma") -> DataFrame:
    x = F.col(col) if isinstance(col, str) else col
    return _with(bars, p - 1, lambda w: [{name: _ready(_weighted(x.cast("double"), w, p), p - 1)}])


def ema(bars: DataFrame, col: str | Column, p: int, name: str = "ema") -> DataFrame:
    return averages(bars, [S.KEY], **{name: ema_(col, p)})


def rma(bars: DataFrame, col: str | Column, p: int, name: str = "rma") -> DataFrame:
    return averages(bars, [S.KEY], **{name: rma_(col, p)})


def hma(bars: DataFrame, col: str | Column, p: int, name: str = "hma") -> DataFrame:
    """Weighted average over round(sqrt p) of 2 * wma(p/2) - wma(p)."""
    x = (F.col(col) if isinstance(col, str) else col).cast("double")
    half, root = max(1, p // 2), max(1, round(math.sqrt(p)))
    return _with(
        bars, p + root - 2,
        lambda w: [
            {"_raw": 2.0 * _weighted(x, w, half) - _weighted(x, w, p)},
            {name: _ready(_weighted(F.col("_raw"), w, root), p + root - 2)},
        ],
    ).drop("_raw")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9) -> DataFrame:
    line = averages(bars, [S.KEY], _fast=ema_(price_source("close"), fast), _slow=ema_(price_source("close"), slow))
    line = line.withColumn("macd", F.col("_fast") - F.col("_slow")).drop("_fast", "_slow")
    return averages(line, [S.KEY], signal=ema_("macd", signal, start=max(fast, slow) - 1)).withColumn(
        "histogram", F.col("macd") - F.col("signal")
    )


def bollinger(bars: DataFrame, p: int = 20, k: float = 2.0) -> DataFrame:
    """Mean and k population standard deviations around it."""

    def stages(w):
        recent = _last(w, p)
        return [
            {"bb_middle": _ready(F.avg(price_source("close")).over(recent), p - 1),
             "_sd": F.stddev_pop(price_source("close")).over(recent)},
            {"bb_upper": F.col("bb_middle") + k * F.col("_sd"), "bb_lower": F.col("bb_middle") - k * F.col("_sd")},
            {"bb_width": F.when(F.col("bb_middle") == 0, 0.0).otherwise(
                (F.col("bb_upper") - F.col("bb_lower")) / F.col("bb_middle"))},
        ]

    return _with(bars, p - 1, stages).drop("_sd")


def donchian(bars: DataFrame, p: int = 20) -> DataFrame:
    def stages(w):
        recent = _last(w, p)
        return [
            {"dc_upper": _ready(F.max("high").over(recent), p - 1), "dc_lower": _ready(F.min("low").over(recent), p - 1)},
            {"dc_middle": (F.col("dc_upper") + F.col("dc_lower")) / 2.0},
        ]

    return _with(bars, p - 1, stages)


def _true_range(before: Column) -> Column:
    spread = F.col("high") - F.col("low")
    return F.coalesce(
        F.greatest(spread, F.abs(F.col("high") - before), F.abs(F.col("low") - before)), spread
    ).cast("double")


def true_range(bars: DataFrame) -> DataFrame:
    return _with(bars, 1, lambda w: [{"tr": F.when(F.col("idx") > 0, _true_range(F.lag("close").over(w))).otherwise(
        (F.col("high") - F.col("low")).cast("double"))}])


def atr(bars: DataFrame, p: int = 14) -> DataFrame:
    return averages(true_range(bars), [S.KEY], atr=rma_("tr", p))


def keltner(bars: DataFrame, ema_period: int = 20, atr_period: int = 10, k: float = 2.0, source: str = "close") -> DataFrame:
    both = averages(
        true_range(bars), [S.KEY], _mid=ema_(price_source(source), ema_period), _atr=rma_("tr", atr_period)
    )
    middle = F.when(F.col("_atr").isNotNull(), F.col("_mid"))
    return both.withColumns(
        {"kc_middle": middle, "kc_upper": middle + k * F.col("_atr"), "kc_lower": middle - k * F.col("_atr")}
    ).drop("_mid", "_atr")


def _directional(w: WindowSpec) -> list[dict[str, Column]]:
    up = F.col("high") - F.lag("high").over(w)
    down = F.lag("low").over(w) - F.col("low")
    return [
        {"_up": up, "_down": down, "_tr1": _true_range(F.lag("close").over(w))},
        {
            "_plus": F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0).cast("double"),
            "_minus": F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0).cast("double"),
        },
    ]


def _adx_lines(df: DataFrame, p: int) -> DataFrame:
    """Directional lines from the averages ``_a``, ``_p``, ``_m``."""

    def share(c: str) -> Column:
        return F.when(F.col("_a") <= 0, 0.0).otherwise(100.0 * F.col(c) / F.col("_a"))

    total = F.col("plus_di") + F.col("minus_di")
    return df.withColumns({"plus_di": share("_p"), "minus_di": share("_m")}).withColumn(
        "_dx", F.when(total <= 0, 0.0).otherwise(100.0 * F.abs(F.col("plus_di") - F.col("minus_di")) / total)
    ).withColumns(
        {c: F.when(F.col("idx") >= p, F.col(c)) for c in ("plus_di", "minus_di", "_dx")}
    )


def adx(bars: DataFrame, p: int = 14) -> DataFrame:
    moves = _with(bars, 1, _directional)
    smoothed = averages(
        moves, [S.KEY], _a=rma_("_tr1", p, start=1), _p=rma_("_plus", p, start=1), _m=rma_("_minus", p, start=1)
    )
    out = averages(_adx_lines(smoothed, p), [S.KEY], adx=rma_("_dx", p, start=p))
    return out.withColumn("adx", F.greatest(F.lit(0.0), F.least(F.lit(100.0), "adx")) + F.col("adx") * 0).drop(
        "_up", "_down", "_tr1", "_plus", "_minus", "_a", "_p", "_m", "_dx"
    )


def _rsi(gain: str, loss: str) -> Column:
    strength = F.when(F.col(loss) <= 0, 100.0).otherwise(100.0 - 100.0 / (1.0 + F.col(gain) / F.col(loss)))
    return F.when(F.col(gain).isNotNull(), strength)


def rsi(bars: DataFrame, p: int = 14, source: str = "close") -> DataFrame:
    change = price_source(source) - F.col("_before")
    moved = _with(bars, 1, lambda w: [{"_before": F.lag(price_source(source)).over(w)},
                                      {"_gain": F.greatest(F.lit(0.0), change), "_loss": F.greatest(F.lit(0.0), -change)}])
    out = averages(moved, [S.KEY], _g=rma_("_gain", p, start=1), _l=rma_("_loss", p, start=1))
    return out.withColumn("rsi", _rsi("_g", "_l")).drop("_before", "_gain", "_loss", "_g", "_l")


def _stochastic(w: WindowSpec, p: int, smooth_k: int, smooth_d: int) -> list[dict[str, Column]]:
    high, low = F.max("high").over(_last(w, p)), F.min("low").over(_last(w, p))
    first_k = p + smooth_k - 2
    return [
        {"_hi": high, "_lo": low},
        {"_raw": F.when(F.col("_hi") <= F.col("_lo"), 50.0).otherwise(
            100.0 * (F.col("close") - F.col("_lo")) / (F.col("_hi") - F.col("_lo")))},
        {"stoch_k": _ready(F.avg("_raw").over(_last(w, smooth_k)), first_k)},
        {"stoch_d": _ready(F.avg("stoch_k").over(_last(w, smooth_d)), first_k + smooth_d - 1)},
    ]


def stochastic(bars: DataFrame, p: int = 14, smooth_k: int = 3, smooth_d: int = 3) -> DataFrame:
    return _with(bars, p + smooth_k + smooth_d - 3, lambda w: _stochastic(w, p, smooth_k, smooth_d)).drop("_hi", "_lo", "_raw")


def _cci(w: WindowSpec, p: int) -> list[dict[str, Column]]:
    recent = _last(w, p)
    tp = price_source("typical")
    spread = F.aggregate("_recent", F.lit(0.0), lambda a, x: a + F.abs(x - F.col("_mean"))) / p
    return [
        {"_mean": F.avg(tp).over(recent), "_recent": F.collect_list(tp).over(recent)},
        {"_mad": spread},
        {"cci": _ready(F.when(F.col("_mad") <= 0, 0.0).otherwise((tp - F.col("_mean")) / (0.015 * F.col("_mad"))), p - 1)},
    ]


def cci(bars: DataFrame, p: int = 20) -> DataFrame:
    return _with(bars, p - 1, lambda w: _cci(w, p)).drop("_mean", "_recent", "_mad")


def roc(bars: DataFrame, p: int = 9) -> DataFrame:
    past = F.col("_past")
    return _with(bars, p, lambda w: [
        {"_past": F.lag(price_source("close"), p).over(w)},
        {"roc": F.when(past == 0, 0.0).otherwise(100.0 * (price_source("close") - past) / past)},
    ]).drop("_past")


def momentum(bars: DataFrame, p: int = 10) -> DataFrame:
    return _with(bars, p, lambda w: [{"momentum": price_source("close") - F.lag(price_source("close"), p).over(w)}])


def chaikin_ad(bars: DataFrame) -> DataFrame:
    """Running accumulation/distribution; flat or empty bars add nothing."""
    spread = F.col("high") - F.col("low")
    lean = (2 * F.col("close") - F.col("low") - F.col("high")) / spread
    step = F.when((spread > 0) & (F.col("volume") > 0), lean * F.col("volume")).otherwise(0.0)
    return running(bars, [S.KEY], order="idx", chaikin_ad=sum_(step))


# Codes of the indicator set.
CODES = ("MA", "BB", "DC", "KC", "RSI", "MACD", "ADX", "ATR", "STOCH", "CCI", "ROC", "MOM")


def indicator_frame(bars: DataFrame, codes: Sequence[str] = CODES) -> DataFrame:
    """Selected indicators with their default periods, aligned to the bars.

    All finite look-backs share one pass and one sort; exponential averages
    share a second pass, and those built on other averages a third.
    """
    codes = [c.upper() for c in codes]
    out: list[str] = []
    close = price_source("close")

    def finite(w: WindowSpec) -> list[dict[str, Column]]:
        stages = [
            {"_before": F.lag(close).over(w), "_tr": F.when(F.col("idx") > 0, _true_range(F.lag("close").over(w))).otherwise((F.col("high") - F.col("low")).cast("double"))},
            {"_gain": F.greatest(F.lit(0.0), close - F.col("_before")), "_loss": F.greatest(F.lit(0.0), F.col("_before") - close)},
        ]
        if "ADX" in codes:
            stages += _directional(w)
        if "BB" in codes:
            recent = _last(w, 20)
            stages += [{"bb_middle": _ready(F.avg(close).over(recent), 19), "_sd": F.stddev_pop(close).over(recent)},
                       {"bb_upper": F.col("bb_middle") + 2.0 * F.col("_sd"), "bb_lower": F.col("bb_middle") - 2.0 * F.col("_sd")}]
        if "DC" in codes:
            stages += [{"dc_upper": _ready(F.max("high").over(_last(w, 20)), 19), "dc_lower": _ready(F.min("low").over(_last(w, 20)), 19)}]
        if "STOCH" in codes:
            stages += _stochastic(w, 14, 3, 3)
        if "CCI" in codes:
            stages += _cci(w, 20)
        if "ROC" in codes:
            stages += [{"_past": F.lag(close, 9).over(w)},
                       {"roc": F.when(F.col("_past") == 0, 0.0).otherwise(100.0 * (close - F.col("_past")) / F.col("_past"))}]
        if "MOM" in codes:
            stages += [{"momentum": close - F.lag(close, 10).over(w)}]
        return stages

    frame = _with(bars, 26, finite)
    first = {}
    if "MA" in codes or "KC" in codes:
        first["ma"] = ema_(close, 20)
    if "KC" in codes:
        first["_atr10"] = rma_("_tr", 10)
    if "RSI" in codes:
        first |= {"_g": rma_("_gain", 14, start=1), "_l": rma_("_loss", 14, start=1)}
    if "MACD" in codes:
        first |= {"_fast": ema_(close, 12), "_slow": ema_(close, 26)}
    if "ATR" in codes:
        first["atr"] = rma_("_tr", 14)
    if "ADX" in codes:
        first |= {"_a": rma_("_tr1", 14, start=1), "_p": rma_("_plus", 14, start=1), "_m": rma_("_minus", 14, start=1)}
    if first:
        frame = averages(frame, [S.KEY], **first)
    second = {}
    if "KC" in codes:
        frame = frame.withColumns({"kc_upper": F.col("ma") + 2.0 * F.col("_atr10"), "kc_lower": F.col("ma") - 2.0 * F.col("_atr10")})
    if "RSI" in codes:
        frame = frame.withColumn("rsi", _rsi("_g", "_l"))
    if "MACD" in codes:
        frame = frame.withColumn("macd", F.col("_fast") - F.col("_slow"))
        second["signal"] = ema_("macd", 9, start=25)
    if "ADX" in codes:
        frame = _adx_lines(frame, 14)
        second["adx"] = rma_("_dx", 14, start=14)
    if second:
        frame = averages(frame, [S.KEY], **second)
    out = [c for c in frame.columns if not c.startswith("_")]
    return frame.select(*out)
