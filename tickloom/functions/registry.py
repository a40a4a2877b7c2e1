"""Registries of indicators, bar builders, studies and footprint presets; users add their own entries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from tickloom.operators import bars as b
from tickloom.operators import detectors, flow, price_action, profile, tape_view
from tickloom.operators import footprint as fp
from tickloom.operators import indicators as i


@dataclass(frozen=True)
class Indicator:
    """``run(bars, **params)`` adds columns; ``needs`` are the bar columns it reads."""

    id: str
    name: str
    category: str
    run: Callable[..., DataFrame]
    needs: tuple[str, ...] = ("idx", "open", "high", "low", "close")
    overlay: bool = False
    warm_up: int = 0


OHLC = ("idx", "open", "high", "low", "close")
INDICATORS: dict[str, Indicator] = {}


def register_indicator(indicator: Indicator) -> None:
    INDICATORS[indicator.id.lower()] = indicator


for _entry in [
    Indicator("ma", "Moving Average", "Trend", lambda bars, p=20: i.ema(bars, "close", p, "ma"), overlay=True, warm_up=20),
    Indicator("macd", "MACD", "Trend", i.macd, warm_up=34),
    Indicator("adx", "Average Directional Index", "Trend", i.adx, warm_up=28),
    Indicator("atr", "Average True Range", "Volatility", i.atr, warm_up=14),
    Indicator("bb", "Bollinger Bands", "Volatility", i.bollinger, overlay=True, warm_up=20),
    Indicator("dc", "Donchian Channel", "Volatility", i.donchian, overlay=True, warm_up=20),
    Indicator("kc", "Keltner Channel", "Volatility", i.keltner, overlay=True, warm_up=20),
    Indicator("rsi", "RSI", "Momentum", i.rsi, warm_up=15),
    Indicator("stoch", "Stochastic Oscillator", "Momentum", i.stochastic, warm_up=18),
    Indicator("cci", "Commodity Channel Index", "Momentum", i.cci, warm_up=20),
    Indicator("roc", "Rate of Change", "Momentum", i.roc, warm_up=10),
    Indicator("mom", "Momentum", "Momentum", i.momentum, warm_up=11),
]:
    register_indicator(_entry)


def missing_columns(df: DataFrame, needs: tuple[str, ...]) -> list[str]:
    return [c for c in needs if c not in df.columns]


def run_indicator(id: str, bars: DataFrame, **params) -> DataFrame:
    """Look up by id in any case, check the data it needs, apply."""
    entry = INDICATORS[id.lower()]
    lacking = missing_columns(bars, entry.needs)
    if lacking:
        raise ValueError(f"{entry.name} needs columns {lacking}")
    return entry.run(bars, **params)


def list_indicators(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(
        [(e.id, e.name, e.category, e.overlay, e.warm_up, list(e.needs)) for e in INDICATORS.values()],
        "id string, name string, category string, overlay boolean, warm_up int, needs array<string>",
    )


# Bar builders: name -> f(events, size) returning bars.
BARS: dict[str, Callable[[DataFrame, int], DataFrame]] = {
    "time": b.time_bars, "tick": b.tick_bars, "volume": b.volume_bars, "range": b.range_bars,
}


def register_bars(name: str, build: Callable[[DataFrame, int], DataFrame]) -> None:
    BARS[name] = build


# Study codes by group, with the operator that computes each; None would mean that there is none yet.
STUDIES: dict[str, dict[str, Callable | None]] = {
    "Volume & Profile": {
        "VBP": profile.volume_profile, "VOL": b.bar_volume_strip, "BAC": profile.bid_ask_profile, "DP": profile.delta_profile,
        "TPO": profile.tpo_profile, "VPS": profile.value_area, "VWAP": flow.vwap,
    },
    "Order Flow & Tape": {
        "FP": fp.footprint_bar, "IMB": fp.imbalance_markers, "CVD": flow.cvd, "LT": detectors.large_trade, "ICE": detectors.iceberg,
        "SOT": tape_view.tape_speed, "SR": detectors.stop_run,
    },
    "Technical & Price Action": {
        "FVG": price_action.fair_value_gap, "ORB": price_action.opening_range_breakout, "ADR": price_action.average_daily_range,
        "MTF": b.resample_bars, "AD": i.chaikin_ad, "GAP": price_action.session_gap,
    },
    "Technical Indicators": {
        "MA": i.sma, "BB": i.bollinger, "DC": i.donchian, "KC": i.keltner, "RSI": i.rsi, "MACD": i.macd, "ADX": i.adx, "ATR": i.atr,
        "STOCH": i.stochastic, "CCI": i.cci, "ROC": i.roc, "MOM": i.momentum,
    },
}


def list_studies(spark: SparkSession) -> DataFrame:
    """Every study with its operator and whether this engine has one."""
    rows = [
        (code, group, "available" if run else "missing", f"{run.__module__.rpartition('.')[2]}.{run.__name__}" if run else None)
        for group, codes in STUDIES.items() for code, run in codes.items()
    ]
    return spark.createDataFrame(rows, "code string, category string, status string, operator string")


@dataclass(frozen=True)
class Preset:
    """A named way to show a footprint: cell metric, background, thresholds."""

    name: str
    mode: str
    background: str = "none"
    settings: fp.FootprintSettings = field(default_factory=fp.FootprintSettings)

    def for_root(self, root: str) -> fp.FootprintSettings:
        """The preset with the thresholds of an instrument."""
        own = fp.ES if root == "ES" else fp.NQ
        return replace(self.settings, large_trade=own.large_trade, min_imbalance=own.min_imbalance).validated()


# Built-in presets as (name, cell mode, background).
PRESETS = {
    name: Preset(name, mode, background)
    for name, mode, background in [
        ("Classic Bid×Ask", "bid_ask", "none"),
        ("Bid×Ask Heat", "bid_ask", "delta"),
        ("Delta Footprint", "delta", "delta"),
        ("Delta Profile", "delta", "none"),
        ("Volume Profile", "volume_profile", "none"),
        ("Bid/Ask Profile", "bid_ask", "none"),
        ("Minimal", "bid_ask", "none"),
        ("Order-Flow Ladder", "bid_ask", "none"),
        ("Large Trades", "total", "total"),
        ("Imbalance Map", "bid_ask", "none"),
        ("Volume + Delta Hybrid", "total", "delta"),
        ("Clean Replay Study", "bid_ask", "none"),
    ]
}


def list_presets(spark: SparkSession) -> DataFrame:
    rows = [(p.name, p.mode, p.background, p.settings.large_trade, p.settings.min_imbalance) for p in PRESETS.values()]
    return spark.createDataFrame(rows, "name string, mode string, background string, large_trade bigint, min_imbalance bigint")


def preset_cells(levels: DataFrame, name: str) -> DataFrame:
    """Cells of a footprint under a preset, found by name in any case."""
    preset = next(p for p in PRESETS.values() if p.name.lower() == name.lower())
    return fp.cell_intensity(levels, preset.mode, preset.background)
