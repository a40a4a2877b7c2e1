"""Order-flow detectors.  All return rows of the same detection shape."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators.bars import trade_columns
from tickloom.plans import count_, last_, materialize, max_, min_, numbered, previous, running, sum_
from tickloom.plans.grouped import grouped_map
from tickloom.plans.lookback import lookback
from tickloom.plans.order_statistic import OrderStatistic
from tickloom.plans.resets import BandLimit, SweepLimit, TimeLimit, restarting
from tickloom.plans.scan import slice_of, slice_rows
from tickloom.plans.sliding import before_window

MS, SECOND = 1_000, 1_000_000


# -- settings (fixed values: the default thresholds) ------------------------

@dataclass(frozen=True)
class LargeTrade:
    fixed: int = 50
    percentile: float | None = 0.98
    window: int = 500
    warm_up: int = 20


@dataclass(frozen=True)
class Sweep:
    min_levels: int = 3
    max_gap_us: int = 750 * MS
    min_volume: int = 30


@dataclass(frozen=True)
class Absorption:
    min_volume: int = 200
    max_move: int = 2
    window_us: int = 5 * SECOND


@dataclass(frozen=True)
class Iceberg:
    ratio: float = 4.0
    min_executed: int = 100


@dataclass(frozen=True)
class Replenishment:
    times: int = 3
    min_size: int = 20
    window_us: int = 10 * SECOND


@dataclass(frozen=True)
class StopRun:
    lookback_us: int = 300 * SECOND
    buffer: int = 1
    burst: float = 2.0
    short_us: int = 3 * SECOND
    cooldown_us: int = 10 * SECOND
    min_prints: int = 10


@dataclass(frozen=True)
class MarketRegime:
    window_us: int = 10 * SECOND
    quiet: float = 2.0
    normal: float = 10.0
    fast: float = 30.0


@dataclass(frozen=True)
class DeltaDivergence:
    bars: int = 10


LARGE_TRADE_BY_ROOT = {"NQ": LargeTrade(fixed=50), "ES": LargeTrade(fixed=75)}


def _detection(
    df: DataFrame, name: str, bias: Column, text: Column, measurements: dict[str, Column],
    estimated: bool = False, price: str = "price_ticks",
) -> DataFrame:
    pairs = [x for k, v in measurements.items() for x in (F.lit(k), v.cast("double"))]
    label = F.concat(text, F.lit(" (Estimated)")) if estimated else text
    return df.select(
        S.KEY, F.lit(name).alias("detector"), "seq", F.timestamp_micros("ts_us").alias("ts"),
        F.col(price).alias("price_ticks"), bias.alias("bias"), F.lit(estimated).alias("is_estimated"),
        label.alias("text"), F.create_map(*pairs).alias("measurements"),
    )


def _clock(df: DataFrame) -> DataFrame:
    return df if "ts_us" in df.columns else df.withColumn("ts_us", F.unix_micros("ts"))


def _bias(buy: str = "Bullish", other: str = "Bearish") -> Column:
    return F.when(F.col("aggressor") == S.BUY, buy).otherwise(other)


# -- large trade --------------------------------------------------------------

def large_trade(df: DataFrame, s: LargeTrade = LargeTrade()) -> DataFrame:
    """Prints of at least the fixed size that also reach the percentile of the prints before them.

    The percentile (nearest rank) is looked up for candidates only, all of a
    slice at once, on slices that carry the tail of the slice before.
    """
    trades = trade_columns(df)
    if s.percentile is None:
        hit = trades.where(F.col("quantity") >= s.fixed).withColumn("threshold", F.lit(s.fixed).cast("long"))
    else:
        rows = slice_rows(df.sparkSession)
        indexed = numbered(trades, [S.KEY])
        own = slice_of("idx", rows)
        spread = indexed.withColumn(
            "_slice", F.explode(F.sequence(own, slice_of(F.col("idx") + s.window, rows)))
        )
        fixed, window, warm_up, share = s.fixed, s.window, s.warm_up, s.percentile
        columns = [*trades.columns, "threshold"]

        def candidates(pdf: pd.DataFrame) -> pd.DataFrame:
            size, idx = pdf["quantity"].to_numpy(), pdf["idx"].to_numpy()
            mine = np.flatnonzero((idx // rows == pdf["_slice"].iloc[0]) & (size >= fixed))
            low = np.maximum(0, mine - window)
            count = mine - low
            rank = np.clip(np.ceil(share * count).astype(np.int64) - 1, 0, np.maximum(count - 1, 0))
            warm = (count >= warm_up) & (count > 0)
            p = np.full(len(mine), fixed, dtype=np.int64)
            if warm.any():
                p[warm] = OrderStatistic(size).ranked(low[warm], mine[warm], rank[warm])
            threshold, good = np.maximum(fixed, p), ~warm | (size[mine] >= p)
            out = pdf.iloc[mine].copy()
            out["threshold"] = threshold
            return out.loc[good, columns]

        schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in trades.schema) + ", threshold bigint"
        hit = grouped_map(spread, [S.KEY, "_slice"], ["idx"], candidates, schema)
    text = F.format_string("Large trade %d (threshold %d)", "quantity", "threshold")
    return _detection(hit, "Large Trade", _bias(), text, {"size": F.col("quantity"), "threshold": F.col("threshold")})


# -- sweep --------------------------------------------------------------------

def sweep_runs(df: DataFrame, s: Sweep = Sweep()) -> DataFrame:
    """Prints with a known aggressor and the run (``run_id``) each belongs to."""
    eligible = trade_columns(df).where(F.col("aggressor") != S.UNKNOWN)
    chained = previous(eligible, [S.KEY], _side="aggressor", _ts="ts_us", _price="price_ticks")
    onward = F.when(F.col("aggressor") == S.BUY, F.col("price_ticks") >= F.col("_price")).otherwise(
        F.col("price_ticks") <= F.col("_price")
    )
    continues = (F.col("_side") == F.col("aggressor")) & (F.col("ts_us") - F.col("_ts") <= s.max_gap_us) & onward
    marked = chained.withColumns(
        {
            "is_break": (~F.coalesce(continues, F.lit(False))).cast("long"),
            "is_step": F.coalesce(F.col("price_ticks") != F.col("_price"), F.lit(False)).cast("long"),
        }
    ).drop("_side", "_ts", "_price")
    return restarting(marked, [S.KEY], SweepLimit(s.min_volume, s.min_levels), out="run_id")


def sweep(df: DataFrame, s: Sweep = Sweep()) -> DataFrame:
    """Same-side prints in quick succession through several prices; each run reports once."""
    return sweeps_of(sweep_runs(df, s), s)


def sweeps_of(runs: DataFrame, s: Sweep) -> DataFrame:
    inner = F.col("seq") > F.col("run_id")
    swept = runs.groupBy(S.KEY, "run_id").agg(
        (1 + F.sum(F.when(inner, F.col("is_step")).otherwise(0))).alias("levels"),
        F.sum("quantity").alias("volume"),
        F.count(F.lit(1)).alias("prints"),
        F.min_by("price_ticks", "seq").alias("start_price"),
        F.min("ts_us").alias("start_us"),
        F.max_by("price_ticks", "seq").alias("price_ticks"),
        F.max("ts_us").alias("ts_us"),
        F.max("seq").alias("seq"),
        F.first("aggressor").alias("aggressor"),
    ).where((F.col("levels") >= s.min_levels) & (F.col("volume") >= s.min_volume) & (F.col("prints") > 1))
    text = F.concat(
        F.lit("Sweep "), F.when(F.col("aggressor") == S.BUY, "up").otherwise("down"),
        F.format_string(" %d levels, vol %d", "levels", "volume"),
    )
    return _detection(swept, "Sweep", _bias(), text, {
        "levels": F.col("levels"), "volume": F.col("volume"),
        "ticksSpanned": F.abs(F.col("price_ticks") - F.col("start_price")) + 1,
        "durationMs": (F.col("ts_us") - F.col("start_us")) / 1000.0,
    })


# -- absorption ---------------------------------------------------------------

def absorption_windows(df: DataFrame, s: Absorption = Absorption()) -> DataFrame:
    return restarting(trade_columns(df), [S.KEY], BandLimit(s.window_us, s.max_move), out="window_id")


def absorption(df: DataFrame, s: Absorption = Absorption()) -> DataFrame:
    """Heavy volume inside a narrow band; once per anchored window."""
    return absorptions_of(materialize(absorption_windows(df, s), "absorption"), s)


def absorptions_of(windows: DataFrame, s: Absorption) -> DataFrame:
    qty, zero = F.col("quantity"), F.lit(0).cast("long")
    run = running(
        windows, [S.KEY, "window_id"],
        buy=sum_(F.when(F.col("aggressor") == S.BUY, qty).otherwise(zero)),
        sell=sum_(F.when(F.col("aggressor") == S.SELL, qty).otherwise(zero)),
        high=max_("price_ticks"), low=min_("price_ticks"),
    )
    heavy = F.col("buy") + F.col("sell") >= s.min_volume
    first = F.min(F.when(heavy, F.struct("seq", "ts_us", "buy", "sell", (F.col("high") - F.col("low")).alias("move"))))
    fired = run.groupBy(S.KEY, "window_id").agg(
        first.alias("f"), F.min_by("price_ticks", "seq").alias("price_ticks")
    ).where(F.col("f").isNotNull()).select(S.KEY, "price_ticks", "f.*")
    total = F.col("buy") + F.col("sell")
    return _detection(
        fired, "Absorption", F.when(F.col("buy") >= F.col("sell"), "Bearish").otherwise("Bullish"),
        F.format_string("%d traded while the price moved %d ticks", total, F.col("move")),
        {"totalVolume": total, "buyVolume": F.col("buy"), "sellVolume": F.col("sell"), "moveTicks": F.col("move")},
    )


# -- iceberg and replenishment --------------------------------------------------

def iceberg(df: DataFrame, s: Iceberg = Iceberg()) -> DataFrame:
    """Executions at a price far beyond the largest size ever shown there; once per price."""
    is_trade = (F.col("type") == S.TRADE) & (F.col("quantity") > 0)
    is_quote = F.col("type").isin(S.BID_UPDATE, S.ASK_UPDATE) & (F.col("quantity") > 0)
    slim = _clock(df).where(is_trade | is_quote).select(S.KEY, "seq", "ts_us", "type", "price_ticks", "quantity", "aggressor")
    run = running(
        slim, [S.KEY, "price_ticks"],
        executed=sum_(F.when(is_trade, F.col("quantity"))), displayed=max_(F.when(is_quote, F.col("quantity"))),
    )
    fits = is_trade & (F.col("executed") >= s.min_executed) & (F.col("executed") >= s.ratio * F.col("displayed"))
    fired = run.where(fits).groupBy(S.KEY, "price_ticks").agg(
        F.min(F.struct("seq", "ts_us", "aggressor", "executed", "displayed")).alias("f")
    ).select(S.KEY, "price_ticks", "f.*")
    return _detection(
        fired, "Iceberg", _bias("Bearish", "Bullish"),
        F.format_string("%d executed against %d shown", "executed", "displayed"),
        {
            "executed": F.col("executed"), "maxDisplayed": F.col("displayed"),
            "ratio": F.col("executed") / F.col("displayed"),
            "confidence": F.least(F.lit(1.0), F.col("executed") / (F.col("displayed") * s.ratio)),
        },
        estimated=True,
    )


QUOTED = [S.KEY, "type", "price_ticks"]


def replenishment_windows(
    df: DataFrame, s: Replenishment = Replenishment(), before: DataFrame | None = None, least: int = 0
) -> DataFrame:
    """Depth updates with their anchored window and whether they restore an emptied level.

    ``before`` (level, ``_empty``) tells which levels were already empty. Levels
    restored fewer than ``least`` times in all are left out.
    """
    level = QUOTED
    quotes = _clock(df).where(F.col("type").isin(S.BID_UPDATE, S.ASK_UPDATE)).select(
        *level, "seq", "ts_us", F.greatest(F.lit(0).cast("long"), "quantity").alias("size")
    )
    emptied = F.when(F.col("size") == 0, True).when(F.col("size") >= s.min_size, False)
    flagged = running(quotes, level, was_empty=last_(emptied, exclusive=True))
    if before is not None:
        flagged = flagged.join(before, level, "left").withColumn("was_empty", F.coalesce("was_empty", "_empty")).drop("_empty")
    flagged = flagged.withColumn(
        "is_restore", F.coalesce("was_empty", F.lit(False)) & (F.col("size") >= s.min_size)
    ).drop("was_empty")
    if least:
        flagged = materialize(flagged, "levels")
        often = flagged.groupBy(*level).agg(F.count_if("is_restore").alias("_n")).where(F.col("_n") >= least).drop("_n")
        flagged = flagged.join(often, level, "left_semi")
    return restarting(
        flagged, [S.KEY], TimeLimit(s.window_us), out="window_id", within=["type", "price_ticks"]
    )


def replenishment(df: DataFrame, s: Replenishment = Replenishment()) -> DataFrame:
    """A level emptied and restored several times within an anchored window."""
    return replenishments_of(materialize(replenishment_windows(df, s, least=s.times), "replenishment"), s)


def replenishments_of(windows: DataFrame, s: Replenishment) -> DataFrame:
    counted = running(windows, [*QUOTED, "window_id"], restores=count_(F.col("is_restore")))
    fired = counted.where(F.col("is_restore") & (F.col("restores") % s.times == 0))
    return _detection(
        fired, "Replenishment", F.when(F.col("type") == S.BID_UPDATE, "Bullish").otherwise("Bearish"),
        F.lit(f"Refilled {s.times} times in its window"), {"size": F.col("size")},
    )


# -- stop run and regime --------------------------------------------------------

def stop_run(df: DataFrame, s: StopRun = StopRun(), seen: DataFrame | None = None, fires: DataFrame | None = None) -> DataFrame:
    """A break of the recent swing with a burst of volume, at most one per cooldown.

    When continuing a stream, ``seen`` (instrument_id, last_seq) excludes earlier rows
    from firing and ``fires`` (instrument_id, ``_initial``) holds the last fire.
    """
    trades = trade_columns(df)
    one, qty, price = F.lit(1).cast("long"), F.col("quantity"), F.col("price_ticks")
    swing = before_window(
        trades, [S.KEY], s.lookback_us, sums={"_n": one, "_vol": qty, "_short": qty}, maxs={"_hi": price}, mins={"_lo": price},
        widths={"_short": s.short_us},
    )
    peers = running(
        trades, [S.KEY, "ts_us"], _pn=count_(exclusive=True), _pvol=sum_(qty, exclusive=True),
        _phi=max_(price, exclusive=True), _plo=min_(price, exclusive=True),
    )
    zero = F.lit(0).cast("long")
    earlier = F.coalesce("_pvol", zero)
    both = peers.join(swing, [S.KEY, "ts_us"]).select(
        *trades.columns,
        (F.col("_n") + F.coalesce("_pn", zero)).alias("n"),
        F.greatest("_hi", "_phi").alias("swing_high"), F.least("_lo", "_plo").alias("swing_low"),
        ((F.col("_vol") + earlier) / F.lit(max(1.0, s.lookback_us / s.short_us))).alias("avg_burst"),
        (F.col("_short") + earlier + qty).alias("short_volume"),
    )
    up = price >= F.col("swing_high") + s.buffer
    down = price <= F.col("swing_low") - s.buffer
    broken = both.where(
        (F.col("n") >= s.min_prints) & (F.col("short_volume") >= s.burst * F.col("avg_burst")) & (up | down)
    ).withColumn("is_up", up)
    if seen is not None:
        broken = broken.join(seen, S.KEY, "left").where(
            F.col("seq") > F.coalesce("last_seq", F.lit(-1))
        ).drop("last_seq")
    # few rows behind costly windows, read twice below
    broken = materialize(broken, "stop-run")
    fired = restarting(
        broken, [S.KEY], TimeLimit(s.cooldown_us, at_least=True), out="window_id", initial=fires
    ).where(F.col("seq") == F.col("window_id"))
    level = F.when(F.col("is_up"), F.col("swing_high")).otherwise(F.col("swing_low"))
    return _detection(
        fired, "Stop-Run", F.when(F.col("is_up"), "Bullish").otherwise("Bearish"),
        F.concat(F.lit("Burst through the swing "), F.when(F.col("is_up"), "high").otherwise("low")),
        {"swing": level, "breakTicks": F.abs(price - level), "shortVolume": F.col("short_volume"), "avgBurst": F.col("avg_burst")},
    )


def market_regime(df: DataFrame, s: MarketRegime = MarketRegime()) -> DataFrame:
    """Changes between quiet, normal, fast and extreme trading."""
    is_trade = F.col("type") == S.TRADE
    is_quote = F.col("type").isin(S.BID_UPDATE, S.ASK_UPDATE)
    price = F.col("price_ticks")
    events = running(
        _clock(df).select(S.KEY, "seq", "ts_us", "type", "price_ticks"), [S.KEY],
        _last=last_(F.when(is_trade, price), exclusive=True),
        _bid=last_(F.when(F.col("type") == S.BID_UPDATE, price)),
        _ask=last_(F.when(F.col("type") == S.ASK_UPDATE, price)),
    )
    zero, one = F.lit(0).cast("long"), F.lit(1).cast("long")
    move = price - F.col("_last")
    events = events.withColumn("_d2", F.when(is_trade, F.coalesce(move * move, zero)))
    trades, quotes = F.when(is_trade, one).otherwise(zero), F.when(is_quote, one).otherwise(zero)
    before = before_window(
        events, [S.KEY], s.window_us, sums={"_bt": trades, "_bq": quotes, "_bs": F.coalesce("_d2", zero)},
        firsts={"_bf": F.col("_d2")},
    )
    at = running(
        events, [S.KEY, "ts_us"], _t=sum_(trades), _q=sum_(quotes), _s=sum_(F.coalesce("_d2", zero)),
        _f=min_(F.when(is_trade, F.struct("seq", "_d2"))),
    )
    seconds = s.window_us / SECOND
    n = F.col("_bt") + F.col("_t")
    first = F.when(F.col("_bt") > 0, F.col("_bf")).otherwise(F.col("_f._d2"))
    rated = at.join(before, [S.KEY, "ts_us"]).select(
        S.KEY, "seq", "ts_us", "price_ticks",
        (n / seconds).alias("tps"), ((F.col("_bq") + F.col("_q")) / seconds).alias("ups"),
        F.when(n < 2, 0.0).otherwise(F.sqrt((F.col("_bs") + F.col("_s") - first) / F.nullif(n - 1, zero))).alias("vol"),
        F.when((F.col("_bid") > 0) & (F.col("_ask") > 0), F.col("_ask") - F.col("_bid")).otherwise(zero).alias("spread"),
    )
    tps = F.col("tps")
    named = rated.withColumn(
        "regime",
        F.when(tps <= s.quiet, "Quiet").when(tps <= s.normal, "Normal").when(tps <= s.fast, "Fast").otherwise("Extreme"),
    )
    named = materialize(named, "regime")
    changed = previous(named, [S.KEY], _was="regime").where(F.col("regime") != F.coalesce("_was", F.lit("Quiet")))
    return _detection(
        changed, "Market Regime", F.lit("None"),
        F.concat(F.lit("Regime → "), "regime", F.format_string(" (%.1f trades/s)", "tps")),
        {"tradesPerSecond": tps, "bookUpdatesPerSecond": F.col("ups"), "realizedVolTicks": F.col("vol"), "spreadTicks": F.col("spread")},
    )


# -- delta divergence -------------------------------------------------------------

def delta_divergence(bars: DataFrame, s: DeltaDivergence = DeltaDivergence()) -> DataFrame:
    """A new high (low) of the last bars whose delta does not confirm it."""

    def swings(df: DataFrame, w) -> DataFrame:
        prior = w.rowsBetween(-s.bars, -1)
        return df.withColumns(
            {
                "_hi": F.max(F.struct(F.col("high").alias("p"), (-F.col("idx")).alias("i"), F.col("delta").alias("d"))).over(prior),
                "_lo": F.min(F.struct(F.col("low").alias("p"), F.col("idx").alias("i"), F.col("delta").alias("d"))).over(prior),
            }
        )

    seen = lookback(bars, [S.KEY], s.bars, swings).where(F.col("idx") >= s.bars)
    down = (F.col("high") > F.col("_hi.p")) & (F.col("delta") < F.col("_hi.d"))
    up = (F.col("low") < F.col("_lo.p")) & (F.col("delta") > F.col("_lo.d"))
    fired = seen.where(down | up).select(
        S.KEY, F.col("last_seq").alias("seq"), F.col("end_us").alias("ts_us"),
        F.when(down, F.col("high")).otherwise(F.col("low")).alias("price_ticks"),
        down.alias("is_down"), "delta", F.when(down, F.col("_hi.d")).otherwise(F.col("_lo.d")).alias("swing_delta"),
    )
    return _detection(
        fired, "Delta Divergence", F.when(F.col("is_down"), "Bearish").otherwise("Bullish"),
        F.when(F.col("is_down"), "Higher high with weaker delta").otherwise("Lower low with stronger delta"),
        {"curDelta": F.col("delta"), "swingDelta": F.col("swing_delta")},
    )


# -- all together -------------------------------------------------------------------

@dataclass(frozen=True)
class Detector:
    """Registry entry: what a detector reads and how to run it."""

    name: str
    tooltip: str
    run: Callable
    settings: object
    on_bars: bool = False


DETECTORS = {
    d.name: d
    for d in [
        Detector("Large Trade", "Unusually large prints by fixed size and rolling percentile.", large_trade, LargeTrade()),
        Detector("Sweep", "Aggressive run through several price levels in a short time.", sweep, Sweep()),
        Detector("Absorption", "Heavy volume held within a tight price band.", absorption, Absorption()),
        Detector("Iceberg", "Executed volume far above the displayed size; an estimate.", iceberg, Iceberg()),
        Detector("Replenishment", "A level repeatedly emptied and restored.", replenishment, Replenishment()),
        Detector("Stop-Run", "Break of a swing level with a volume burst.", stop_run, StopRun()),
        Detector("Market Regime", "Trade rate classes with volatility and spread.", market_regime, MarketRegime()),
        Detector("Delta Divergence", "New extreme without confirming delta.", delta_divergence, DeltaDivergence(), on_bars=True),
    ]
}


def register_detector(detector: Detector) -> None:
    DETECTORS[detector.name] = detector


def detect_all(
    df: DataFrame, bars: DataFrame, enabled: Sequence[str] | None = None, settings: dict[str, object] | None = None
) -> DataFrame:
    """Detections of every enabled detector."""
    settings = settings or {}
    out = None
    for name in enabled if enabled is not None else DETECTORS:
        d = DETECTORS[name]
        found = d.run(bars if d.on_bars else df, settings.get(name, d.settings))
        out = found if out is None else out.unionByName(found)
    return out


def recent(detections: DataFrame, n: int) -> DataFrame:
    """Newest first."""
    return detections.orderBy(F.col("ts").desc(), F.col("seq").desc(), "detector", S.KEY).limit(n)


def detection_counts(detections: DataFrame) -> DataFrame:
    return detections.groupBy("detector").agg(F.count(F.lit(1)).alias("detections"))
