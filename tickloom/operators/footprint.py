"""Footprints: order flow per bar and price.

Everything starts from levels (one row per bar and price) aggregated with
map-side combine.  Later steps are windows over the prices of one bar.
"""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom import schema as S

BAR = ["instrument_id", "bar_id"]

# Zero-denominator policies and POC metrics.
POLICIES = ("ignore", "require_min_numerator", "extreme_imbalance", "denominator_floor")
POC_METRICS = ("total", "bid", "ask", "abs_delta", "trades")


@dataclass(frozen=True)
class FootprintSettings:
    """Thresholds of the footprint flags; limits of each are in ``validated``."""

    diagonal: bool = True
    horizontal: bool = False
    buy_ratio: float = 3.0
    sell_ratio: float = 3.0
    min_imbalance: int = 1
    zero_denominator: str = "require_min_numerator"
    denominator_floor: int = 1
    stacked_count: int = 3
    allow_one_gap: bool = False
    min_stack_volume: int = 0
    poc_metric: str = "total"
    zero_print_min: int = 1
    zero_print_exclude_extremes: bool = True
    unfinished_min: int = 1
    large_trade: int = 50
    large_trade_percentile: float | None = None

    def validated(self) -> FootprintSettings:
        def within(value, low, high=None):
            return max(low, value if high is None else min(value, high))

        return replace(
            self,
            buy_ratio=within(self.buy_ratio, 1.01, 100.0),
            sell_ratio=within(self.sell_ratio, 1.01, 100.0),
            min_imbalance=within(self.min_imbalance, 0),
            denominator_floor=within(self.denominator_floor, 1),
            stacked_count=within(self.stacked_count, 2, 50),
            min_stack_volume=within(self.min_stack_volume, 0),
            zero_print_min=within(self.zero_print_min, 0),
            unfinished_min=within(self.unfinished_min, 0),
            large_trade=within(self.large_trade, 1),
        )


NQ = FootprintSettings(large_trade=45, min_imbalance=2)
ES = FootprintSettings(large_trade=75, min_imbalance=4)


def settings_table(spark: SparkSession, by_instrument: dict[int, FootprintSettings]) -> DataFrame:
    """Validated thresholds, one row per instrument."""
    names = [f.name for f in fields(FootprintSettings) if f.name != "large_trade_percentile"]
    kinds = {"bool": "boolean", "int": "bigint", "float": "double", "str": "string"}
    types = {f.name: kinds[str(f.type)] for f in fields(FootprintSettings) if f.name in names}
    rows = [
        (key, *[getattr(s.validated(), n) for n in names]) for key, s in sorted(by_instrument.items())
    ]
    schema = "instrument_id int, " + ", ".join(f"{n} {types[n]}" for n in names)
    return spark.createDataFrame(rows, schema)


NAMES = [f.name for f in fields(FootprintSettings) if f.name != "large_trade_percentile"]
#: Least and greatest value of each threshold that has limits.
LIMITS = {
    "buy_ratio": (1.01, 100.0), "sell_ratio": (1.01, 100.0), "min_imbalance": (0, None), "denominator_floor": (1, None), "stacked_count": (2, 50),
    "min_stack_volume": (0, None), "zero_print_min": (0, None), "unfinished_min": (0, None), "large_trade": (1, None),
}


def validated_table(settings: DataFrame) -> DataFrame:
    """A table of thresholds (instrument_id and any of them) with defaults for what is missing or null, all within their limits."""
    default = FootprintSettings()
    columns = []
    for name in NAMES:
        value = F.lit(getattr(default, name))
        if name in settings.columns:
            value = F.coalesce(F.col(name), value)
        low, high = LIMITS.get(name, (None, None))
        value = value if low is None else F.greatest(value, F.lit(low))
        columns.append((value if high is None else F.least(value, F.lit(high))).alias(name))
    return settings.select(S.KEY, *columns)


class Thresholds:
    """Thresholds as columns: of one setting, or of the row's instrument where a table of them was joined."""

    def __init__(self, fixed: FootprintSettings | None = None):
        self._fixed = fixed

    def __getattr__(self, name: str) -> Column:
        return F.col(f"_s_{name}") if self._fixed is None else F.lit(getattr(self._fixed, name))

    def may(self, name: str) -> bool:
        """Whether a switch is on, for any row as far as the plan can tell."""
        return self._fixed is None or bool(getattr(self._fixed, name))


def with_thresholds(levels: DataFrame, settings: FootprintSettings | DataFrame) -> tuple[DataFrame, Thresholds]:
    """Levels ready to be judged by ``settings``: one for all, or a table with a row per instrument (others have no result)."""
    if isinstance(settings, FootprintSettings):
        return levels, Thresholds(settings.validated())
    own = validated_table(settings).select(S.KEY, *[F.col(n).alias(f"_s_{n}") for n in NAMES])
    return levels.join(own, S.KEY), Thresholds()


def _plain(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith("_s_")])


def footprint_levels(assigned: DataFrame) -> DataFrame:
    """Volumes, counts and largest prints per bar and price."""
    qty = F.col("quantity")
    zero = F.lit(0).cast("long")
    bought, sold = F.col("aggressor") == S.BUY, F.col("aggressor") == S.SELL
    levels = assigned.groupBy(*BAR, "price_ticks").agg(
        F.sum(F.when(sold, qty).otherwise(zero)).alias("bid"),
        F.sum(F.when(bought, qty).otherwise(zero)).alias("ask"),
        F.sum(F.when(bought | sold, zero).otherwise(qty)).alias("unknown"),
        F.count(F.lit(1)).alias("trades"),
        F.count_if(bought).alias("buy_trades"),
        F.count_if(sold).alias("sell_trades"),
        F.max(qty).alias("max_print"),
        F.coalesce(F.max(F.when(bought, qty)), zero).alias("largest_buy"),
        F.coalesce(F.max(F.when(sold, qty)), zero).alias("largest_sell"),
    )
    total = F.col("bid") + F.col("ask")
    return levels.withColumn("total", total).withColumn("delta", F.col("ask") - F.col("bid")).withColumn(
        "delta_percent", F.when(F.col("total") > 0, 100.0 * F.col("delta") / F.col("total")).otherwise(0.0)
    )


def published(levels: DataFrame) -> DataFrame:
    return levels.where(F.col("total") > 0)


def _metric(name: str) -> Column:
    return {"bid": F.col("bid"), "ask": F.col("ask"), "abs_delta": F.abs("delta"), "trades": F.col("trades")}.get(
        name, F.col("total")
    )


def _metric_of(t: Thresholds) -> Column:
    out = _metric("total")
    for name in POC_METRICS[1:]:
        out = F.when(t.poc_metric == name, _metric(name)).otherwise(out)
    return out


def footprint_poc(levels: DataFrame, bars: DataFrame, metric: str = "total") -> DataFrame:
    """Price of the largest metric; ties go towards the close, then with the bar's direction."""
    away = -F.abs(F.col("price_ticks") - F.col("close"))
    lean = F.when(F.col("close") >= F.col("open"), F.col("price_ticks")).otherwise(-F.col("price_ticks"))
    best = F.max(F.struct(_metric(metric).alias("m"), away.alias("a"), lean.alias("l"), F.col("price_ticks").alias("p")))
    return (
        published(levels).join(bars.select(*BAR, "open", "close"), BAR)
        .groupBy(*BAR).agg(best.alias("_b")).select(*BAR, F.col("_b.p").alias("poc"))
    )


def qualifies(dominant: Column, compared: Column, ratio: Column | float, t: Thresholds, policy: Column | None = None) -> Column:
    """Whether one side outweighs the other; the policy decides when the other is empty."""
    policy = t.zero_denominator if policy is None else policy
    enough = (dominant >= t.min_imbalance) & (dominant > 0)
    # a volume that is enough meets the required numerator and any empty side
    empty = (policy != "ignore") & ((policy != "denominator_floor") | (dominant >= ratio * t.denominator_floor))
    return enough & F.when(compared <= 0, empty).otherwise(dominant >= ratio * compared)


def _neighbours(levels: DataFrame) -> DataFrame:
    """Bid volume one tick below and ask volume one tick above (0 where no such level)."""
    by_price = Window.partitionBy(*BAR).orderBy("price_ticks")
    zero = F.lit(0).cast("long")
    below = F.when(F.lag("price_ticks").over(by_price) == F.col("price_ticks") - 1, F.lag("bid").over(by_price))
    above = F.when(F.lead("price_ticks").over(by_price) == F.col("price_ticks") + 1, F.lead("ask").over(by_price))
    return levels.withColumn("bid_below", F.coalesce(below, zero)).withColumn("ask_above", F.coalesce(above, zero))


def diagonal_imbalance(levels: DataFrame, settings: FootprintSettings | DataFrame) -> DataFrame:
    levels, t = with_thresholds(levels, settings)
    return _plain(_neighbours(published(levels)).withColumns(
        {
            "buy_imbalance": qualifies(F.col("ask"), F.col("bid_below"), t.buy_ratio, t),
            "sell_imbalance": qualifies(F.col("bid"), F.col("ask_above"), t.sell_ratio, t),
        }
    ))


def horizontal_imbalance(levels: DataFrame, settings: FootprintSettings | DataFrame) -> DataFrame:
    """Same-price comparison; one marker per level, buys first."""
    levels, t = with_thresholds(levels, settings)
    always = F.lit("extreme_imbalance")
    buy = qualifies(F.col("ask"), F.col("bid"), t.buy_ratio, t, always)
    sell = qualifies(F.col("bid"), F.col("ask"), t.sell_ratio, t, always)
    side = F.when(buy, "Buy").when(sell, "Sell")
    return published(levels).withColumn("side", side).where(F.col("side").isNotNull()).select(
        *BAR, "price_ticks", "side",
        F.when(buy, F.col("ask")).otherwise(F.col("bid")).alias("volume"),
        F.when(buy, F.col("bid")).otherwise(F.col("ask")).alias("compared"),
    )


def _imbalance_flags(levels: DataFrame, t: Thresholds) -> DataFrame:
    buy, sell = F.lit(False), F.lit(False)
    if t.may("diagonal"):
        buy = buy | (t.diagonal & qualifies(F.col("ask"), F.col("bid_below"), t.buy_ratio, t))
        sell = sell | (t.diagonal & qualifies(F.col("bid"), F.col("ask_above"), t.sell_ratio, t))
    if t.may("horizontal"):
        buy = buy | (t.horizontal & qualifies(F.col("ask"), F.col("bid"), t.buy_ratio, t))
        sell = sell | (t.horizontal & qualifies(F.col("bid"), F.col("ask"), t.sell_ratio, t))
    return _neighbours(published(levels)).withColumns({"buy_imbalance": buy, "sell_imbalance": sell})


def imbalance_flags(levels: DataFrame, settings: FootprintSettings | DataFrame) -> DataFrame:
    """Buy and sell flags of each level; diagonal and horizontal rules are OR-ed."""
    return _plain(_imbalance_flags(*with_thresholds(levels, settings)))


def imbalance_markers(levels: DataFrame, ratio: float = 3.0, min_volume: int = 1) -> DataFrame:
    """Diagonal imbalances as rows; an empty opposite side always qualifies."""

    def hit(dominant: Column, compared: Column) -> Column:
        return (dominant >= min_volume) & ((compared <= 0) | (dominant >= ratio * compared))

    def marker(side: str, volume: str, compared: str) -> Column:
        return F.when(
            hit(F.col(volume), F.col(compared)),
            F.struct(F.lit(side).alias("side"), F.col(volume).alias("volume"), F.col(compared).alias("compared")),
        )

    both = F.array_compact(F.array(marker("Buy", "ask", "bid_below"), marker("Sell", "bid", "ask_above")))
    return _neighbours(published(levels)).select(*BAR, "price_ticks", F.explode(both).alias("m")).select(
        *BAR, "price_ticks", "m.side", "m.volume", "m.compared"
    )


SIDES = {"Buy": ("buy_imbalance", "ask", "stacked_buy"), "Sell": ("sell_imbalance", "bid", "stacked_sell")}


def _zoned(flags: DataFrame, side: str, t: Thresholds) -> DataFrame:
    """Add the zone of each flagged level of one side, and whether the zone counts.

    Runs of flagged neighbours are islands.  With ``allow_one_gap`` an island
    may join the next one across a single price that did not trade; as a zone
    uses one such gap at most, linked islands pair up in order.  All windows
    share the partitioning by bar.
    """
    name, volume, _ = SIDES[side]
    flag = F.col(name)
    by_price = Window.partitionBy(*BAR).orderBy("price_ticks")
    so_far = by_price.rowsBetween(Window.unboundedPreceding, 0)
    step = F.col("price_ticks") - F.lag("price_ticks").over(by_price)
    before = F.coalesce(F.lag(flag).over(by_price), F.lit(False))
    island_start = F.coalesce(flag & ~(before & (step == 1)), flag)
    chain_start = F.coalesce(flag & ~(before & ((step == 1) | (step == 2))), flag)
    numbered = flags.withColumns({"_start": island_start, "_chain": chain_start}).withColumns(
        {"_i": F.count_if("_start").over(so_far), "_c": F.count_if("_chain").over(so_far)}
    )
    zone = F.struct(F.col("_i").alias("run"), F.lit(0).cast("long").alias("pair"))
    if t.may("allow_one_gap"):
        in_chain = Window.partitionBy(*BAR, "_c")
        first = F.min(F.when(flag, F.col("_i"))).over(in_chain)
        zone = F.when(t.allow_one_gap, F.struct(F.col("_c").alias("run"), F.floor((F.col("_i") - first) / 2).alias("pair"))).otherwise(zone)
    of_zone = Window.partitionBy(*BAR, "_zone")
    counts = (F.count_if(flag).over(of_zone) >= t.stacked_count) & (
        F.sum(F.when(flag, F.col(volume))).over(of_zone) >= t.min_stack_volume
    )
    return (
        numbered.withColumn("_zone", zone).withColumn("_stacked", flag & counts)
        .drop("_start", "_chain", "_i", "_c")
    )


def _stacked_flags(flags: DataFrame, t: Thresholds) -> DataFrame:
    for side, (_, _, stacked) in SIDES.items():
        flags = _zoned(flags, side, t).withColumnsRenamed(
            {"_zone": f"zone_{side.lower()}", "_stacked": stacked}
        )
    return flags


def stacked_flags(flags: DataFrame, settings: FootprintSettings | DataFrame) -> DataFrame:
    """Levels that belong to a zone, flagged per side; ``zone_buy`` and ``zone_sell`` tell which."""
    return _plain(_stacked_flags(*with_thresholds(flags, settings)))


def zones_of(stacked: DataFrame) -> DataFrame:
    """Zones of levels flagged by ``stacked_flags``, one row each."""
    member = F.array_compact(
        F.array(
            *[
                F.when(F.col(name), F.struct(F.lit(side).alias("side"), F.col(f"zone_{side.lower()}").alias("zone")))
                for side, (_, _, name) in SIDES.items()
            ]
        )
    )
    return (
        stacked.select(*BAR, "price_ticks", F.explode(member).alias("m")).groupBy(*BAR, "m")
        .agg(F.min("price_ticks").alias("low"), F.max("price_ticks").alias("high"), F.count(F.lit(1)).alias("levels"))
        .select(*BAR, F.col("m.side").alias("side"), "low", "high", "levels")
    )


def stacked_zones(flags: DataFrame, settings: FootprintSettings | DataFrame) -> DataFrame:
    """Zones of stacked imbalances per bar and side."""
    return zones_of(stacked_flags(flags, settings))


def _with_bar(levels: DataFrame, bars: DataFrame, *columns: str) -> DataFrame:
    return published(levels).join(bars.select(*BAR, *columns), BAR)


def _is_zero_print(t: Thresholds) -> Column:
    one_sided = ((F.col("bid") == 0) & (F.col("ask") >= t.zero_print_min)) | (
        (F.col("ask") == 0) & (F.col("bid") >= t.zero_print_min)
    )
    inner = (F.col("price_ticks") != F.col("high")) & (F.col("price_ticks") != F.col("low"))
    return one_sided & (~t.zero_print_exclude_extremes | inner)


def zero_prints(levels: DataFrame, bars: DataFrame, settings: FootprintSettings | DataFrame) -> DataFrame:
    """Levels where only one side traded."""
    levels, t = with_thresholds(levels, settings)
    return _with_bar(levels, bars, "high", "low").where(_is_zero_print(t)).select(*BAR, "price_ticks", "bid", "ask")


def _unfinished(t: Thresholds) -> tuple[Column, Column]:
    at_high = (F.col("price_ticks") == F.col("high")) & (F.col("bid") >= t.unfinished_min)
    at_low = (F.col("price_ticks") == F.col("low")) & (F.col("ask") >= t.unfinished_min)
    return at_high, at_low


def _auction(hit: Column) -> Column:
    state = F.when(F.col("is_closed"), "Confirmed").otherwise("Developing")
    return F.coalesce(F.max(F.when(hit, state)), F.lit("None"))


def unfinished_auction(levels: DataFrame, bars: DataFrame, settings: FootprintSettings | DataFrame) -> DataFrame:
    """Both sides still trading at an extreme: at the high, at the low."""
    levels, t = with_thresholds(levels, settings)
    at_high, at_low = _unfinished(t)
    return _with_bar(levels, bars, "high", "low", "is_closed").groupBy(*BAR).agg(
        _auction(at_high).alias("unfinished_high"), _auction(at_low).alias("unfinished_low")
    )


def large_trade_levels(levels: DataFrame, settings: FootprintSettings, trades: DataFrame | None = None) -> DataFrame:
    """Levels with a print of at least the fixed size, or of the instrument's size percentile."""
    s = settings.validated()
    shown = published(levels)
    if s.large_trade_percentile is None:
        return shown.where(F.col("max_print") >= s.large_trade).select(*BAR, "price_ticks", "max_print")
    # nearest rank over one row per distinct size
    key = Window.partitionBy(S.KEY)
    sizes = trades.groupBy(S.KEY, "quantity").agg(F.count(F.lit(1)).alias("_n")).withColumns(
        {
            "_upto": F.sum("_n").over(key.orderBy("quantity").rowsBetween(Window.unboundedPreceding, 0)),
            "_all": F.sum("_n").over(key),
        }
    )
    limit = sizes.where(F.col("_upto") >= F.ceil(F.lit(s.large_trade_percentile) * F.col("_all"))).groupBy(S.KEY).agg(
        F.min("quantity").alias("_limit")
    )
    return shown.join(limit, S.KEY).where(F.col("max_print") >= F.col("_limit")).select(
        *BAR, "price_ticks", "max_print"
    )


def footprint_bar(levels: DataFrame, bars: DataFrame, settings: FootprintSettings | DataFrame) -> DataFrame:
    """One row per bar with totals, flags, nested levels and nested zones.

    ``settings`` is one setting for all instruments or a table of thresholds by
    instrument; instruments that it does not have come without flags.
    """
    judged, t = with_thresholds(levels, settings)
    flags = _stacked_flags(_imbalance_flags(judged, t), t)
    at_high, at_low = _unfinished(t)
    marked = (
        flags.join(bars.select(*BAR, "open", "high", "low", "close", "is_closed"), BAR)
        .withColumn("is_zero_print", _is_zero_print(t))
        .withColumn("is_unfinished", at_high | at_low)
        .withColumn("is_large", F.col("max_print") >= t.large_trade)
    )
    away = -F.abs(F.col("price_ticks") - F.col("close"))
    lean = F.when(F.col("close") >= F.col("open"), F.col("price_ticks")).otherwise(-F.col("price_ticks"))
    best = F.max(F.struct(_metric_of(t).alias("m"), away.alias("a"), lean.alias("l"), F.col("price_ticks").alias("p")))
    zero = F.lit(0).cast("long")
    nested = F.struct(
        "price_ticks", "bid", "ask", "unknown", "trades", "max_print", "buy_imbalance", "sell_imbalance",
        "stacked_buy", "stacked_sell", "is_zero_print", "is_unfinished", "is_large",
    )
    rolled = marked.groupBy(*BAR).agg(
        best["p"].alias("poc"),
        F.greatest(zero, F.max("delta")).alias("max_delta"),
        F.least(zero, F.min("delta")).alias("min_delta"),
        F.count_if("buy_imbalance").alias("buy_imbalances"),
        F.count_if("sell_imbalance").alias("sell_imbalances"),
        _auction(at_high).alias("unfinished_high"),
        _auction(at_low).alias("unfinished_low"),
        F.sort_array(F.collect_list(nested)).alias("levels"),
    )
    zones = zones_of(flags).groupBy(*BAR).agg(
        F.count(F.lit(1)).alias("zone_count"),
        F.sort_array(F.collect_list(F.struct("side", "low", "high", F.col("levels").alias("count")))).alias("zones"),
    )
    totals = levels.groupBy(*BAR).agg(F.sum("unknown").alias("unknown"))
    return (
        bars.join(totals, BAR).join(rolled, BAR, "left").join(zones, BAR, "left")
        .withColumn("zone_count", F.coalesce("zone_count", zero))
    )


def footprint_fingerprint(footprints: DataFrame) -> DataFrame:
    """MD5 of each bar's prices, levels and zones as text, the same for any order of its trades within the levels."""
    def text(x: Column) -> Column:
        return F.coalesce(x.cast("string"), F.lit(""))

    levels = F.transform(F.array_sort("levels"), lambda x: F.concat_ws(":", *[text(x[c]) for c in ("price_ticks", "bid", "ask", "unknown", "trades", "max_print")]))
    zones = F.transform(F.array_sort("zones"), lambda z: F.concat_ws(":", *[text(z[c]) for c in ("side", "low", "high", "count")]))
    parts = [text(F.col(c)) for c in ("open", "high", "low", "close", "poc")] + [F.coalesce(F.array_join(x, ","), F.lit("")) for x in (levels, zones)]
    return footprints.select(*BAR, F.md5(F.concat_ws("|", *parts)).alias("fingerprint"))


def cell_metric(mode: str) -> Column:
    """What a footprint cell shows."""
    return {
        "delta": F.abs("delta"), "bid_only": F.col("bid"), "ask_only": F.col("ask"),
        "delta_percent": F.abs("delta_percent"), "trade_count": F.col("trades"),
    }.get(mode, F.col("total")).cast("double")


def cell_background(source: str) -> Column:
    """What a footprint cell's background stands for."""
    return {
        "bid": F.col("bid"), "ask": F.col("ask"), "total": F.col("total"), "delta": F.abs("delta"),
        "abs_delta": F.abs("delta"), "delta_percent": F.abs("delta_percent"), "trade_count": F.col("trades"),
    }.get(source, F.lit(0)).cast("double")


def cell_intensity(levels: DataFrame, mode: str, background: str = "none", norm: str = "per_bar") -> DataFrame:
    """Cell metric and background scaled to 0..1 per bar, or per instrument for ``norm='range'``.

    ``norm`` is ``per_bar``, ``range``, ``log`` or ``sqrt``; the last two use the bar's maximum.
    """
    shown = published(levels).withColumn("metric", cell_metric(mode)).withColumn("magnitude", cell_background(background))
    scope = [S.KEY] if norm == "range" else BAR
    top = shown.groupBy(*scope).agg(
        F.greatest(F.lit(1.0), F.max("metric")).alias("_metric_top"),
        F.greatest(F.lit(1.0), F.max("magnitude")).alias("_magnitude_top"),
    )

    def scaled(value: Column, limit: Column) -> Column:
        if norm == "log":
            ratio = F.log1p(value) / F.log1p(limit)
        elif norm == "sqrt":
            ratio = F.sqrt(value) / F.sqrt(limit)
        else:
            ratio = value / limit
        return F.when(value <= 0, 0.0).otherwise(F.least(F.lit(1.0), ratio))

    return shown.join(top, scope).select(
        *BAR, "price_ticks", "metric",
        scaled(F.col("metric"), F.col("_metric_top")).alias("intensity"),
        scaled(F.col("magnitude"), F.col("_magnitude_top")).alias("background"),
    )
