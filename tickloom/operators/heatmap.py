"""Liquidity over time: column intervals per level, cells only for the range asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators.bars import trade_columns
from tickloom.plans import first_, running, whole

LEVEL = ["instrument_id", "side", "price_ticks"]


def heat_intervals(df: DataFrame, interval_us: int = 250_000) -> DataFrame:
    """Size of each level per stretch of columns [from_col, to_col).

    Columns count from the first depth update of the instrument; the last size
    in a column counts, and it stands until changed.
    """
    if "ts_us" not in df.columns:
        df = df.withColumn("ts_us", F.unix_micros("ts"))
    quotes = df.where(F.col("type").isin(S.BID_UPDATE, S.ASK_UPDATE)).select(
        S.KEY, (F.col("type") - 5).cast("int").alias("side"), "price_ticks", "seq", "ts_us", "quantity"
    )
    span = quotes.groupBy(S.KEY).agg(F.min("ts_us").alias("_t0"), F.max("ts_us").alias("_t1"))
    placed = quotes.join(span, S.KEY).withColumn("col", whole(F.col("ts_us") - F.col("_t0"), interval_us))
    last = placed.groupBy(*LEVEL, "col", "_t0", "_t1").agg(F.max_by("quantity", "seq").alias("size"))
    chained = running(last, LEVEL, order="col", _next=first_("col", exclusive=True))
    end = whole(F.col("_t1") - F.col("_t0"), interval_us)
    return chained.where(F.col("size") > 0).select(
        *LEVEL, "size", F.col("col").alias("from_col"), F.coalesce("_next", end + 1).alias("to_col"),
        end.alias("last_col"), F.col("_t0").alias("origin_us"),
    )


def clipped(intervals: DataFrame, start: int | None = None, end: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Intervals inside columns [start, end]; of the newest ``max_columns`` only if a number is given."""
    low = F.lit(0 if start is None else start).cast("long")
    if max_columns is not None:
        low = F.greatest(F.col("last_col") - max_columns + 1, low)
    high = F.least(F.col("last_col"), F.col("last_col") if end is None else F.lit(end))
    return intervals.withColumns(
        {"from_col": F.greatest("from_col", low), "to_col": F.least("to_col", high + 1)}
    ).where(F.col("from_col") < F.col("to_col"))


def liquidity_heatmap(intervals: DataFrame, start: int | None = None, end: int | None = None, max_columns: int | None = None) -> DataFrame:
    """Cells (column, side, price, size) of the asked columns, all of them by default."""
    cut = clipped(intervals, start, end, max_columns)
    return cut.select(
        S.KEY, F.explode(F.sequence(F.col("from_col"), F.col("to_col") - 1)).alias("col"), "side", "price_ticks", "size"
    )


def heatmap_retention(intervals: DataFrame, max_columns: int = 4096) -> DataFrame:
    """What a display that keeps the newest ``max_columns`` columns still holds."""
    return clipped(intervals, max_columns=max_columns)


def heatmap_scale(intervals: DataFrame) -> DataFrame:
    """Upper end of the colour scale per instrument: largest, 95th percentile (nearest rank), logarithmic.

    Taken from intervals weighted by their length, one row per distinct size.
    """
    weight = F.col("to_col") - F.col("from_col")
    sizes = intervals.groupBy(S.KEY, "size").agg(F.sum(weight).alias("_n"))
    key = Window.partitionBy(S.KEY)
    upto = key.orderBy("size").rowsBetween(Window.unboundedPreceding, 0)
    ranked = sizes.withColumns({"_upto": F.sum("_n").over(upto), "_all": F.sum("_n").over(key)})
    reached = F.col("_upto") >= F.greatest(F.lit(1), F.ceil(F.lit(0.95) * F.col("_all")))
    return ranked.groupBy(S.KEY).agg(
        F.max("size").cast("double").alias("absolute"),
        F.greatest(F.lit(1), F.min(F.when(reached, F.col("size")))).cast("double").alias("percentile"),
        F.log1p(F.max("size")).alias("logarithmic"),
    )


def heatmap_intensity(size: Column, top: Column, scale: str = "absolute") -> Column:
    value = F.log1p(size) if scale == "logarithmic" else size.cast("double")
    return F.when((size <= 0) | (top <= 0), 0.0).otherwise(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(value, top)))
    )


def column_mid(cells: DataFrame, window: DataFrame) -> DataFrame:
    """Middle of each column's best bid and ask; the other side, or the window's centre, where one is missing."""
    bid = F.max(F.when(F.col("side") == S.BID, F.col("price_ticks")))
    ask = F.min(F.when(F.col("side") == S.ASK, F.col("price_ticks")))
    best = cells.groupBy(S.KEY, "col").agg(bid.alias("_bid"), ask.alias("_ask"))
    centre = F.floor((F.col("lo") + F.col("hi")) / 2)
    return best.join(F.broadcast(window), S.KEY).select(
        S.KEY, "col",
        F.coalesce(F.floor((F.col("_bid") + F.col("_ask")) / 2), "_bid", "_ask", centre).cast("long").alias("mid"),
    )


def price_window(intervals: DataFrame, columns: int = 80) -> DataFrame:
    """Price range of the newest columns with a margin."""
    recent = clipped(intervals, max_columns=columns).groupBy(S.KEY).agg(
        F.min("price_ticks").alias("_lo"), F.max("price_ticks").alias("_hi")
    )
    pad = F.greatest(F.lit(4), F.floor((F.col("_hi") - F.col("_lo")) / 12)).cast("long")
    return recent.select(S.KEY, (F.col("_lo") - pad).alias("lo"), (F.col("_hi") + pad).alias("hi"))


def default_window(mids: DataFrame) -> DataFrame:
    """Window of an empty heatmap: 80 ticks around the given ``mid``."""
    pad = 4 + F.lit(0)
    return mids.select(
        S.KEY, (F.col("mid") - 80 - F.greatest(pad, F.lit(160 // 12))).alias("lo"),
        (F.col("mid") + 80 + F.greatest(pad, F.lit(160 // 12))).alias("hi"),
    )


def heatmap_cells(
    cells: DataFrame, scale: DataFrame, window: DataFrame, min_size: int = 1, mode: str = "absolute",
    least_intensity: float = 0.0,
) -> DataFrame:
    """Cells to draw: both sides merged, inside the price window, coloured by position around the middle.

    Cells fainter than ``least_intensity`` are left out; by default none is.

    Windows and scales have a row per instrument and go to every task. Cells meet
    their column's middle by shuffle: the planner takes cells for as small as the
    intervals they are spread from and would send them all through the driver.
    """
    inside = cells.join(F.broadcast(window), S.KEY).where((F.col("price_ticks") >= F.col("lo")) & (F.col("price_ticks") < F.col("hi")))
    merged = inside.groupBy(S.KEY, "col", "price_ticks").agg(F.sum("size").alias("size")).where(F.col("size") >= min_size)
    lit = merged.hint("merge").join(column_mid(cells, window), [S.KEY, "col"]).join(
        F.broadcast(scale.select(S.KEY, F.col(mode).alias("_top"))), S.KEY
    )
    return lit.withColumn("intensity", heatmap_intensity(F.col("size"), F.col("_top"), mode)).where(
        F.col("intensity") >= least_intensity
    ).select(S.KEY, "col", "price_ticks", "size", (F.col("price_ticks") < F.col("mid")).alias("is_below"), "intensity")


def resting_walls(intervals: DataFrame, window: DataFrame, min_size: int = 1) -> DataFrame:
    """Largest levels standing in the latest column."""
    latest = intervals.where(F.col("to_col") > F.col("last_col"))
    top = latest.groupBy(S.KEY).agg(F.greatest(F.lit(1).cast("long"), F.max("size")).alias("_top"))
    limit = F.greatest(F.lit(min_size).cast("long"), F.floor(F.col("_top") * 0.55).cast("long"))
    return latest.join(top, S.KEY).join(window, S.KEY).where(
        (F.col("price_ticks") >= F.col("lo")) & (F.col("price_ticks") < F.col("hi")) & (F.col("size") >= limit)
    ).select(*LEVEL, "size", F.least(F.lit(1.0), F.col("size") / F.col("_top")).alias("strength"))


def _bucketed(df: DataFrame, start_us: int, end_us: int, buckets: int) -> DataFrame:
    steps = max(1, buckets - 1)
    seconds = max(0.001, (end_us - start_us) / 1e6)
    at = (F.col("ts_us") - start_us) / F.lit(1e6) / F.lit(seconds) * F.lit(float(steps))
    bucket = F.greatest(F.lit(0.0), F.least(F.lit(float(steps)), at)).cast("int")
    return trade_columns(df).where(F.col("ts_us") >= start_us).withColumn("bucket", bucket)


def _sides() -> list[Column]:
    buy = F.col("aggressor") == S.BUY
    zero = F.lit(0).cast("long")
    return [
        F.sum(F.when(buy, F.col("quantity")).otherwise(zero)).alias("buy"),
        F.sum(F.when(buy, zero).otherwise(F.col("quantity"))).alias("sell"),
    ]


def trade_bubbles(df: DataFrame, start_us: int, end_us: int, buckets: int) -> DataFrame:
    """Trades per time bucket and price; the radius follows the square root of the share of the largest."""
    dots = _bucketed(df, start_us, end_us, buckets).groupBy(S.KEY, "bucket", "price_ticks").agg(*_sides())
    dots = dots.withColumn("total", F.col("buy") + F.col("sell"))
    top = dots.groupBy(S.KEY).agg(F.greatest(F.lit(1).cast("long"), F.max("total")).alias("_top"))
    radius = 2.4 + F.sqrt(F.col("total") / F.col("_top")) * 16.0
    return dots.join(top, S.KEY).select(
        S.KEY, "bucket", "price_ticks", "buy", "sell", (F.col("buy") >= F.col("sell")).alias("is_buy"),
        F.greatest(F.lit(2.4), F.least(F.lit(18.0), radius)).alias("radius"),
    )


def volume_histogram(df: DataFrame, start_us: int, end_us: int, buckets: int) -> DataFrame:
    return _bucketed(df, start_us, end_us, buckets).groupBy(S.KEY, "bucket").agg(*_sides())
