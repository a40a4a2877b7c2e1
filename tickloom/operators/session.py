"""Session state, its digest, and reproducibility."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators import bars as bars_, book, flow, profile, tape_view
from tickloom.operators.quality import trades as trades_

STATE = ["events", "trades", "best_bid", "best_ask", "cvd", "poc", "last_close", "completed_bars", "vwap_milli"]


def session_state(df: DataFrame, interval_us: int = 60_000_000) -> DataFrame:
    """Where a session ended up, one row per instrument."""
    is_trade = F.col("type") == S.TRADE
    traded = is_trade & (F.col("quantity") > 0)
    wide = flow.WIDE
    pq = F.when(traded, F.col("price_ticks") * F.col("quantity")).cast(wide)
    totals = df.groupBy(S.KEY).agg(
        F.count(F.lit(1)).alias("events"),
        F.count_if(is_trade).alias("trades"),
        F.sum(F.when(traded, flow.signed_quantity()).otherwise(0)).alias("cvd"),
        F.max_by("price_ticks", F.when(traded, F.col("seq"))).alias("last_close"),
        F.sum(pq).alias("_pv"),
        F.sum(F.when(traded, F.col("quantity"))).alias("_v"),
    )
    levels = book.book_levels_asof(df)
    best = levels.groupBy(S.KEY).agg(
        F.max(F.when(F.col("side") == S.BID, F.col("price_ticks"))).alias("best_bid"),
        F.min(F.when(F.col("side") == S.ASK, F.col("price_ticks"))).alias("best_ask"),
    )
    counted = bars_.assign_time(df, interval_us).groupBy(S.KEY, "bar_id").agg(F.lit(1).alias("_one")).groupBy(S.KEY).agg(
        (F.count(F.lit(1)) - 1).alias("completed_bars")
    )
    poc = profile.poc(profile.volume_profile(trades_(df)))
    vwap = F.try_divide(F.col("_pv").cast("double"), F.col("_v").cast("double"))
    return (
        totals.join(best, S.KEY, "left").join(poc, S.KEY, "left").join(counted, S.KEY, "left")
        .withColumn("vwap_milli", F.coalesce(F.bround(vwap * 1000, 0).cast("long"), F.lit(0).cast("long")))
        .select(S.KEY, *STATE)
    )


def session_digest(state: DataFrame) -> DataFrame:
    """MD5 of each instrument's state, its values in the order of STATE joined by ``|`` (null: empty)."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in STATE]
    return state.select(S.KEY, F.md5(F.concat_ws("|", *parts)).alias("digest"))


def verify_reproducible(df: DataFrame) -> DataFrame:
    """Digests of the same events under two unrelated partitionings and row orders."""
    one = session_digest(session_state(df))
    shuffled = df.repartition(7, F.xxhash64("price_ticks", "quantity")).sortWithinPartitions(F.col("quantity").desc())
    two = session_digest(session_state(shuffled)).withColumnRenamed("digest", "second_digest")
    return one.join(two, S.KEY, "full").withColumn("is_same", F.equal_null("digest", "second_digest"))


def market_snapshot(
    df: DataFrame, at: int, bars: DataFrame, detections: DataFrame | None = None, prints: int = 100, rungs: int = 20,
) -> dict[str, DataFrame]:
    """The assembled view as of sequence ``at``; each part is planned only when used.

    ``prints`` trades of the tape and ``rungs`` price steps around the market are shown.
    """
    seen = df.where(F.col("seq") <= at)
    traded = trades_(seen)
    levels = book.book_levels_asof(seen)
    volume = profile.volume_profile(traded)
    area = profile.value_area(volume)
    parts = {
        "bars": bars.where(F.col("first_seq") <= at),
        "book": levels,
        "dom": book.dom_ladder(levels, volume, area, rungs),
        "profile": volume,
        "value_area": area,
        "cvd": traded.groupBy(S.KEY).agg(F.sum(flow.signed_quantity()).alias("cvd")),
        "vwap": flow.vwap_total(traded, [S.KEY]),
        "tape": tape_view.time_and_sales(seen, prints),
    }
    if detections is not None:
        parts["detections"] = detections.where(F.col("seq") <= at)
    return parts
