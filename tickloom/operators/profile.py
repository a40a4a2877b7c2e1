"""Volume and time profiles over price.

Levels are pre-aggregated to one row per (key, price), so the windows below see
at most as many rows per key as it has distinct prices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.plans import whole

LETTERS = 26


def volume_profile(trades: DataFrame, keys: Sequence[str] = (S.KEY,)) -> DataFrame:
    """Buy, sell and unknown volume per price."""
    qty = F.col("quantity")

    def by(aggressor: int) -> Column:
        return F.sum(F.when(F.col("aggressor") == aggressor, qty).otherwise(F.lit(0).cast("long")))

    return (
        trades.groupBy(*keys, "price_ticks")
        .agg(by(S.BUY).alias("buy"), by(S.SELL).alias("sell"), by(S.UNKNOWN).alias("unknown"))
        .withColumn("total", F.col("buy") + F.col("sell"))
        .withColumn("delta", F.col("buy") - F.col("sell"))
    )


def published(profile: DataFrame) -> DataFrame:
    """Levels shown to users: prices traded only with unknown aggressor are left out."""
    return profile.where(F.col("total") > 0)


def poc(profile: DataFrame, keys: Sequence[str] = (S.KEY,), weight: str = "total") -> DataFrame:
    """Price with the largest weight, the higher one on ties."""
    best = F.max(F.struct(weight, "price_ticks"))
    return profile.where(F.col(weight) > 0).groupBy(*keys).agg(best.alias("_b")).select(
        *keys, F.col("_b.price_ticks").alias("poc")
    )


def _area(levels: DataFrame, keys: Sequence[str], weight: str, target: Column) -> DataFrame:
    """Greedy expansion from the POC, stated as an order.

    The expansion always takes the larger neighbour.  A level is therefore
    reached no earlier than every level nearer to the POC on its side, which
    makes its rank the running minimum walking outward; taking levels by
    (rank, above first, distance) until the target is met gives the same set.
    """
    key = Window.partitionBy(*keys)
    best = F.max(F.struct(F.col(weight), F.col("price_ticks"))).over(key)
    away = F.col("price_ticks") - F.col("poc")
    side = F.signum(away).cast("int")
    outward = Window.partitionBy(*keys, "_side").orderBy(F.abs(away)).rowsBetween(Window.unboundedPreceding, 0)
    taking = Window.partitionBy(*keys).orderBy(
        (F.col("_side") != 0).cast("int"), F.col("_rank").desc(), F.col("_side").desc(), F.abs(away)
    ).rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        levels.withColumn("poc", best["price_ticks"])
        .withColumn("_side", side)
        .withColumn("_rank", F.min(weight).over(outward))
        .withColumn("_before", F.coalesce(F.sum(weight).over(taking), F.lit(0).cast("long")))
    )
    taken = ranked.where((F.col("_side") == 0) | (F.col("_before") < target))
    return taken.groupBy(*keys).agg(
        F.max("poc").alias("poc"), F.min("price_ticks").alias("val"), F.max("price_ticks").alias("vah")
    )


def value_area(profile: DataFrame, pct: float = 0.70, keys: Sequence[str] = (S.KEY,)) -> DataFrame:
    """POC, VAL and VAH.  The target counts unknown volume, the levels do not."""
    key = Window.partitionBy(*keys)
    everything = F.sum(F.col("total") + F.col("unknown")).over(key)
    levels = published(profile.withColumn("_target", F.ceil(everything * F.lit(float(pct)))))
    return _area(levels, keys, "total", F.col("_target"))


def delta_profile(profile: DataFrame, keys: Sequence[str] = (S.KEY,)) -> DataFrame:
    return published(profile).select(*keys, "price_ticks", "delta")


def bid_ask_profile(profile: DataFrame, keys: Sequence[str] = (S.KEY,)) -> DataFrame:
    return published(profile).select(
        *keys, "price_ticks", F.col("sell").alias("at_bid"), F.col("buy").alias("at_ask")
    )


def tpo_profile(
    trades: DataFrame, start_us: str | Column, bracket_us: int = 1_800_000_000, keys: Sequence[str] = (S.KEY,)
) -> DataFrame:
    """Per price: how many half-hour brackets traded there, and their letters."""
    start = F.col(start_us) if isinstance(start_us, str) else start_us
    bracket = whole(F.col("ts_us") - start, bracket_us)
    visits = trades.where(F.col("ts_us") >= start).select(*keys, "price_ticks", bracket.alias("bracket")).distinct()
    letters = F.transform(F.array_sort("brackets"), lambda b: F.char((65 + b % LETTERS).cast("int")))
    return (
        visits.groupBy(*keys, "price_ticks")
        .agg(F.count(F.lit(1)).alias("tpo"), F.collect_list("bracket").alias("brackets"))
        .select(*keys, "price_ticks", "tpo", F.array_join(letters, "").alias("letters"),
                F.array_max("brackets").alias("last_bracket"))
    )


def tpo_poc(tpo: DataFrame, keys: Sequence[str] = (S.KEY,)) -> DataFrame:
    return poc(tpo, keys, "tpo")


def tpo_value_area(tpo: DataFrame, pct: float = 0.70, keys: Sequence[str] = (S.KEY,)) -> DataFrame:
    everything = F.sum("tpo").over(Window.partitionBy(*keys))
    return _area(tpo.withColumn("_target", F.ceil(everything * F.lit(float(pct)))), keys, "tpo", F.col("_target"))


def bracket_count(tpo: DataFrame, keys: Sequence[str] = (S.KEY,)) -> DataFrame:
    return tpo.groupBy(*keys).agg((F.max("last_bracket") + 1).alias("brackets"))
