"""Review tables: notes, bookmarks and manual annotations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.plans.asof import asof

HOUR_SLICE = 2 * 3_600_000_000  # order units (two per microsecond) of one hour


def upsert_latest(df: DataFrame, key: str, version: str, mutable: Sequence[str]) -> DataFrame:
    """Fold repeated saves of a record: ``mutable`` columns take the last value, the others keep the first."""
    rest = [c for c in df.columns if c not in (key, version)]
    return df.groupBy(key).agg(
        *[(F.max_by if c in mutable else F.min_by)(c, version).alias(c) for c in rest],
        F.max(version).alias(version),
    )


def review_query(
    df: DataFrame, root: str | None = None, contract: str | None = None, tag: str | None = None,
    first_date: str | None = None, last_date: str | None = None,
) -> DataFrame:
    """Records matching all given filters, dates inclusive, in time order."""
    if root is not None:
        df = df.where(F.col("root") == root)
    if contract is not None:
        df = df.where(F.col("contract") == contract)
    if tag is not None:
        df = df.where(F.array_contains("tags", tag))
    if first_date is not None:
        df = df.where(F.col("created") >= F.lit(first_date).cast("timestamp_ntz"))
    if last_date is not None:
        df = df.where(F.col("created") < F.date_add(F.lit(last_date).cast("date"), 1).cast("timestamp_ntz"))
    return df.orderBy("created", "id")


def risk_reward(df: DataFrame) -> DataFrame:
    """Distance to target over distance to stop; NULL where either is missing or the risk is zero."""
    risk = F.nullif(F.abs(F.col("entry_ticks") - F.col("stop_ticks")), F.lit(0).cast("long"))
    return df.withColumn("risk_reward", F.abs(F.col("target_ticks") - F.col("entry_ticks")) / risk)


def bookmark_context(bookmarks: DataFrame, bars: DataFrame, cvd: DataFrame) -> DataFrame:
    """What the market looked like at each bookmark's ``replay_us``: latest bar begun and delta so far."""
    by_time = cvd.groupBy(S.KEY, "ts_us").agg(F.max_by("cvd", "seq").alias("cvd"))
    stated = asof(bookmarks, by_time.withColumnRenamed("ts_us", "replay_us"), [S.KEY], "replay_us", ["cvd"], HOUR_SLICE)
    begun = bars.select(S.KEY, F.col("start_us").alias("replay_us"), "bar_id", "close")
    return asof(stated, begun, [S.KEY], "replay_us", ["bar_id", "close"], HOUR_SLICE)


def export_review(df: DataFrame, path: str, format: str = "csv") -> None:
    """CSV (tags joined by pipes, quotes doubled) or JSON lines."""
    if format == "json":
        df.write.mode("overwrite").json(path)
        return
    flat = df
    if "tags" in df.columns:
        flat = flat.withColumn("tags", F.concat_ws("|", "tags"))
    if "risk_reward" in df.columns:
        flat = flat.withColumn("risk_reward", F.when(F.col("risk_reward").isNotNull(), F.format_string("%.2f", "risk_reward"))).withColumn("manual_unverified", F.lit(True))
    flat.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
