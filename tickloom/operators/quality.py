"""Normalisation, typed projections and sequence checks."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.plans import max_, previous, running

# Sequence outcomes and contract months.
OK, NO_SEQUENCE, DUPLICATE, GAP = "Ok", "NoSequence", "Duplicate", "Gap"
QUARTER_MONTHS = {"H": 3, "M": 6, "U": 9, "Z": 12}


# -- prices ---------------------------------------------------------------

def with_spec(df: DataFrame, specs: DataFrame) -> DataFrame:
    """Attach the instrument dimension; Spark broadcasts it when its size allows."""
    return df.join(specs.drop("root"), S.KEY)


def to_ticks(df: DataFrame, specs: DataFrame, price: str = "price") -> DataFrame:
    """Nearest tick, halves to even."""
    ratio = F.col(price).cast("decimal(18,6)") / F.col("tick_size")
    return with_spec(df, specs).withColumn("ticks", F.bround(ratio, 0).cast("long"))


def to_price(df: DataFrame, specs: DataFrame, ticks: str = "price_ticks") -> DataFrame:
    return with_spec(df, specs).withColumn(
        "price", (F.col(ticks).cast("decimal(18,0)") * F.col("tick_size")).cast("decimal(24,6)")
    )


def tick_value(df: DataFrame, specs: DataFrame, ticks: str, quantity: str) -> DataFrame:
    """Currency value of a move of ``ticks`` on ``quantity`` contracts."""
    lots = (F.col(ticks) * F.col(quantity)).cast("decimal(18,0)")
    return with_spec(df, specs).withColumn("value", (lots * F.col("tick_currency")).cast("decimal(28,6)"))


def off_tick(df: DataFrame, specs: DataFrame, price: str = "price") -> DataFrame:
    return with_spec(df, specs).withColumn(
        "is_off_tick", F.col(price).cast("decimal(18,6)") % F.col("tick_size") != 0
    )


# -- typed projections ----------------------------------------------------

def trades(df: DataFrame) -> DataFrame:
    return df.where((F.col("type") == S.TRADE) & (F.col("quantity") > 0))


def depth(df: DataFrame) -> DataFrame:
    return df.where(F.col("type").isin(S.ADD, S.MODIFY, S.CANCEL, S.EXECUTE, S.BID_UPDATE, S.ASK_UPDATE))


def control(df: DataFrame) -> DataFrame:
    return df.where(F.col("type") >= S.SNAPSHOT_START)


def has_flag(flag: int) -> Column:
    return F.col("flags").bitwiseAND(F.lit(flag)) == flag


def is_valid_quote() -> Column:
    """Quotes are book rows only, carry a side that fits their type and no negative size."""
    fits = (
        F.when(F.col("type") == S.BID_UPDATE, F.col("side") == S.BID)
        .when(F.col("type") == S.ASK_UPDATE, F.col("side") == S.ASK)
        .when(F.col("type").isin(S.ADD, S.MODIFY, S.CANCEL, S.EXECUTE), F.col("side").isin(S.BID, S.ASK))
        .otherwise(False)
    )
    return fits & (F.col("quantity") >= 0)


def is_valid_event() -> Column:
    """Rows a running pipeline can process; the rest is quarantined."""
    return (
        F.col(S.KEY).isNotNull() & F.col("seq").isNotNull() & F.col("ts").isNotNull()
        & F.col("type").between(S.ADD, S.SEQUENCE_GAP)
        & ((F.col("type") >= S.SNAPSHOT_START) | (F.col("price_ticks").isNotNull() & (F.col("quantity") >= 0)))
    )


def parse_contract(df: DataFrame, col: str = "symbol", roots: Sequence[str] = ("NQ", "ES")) -> DataFrame:
    """Root, month, year of symbols such as NQZ5, NQZ25, NQZ2025; NULL where not understood.

    ``roots`` are those of the instrument dimension; the longest one that fits is taken.
    """
    text = F.upper(F.trim(F.col(col)))
    known = "|".join(re.escape(r) for r in sorted(roots, key=len, reverse=True))
    pattern = rf"^({known})([HMUZ])(\d{{4}}|\d{{2}}|\d)$"
    root, code, digits = (F.regexp_extract(text, pattern, i) for i in (1, 2, 3))
    year = digits.try_cast("int")
    month = F.coalesce(*[F.when(code == c, F.lit(m)) for c, m in QUARTER_MONTHS.items()])
    return (
        df.withColumn("contract_root", F.when(root != "", root))
        .withColumn("contract_month", month)
        .withColumn(
            "contract_year",
            F.when(F.length(digits) == 1, 2020 + year)
            .when(F.length(digits) == 2, 2000 + year)
            .when(F.length(digits) == 4, year),
        )
    )


def estimated_flags(df: DataFrame) -> DataFrame:
    """Aggressor not supplied by the venue; queue analysis needs order ids."""
    estimated = (F.col("type") == S.TRADE) & ~has_flag(S.AGGRESSOR_SUPPLIED)
    return df.withColumns(
        {
            "aggressor_is_estimated": estimated,
            "supports_queue_analysis": F.col("order_id") > 0,
            "aggressor_label": F.concat(
                F.when(F.col("aggressor") == S.BUY, "Buy").when(F.col("aggressor") == S.SELL, "Sell").otherwise("Unknown"),
                F.when(estimated, " (Estimated)").otherwise(""),
            ),
        }
    )


# -- sequence -------------------------------------------------------------

def sequence_audit(
    df: DataFrame, sequence: str = "seq", arrival: str = "seq", before: DataFrame | None = None
) -> DataFrame:
    """Outcome of every event against the highest sequence accepted before it.

    ``arrival`` is the position in which events arrived (recorder ordinal or
    log offset).  Rows without the has-sequence flag neither count nor advance.
    ``before`` (instrument_id, last_sequence) tells what was accepted earlier.
    """
    sequenced = F.when(has_flag(S.HAS_SEQUENCE), F.col(sequence))
    out = running(df, [S.KEY], order=arrival, last_sequence=max_(sequenced, exclusive=True))
    if before is not None:
        known = before.select(S.KEY, F.col("last_sequence").alias("_known"))
        out = out.join(known, S.KEY, "left").withColumn(
            "last_sequence", F.greatest("last_sequence", "_known")
        ).drop("_known")
    last = F.col("last_sequence")
    return out.withColumn(
        "outcome",
        F.when(sequenced.isNull(), NO_SEQUENCE)
        .when(last.isNull(), OK)
        .when(F.col(sequence) <= last, DUPLICATE)
        .when(F.col(sequence) > last + 1, GAP)
        .otherwise(OK),
    )


def clean_stream(
    df: DataFrame, sequence: str = "seq", arrival: str = "seq", before: DataFrame | None = None
) -> DataFrame:
    """Without duplicates, and with a control row ahead of each gapped event.

    ``sub`` orders the control row (0) before its event (1).
    """
    audited = sequence_audit(df, sequence, arrival, before).where(F.col("outcome") != DUPLICATE)
    parts = F.when(F.col("outcome") == GAP, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(1)))
    exploded = audited.withColumn("sub", F.explode(parts))
    is_gap = F.col("sub") == 0
    blank = {
        c: F.when(is_gap, F.lit(0).cast(df.schema[c].dataType)).otherwise(F.col(c))
        for c in ("side", "price_ticks", "quantity", "order_id", "trade_id", "aggressor")
        if c in df.columns
    }
    return exploded.withColumns(
        {"type": F.when(is_gap, S.SEQUENCE_GAP).otherwise(F.col("type")), **blank}
    ).drop("outcome", "last_sequence")


def diagnostic_counters(sequence: str = "seq") -> dict[str, Column]:
    """Aggregates over audited events (``sequence_audit``)."""
    kept = F.col("outcome") != DUPLICATE
    gap = F.col("outcome") == GAP
    return {
        "ingested": F.count(F.lit(1)),
        "processed": F.count_if(kept),
        "gaps": F.count_if(gap),
        "duplicates": F.count_if(~kept),
        "invalidations": F.count_if(gap | (kept & F.col("type").isin(S.BOOK_CLEAR, S.SEQUENCE_GAP))),
        "trades": F.count_if(kept & (F.col("type") == S.TRADE)),
        "depth_updates": F.count_if(kept & F.col("type").isin(S.BID_UPDATE, S.ASK_UPDATE)),
        "last_sequence": F.max(F.col(sequence)),
    }


def pipeline_diagnostics(df: DataFrame, sequence: str = "seq", arrival: str = "seq") -> DataFrame:
    """Counters of one pass of the pipeline per instrument."""
    audited = sequence_audit(df, sequence, arrival)
    return audited.groupBy(S.KEY).agg(*[c.alias(n) for n, c in diagnostic_counters(sequence).items()])


def stale_gaps(df: DataFrame, threshold_us: int) -> DataFrame:
    """Stretches without activity longer than the threshold."""
    if "ts_us" not in df.columns:
        df = df.withColumn("ts_us", F.unix_micros("ts"))
    slim = df.select(S.KEY, "seq", "ts_us")
    gap = F.col("ts_us") - F.col("last_activity_us")
    return (
        previous(slim, [S.KEY], last_activity_us="ts_us")
        .where(gap > threshold_us)
        .select(S.KEY, "last_activity_us", F.col("ts_us").alias("resumed_us"), gap.alias("silent_us"))
    )
