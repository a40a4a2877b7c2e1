"""Prices, typed projections, sequence checks."""

from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.catalog.base import days, fast, query, with_days, with_fast
from tickloom.operators import quality as q


def _priced(spark, sf):
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("event_id").alias("seq"),
        (F.col("user_id") % 2 + 1).cast("int").alias("instrument_id"),
        (F.col("value") / 2).cast("decimal(18,6)").alias("price"),
    )


PRICED = """priced AS (SELECT event_id AS seq, CAST(user_id % 2 + 1 AS INTEGER) AS instrument_id,
  CAST(value / 2 AS DECIMAL(18,6)) AS price FROM events)"""


@query("to_ticks", f"""WITH {PRICED} SELECT seq, instrument_id, CAST(round_even(CAST(price AS DOUBLE) / 0.25::DOUBLE, 0) AS BIGINT) AS ticks FROM priced""")
def _(spark, sf):
    return q.to_ticks(_priced(spark, sf), S.instrument_specs(spark)).select("seq", "instrument_id", "ticks")


@query("to_price", with_fast("SELECT seq, price_ticks, CAST(price_ticks * 0.25::DOUBLE AS DOUBLE) AS price FROM tape"))
def _(spark, sf):
    out = q.to_price(fast(spark, sf), S.instrument_specs(spark))
    return out.select("seq", "price_ticks", F.col("price").cast("double").alias("price"))


@query("tick_value", with_fast("""SELECT seq, (price_ticks - 80000) * quantity * CASE instrument_id WHEN 1 THEN 5::DOUBLE ELSE 12.5::DOUBLE END AS value FROM trades"""))
def _(spark, sf):
    moved = q.trades(fast(spark, sf)).withColumn("move", F.col("price_ticks") - 80000)
    out = q.tick_value(moved, S.instrument_specs(spark), "move", "quantity")
    return out.select("seq", F.col("value").cast("double").alias("value"))


@query("off_tick", f"""WITH {PRICED} SELECT seq, (price % 0.25::DECIMAL(18,6)) <> 0 AS is_off_tick FROM priced""")
def _(spark, sf):
    return q.off_tick(_priced(spark, sf), S.instrument_specs(spark)).select("seq", "is_off_tick")


@query("trade_filter", with_fast("""SELECT instrument_id, type, count(*) AS n, count(*) FILTER (type = 5 AND quantity > 0) AS trades,
  count(*) FILTER (type IN (6, 7)) AS depth_rows, count(*) FILTER (flags & 1 = 1) AS supplied, count(*) FILTER (flags & 2 = 2) AS inferred,
  count(*) FILTER (type IN (6, 7) AND side = type - 5 AND quantity >= 0) AS valid_quotes FROM tape GROUP BY ALL"""))
def _(spark, sf):
    return fast(spark, sf).groupBy("instrument_id", "type").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if((F.col("type") == S.TRADE) & (F.col("quantity") > 0)).alias("trades"),
        F.count_if(F.col("type").isin(1, 2, 3, 4, 6, 7)).alias("depth_rows"),
        F.count_if(q.has_flag(S.AGGRESSOR_SUPPLIED)).alias("supplied"),
        F.count_if(q.has_flag(S.AGGRESSOR_INFERRED)).alias("inferred"),
        F.count_if(q.is_valid_quote()).alias("valid_quotes"),
    )


SYMBOL = """CASE WHEN k % 11 = 0 THEN 'XX' WHEN instrument_id = 1 THEN ' nq' ELSE 'ES' END
  || CASE k % 5 WHEN 0 THEN 'H' WHEN 1 THEN 'M' WHEN 2 THEN 'U' WHEN 3 THEN 'z' ELSE 'F' END
  || CASE k % 4 WHEN 0 THEN '5' WHEN 1 THEN '25' WHEN 2 THEN '2026' ELSE '125' END"""


@query("parse_contract", with_fast(f"""SELECT seq, symbol, CASE WHEN ok THEN upper(trim(symbol))[1:2] END AS contract_root,
  CASE WHEN ok THEN CASE k % 5 WHEN 0 THEN 3 WHEN 1 THEN 6 WHEN 2 THEN 9 ELSE 12 END END AS contract_month,
  CASE WHEN ok THEN CASE k % 4 WHEN 2 THEN 2026 ELSE 2025 END END AS contract_year
  FROM (SELECT seq, k, {SYMBOL} AS symbol, k % 11 <> 0 AND k % 5 < 4 AND k % 4 < 3 AS ok FROM tape)"""))
def _(spark, sf):
    named = fast(spark, sf).withColumn("k", F.unix_micros("receive_ts") - F.col("ts_us"))
    named = named.withColumn("symbol", F.expr(SYMBOL))
    return q.parse_contract(named).select("seq", "symbol", "contract_root", "contract_month", "contract_year")


@query("estimated_flags", with_fast("""SELECT seq, type = 5 AND flags & 1 = 0 AS aggressor_is_estimated, false AS supports_queue_analysis,
  CASE aggressor_ WHEN 1 THEN 'Buy' WHEN 2 THEN 'Sell' ELSE 'Unknown' END || CASE WHEN type = 5 AND flags & 1 = 0 THEN ' (Estimated)' ELSE '' END AS aggressor_label
  FROM (SELECT *, CASE WHEN type = 5 THEN aggressor ELSE 0 END AS aggressor_ FROM tape)"""))
def _(spark, sf):
    return q.estimated_flags(fast(spark, sf)).select(
        "seq", "aggressor_is_estimated", "supports_queue_analysis", "aggressor_label"
    )


def _rough(spark, sf):
    """The tape with gaps and repeats in its sequence numbers; ``seq`` stays the arrival order."""
    bump = F.when(F.col("seq") % 97 == 0, 3).when(F.col("seq") % 89 == 0, -1).otherwise(0)
    return fast(spark, sf).withColumn("sequence", F.col("seq") + bump)


ROUGH = """rough AS (SELECT *, seq + CASE WHEN seq % 97 = 0 THEN 3 WHEN seq % 89 = 0 THEN -1 ELSE 0 END AS sequence FROM tape),
audited AS (SELECT *, CASE WHEN last_sequence IS NULL THEN 'Ok' WHEN sequence <= last_sequence THEN 'Duplicate'
    WHEN sequence > last_sequence + 1 THEN 'Gap' ELSE 'Ok' END AS outcome
  FROM (SELECT *, max(sequence) OVER (PARTITION BY instrument_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_sequence FROM rough))"""


@query("sequence_audit", with_fast("SELECT instrument_id, seq, sequence, last_sequence, outcome FROM audited", ROUGH))
def _(spark, sf):
    out = q.sequence_audit(_rough(spark, sf), "sequence")
    return out.select("instrument_id", "seq", "sequence", "last_sequence", "outcome")


@query("clean_stream", with_fast("""SELECT instrument_id, seq, sub, CASE WHEN sub = 0 THEN 14 ELSE type END AS type, CASE WHEN sub = 0 THEN 0 ELSE price_ticks END AS price_ticks
  FROM audited, (VALUES (0), (1)) s(sub) WHERE outcome <> 'Duplicate' AND (sub = 1 OR outcome = 'Gap')""", ROUGH))
def _(spark, sf):
    return q.clean_stream(_rough(spark, sf), "sequence").select("instrument_id", "seq", "sub", "type", "price_ticks")


DIAGNOSTICS_SQL = """SELECT instrument_id, count(*) AS ingested, count(*) FILTER (outcome <> 'Duplicate') AS processed,
  count(*) FILTER (outcome = 'Gap') AS gaps, count(*) FILTER (outcome = 'Duplicate') AS duplicates, count(*) FILTER (outcome = 'Gap') AS invalidations,
  count(*) FILTER (outcome <> 'Duplicate' AND type = 5) AS trades, count(*) FILTER (outcome <> 'Duplicate' AND type IN (6, 7)) AS depth_updates,
  max(sequence) AS last_sequence FROM audited GROUP BY instrument_id"""


@query("feed_diagnostics", with_fast(DIAGNOSTICS_SQL, ROUGH))
def _(spark, sf):
    return q.pipeline_diagnostics(_rough(spark, sf), "sequence")


@query("stale_gaps", with_fast("""SELECT instrument_id, last_activity_us, ts_us AS resumed_us, ts_us - last_activity_us AS silent_us
  FROM (SELECT *, lag(ts_us) OVER (PARTITION BY instrument_id ORDER BY seq) AS last_activity_us FROM tape) WHERE ts_us - last_activity_us > 5000000"""))
def _(spark, sf):
    return q.stale_gaps(fast(spark, sf), 5_000_000)
