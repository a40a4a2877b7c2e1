"""Delta, VWAP, and the flagship query."""

from pyspark.sql import functions as F

from tickloom.catalog.bars import ASSIGNED, BARS, DATED_TRADES, dated_tape, minute_bars, minute_trades
from tickloom.catalog.base import days, fast, query, shared, with_days, with_fast
from tickloom.catalog.calendar import DATED
from tickloom.operators import calendar as c
from tickloom.operators import flow as f
from tickloom.operators import footprint as fp
from tickloom.operators.quality import trades

SIGNED = "CASE aggressor WHEN 1 THEN quantity WHEN 2 THEN -quantity ELSE 0 END"
RUN = "OVER (PARTITION BY instrument_id ORDER BY seq)"
CVD = f"cvd AS (SELECT *, CAST(sum({SIGNED}) {RUN} AS BIGINT) AS cvd FROM trades)"


def _vwap_sql(source: str, part: str, columns: str) -> str:
    over = f"OVER (PARTITION BY {part} ORDER BY seq)"
    return f"""SELECT {columns}, round(m, 5) AS vwap, round(sqrt(greatest(0, s - m * m)), 3) AS sd FROM (SELECT *,
      CAST(sum(price_ticks * quantity) {over} AS DOUBLE) / CAST(sum(quantity) {over} AS DOUBLE) AS m,
      CAST(sum(price_ticks * price_ticks * quantity) {over} AS DOUBLE) / CAST(sum(quantity) {over} AS DOUBLE) AS s FROM {source})"""


def day_trades(spark, sf):
    return trades(dated_tape(spark, sf))


def _rounded(df):
    return df.withColumns({"vwap": F.round("vwap", 5), "sd": F.round("sd", 3)})


@query("cvd", with_fast("SELECT instrument_id, seq, cvd FROM cvd", CVD))
def _(spark, sf):
    return f.cvd(trades(fast(spark, sf))).select("instrument_id", "seq", "cvd")


@query("cvd_extremes", with_fast(f"SELECT instrument_id, seq, cvd, greatest(0, max(cvd) {RUN}) AS max_positive, least(0, min(cvd) {RUN}) AS max_negative FROM cvd", CVD))
def _(spark, sf):
    return f.cvd_extremes(trades(fast(spark, sf))).select("instrument_id", "seq", "cvd", "max_positive", "max_negative")


@query("cvd_bars", with_fast(f"""SELECT instrument_id, bar_id, o AS "open", greatest(o, h) AS high, least(o, l) AS low, c AS "close" FROM
  (SELECT *, coalesce(lag(c) OVER (PARTITION BY instrument_id ORDER BY bar_id), 0) AS o FROM
  (SELECT instrument_id, bar_id, max(cvd) AS h, min(cvd) AS l, arg_max(cvd, seq) AS c FROM (SELECT a.bar_id, c.* FROM cvd c JOIN assigned a USING (instrument_id, seq)) GROUP BY ALL))""", CVD, ASSIGNED))
def _(spark, sf):
    return f.cvd_bars(minute_trades(spark, sf))


@query("vwap", with_fast(_vwap_sql("trades", "instrument_id", "instrument_id, seq")))
def _(spark, sf):
    return _rounded(f.vwap(trades(fast(spark, sf)))).select("instrument_id", "seq", "vwap", "sd")


@query("vwap_bands", with_fast(f"""SELECT instrument_id, seq, round(vwap + 2 * sd, 2) AS upper_2, round(vwap - 2 * sd, 2) AS lower_2 FROM (
  {_vwap_sql("trades", "instrument_id", "instrument_id, seq").replace("round(m, 5)", "m").replace("round(sqrt(greatest(0, s - m * m)), 3)", "sqrt(greatest(0, s - m * m))")})"""))
def _(spark, sf):
    out = f.vwap(trades(fast(spark, sf)), bands=[2])
    return out.select("instrument_id", "seq", F.round("upper_2", 2).alias("upper_2"), F.round("lower_2", 2).alias("lower_2"))


for _name, _period, _key in [
    ("vwap_daily", "day", "CAST(trading_date AS VARCHAR)"),
    ("vwap_weekly", "week", "isoyear(trading_date) || '-W' || week(trading_date)"),
    ("vwap_monthly", "month", "strftime(trading_date, '%Y-%m')"),
]:

    @query(_name, with_days(
        _vwap_sql(f"(SELECT *, {_key} AS period FROM dtrades)", "instrument_id, period", "instrument_id, seq, period"), DATED_TRADES))
    def _(spark, sf, period=_period):
        out = f.periodic_vwap(day_trades(spark, sf), period)
        return _rounded(out).select("instrument_id", "seq", "period", "vwap", "sd")


@query("vwap_anchored", with_fast(
    _vwap_sql("anchored", "instrument_id, anchor_seq", "instrument_id, seq, anchor_seq"),
    "anchors AS (SELECT instrument_id, seq AS anchor_seq FROM tape WHERE type = 7 AND k % 20 = 3)",
    "anchored AS (SELECT t.*, a.anchor_seq FROM trades t ASOF JOIN anchors a ON t.instrument_id = a.instrument_id AND t.seq >= a.anchor_seq)"))
def _(spark, sf):
    tape = fast(spark, sf)
    k = F.unix_micros("receive_ts") - F.col("ts_us")
    anchors = tape.where((F.col("type") == 7) & (k % 20 == 3)).select("instrument_id", F.col("seq").alias("anchor_seq"))
    slim = trades(tape).select("instrument_id", "seq", "price_ticks", "quantity")
    return _rounded(f.vwap_anchored(slim, anchors)).select("instrument_id", "seq", "anchor_seq", "vwap", "sd")


@query("vwap_by_bar", with_fast(
    "SELECT instrument_id, bar_id, arg_max(vwap, seq) AS vwap FROM v JOIN assigned USING (instrument_id, seq) GROUP BY ALL",
    ASSIGNED, f"v AS ({_vwap_sql('trades', 'instrument_id', 'instrument_id, seq')})"))
def _(spark, sf):
    return f.vwap_by_bar(minute_trades(spark, sf)).withColumn("vwap", F.round("vwap", 5))


@query("flow_by_minute", with_fast("""SELECT b.instrument_id, b.bar_id, b."open", b.high, b.low, b."close", b.volume, b.delta, c.cvd_close, p.poc, p.max_delta, p.min_delta
  FROM bars b JOIN (SELECT a.instrument_id, a.bar_id, arg_max(cvd, seq) AS cvd_close FROM cvd JOIN assigned a USING (instrument_id, seq) GROUP BY ALL) c USING (instrument_id, bar_id)
  LEFT JOIN (SELECT instrument_id, bar_id, first(price_ticks ORDER BY total DESC, abs(price_ticks - "close"), CASE WHEN "close" >= "open" THEN -price_ticks ELSE price_ticks END) AS poc,
    greatest(0, max(level_delta)) AS max_delta, least(0, min(level_delta)) AS min_delta
    FROM (SELECT instrument_id, bar_id, price_ticks, CAST(sum(CASE WHEN aggressor > 0 THEN quantity ELSE 0 END) AS BIGINT) AS total,
       CAST(sum(CASE aggressor WHEN 1 THEN quantity WHEN 2 THEN -quantity ELSE 0 END) AS BIGINT) AS level_delta FROM assigned GROUP BY ALL HAVING total > 0) JOIN bars USING (instrument_id, bar_id) GROUP BY ALL) p USING (instrument_id, bar_id)""", BARS, CVD))
def flow_by_minute(spark, sf):
    """OHLCV, delta, CVD at close, footprint POC and level-delta extremes per minute."""
    bars, assigned = minute_bars(spark, sf), minute_trades(spark, sf)
    levels = fp.published(fp.footprint_levels(assigned))
    zero = F.lit(0).cast("long")
    extremes = levels.groupBy(*fp.BAR).agg(
        F.greatest(zero, F.max("delta")).alias("max_delta"), F.least(zero, F.min("delta")).alias("min_delta"))
    closes = f.cvd_bars(assigned).select(*fp.BAR, F.col("close").alias("cvd_close"))
    return (
        bars.select(*fp.BAR, "open", "high", "low", "close", "volume", "delta")
        .join(closes, fp.BAR)
        .join(fp.footprint_poc(levels, bars), fp.BAR, "left")
        .join(extremes, fp.BAR, "left")
    )
