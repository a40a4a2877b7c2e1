"""Bars."""

from pyspark.sql import functions as F

from tickloom.catalog.base import TAPE_DAYS, days, fast, query, shared, with_fast
from tickloom.catalog.calendar import DATED
from tickloom.functions.tables import register_table_functions
from tickloom.operators import calendar as c
from tickloom.operators import bars as b

MINUTE = 60_000_000
DATED_TRADES = DATED + ", dtrades AS (SELECT * FROM dated WHERE type = 5 AND quantity > 0)"


def dated_tape(spark, sf):
    """The tape of several days with its trading dates."""
    return shared(spark, sf, "dated-tape", lambda: c.trading_date(days(spark, sf)))

OHLC = """instrument_id, bar_id, arg_min(price_ticks, seq) AS "open", max(price_ticks) AS high, min(price_ticks) AS low, arg_max(price_ticks, seq) AS "close",
  CAST(sum(quantity) AS BIGINT) AS volume, CAST(sum(CASE aggressor WHEN 1 THEN quantity ELSE 0 END) AS BIGINT) AS buy, CAST(sum(CASE aggressor WHEN 2 THEN quantity ELSE 0 END) AS BIGINT) AS sell,
  count(*) AS trades, min(seq) AS first_seq, max(seq) AS last_seq, min(ts_us) AS start_ts, max(ts_us) AS end_ts"""

ASSIGNED = """assigned AS (SELECT *, max(ts_us // 60000000) OVER (PARTITION BY instrument_id ORDER BY seq) AS bar_id FROM trades)"""
BARS = ASSIGNED + f""",
bars0 AS (SELECT {OHLC} FROM assigned GROUP BY instrument_id, bar_id),
bars AS (SELECT * EXCLUDE (start_ts, end_ts), buy - sell AS delta, bar_id < max(bar_id) OVER (PARTITION BY instrument_id) AS is_closed,
  bar_id * 60000000 AS start_us, CASE WHEN bar_id < max(bar_id) OVER (PARTITION BY instrument_id) THEN (bar_id + 1) * 60000000 ELSE end_ts END AS end_us,
  row_number() OVER (PARTITION BY instrument_id ORDER BY bar_id) - 1 AS idx FROM bars0)"""
COLUMNS = ["instrument_id", "bar_id", "start_us", "end_us", "open", "high", "low", "close", "volume", "buy", "sell", "delta", "trades", "is_closed"]
SQL_COLUMNS = ", ".join(f'"{c}"' for c in COLUMNS)


def minute_bars(spark, sf):
    """Indexed one-minute bars, the table indicators and studies start from."""
    return shared(spark, sf, "bars-1m", lambda: b.bar_index(b.time_bars(fast(spark, sf), MINUTE)))


def minute_trades(spark, sf):
    """Trades with the minute bar they belong to."""
    return shared(spark, sf, "trades-1m", lambda: b.assign_time(fast(spark, sf), MINUTE))


@query("time_bars", with_fast(f"SELECT {SQL_COLUMNS} FROM bars", BARS))
def _(spark, sf):
    return b.time_bars(fast(spark, sf), MINUTE).select(*COLUMNS)


@query("tick_bars", with_fast(f"SELECT {OHLC}, count(*) >= 50 AS is_closed FROM (SELECT *, (row_number() OVER (PARTITION BY instrument_id ORDER BY seq) - 1) // 50 AS bar_id FROM trades) GROUP BY instrument_id, bar_id"))
def _(spark, sf):
    out = b.tick_bars(fast(spark, sf), 50)
    return _plain(out)


def _plain(bars):
    return bars.select(
        "instrument_id", "bar_id", "open", "high", "low", "close", "volume", "buy", "sell", "trades",
        "first_seq", "last_seq", F.col("start_us").alias("start_ts"), F.col("end_us").alias("end_ts"), "is_closed",
    )


def _restart_sql(close: str, state: str, fold: str, closed: str) -> str:
    """Bars by folding each instrument's ordered trades; only the starts are kept, then joined back by position."""
    return with_fast(
        f"SELECT {OHLC}, {closed} AS is_closed FROM joined GROUP BY instrument_id, bar_id",
        "lists AS (SELECT instrument_id, list({'s': seq, 'p': price_ticks, 'q': quantity} ORDER BY seq) AS l FROM trades GROUP BY instrument_id)",
        f"folded AS (SELECT instrument_id, list_reduce(l, lambda a, x: {fold}, {state}) AS r FROM lists)",
        "starts AS (SELECT instrument_id, unnest(r.starts) AS start_seq FROM folded)",
        "joined AS (SELECT t.*, s.start_seq AS bar_id FROM trades t ASOF JOIN starts s ON t.instrument_id = s.instrument_id AND t.seq >= s.start_seq)",
    )


VOLUME_SQL = _restart_sql(
    "", "{'fresh': true, 'v': 0::BIGINT, 'starts': []::BIGINT[]}",
    """{'fresh': (CASE WHEN a.fresh THEN 0 ELSE a.v END) + x.q >= 400, 'v': (CASE WHEN a.fresh THEN 0 ELSE a.v END) + x.q,
        'starts': CASE WHEN a.fresh THEN list_append(a.starts, x.s) ELSE a.starts END}""",
    "sum(quantity) >= 400",
)
RANGE_SQL = _restart_sql(
    "", "{'fresh': true, 'h': 0::BIGINT, 'l': 0::BIGINT, 'starts': []::BIGINT[]}",
    """{'fresh': (CASE WHEN a.fresh THEN 0 ELSE greatest(a.h, x.p) - least(a.l, x.p) END) >= 6,
        'h': CASE WHEN a.fresh THEN x.p ELSE greatest(a.h, x.p) END, 'l': CASE WHEN a.fresh THEN x.p ELSE least(a.l, x.p) END,
        'starts': CASE WHEN a.fresh THEN list_append(a.starts, x.s) ELSE a.starts END}""",
    "max(price_ticks) - min(price_ticks) >= 6",
)


def _from_sql(spark, sf, call):
    """Bars of a table function called from SQL text."""
    register_table_functions(spark)
    b.trade_columns(fast(spark, sf)).createOrReplaceTempView("prints")
    return _plain(spark.sql(f"SELECT * FROM {call}, TABLE(prints) PARTITION BY instrument_id ORDER BY seq)"))


@query("sql_tick_bars", with_fast(f"SELECT * REPLACE (first_seq AS bar_id) FROM (SELECT {OHLC}, count(*) >= 50 AS is_closed FROM (SELECT *, (row_number() OVER (PARTITION BY instrument_id ORDER BY seq) - 1) // 50 AS bar_id FROM trades) GROUP BY instrument_id, bar_id)"))
def _(spark, sf):
    """``tick_bars`` called from SQL; bars are named by their first sequence."""
    return _from_sql(spark, sf, "tick_bars(50")


@query("sql_volume_bars", VOLUME_SQL)
def _(spark, sf):
    return _from_sql(spark, sf, "volume_bars(400")


@query("sql_range_bars", RANGE_SQL)
def _(spark, sf):
    return _from_sql(spark, sf, "range_bars(6")


@query("volume_bars", VOLUME_SQL)
def _(spark, sf):
    return _plain(b.volume_bars(fast(spark, sf), 400))


@query("range_bars", RANGE_SQL)
def _(spark, sf):
    return _plain(b.range_bars(fast(spark, sf), 6))


@query("developing_bar", with_fast('SELECT instrument_id, bar_id, "close", volume, end_us FROM bars WHERE NOT is_closed', BARS))
def _(spark, sf):
    return b.developing(minute_bars(spark, sf)).select("instrument_id", "bar_id", "close", "volume", "end_us")


@query("close_current", with_fast('SELECT instrument_id, bar_id, "close", true AS is_closed FROM bars', BARS))
def _(spark, sf):
    return b.close_current(minute_bars(spark, sf)).select("instrument_id", "bar_id", "close", "is_closed")


@query("bar_volume_strip", with_fast("""SELECT instrument_id, bar_id, start_us, volume, "close" >= "open" AS is_up,
  round(volume / greatest(max(volume) OVER (PARTITION BY instrument_id), 1), 6) AS height FROM bars""", BARS))
def _(spark, sf):
    return b.bar_volume_strip(minute_bars(spark, sf)).withColumn("height", F.round("height", 6))


@query("resample_bars", with_fast(f"SELECT {OHLC.replace(', min(ts_us) AS start_ts, max(ts_us) AS end_ts', '')}, bar_id * 900000000 AS start_us FROM (SELECT * EXCLUDE (bar_id), bar_id // 15 AS bar_id FROM assigned) GROUP BY instrument_id, bar_id", BARS))
def _(spark, sf):
    return b.resample_bars(minute_bars(spark, sf), 15 * MINUTE).drop("delta")


def _session_fold(state: str, fold: str) -> str:
    return f"""SELECT t.*, s.start_seq AS bar_id FROM dtrades t ASOF JOIN (SELECT instrument_id, trading_date, unnest(r.starts) AS start_seq FROM
    (SELECT instrument_id, trading_date, list_reduce(l, lambda a, x: {fold}, {state}) AS r FROM dlists)) s
    ON t.instrument_id = s.instrument_id AND t.trading_date = s.trading_date AND t.seq >= s.start_seq"""


_VOLUME_FOLD = ("{'fresh': true, 'v': 0::BIGINT, 'starts': []::BIGINT[]}", """{'fresh': (CASE WHEN a.fresh THEN 0 ELSE a.v END) + x.q >= 400, 'v': (CASE WHEN a.fresh THEN 0 ELSE a.v END) + x.q,
  'starts': CASE WHEN a.fresh THEN list_append(a.starts, x.s) ELSE a.starts END}""")
_RANGE_FOLD = ("{'fresh': true, 'h': 0::BIGINT, 'l': 0::BIGINT, 'starts': []::BIGINT[]}", """{'fresh': (CASE WHEN a.fresh THEN 0 ELSE greatest(a.h, x.p) - least(a.l, x.p) END) >= 6,
  'h': CASE WHEN a.fresh THEN x.p ELSE greatest(a.h, x.p) END, 'l': CASE WHEN a.fresh THEN x.p ELSE least(a.l, x.p) END,
  'starts': CASE WHEN a.fresh THEN list_append(a.starts, x.s) ELSE a.starts END}""")
_HOUR = 3_600_000_000
SESSION_BARS = f"""dlists AS (SELECT instrument_id, trading_date, list({{'s': seq, 'p': price_ticks, 'q': quantity}} ORDER BY seq) AS l FROM dtrades GROUP BY ALL),
kinds AS (
  SELECT 'time' AS kind, *, max(ts_us // {_HOUR}) OVER (PARTITION BY instrument_id, trading_date ORDER BY seq) AS bar_id FROM dtrades
  UNION ALL BY NAME SELECT 'tick' AS kind, * EXCLUDE (n), max(CASE WHEN n % 7 = 0 THEN seq END) OVER (PARTITION BY instrument_id, trading_date ORDER BY seq) AS bar_id
    FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, trading_date ORDER BY seq) - 1 AS n FROM dtrades)
  UNION ALL BY NAME SELECT 'volume' AS kind, * FROM ({_session_fold(*_VOLUME_FOLD)})
  UNION ALL BY NAME SELECT 'range' AS kind, * FROM ({_session_fold(*_RANGE_FOLD)})),
sbars AS (SELECT kind, trading_date, {OHLC} FROM kinds GROUP BY kind, trading_date, instrument_id, bar_id)"""


@query("session_bars", "WITH " + ",\n".join([TAPE_DAYS, DATED_TRADES, SESSION_BARS]) + f"""
SELECT kind, trading_date, instrument_id, bar_id, "open", high, low, "close", volume, trades, first_seq, last_seq,
  CASE kind WHEN 'time' THEN bar_id * {_HOUR} ELSE start_ts END AS start_us,
  CASE WHEN kind = 'time' AND bar_id < max(bar_id) OVER (PARTITION BY kind, instrument_id, trading_date) THEN (bar_id + 1) * {_HOUR} ELSE end_ts END AS end_us,
  last_seq < max(last_seq) OVER (PARTITION BY kind, instrument_id)
    OR CASE kind WHEN 'time' THEN false WHEN 'tick' THEN trades >= 7 WHEN 'volume' THEN volume >= 400 ELSE high - low >= 6 END AS is_closed
FROM sbars""")
def _(spark, sf):
    """All four kinds of bars on a tape of several days, force-closed at the end of each trading date."""
    tape = dated_tape(spark, sf)
    kinds = [b.time_bars(tape, _HOUR, "trading_date"), b.tick_bars(tape, 7, "trading_date"), b.volume_bars(tape, 400, "trading_date"), b.range_bars(tape, 6, "trading_date")]
    out = None
    for bars in kinds:
        one = bars.select("kind", "trading_date", "instrument_id", "bar_id", "open", "high", "low", "close", "volume", "trades", "first_seq", "last_seq", "start_us", "end_us", "is_closed")
        out = one if out is None else out.unionByName(one)
    return out
