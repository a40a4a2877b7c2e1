"""Indicators and price action."""

from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.catalog.bars import BARS, minute_bars, minute_trades
from tickloom.catalog.base import query, shared, with_days, with_fast
from tickloom.catalog.calendar import DATED, WINDOWS
from tickloom.catalog.flow import DATED_TRADES, day_trades
from tickloom.operators import calendar as c
from tickloom.operators import indicators as i
from tickloom.operators import price_action as pa
from tickloom.plans import numbered

W = "OVER (PARTITION BY instrument_id ORDER BY idx)"


def last(n: int) -> str:
    return f"OVER (PARTITION BY instrument_id ORDER BY idx ROWS {n - 1} PRECEDING)"


def smooth(name: str, source: str, x: str, p: int, alpha: float, start: int = 0) -> str:
    """CTE ``name(instrument_id, idx, y)``: the recurrence folded over the ordered inputs from ``start`` on."""
    return f"""{name}_l AS (SELECT instrument_id, list(CAST({x} AS DOUBLE) ORDER BY idx) AS l FROM {source} WHERE idx >= {start} GROUP BY 1),
{name}_f AS (SELECT instrument_id, list_reduce(l[{p + 1}:], lambda a, x: list_append(a, {1 - alpha!r}::DOUBLE * a[-1] + {alpha!r}::DOUBLE * x), [list_avg(l[1:{p}])]) AS ys FROM {name}_l WHERE len(l) >= {p}),
{name} AS (SELECT instrument_id, {start + p - 1} + generate_subscripts(ys, 1) - 1 AS idx, unnest(ys) AS y FROM {name}_f)"""


def ema(name, source, x, p, start=0):
    return smooth(name, source, x, p, 2.0 / (p + 1), start)


def rma(name, source, x, p, start=0):
    return smooth(name, source, x, p, 1.0 / p, start)


CLOSE = '"close"'
TR = """trs AS (SELECT *, CAST(CASE WHEN idx = 0 THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS DOUBLE) AS tr,
  CAST(CASE WHEN up > down AND up > 0 THEN up ELSE 0 END AS DOUBLE) AS plus, CAST(CASE WHEN down > up AND down > 0 THEN down ELSE 0 END AS DOUBLE) AS minus,
  CAST(greatest(0, "close" - pc) AS DOUBLE) AS gain, CAST(greatest(0, pc - "close") AS DOUBLE) AS loss
  FROM (SELECT *, lag("close") %s AS pc, high - lag(high) %s AS up, lag(low) %s - low AS down FROM bars))""" % (W, W, W)
J = "USING (instrument_id, idx)"


def bars(spark, sf):
    return minute_bars(spark, sf)


def show(df, *columns, digits=4):
    return df.select("instrument_id", "idx", *[F.round(F.col(x).cast("double"), digits).alias(x) for x in columns])


_sources = {
    "close": "CAST(\"close\" AS DOUBLE)", "open": "CAST(\"open\" AS DOUBLE)", "high": "CAST(high AS DOUBLE)", "low": "CAST(low AS DOUBLE)",
    "hl2": "(high + low) / 2", "hlc3": "(high + low + \"close\") / 3", "typical": "(high + low + \"close\") / 3",
    "ohlc4": "(\"open\" + high + low + \"close\") / 4", "weighted_close": "(high + low + 2 * \"close\") / 4",
}


@query("price_source", with_fast("SELECT instrument_id, idx, " + ", ".join(f"round({v}, 4) AS src_{k}" for k, v in _sources.items()) + " FROM bars", BARS))
def _(spark, sf):
    return bars(spark, sf).select("instrument_id", "idx", *[F.round(i.price_source(k), 4).alias(f"src_{k}") for k in _sources])


@query("sma", with_fast(f"SELECT instrument_id, idx, CASE WHEN idx >= 19 THEN round(avg({CLOSE}) {last(20)}, 4) END AS sma FROM bars", BARS))
def _(spark, sf):
    return show(i.sma(bars(spark, sf), "close", 20), "sma")


def wma_sql(x: str, p: int, inner: str = "") -> str:
    terms = " + ".join(f"{p - k} * lag({x}, {k}) {W}" for k in range(p))
    return f"({terms}) / {p * (p + 1) / 2}::DOUBLE"


@query("wma", with_fast(f"SELECT instrument_id, idx, round({wma_sql(CLOSE, 10)}, 4) AS wma FROM bars", BARS))
def _(spark, sf):
    return show(i.wma(bars(spark, sf), "close", 10), "wma")


@query("hma", with_fast(f"SELECT instrument_id, idx, CASE WHEN idx >= 17 THEN round({wma_sql('raw', 4)}, 4) END AS hma FROM (SELECT *, 2 * {wma_sql(CLOSE, 8)} - {wma_sql(CLOSE, 16)} AS raw FROM bars)".replace("idx >= 17", "idx >= 18"), BARS))
def _(spark, sf):
    return show(i.hma(bars(spark, sf), "close", 16), "hma")


@query("ema", with_fast(f"SELECT b.instrument_id, b.idx, round(y, 4) AS ema FROM bars b LEFT JOIN e {J}", BARS, ema("e", "bars", CLOSE, 20)))
def _(spark, sf):
    return show(i.ema(bars(spark, sf), "close", 20), "ema")


@query("rma", with_fast(f"SELECT b.instrument_id, b.idx, round(y, 4) AS rma FROM bars b LEFT JOIN e {J}", BARS, rma("e", "bars", CLOSE, 14)))
def _(spark, sf):
    return show(i.rma(bars(spark, sf), "close", 14), "rma")


MACD = [ema("f12", "bars", CLOSE, 12), ema("s26", "bars", CLOSE, 26),
        f"line AS (SELECT instrument_id, idx, f.y - s.y AS macd FROM f12 f JOIN s26 s {J})", ema("sig", "line", "macd", 9, 25)]


@query("macd", with_fast(f'SELECT b.instrument_id, b.idx, round(macd, 4) AS macd, round(y, 4) AS "signal", round(macd - y, 4) AS histogram FROM bars b LEFT JOIN line {J} LEFT JOIN sig {J}', BARS, *MACD))
def _(spark, sf):
    return show(i.macd(bars(spark, sf)), "macd", "signal", "histogram")


BB = f"""bb AS (SELECT instrument_id, idx, avg({CLOSE}) {last(20)} AS m, stddev_pop({CLOSE}) {last(20)} AS sd FROM bars)"""


@query("bollinger", with_fast("SELECT instrument_id, idx, CASE WHEN idx >= 19 THEN round(m, 4) END AS bb_middle, CASE WHEN idx >= 19 THEN round(m + 2 * sd, 4) END AS bb_upper, CASE WHEN idx >= 19 THEN round(m - 2 * sd, 4) END AS bb_lower, CASE WHEN idx >= 19 THEN round(4 * sd / m, 4) END AS bb_width FROM bb", BARS, BB))
def _(spark, sf):
    return show(i.bollinger(bars(spark, sf)), "bb_middle", "bb_upper", "bb_lower", "bb_width")


@query("donchian", with_fast(f"SELECT instrument_id, idx, CASE WHEN idx >= 19 THEN CAST(max(high) {last(20)} AS DOUBLE) END AS dc_upper, CASE WHEN idx >= 19 THEN CAST(min(low) {last(20)} AS DOUBLE) END AS dc_lower, CASE WHEN idx >= 19 THEN (max(high) {last(20)} + min(low) {last(20)}) / 2 END AS dc_middle FROM bars", BARS))
def _(spark, sf):
    return show(i.donchian(bars(spark, sf)), "dc_upper", "dc_lower", "dc_middle")


@query("keltner", with_fast(f"SELECT b.instrument_id, b.idx, round(e.y, 4) AS kc_middle, round(e.y + 2 * a.y, 4) AS kc_upper, round(e.y - 2 * a.y, 4) AS kc_lower FROM bars b LEFT JOIN e {J} LEFT JOIN a {J}", BARS, TR, ema("e", "bars", CLOSE, 20), rma("a", "trs", "tr", 10)))
def _(spark, sf):
    return show(i.keltner(bars(spark, sf)), "kc_middle", "kc_upper", "kc_lower")


@query("true_range", with_fast("SELECT instrument_id, idx, tr FROM trs", BARS, TR))
def _(spark, sf):
    return show(i.true_range(bars(spark, sf)), "tr")


@query("atr", with_fast(f"SELECT b.instrument_id, b.idx, round(y, 4) AS atr FROM bars b LEFT JOIN a {J}", BARS, TR, rma("a", "trs", "tr", 14)))
def _(spark, sf):
    return show(i.atr(bars(spark, sf)), "atr")


ADX = [rma("xa", "trs", "tr", 14, 1), rma("xp", "trs", "plus", 14, 1), rma("xm", "trs", "minus", 14, 1),
       f"""di AS (SELECT instrument_id, idx, CASE WHEN xa.y <= 0 THEN 0 ELSE 100 * xp.y / xa.y END AS plus_di, CASE WHEN xa.y <= 0 THEN 0 ELSE 100 * xm.y / xa.y END AS minus_di
  FROM xa JOIN xp {J} JOIN xm {J})""",
       "dx AS (SELECT *, CASE WHEN plus_di + minus_di <= 0 THEN 0 ELSE 100 * abs(plus_di - minus_di) / (plus_di + minus_di) END AS dx FROM di)",
       rma("ax", "dx", "dx", 14, 14)]


@query("adx", with_fast(f"SELECT b.instrument_id, b.idx, round(plus_di, 4) AS plus_di, round(minus_di, 4) AS minus_di, round(y, 4) AS adx FROM bars b LEFT JOIN di {J} LEFT JOIN ax {J}", BARS, TR, *ADX))
def _(spark, sf):
    return show(i.adx(bars(spark, sf)), "plus_di", "minus_di", "adx")


RSI = [rma("g", "trs", "gain", 14, 1), rma("lo", "trs", "loss", 14, 1)]
RSI_EXPR = "CASE WHEN lo.y <= 0 THEN 100 ELSE 100 - 100 / (1 + g.y / lo.y) END"


@query("rsi", with_fast(f"SELECT b.instrument_id, b.idx, round({RSI_EXPR}, 4) AS rsi FROM bars b LEFT JOIN g {J} LEFT JOIN lo {J}", BARS, TR, *RSI))
def _(spark, sf):
    return show(i.rsi(bars(spark, sf)), "rsi")


STOCH = f"""st0 AS (SELECT *, max(high) {last(14)} AS hi, min(low) {last(14)} AS lw FROM bars),
st1 AS (SELECT *, CASE WHEN hi <= lw THEN 50 ELSE 100.0::DOUBLE * ("close" - lw) / (hi - lw) END AS raw FROM st0),
st2 AS (SELECT *, CASE WHEN idx >= 15 THEN avg(raw) {last(3)} END AS k FROM st1),
st AS (SELECT instrument_id, idx, k, CASE WHEN idx >= 17 THEN avg(k) {last(3)} END AS d FROM st2)"""


@query("stochastic", with_fast("SELECT instrument_id, idx, round(k, 4) AS stoch_k, round(d, 4) AS stoch_d FROM st", BARS, STOCH))
def _(spark, sf):
    return show(i.stochastic(bars(spark, sf)), "stoch_k", "stoch_d")


CCI = f"""cc AS (SELECT instrument_id, idx, tp, avg(tp) {last(20)} AS mean, list(tp) {last(20)} AS l FROM (SELECT *, (high + low + "close") / 3.0::DOUBLE AS tp FROM bars)),
cci AS (SELECT instrument_id, idx, CASE WHEN idx >= 19 THEN CASE WHEN mad <= 0 THEN 0 ELSE (tp - mean) / (0.015::DOUBLE * mad) END END AS cci
  FROM (SELECT *, list_sum(list_transform(l, lambda x: abs(x - mean))) / 20 AS mad FROM cc))"""


@query("cci", with_fast("SELECT instrument_id, idx, round(cci, 4) AS cci FROM cci", BARS, CCI))
def _(spark, sf):
    return show(i.cci(bars(spark, sf)), "cci")


@query("roc", with_fast(f"SELECT instrument_id, idx, round(100.0::DOUBLE * ({CLOSE} - lag({CLOSE}, 9) {W}) / lag({CLOSE}, 9) {W}, 4) AS roc FROM bars", BARS))
def _(spark, sf):
    return show(i.roc(bars(spark, sf)), "roc")


@query("momentum", with_fast(f"SELECT instrument_id, idx, CAST({CLOSE} - lag({CLOSE}, 10) {W} AS DOUBLE) AS momentum FROM bars", BARS))
def _(spark, sf):
    return show(i.momentum(bars(spark, sf)), "momentum")


@query("chaikin_ad", with_fast(f"SELECT instrument_id, idx, round(sum(CASE WHEN high > low AND volume > 0 THEN (2 * {CLOSE} - low - high) / CAST(high - low AS DOUBLE) * volume ELSE 0 END) {W}, 4) AS chaikin_ad FROM bars", BARS))
def _(spark, sf):
    return show(i.chaikin_ad(bars(spark, sf)), "chaikin_ad")


@query("indicator_frame", with_fast(f"""SELECT b.instrument_id, b.idx, round(e.y, 4) AS ma, CASE WHEN b.idx >= 19 THEN round(m + 2 * sd, 4) END AS bb_upper, round(e.y + 2 * a10.y, 4) AS kc_upper,
  round({RSI_EXPR}, 4) AS rsi, round(macd, 4) AS macd, round(sig.y, 4) AS "signal", round(ax.y, 4) AS adx, round(a14.y, 4) AS atr, round(k, 4) AS stoch_k, round(d, 4) AS stoch_d, round(cci, 4) AS cci,
  round(100.0::DOUBLE * (b."close" - lag(b."close", 9) {W}) / lag(b."close", 9) {W}, 4) AS roc, CAST(b."close" - lag(b."close", 10) {W} AS DOUBLE) AS momentum,
  CASE WHEN b.idx >= 19 THEN CAST(max(high) {last(20)} AS DOUBLE) END AS dc_upper
  FROM bars b LEFT JOIN e {J} LEFT JOIN bb {J} LEFT JOIN a10 {J} LEFT JOIN g {J} LEFT JOIN lo {J} LEFT JOIN line {J} LEFT JOIN sig {J} LEFT JOIN ax {J} LEFT JOIN a14 {J} LEFT JOIN st {J} LEFT JOIN cci {J}""".replace(
      "PARTITION BY instrument_id ORDER BY idx", "PARTITION BY b.instrument_id ORDER BY b.idx"),
    BARS, TR, ema("e", "bars", CLOSE, 20), BB, rma("a10", "trs", "tr", 10), rma("a14", "trs", "tr", 14), *RSI, *MACD, *ADX, STOCH, CCI))
def _(spark, sf):
    return show(i.indicator_frame(bars(spark, sf)), "ma", "bb_upper", "kc_upper", "rsi", "macd", "signal", "adx", "atr", "stoch_k", "stoch_d", "cci", "roc", "momentum", "dc_upper")


# -- price action -----------------------------------------------------------

@query("fair_value_gap", with_fast(f"""SELECT instrument_id, bar_id, end_us, CASE WHEN low - h2 >= 1 THEN 'Bullish' ELSE 'Bearish' END AS direction,
  CASE WHEN low - h2 >= 1 THEN low ELSE l2 END AS top, CASE WHEN low - h2 >= 1 THEN h2 ELSE high END AS bottom, CASE WHEN low - h2 >= 1 THEN low - h2 ELSE l2 - high END AS size
  FROM (SELECT *, lag(high, 2) {W} AS h2, lag(low, 2) {W} AS l2 FROM bars) WHERE low - h2 >= 1 OR l2 - high >= 1""", BARS))
def _(spark, sf):
    return pa.fair_value_gap(bars(spark, sf))


DAILY = DATED_TRADES + """, daily AS (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY trading_date) - 1 AS idx FROM (
  SELECT instrument_id, trading_date, arg_min(price_ticks, seq) AS "open", max(price_ticks) AS high, min(price_ticks) AS low, arg_max(price_ticks, seq) AS "close" FROM dtrades GROUP BY ALL))"""


def daily(spark, sf):
    return shared(spark, sf, "daily", lambda: numbered(pa.daily_bars(day_trades(spark, sf)), [S.KEY], order="last_seq"))


@query("session_gap", with_days(f"""SELECT instrument_id, trading_date, pc AS previous_close, "open", CASE WHEN abs("open" - pc) < 3 THEN 'None' WHEN "open" > pc THEN 'Bullish' ELSE 'Bearish' END AS direction,
  CASE WHEN abs("open" - pc) < 3 THEN 0 ELSE abs("open" - pc) END AS size FROM (SELECT *, lag("close") {W} AS pc FROM daily) WHERE pc IS NOT NULL""", DAILY))
def _(spark, sf):
    return pa.session_gap(daily(spark, sf), 3)


@query("average_daily_range", with_days(f"""SELECT instrument_id, trading_date, round(adr, 6) AS adr, "open" + CAST(round_even(adr / 2, 0) AS BIGINT) AS up_target, "open" - CAST(round_even(adr / 2, 0) AS BIGINT) AS down_target
  FROM (SELECT *, avg(high - low) {last(14)} AS adr FROM daily)""", DAILY))
def _(spark, sf):
    return pa.average_daily_range(daily(spark, sf)).withColumn("adr", F.round("adr", 6))


RANGE = DATED_TRADES + """, opened AS (SELECT t.*, w.start_us + 1800000000 AS range_end FROM dtrades t JOIN windows w ON w.template = 'rth' AND w.trading_date = t.trading_date WHERE t.ts_us >= w.start_us),
ranges AS (SELECT instrument_id, trading_date, max(price_ticks) FILTER (ts_us < range_end) AS or_high, min(price_ticks) FILTER (ts_us < range_end) AS or_low FROM opened GROUP BY ALL)"""


def _opened(spark, sf):
    """Trades from each date's regular open on."""
    start = c.micros(c.local_to_utc(c._at(F.col("trading_date"), 0, "08:30")))
    return day_trades(spark, sf).withColumn("range_end", start + 1_800_000_000).where(
        F.col("ts_us") >= F.col("range_end") - 1_800_000_000)


@query("opening_range", with_days("SELECT *, or_high IS NOT NULL AS is_established FROM ranges", RANGE.replace(", opened", ",\n" + WINDOWS + ", opened")))
def _(spark, sf):
    return pa.opening_range(_opened(spark, sf), F.col("range_end"), ["instrument_id", "trading_date"])


@query("opening_range_breakout", with_days("""SELECT instrument_id, trading_date, or_high, or_low, min(seq) AS seq, arg_min(ts_us, seq) AS ts_us, arg_min(price_ticks, seq) AS price_ticks,
  arg_min(CASE WHEN price_ticks > or_high THEN 'Bullish' ELSE 'Bearish' END, seq) AS direction FROM opened JOIN ranges USING (instrument_id, trading_date)
  WHERE ts_us >= range_end AND (price_ticks > or_high OR price_ticks < or_low) GROUP BY ALL""", RANGE.replace(", opened", ",\n" + WINDOWS + ", opened")))
def _(spark, sf):
    return pa.opening_range_breakout(_opened(spark, sf), F.col("range_end"), ["instrument_id", "trading_date"])
