"""Trading dates, sessions, contracts."""

from pyspark.sql import functions as F

from tickloom.catalog.base import days, query, with_days
from tickloom.operators import calendar as c

LOCAL = "timezone('America/Chicago', timezone('UTC', make_timestamp(ts_us)))"
DATED = f"""evening AS (SELECT *, {LOCAL} AS local_ts FROM tape),
shifted AS (SELECT *, CAST(local_ts AS DATE) + CASE WHEN hour(local_ts) >= 17 THEN 1 ELSE 0 END AS d FROM evening),
dated AS (SELECT * EXCLUDE (d), CAST(d + CASE WHEN dayofweek(d) = 6 THEN 2 ELSE 0 END AS DATE) AS trading_date FROM shifted),
dates AS (SELECT DISTINCT trading_date FROM dated)"""


def _utc(day: str, clock: str) -> str:
    return f"epoch_us(timezone('UTC', timezone('America/Chicago', CAST({day} AS TIMESTAMP) + INTERVAL '{clock}')))"


WINDOWS = f"""windows AS (
  SELECT trading_date, 'globex' AS template, 0 AS segment, {_utc('trading_date - 1', '17:00:00')} AS start_us, {_utc('trading_date', '16:00:00')} AS end_us FROM dates
  UNION ALL SELECT trading_date, 'rth', 0, {_utc('trading_date', '08:30:00')}, {_utc('trading_date', '15:00:00')} FROM dates
  UNION ALL SELECT trading_date, 'eth', 0, {_utc('trading_date - 1', '17:00:00')}, {_utc('trading_date', '08:30:00')} FROM dates
  UNION ALL SELECT trading_date, 'eth', 1, {_utc('trading_date', '15:00:00')}, {_utc('trading_date', '16:00:00')} FROM dates
  UNION ALL SELECT trading_date, 'overnight', 0, {_utc('trading_date - 1', '17:00:00')}, {_utc('trading_date', '08:30:00')} FROM dates
  UNION ALL SELECT trading_date, 'custom', 0, {_utc('trading_date', '07:00:00')}, {_utc('trading_date', '12:15:00')} FROM dates)"""


def _dates(spark, sf):
    return c.trading_date(days(spark, sf)).select("trading_date").distinct()


@query("trading_date", with_days("SELECT seq, trading_date FROM dated", DATED))
def _(spark, sf):
    return c.trading_date(days(spark, sf)).select("seq", "trading_date")


@query("session_windows", with_days("SELECT * FROM windows", DATED, WINDOWS))
def _(spark, sf):
    dates = _dates(spark, sf)
    out = None
    for template in ["globex", "rth", "eth", "overnight", [("07:00", 0, "12:15", 0)]]:
        one = c.session_windows(dates, template)
        out = one if out is None else out.unionByName(one)
    return out


@query("tag_session", with_days("""SELECT d.seq, d.trading_date, count(*) FILTER (w.template = 'globex') AS globex, count(*) FILTER (w.template = 'rth') AS rth,
  count(*) FILTER (w.template = 'eth') AS eth, count(*) FILTER (w.template = 'overnight') AS overnight
  FROM dated d LEFT JOIN windows w ON w.trading_date = d.trading_date AND d.ts_us >= w.start_us AND d.ts_us < w.end_us GROUP BY ALL""", DATED, WINDOWS))
def _(spark, sf):
    names = ["globex", "rth", "eth", "overnight"]
    out = c.tag_session(days(spark, sf), names)
    return out.select(
        "seq", "trading_date",
        *[F.array_contains("sessions", n).cast("int").cast("long").alias(n) for n in names],
    )


@query("opening_range_window", with_days("SELECT trading_date, start_us, start_us + 1800000000 AS end_us FROM windows WHERE template = 'rth'", DATED, WINDOWS))
def _(spark, sf):
    return c.opening_range_window(_dates(spark, sf), 30)


@query("initial_balance_window", with_days("SELECT trading_date, start_us, start_us + 3600000000 AS end_us FROM windows WHERE template = 'rth'", DATED, WINDOWS))
def _(spark, sf):
    return c.initial_balance_window(_dates(spark, sf))


FRIDAY = "CAST(make_date({y}, {m}, 1) + CAST((12 - dayofweek(make_date({y}, {m}, 1))) % 7 + 14 AS INTEGER) AS DATE)"
CONTRACTS = f"""contracts AS (SELECT root, CAST(y AS INTEGER) AS year, CAST(m AS INTEGER) AS month, {FRIDAY.format(y='y', m='m')} AS expiry,
  root || CASE m WHEN 3 THEN 'H' WHEN 6 THEN 'M' WHEN 9 THEN 'U' ELSE 'Z' END || (y % 100) AS symbol
  FROM (VALUES ('NQ'), ('ES')) r(root), range(2023, 2027) t(y), (VALUES (3), (6), (9), (12)) q(m))"""


@query("contract_calendar", with_days("SELECT c.* FROM contracts c WHERE root IN (SELECT CASE instrument_id WHEN 1 THEN 'NQ' ELSE 'ES' END FROM tape)", CONTRACTS))
def _(spark, sf):
    return c.contract_calendar(days(spark, sf), 2023, 2026)


@query("front_month", with_days("""SELECT root, trading_date, arg_min(symbol, expiry) AS symbol, min(expiry) AS expiry, CAST(min(expiry) - trading_date AS INTEGER) AS days_to_expiry,
  min(expiry) - trading_date <= 8 AS in_rollover_window
  FROM (SELECT DISTINCT CASE instrument_id WHEN 1 THEN 'NQ' ELSE 'ES' END AS root, CAST(trading_date + CAST(seq % 90 AS INTEGER) AS DATE) AS trading_date FROM dated) d JOIN contracts c USING (root)
  WHERE c.expiry - trading_date >= 8 GROUP BY root, trading_date""", DATED, CONTRACTS))
def _(spark, sf):
    # dates spread over a quarter, so that rolls occur
    spread = c.trading_date(days(spark, sf)).select(
        "root", F.date_add("trading_date", (F.col("seq") % 90).cast("int")).alias("trading_date")
    ).distinct()
    return c.front_month(spread).drop("nearest_expiring")


@query("dst_rules", """SELECT l AS local_us,
  CASE WHEN wall(l + 5*3600000000) = l AND wall(l + 6*3600000000) <> l THEN l + 5*3600000000 ELSE l + 6*3600000000 END AS utc_us FROM
  (SELECT DISTINCT CASE WHEN event_id % 2 = 0 THEN 1710028800000000 ELSE 1730592000000000 END + (event_id % 288) * 300000000 AS l FROM events)""".replace(
    "wall(l + 5*3600000000)", "epoch_us(timezone('America/Chicago', timezone('UTC', make_timestamp(l + 5*3600000000))))").replace(
    "wall(l + 6*3600000000)", "epoch_us(timezone('America/Chicago', timezone('UTC', make_timestamp(l + 6*3600000000))))"))
def _(spark, sf):
    """Wall-clock times of the two switch-over days of 2024."""
    day = F.when(F.col("event_id") % 2 == 0, 1710028800000000).otherwise(1730592000000000)
    local = spark.read.parquet(f"{sf}/events.parquet").select(
        (day + (F.col("event_id") % 288) * 300_000_000).alias("local_us")
    ).distinct()
    return local.select("local_us", c.micros(c.local_to_utc(c.utc_ntz(F.col("local_us")))).alias("utc_us"))
