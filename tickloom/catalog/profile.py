"""Volume and time profiles."""

from pyspark.sql import functions as F

from tickloom.catalog.base import fast, query, with_days, with_fast
from tickloom.catalog.calendar import DATED, WINDOWS
from tickloom.catalog.flow import DATED_TRADES, day_trades
from tickloom.operators import calendar as c
from tickloom.operators import profile as p
from tickloom.operators.quality import trades

PROFILE = """profile AS (SELECT instrument_id, price_ticks, CAST(sum(CASE aggressor WHEN 1 THEN quantity ELSE 0 END) AS BIGINT) AS buy,
  CAST(sum(CASE aggressor WHEN 2 THEN quantity ELSE 0 END) AS BIGINT) AS sell, CAST(sum(CASE aggressor WHEN 0 THEN quantity ELSE 0 END) AS BIGINT) AS unknown
  FROM trades GROUP BY ALL),
levels AS (SELECT *, buy + sell AS total, buy - sell AS delta FROM profile)"""


def area_sql(source: str, keys: str, weight: str, target: str) -> str:
    """The walk itself, level by level: from the point of control the larger of the two next levels is taken (the upper one on
    a tie) until the target is reached."""
    up, down = "a.i < len(up) AND (a.j >= len(down) OR up[a.i + 1] >= down[a.j + 1])", "a.j < len(down)"
    return f"""marked AS (SELECT *, first_value(price_ticks) OVER (PARTITION BY {keys} ORDER BY {weight} DESC, price_ticks DESC) AS poc FROM {source}),
ends_ AS (SELECT {keys}, poc, any_value({target}) AS goal, CAST(sum({weight}) FILTER (price_ticks = poc) AS BIGINT) AS own,
  coalesce(list(CAST({weight} AS BIGINT) ORDER BY price_ticks) FILTER (price_ticks > poc), []) AS up, list(price_ticks ORDER BY price_ticks) FILTER (price_ticks > poc) AS up_prices,
  coalesce(list(CAST({weight} AS BIGINT) ORDER BY price_ticks DESC) FILTER (price_ticks < poc), []) AS down, list(price_ticks ORDER BY price_ticks DESC) FILTER (price_ticks < poc) AS down_prices
  FROM marked GROUP BY {keys}, poc),
walked AS (SELECT *, list_reduce(range(len(up) + len(down)), lambda a, x: CASE WHEN a.s >= goal THEN a
    WHEN {up} THEN {{'i': a.i + 1, 'j': a.j, 's': a.s + up[a.i + 1]}} WHEN {down} THEN {{'i': a.i, 'j': a.j + 1, 's': a.s + down[a.j + 1]}} ELSE a END,
    {{'i': 0::BIGINT, 'j': 0::BIGINT, 's': own}}) AS w FROM ends_),
area AS (SELECT {keys}, poc, CASE WHEN w.j > 0 THEN down_prices[w.j] ELSE poc END AS val, CASE WHEN w.i > 0 THEN up_prices[w.i] ELSE poc END AS vah FROM walked)"""


AREA = ("shown AS (SELECT * FROM (SELECT *, ceil(sum(total + unknown) OVER (PARTITION BY instrument_id) * 0.7::DOUBLE) AS target FROM levels) WHERE total > 0),\n"
        + area_sql("shown", "instrument_id", "total", "target"))


def session_profile(spark, sf):
    return p.volume_profile(trades(fast(spark, sf)))


@query("volume_profile", with_fast("SELECT * FROM levels", PROFILE))
def _(spark, sf):
    return session_profile(spark, sf)


@query("poc", with_fast("SELECT instrument_id, first(price_ticks ORDER BY total DESC, price_ticks DESC) AS poc FROM levels WHERE total > 0 GROUP BY 1", PROFILE))
def _(spark, sf):
    return p.poc(session_profile(spark, sf))


@query("value_area", with_fast("SELECT * FROM area", PROFILE, AREA))
def _(spark, sf):
    return p.value_area(session_profile(spark, sf))


@query("daily_value_area", with_days("SELECT * FROM area", DATED_TRADES, PROFILE.replace("FROM trades", "FROM dtrades").replace("instrument_id,", "instrument_id, trading_date,"),
    "shown AS (SELECT * FROM (SELECT *, ceil(sum(total + unknown) OVER (PARTITION BY instrument_id, trading_date) * 0.7::DOUBLE) AS target FROM levels) WHERE total > 0)",
    area_sql("shown", "instrument_id, trading_date", "total", "target")))
def _(spark, sf):
    keys = ["instrument_id", "trading_date"]
    return p.value_area(p.volume_profile(day_trades(spark, sf), keys), keys=keys)


@query("delta_profile", with_fast("SELECT instrument_id, price_ticks, delta FROM levels WHERE total > 0", PROFILE))
def _(spark, sf):
    return p.delta_profile(session_profile(spark, sf))


@query("bid_ask_profile", with_fast("SELECT instrument_id, price_ticks, sell AS at_bid, buy AS at_ask FROM levels WHERE total > 0", PROFILE))
def _(spark, sf):
    return p.bid_ask_profile(session_profile(spark, sf))


@query("bulk_profile", """SELECT CAST(l_shipdate AS DATE) AS day, CAST(floor(4 * l_extendedprice / l_quantity) AS BIGINT) AS price_ticks,
  CAST(sum(CASE l_returnflag WHEN 'R' THEN l_quantity ELSE 0 END) AS BIGINT) AS buy, CAST(sum(CASE l_returnflag WHEN 'A' THEN l_quantity ELSE 0 END) AS BIGINT) AS sell,
  CAST(sum(CASE l_returnflag WHEN 'N' THEN l_quantity ELSE 0 END) AS BIGINT) AS unknown, CAST(sum(CASE l_returnflag WHEN 'N' THEN 0 ELSE l_quantity END) AS BIGINT) AS total,
  CAST(sum(CASE l_returnflag WHEN 'R' THEN l_quantity WHEN 'A' THEN -l_quantity ELSE 0 END) AS BIGINT) AS delta FROM lineitem GROUP BY ALL""")
def _(spark, sf):
    """Daily profiles of line items taken as trades (order does not matter here)."""
    items = spark.read.parquet(f"{sf}/lineitem.parquet").select(
        F.to_date("l_shipdate").alias("day"),
        F.floor(4 * F.col("l_extendedprice") / F.col("l_quantity")).cast("long").alias("price_ticks"),
        F.col("l_quantity").cast("long").alias("quantity"),
        F.expr("CASE l_returnflag WHEN 'R' THEN 1 WHEN 'A' THEN 2 ELSE 0 END").alias("aggressor"),
    )
    return p.volume_profile(items, ["day"])


KEYS = ["instrument_id", "trading_date"]
TPO = """opened AS (SELECT t.*, w.start_us FROM dtrades t JOIN windows w ON w.template = 'rth' AND w.trading_date = t.trading_date WHERE t.ts_us >= w.start_us),
visits AS (SELECT DISTINCT instrument_id, trading_date, price_ticks, (ts_us - start_us) // 1800000000 AS bracket FROM opened),
tpo AS (SELECT instrument_id, trading_date, price_ticks, count(*) AS tpo, string_agg(chr(CAST(65 + bracket % 26 AS INTEGER)), '' ORDER BY bracket) AS letters, max(bracket) AS last_bracket FROM visits GROUP BY ALL)"""


def _tpo(spark, sf):
    """Time profiles per trading date, from the regular open (brackets run to the date's end)."""
    dated = day_trades(spark, sf)
    start = c.micros(c.local_to_utc(c._at(F.col("trading_date"), 0, "08:30")))
    return p.tpo_profile(dated.withColumn("start_us", start), "start_us", keys=KEYS)


@query("tpo_profile", with_days("SELECT * FROM tpo", DATED_TRADES, WINDOWS, TPO))
def _(spark, sf):
    return _tpo(spark, sf)


@query("tpo_poc", with_days("SELECT instrument_id, trading_date, first(price_ticks ORDER BY tpo DESC, price_ticks DESC) AS poc FROM tpo GROUP BY ALL", DATED_TRADES, WINDOWS, TPO))
def _(spark, sf):
    return p.tpo_poc(_tpo(spark, sf), KEYS)


@query("tpo_value_area", with_days("SELECT * FROM area", DATED_TRADES, WINDOWS, TPO,
    "tshown AS (SELECT *, ceil(sum(tpo) OVER (PARTITION BY instrument_id, trading_date) * 0.7::DOUBLE) AS target FROM tpo)",
    area_sql("tshown", "instrument_id, trading_date", "tpo", "target")))
def _(spark, sf):
    return p.tpo_value_area(_tpo(spark, sf), keys=KEYS)


@query("bracket_count", with_days("SELECT instrument_id, trading_date, max(last_bracket) + 1 AS brackets FROM tpo GROUP BY ALL", DATED_TRADES, WINDOWS, TPO))
def _(spark, sf):
    return p.bracket_count(_tpo(spark, sf), KEYS)
