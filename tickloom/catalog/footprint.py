"""Footprints."""

from dataclasses import replace

from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.catalog.bars import BARS, MINUTE, minute_bars, minute_trades
from tickloom.catalog.base import fast, query, shared, with_fast
from tickloom.operators import bars as b
from tickloom.operators import footprint as fp

SET = fp.FootprintSettings(buy_ratio=2.0, sell_ratio=2.0, stacked_count=2, large_trade=60)
GAP = replace(SET, allow_one_gap=True, horizontal=True)

LV = """lv0 AS (SELECT instrument_id, bar_id, price_ticks, CAST(sum(CASE aggressor WHEN 2 THEN quantity ELSE 0 END) AS BIGINT) AS bid,
  CAST(sum(CASE aggressor WHEN 1 THEN quantity ELSE 0 END) AS BIGINT) AS ask, CAST(sum(CASE aggressor WHEN 0 THEN quantity ELSE 0 END) AS BIGINT) AS unknown,
  count(*) AS trades, count(*) FILTER (aggressor = 1) AS buy_trades, count(*) FILTER (aggressor = 2) AS sell_trades, max(quantity) AS max_print,
  coalesce(max(quantity) FILTER (aggressor = 1), 0) AS largest_buy, coalesce(max(quantity) FILTER (aggressor = 2), 0) AS largest_sell
  FROM assigned GROUP BY ALL),
lv AS (SELECT *, bid + ask AS total, ask - bid AS delta, CASE WHEN bid + ask > 0 THEN 100.0::DOUBLE * (ask - bid) / (bid + ask) ELSE 0 END AS delta_percent FROM lv0),
pub AS (SELECT * FROM lv WHERE total > 0),
nb AS (SELECT p.*, coalesce(d.bid, 0) AS bid_below, coalesce(u.ask, 0) AS ask_above FROM pub p
  LEFT JOIN pub d ON d.instrument_id = p.instrument_id AND d.bar_id = p.bar_id AND d.price_ticks = p.price_ticks - 1
  LEFT JOIN pub u ON u.instrument_id = p.instrument_id AND u.bar_id = p.bar_id AND u.price_ticks = p.price_ticks + 1)"""

DIAG = """ask >= 1 AND ask > 0 AND CASE WHEN bid_below <= 0 THEN ask >= 1 ELSE ask >= 2 * bid_below END AS buy_imbalance,
  bid >= 1 AND bid > 0 AND CASE WHEN ask_above <= 0 THEN bid >= 1 ELSE bid >= 2 * ask_above END AS sell_imbalance"""
FLAGS = f"fl AS (SELECT *, {DIAG} FROM nb)"
# with the same-price rule OR-ed in
FLAGS_GAP = f"""fl0 AS (SELECT *, {DIAG} FROM nb),
fl AS (SELECT * REPLACE (buy_imbalance OR (ask > 0 AND CASE WHEN bid <= 0 THEN true ELSE ask >= 2 * bid END) AS buy_imbalance,
  sell_imbalance OR (bid > 0 AND CASE WHEN ask <= 0 THEN true ELSE bid >= 2 * ask END) AS sell_imbalance) FROM fl0)"""


def _zones_sql(gap: bool) -> str:
    """Walk each bar's levels in price order, extending or closing the current zone."""
    cond = "x.p - a.last_p = 1" + (" OR (x.p - a.last_p = 2 AND NOT a.gap)" if gap else "")
    walk = """{'open': x.f, 'gap': CASE WHEN x.f AND a.open AND (%(c)s) THEN a.gap OR x.p - a.last_p = 2 ELSE false END,
      'last_p': x.p, 'low': CASE WHEN x.f AND a.open AND (%(c)s) THEN a.low ELSE x.p END,
      'zs': CASE WHEN x.f THEN list_append(a.zs, {'p': x.p, 'v': x.v, 'low': CASE WHEN a.open AND (%(c)s) THEN a.low ELSE x.p END}) ELSE a.zs END}""" % {"c": cond}
    init = "{'open': false, 'gap': false, 'last_p': 0::BIGINT, 'low': 0::BIGINT, 'zs': []::STRUCT(p BIGINT, v BIGINT, low BIGINT)[]}"
    return f"""sides AS (SELECT instrument_id, bar_id, 'Buy' AS side, list({{'p': price_ticks, 'v': ask, 'f': buy_imbalance}} ORDER BY price_ticks) AS l FROM fl GROUP BY ALL
  UNION ALL SELECT instrument_id, bar_id, 'Sell', list({{'p': price_ticks, 'v': bid, 'f': sell_imbalance}} ORDER BY price_ticks) FROM fl GROUP BY ALL),
members AS (SELECT instrument_id, bar_id, side, unnest(list_reduce(l, lambda a, x: {walk}, {init}).zs, recursive := true) FROM sides),
zones AS (SELECT instrument_id, bar_id, side, low, max(p) AS high, count(*) AS levels FROM members GROUP BY ALL HAVING count(*) >= 2)"""


def levels(spark, sf):
    return shared(spark, sf, "levels-1m", lambda: fp.footprint_levels(minute_trades(spark, sf)))


BARKEY = "instrument_id, bar_id"


@query("footprint_levels", with_fast("SELECT * REPLACE (round(delta_percent, 6) AS delta_percent) FROM lv", BARS, LV))
def _(spark, sf):
    return fp.footprint_levels(minute_trades(spark, sf)).withColumn("delta_percent", F.round("delta_percent", 6))


POC_SQL = 'first(price_ticks ORDER BY {m} DESC, abs(price_ticks - "close"), CASE WHEN "close" >= "open" THEN -price_ticks ELSE price_ticks END)'
_metrics = {"total": "total", "bid": "bid", "ask": "ask", "abs_delta": "abs(pub.delta)", "trades": "pub.trades"}


@query("footprint_poc", with_fast(
    f"SELECT {BARKEY}, " + ", ".join(f"{POC_SQL.format(m=v)} AS poc_{k}" for k, v in _metrics.items()) + f" FROM pub JOIN bars USING ({BARKEY}) GROUP BY ALL", BARS, LV))
def _(spark, sf):
    lv, bars = levels(spark, sf), minute_bars(spark, sf)
    out = None
    for metric in fp.POC_METRICS:
        one = fp.footprint_poc(lv, bars, metric).withColumnRenamed("poc", f"poc_{metric}")
        out = one if out is None else out.join(one, fp.BAR)
    return out


@query("diagonal_imbalance", with_fast(f"SELECT {BARKEY}, price_ticks, buy_imbalance, sell_imbalance FROM fl", BARS, LV, FLAGS))
def _(spark, sf):
    return fp.diagonal_imbalance(levels(spark, sf), SET).select(*fp.BAR, "price_ticks", "buy_imbalance", "sell_imbalance")


@query("zero_denominator", with_fast(f"""SELECT {BARKEY}, count(*) FILTER (ask >= 5 AND bid_below > 0 AND ask >= 2 * bid_below) AS n_ignore,
  count(*) FILTER (ask >= 5 AND (bid_below <= 0 OR ask >= 2 * bid_below)) AS n_require_min_numerator,
  count(*) FILTER (ask >= 5 AND (bid_below <= 0 OR ask >= 2 * bid_below)) AS n_extreme_imbalance,
  count(*) FILTER (ask >= 5 AND CASE WHEN bid_below <= 0 THEN ask >= 60 ELSE ask >= 2 * bid_below END) AS n_denominator_floor FROM nb GROUP BY ALL""", BARS, LV))
def _(spark, sf):
    lv = fp._neighbours(fp.published(levels(spark, sf)))
    by = [
        F.count_if(fp.qualifies(F.col("ask"), F.col("bid_below"), 2.0, replace(SET, zero_denominator=policy, min_imbalance=5, denominator_floor=30))).alias(f"n_{policy}")
        for policy in fp.POLICIES
    ]
    return lv.groupBy(*fp.BAR).agg(*by)


@query("horizontal_imbalance", with_fast(f"""SELECT {BARKEY}, price_ticks, side, CASE side WHEN 'Buy' THEN ask ELSE bid END AS volume, CASE side WHEN 'Buy' THEN bid ELSE ask END AS compared
  FROM (SELECT *, CASE WHEN ask >= 1 AND (bid <= 0 OR ask >= 2 * bid) THEN 'Buy' WHEN bid >= 1 AND (ask <= 0 OR bid >= 2 * ask) THEN 'Sell' END AS side FROM pub) WHERE side IS NOT NULL""", BARS, LV))
def _(spark, sf):
    return fp.horizontal_imbalance(levels(spark, sf), SET)


@query("imbalance_markers", with_fast(f"""SELECT {BARKEY}, price_ticks, 'Buy' AS side, ask AS volume, bid_below AS compared FROM nb WHERE ask >= 1 AND (bid_below <= 0 OR ask >= 3 * bid_below)
  UNION ALL SELECT {BARKEY}, price_ticks, 'Sell', bid, ask_above FROM nb WHERE bid >= 1 AND (ask_above <= 0 OR bid >= 3 * ask_above)""", BARS, LV))
def _(spark, sf):
    return fp.imbalance_markers(levels(spark, sf))


@query("stacked_zones", with_fast("SELECT * FROM zones", BARS, LV, FLAGS, _zones_sql(False)))
def _(spark, sf):
    return fp.stacked_zones(fp.imbalance_flags(levels(spark, sf), SET), SET)


@query("stacked_zones_gap", with_fast("SELECT * FROM zones", BARS, LV, FLAGS_GAP, _zones_sql(True)))
def _(spark, sf):
    return fp.stacked_zones(fp.imbalance_flags(levels(spark, sf), GAP), GAP)


@query("stacked_flags", with_fast(f"""SELECT {BARKEY}, price_ticks,
  buy_imbalance AND EXISTS (FROM zones z WHERE z.side = 'Buy' AND z.instrument_id = fl.instrument_id AND z.bar_id = fl.bar_id AND price_ticks BETWEEN low AND high) AS stacked_buy,
  sell_imbalance AND EXISTS (FROM zones z WHERE z.side = 'Sell' AND z.instrument_id = fl.instrument_id AND z.bar_id = fl.bar_id AND price_ticks BETWEEN low AND high) AS stacked_sell FROM fl""",
    BARS, LV, FLAGS, _zones_sql(False)))
def _(spark, sf):
    out = fp.stacked_flags(fp.imbalance_flags(levels(spark, sf), SET), SET)
    return out.select(*fp.BAR, "price_ticks", "stacked_buy", "stacked_sell")


ZERO = "((bid = 0 AND ask >= 1) OR (ask = 0 AND bid >= 1)) AND price_ticks <> high AND price_ticks <> low"


@query("zero_prints", with_fast(f"SELECT {BARKEY}, price_ticks, bid, ask FROM pub JOIN bars USING ({BARKEY}) WHERE {ZERO}", BARS, LV))
def _(spark, sf):
    return fp.zero_prints(levels(spark, sf), minute_bars(spark, sf), SET)


AUCTION = """coalesce(max(CASE WHEN price_ticks = high AND bid >= 1 THEN CASE WHEN is_closed THEN 'Confirmed' ELSE 'Developing' END END), 'None') AS unfinished_high,
  coalesce(max(CASE WHEN price_ticks = low AND ask >= 1 THEN CASE WHEN is_closed THEN 'Confirmed' ELSE 'Developing' END END), 'None') AS unfinished_low"""


@query("unfinished_auction", with_fast(f"SELECT {BARKEY}, {AUCTION} FROM pub JOIN bars USING ({BARKEY}) GROUP BY ALL", BARS, LV))
def _(spark, sf):
    return fp.unfinished_auction(levels(spark, sf), minute_bars(spark, sf), SET)


@query("large_trade_levels", with_fast(f"SELECT {BARKEY}, price_ticks, max_print FROM pub WHERE max_print >= 60", BARS, LV))
def _(spark, sf):
    return fp.large_trade_levels(levels(spark, sf), SET)


@query("footprint_bar", with_fast(f"""SELECT b.instrument_id, b.bar_id, b.volume, b.buy, b.sell, t.unknown, b.delta, b.trades, r.poc, r.max_delta, r.min_delta, r.buy_imbalances, r.sell_imbalances,
  coalesce(z.zone_count, 0) AS zone_count, r.unfinished_high, r.unfinished_low, r.n_levels, r.zero_prints FROM bars b
  JOIN (SELECT {BARKEY}, CAST(sum(unknown) AS BIGINT) AS unknown FROM lv GROUP BY ALL) t USING ({BARKEY})
  LEFT JOIN (SELECT {BARKEY}, {POC_SQL.format(m='total')} AS poc, greatest(0, max(fl.delta)) AS max_delta, least(0, min(fl.delta)) AS min_delta, count(*) FILTER (buy_imbalance) AS buy_imbalances,
    count(*) FILTER (sell_imbalance) AS sell_imbalances, {AUCTION}, count(*) AS n_levels, count(*) FILTER ({ZERO}) AS zero_prints FROM fl JOIN bars USING ({BARKEY}) GROUP BY ALL) r USING ({BARKEY})
  LEFT JOIN (SELECT {BARKEY}, count(*) AS zone_count FROM zones GROUP BY ALL) z USING ({BARKEY})""", BARS, LV, FLAGS, _zones_sql(False)))
def _(spark, sf):
    out = fp.footprint_bar(levels(spark, sf), minute_bars(spark, sf), SET)
    return out.select(
        *fp.BAR, "volume", "buy", "sell", "unknown", "delta", "trades", "poc", "max_delta", "min_delta", "buy_imbalances",
        "sell_imbalances", "zone_count", "unfinished_high", "unfinished_low",
        F.when(F.col("levels").isNotNull(), F.size("levels")).cast("long").alias("n_levels"),
        F.when(F.col("levels").isNotNull(), F.size(F.filter("levels", lambda x: x["is_zero_print"]))).cast("long").alias("zero_prints"),
    )


@query("footprint_bar_by_instrument", with_fast(f"""SELECT b.instrument_id, b.bar_id, r.poc, coalesce(r.buy_imbalances, 0) AS buy_imbalances, coalesce(r.sell_imbalances, 0) AS sell_imbalances, coalesce(r.large, 0) AS large FROM bars b
  LEFT JOIN (SELECT {BARKEY}, {POC_SQL.format(m='total')} AS poc, count(*) FILTER (ask >= lim AND (bid_below <= 0 OR ask >= 3 * bid_below)) AS buy_imbalances, count(*) FILTER (bid >= lim AND (ask_above <= 0 OR bid >= 3 * ask_above)) AS sell_imbalances,
    count(*) FILTER (max_print >= CASE instrument_id WHEN 1 THEN 45 ELSE 75 END) AS large FROM (SELECT *, CASE instrument_id WHEN 1 THEN 2 ELSE 4 END AS lim FROM nb) JOIN bars USING ({BARKEY}) GROUP BY ALL) r USING ({BARKEY})""", BARS, LV))
def _(spark, sf):
    out = fp.footprint_bar(levels(spark, sf), minute_bars(spark, sf), fp.settings_table(spark, {1: fp.NQ, 2: fp.ES}))
    zero = F.lit(0).cast("long")
    return out.select(
        *fp.BAR, "poc", F.coalesce("buy_imbalances", zero).alias("buy_imbalances"), F.coalesce("sell_imbalances", zero).alias("sell_imbalances"),
        F.coalesce(F.when(F.col("levels").isNotNull(), F.size(F.filter("levels", lambda x: x["is_large"]))).cast("long"), zero).alias("large"),
    )


@query("footprint_fingerprint", with_fast(f"""SELECT b.instrument_id, b.bar_id, md5(concat_ws('|', b."open", b.high, b.low, b."close", coalesce(CAST(poc AS VARCHAR), ''), coalesce(ls, ''), coalesce(zs, ''))) AS fingerprint FROM bars b
  LEFT JOIN (SELECT {BARKEY}, {POC_SQL.format(m='total')} AS poc, string_agg(concat_ws(':', price_ticks, bid, ask, unknown, fl.trades, max_print), ',' ORDER BY price_ticks) AS ls FROM fl JOIN bars USING ({BARKEY}) GROUP BY ALL) r USING ({BARKEY})
  LEFT JOIN (SELECT {BARKEY}, string_agg(concat_ws(':', side, low, high, levels), ',' ORDER BY side, low, high) AS zs FROM zones GROUP BY ALL) z USING ({BARKEY})""", BARS, LV, FLAGS, _zones_sql(False)))
def _(spark, sf):
    return fp.footprint_fingerprint(fp.footprint_bar(levels(spark, sf), minute_bars(spark, sf), SET))


@query("footprint_settings", with_fast(f"""SELECT instrument_id, CASE instrument_id WHEN 1 THEN 45 ELSE 75 END::BIGINT AS large_trade, CASE instrument_id WHEN 1 THEN 2 ELSE 4 END::BIGINT AS min_imbalance,
  count(*) FILTER (max_print >= CASE instrument_id WHEN 1 THEN 45 ELSE 75 END) AS large_levels, count(*) AS levels FROM pub GROUP BY ALL""", BARS, LV))
def _(spark, sf):
    table = fp.settings_table(spark, {1: fp.NQ, 2: fp.ES})
    return fp.published(levels(spark, sf)).join(table, S.KEY).groupBy("instrument_id", "large_trade", "min_imbalance").agg(
        F.count_if(F.col("max_print") >= F.col("large_trade")).alias("large_levels"), F.count(F.lit(1)).alias("levels"))


@query("cell_metric", with_fast(f"""SELECT {BARKEY}, price_ticks, CAST(abs(delta) AS DOUBLE) AS metric, round(CASE WHEN delta = 0 THEN 0 ELSE ln(1 + abs(delta)) / ln(1 + greatest(1, max(abs(delta)) OVER (PARTITION BY {BARKEY}))) END, 6) AS intensity,
  round(total / greatest(1, max(total) OVER (PARTITION BY {BARKEY})), 6) AS background FROM pub""".replace(
      "round(total / greatest(1, max(total) OVER (PARTITION BY instrument_id, bar_id)), 6)", "round(ln(1 + total) / ln(1 + greatest(1, max(total) OVER (PARTITION BY instrument_id, bar_id))), 6)"), BARS, LV))
def _(spark, sf):
    out = fp.cell_intensity(levels(spark, sf), "delta", "total", "log")
    return out.withColumns({"intensity": F.round("intensity", 6), "background": F.round("background", 6)})


@query("cell_intensity", with_fast(f"""SELECT {BARKEY}, price_ticks, CAST(total AS DOUBLE) AS metric, round(total / greatest(1, max(total) OVER (PARTITION BY instrument_id))::DOUBLE, 6) AS intensity,
  round(abs(delta) / greatest(1, max(abs(delta)) OVER (PARTITION BY instrument_id))::DOUBLE, 6) AS background FROM pub""", BARS, LV))
def _(spark, sf):
    out = fp.cell_intensity(levels(spark, sf), "bid_ask", "abs_delta", "range")
    return out.withColumns({"intensity": F.round("intensity", 6), "background": F.round("background", 6)})


#: Every cell mode with a background, and what they show.
MODES = [
    ("bid_ask", "bid", "total", "bid"), ("delta", "ask", "abs(delta)", "ask"), ("total", "total", "total", "total"), ("volume_profile", "delta", "total", "abs(delta)"),
    ("bid_only", "abs_delta", "bid", "abs(delta)"), ("ask_only", "delta_percent", "ask", "abs(delta_percent)"), ("delta_percent", "trade_count", "abs(delta_percent)", "trades"), ("trade_count", "none", "trades", "0"),
]


def _mode_sql(mode: str, metric: str, magnitude: str) -> str:
    def scaled(value: str) -> str:
        return f"CASE WHEN {value} <= 0 THEN 0 ELSE least(1, sqrt(CAST({value} AS DOUBLE)) / sqrt(CAST(greatest(1, max({value}) OVER w) AS DOUBLE))) END"

    return f"""SELECT '{mode}' AS mode, {BARKEY}, price_ticks, round(CAST({metric} AS DOUBLE), 6) AS metric, round({scaled(metric)}, 6) AS intensity,
  round({scaled(magnitude)}, 6) AS background FROM pub WINDOW w AS (PARTITION BY {BARKEY})"""


@query("cell_modes", with_fast(" UNION ALL ".join(_mode_sql(mode, metric, magnitude) for mode, _, metric, magnitude in MODES), BARS, LV))
def _(spark, sf):
    """All cell modes and backgrounds, scaled by square roots."""
    out = None
    for mode, background, _, _ in MODES:
        cells = fp.cell_intensity(levels(spark, sf), mode, background, "sqrt")
        one = cells.select(F.lit(mode).alias("mode"), *fp.BAR, "price_ticks", *[F.round(x, 6).alias(x) for x in ("metric", "intensity", "background")])
        out = one if out is None else out.unionByName(one)
    return out


@query("large_prints_by_percentile", with_fast(f"""SELECT {BARKEY}, price_ticks, max_print FROM pub JOIN (SELECT instrument_id, min(quantity) FILTER (r >= ceil(0.99::DOUBLE * n)) AS lim FROM
  (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY quantity) AS r, count(*) OVER (PARTITION BY instrument_id) AS n FROM assigned) GROUP BY 1) USING (instrument_id) WHERE max_print >= lim""", BARS, LV))
def _(spark, sf):
    s = replace(SET, large_trade_percentile=0.99)
    return fp.large_trade_levels(levels(spark, sf), s, minute_trades(spark, sf))
