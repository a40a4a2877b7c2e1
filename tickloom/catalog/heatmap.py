"""Heatmap, bubbles, time and sales."""

from pyspark.sql import functions as F

from tickloom.catalog.base import fast, query, shared, with_fast
from tickloom.operators import heatmap as h
from tickloom.operators import tape_view as t

STEP = 60_000_000
OPEN, CLOSE = 1_717_421_400_000_000, 1_717_432_200_000_000

HEAT = f"""quotes AS (SELECT instrument_id, side, price_ticks, seq, quantity, (ts_us - min(ts_us) OVER (PARTITION BY instrument_id)) // {STEP} AS col,
  (max(ts_us) OVER (PARTITION BY instrument_id) - min(ts_us) OVER (PARTITION BY instrument_id)) // {STEP} AS last_col FROM tape WHERE type IN (6, 7)),
lasts AS (SELECT instrument_id, side, price_ticks, col, last_col, arg_max(quantity, seq) AS size FROM quotes GROUP BY ALL),
spans AS (SELECT * FROM (SELECT *, coalesce(lead(col) OVER (PARTITION BY instrument_id, side, price_ticks ORDER BY col), last_col + 1) AS to_col FROM lasts) WHERE size > 0),
cells AS (SELECT instrument_id, unnest(range(col, to_col)) AS col, side, price_ticks, size FROM spans),
win AS (SELECT instrument_id, min(price_ticks) - greatest(4, (max(price_ticks) - min(price_ticks)) // 12) AS lo, max(price_ticks) + greatest(4, (max(price_ticks) - min(price_ticks)) // 12) AS hi
  FROM cells JOIN (SELECT DISTINCT instrument_id, last_col FROM lasts) USING (instrument_id) WHERE col > last_col - 80 GROUP BY 1),
mids AS (SELECT instrument_id, col, coalesce((b + a) // 2, b, a) AS mid FROM (SELECT instrument_id, col, max(price_ticks) FILTER (side = 1) AS b, min(price_ticks) FILTER (side = 2) AS a FROM cells GROUP BY ALL)),
scales AS (SELECT instrument_id, CAST(max(size) AS DOUBLE) AS absolute, CAST(greatest(1, min(size) FILTER (r >= ceil(0.95::DOUBLE * n))) AS DOUBLE) AS percentile, ln(max(size) + 1) AS logarithmic
  FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY size) AS r, count(*) OVER (PARTITION BY instrument_id) AS n FROM cells) GROUP BY 1)"""


def spans(spark, sf):
    return shared(spark, sf, "heat-spans", lambda: h.heat_intervals(fast(spark, sf), STEP))


def cells(spark, sf):
    return h.liquidity_heatmap(spans(spark, sf))


@query("liquidity_heatmap", with_fast("SELECT * FROM cells", HEAT))
def _(spark, sf):
    return cells(spark, sf)


FINE = 2_000_000  # more columns than a display keeps


@query("liquidity_heatmap_fine", with_fast("SELECT instrument_id, col, count(*) AS levels, CAST(sum(size) AS BIGINT) AS size FROM cells GROUP BY ALL", HEAT.replace(str(STEP), str(FINE))))
def _(spark, sf):
    """Depth of every column at a fine interval, the oldest included."""
    fine = h.liquidity_heatmap(h.heat_intervals(fast(spark, sf), FINE))
    return fine.groupBy("instrument_id", "col").agg(F.count(F.lit(1)).alias("levels"), F.sum("size").alias("size"))


@query("heatmap_faint", with_fast("""SELECT m.instrument_id, m.col, m.price_ticks, m.size FROM
  (SELECT instrument_id, col, price_ticks, CAST(sum(size) AS BIGINT) AS size FROM cells JOIN win USING (instrument_id) WHERE price_ticks >= lo AND price_ticks < hi GROUP BY ALL) m
  JOIN scales USING (instrument_id) WHERE least(1, m.size / absolute) >= 0.2""", HEAT))
def _(spark, sf):
    """Cells of at least a fifth of the scale."""
    s = spans(spark, sf)
    return h.heatmap_cells(cells(spark, sf), h.heatmap_scale(s), h.price_window(s), least_intensity=0.2).select("instrument_id", "col", "price_ticks", "size")


@query("heatmap_range", with_fast("SELECT * FROM cells WHERE col BETWEEN 40 AND 49", HEAT))
def _(spark, sf):
    return h.liquidity_heatmap(spans(spark, sf), 40, 49)


@query("heatmap_scale", with_fast("SELECT instrument_id, absolute, percentile, round(logarithmic, 6) AS logarithmic FROM scales", HEAT))
def _(spark, sf):
    return h.heatmap_scale(spans(spark, sf)).withColumn("logarithmic", F.round("logarithmic", 6))


@query("heatmap_intensity", with_fast("""SELECT instrument_id, col, side, price_ticks, round(least(1, size / percentile), 6) AS by_percentile, round(least(1, ln(size + 1) / logarithmic), 6) AS by_log
  FROM cells JOIN scales USING (instrument_id)""", HEAT))
def _(spark, sf):
    lit = cells(spark, sf).join(h.heatmap_scale(spans(spark, sf)), "instrument_id")
    size = F.col("size")
    return lit.select(
        "instrument_id", "col", "side", "price_ticks",
        F.round(h.heatmap_intensity(size, F.col("percentile"), "percentile"), 6).alias("by_percentile"),
        F.round(h.heatmap_intensity(size, F.col("logarithmic"), "logarithmic"), 6).alias("by_log"),
    )


@query("heatmap_retention", with_fast("""SELECT instrument_id, side, price_ticks, greatest(col, last_col - 31) AS from_col, to_col, size FROM spans WHERE to_col > last_col - 31""", HEAT))
def _(spark, sf):
    return h.heatmap_retention(spans(spark, sf), 32).select("instrument_id", "side", "price_ticks", "from_col", "to_col", "size")


@query("price_window", with_fast("SELECT * FROM win", HEAT))
def _(spark, sf):
    return h.price_window(spans(spark, sf), 80)


@query("column_mid", with_fast("SELECT * FROM mids", HEAT))
def _(spark, sf):
    return h.column_mid(cells(spark, sf), h.price_window(spans(spark, sf)))


@query("heatmap_cells", with_fast("""SELECT m.instrument_id, m.col, m.price_ticks, m.size, m.price_ticks < mid AS is_below, round(least(1, m.size / absolute), 6) AS intensity FROM
  (SELECT instrument_id, col, price_ticks, CAST(sum(size) AS BIGINT) AS size FROM cells JOIN win USING (instrument_id) WHERE price_ticks >= lo AND price_ticks < hi GROUP BY ALL HAVING sum(size) >= 10) m
  JOIN mids USING (instrument_id, col) JOIN scales USING (instrument_id)""", HEAT))
def _(spark, sf):
    s = spans(spark, sf)
    out = h.heatmap_cells(cells(spark, sf), h.heatmap_scale(s), h.price_window(s), 10)
    return out.withColumn("intensity", F.round("intensity", 6))


@query("resting_walls", with_fast("""SELECT instrument_id, side, price_ticks, size, round(size / CAST(top AS DOUBLE), 6) AS strength FROM (SELECT *, max(size) OVER (PARTITION BY instrument_id) AS top FROM spans WHERE to_col > last_col)
  JOIN win USING (instrument_id) WHERE price_ticks >= lo AND price_ticks < hi AND size >= greatest(5, CAST(floor(top * 0.55::DOUBLE) AS BIGINT))""", HEAT))
def _(spark, sf):
    s = spans(spark, sf)
    return h.resting_walls(s, h.price_window(s), 5).withColumn("strength", F.round("strength", 6))


BUCKETED = f"""bucketed AS (SELECT *, CAST(floor(greatest(0, least(199, (ts_us - {OPEN}) / 1e6::DOUBLE / {(CLOSE - OPEN) / 1e6}::DOUBLE * 199::DOUBLE))) AS INTEGER) AS bucket FROM trades WHERE ts_us >= {OPEN})"""


@query("trade_bubbles", with_fast("""SELECT instrument_id, bucket, price_ticks, buy, sell, buy >= sell AS is_buy, round(greatest(2.4, least(18, 2.4 + sqrt((buy + sell) / CAST(max(buy + sell) OVER (PARTITION BY instrument_id) AS DOUBLE)) * 16)), 4) AS radius FROM
  (SELECT instrument_id, bucket, price_ticks, CAST(sum(CASE aggressor WHEN 1 THEN quantity ELSE 0 END) AS BIGINT) AS buy, CAST(sum(CASE aggressor WHEN 1 THEN 0 ELSE quantity END) AS BIGINT) AS sell FROM bucketed GROUP BY ALL)""", BUCKETED))
def _(spark, sf):
    return h.trade_bubbles(fast(spark, sf), OPEN, CLOSE, 200).withColumn("radius", F.round("radius", 4))


@query("volume_histogram", with_fast("""SELECT instrument_id, bucket, CAST(sum(CASE aggressor WHEN 1 THEN quantity ELSE 0 END) AS BIGINT) AS buy, CAST(sum(CASE aggressor WHEN 1 THEN 0 ELSE quantity END) AS BIGINT) AS sell FROM bucketed GROUP BY ALL""", BUCKETED))
def _(spark, sf):
    return h.volume_histogram(fast(spark, sf), OPEN, CLOSE, 200)


@query("time_and_sales", with_fast("SELECT instrument_id, seq, price_ticks, quantity, aggressor, quantity >= 50 AS is_large FROM trades WHERE quantity >= 10 AND aggressor IN (1, 2) ORDER BY ts_us DESC, seq DESC, instrument_id LIMIT 200"))
def _(spark, sf):
    return t.time_and_sales(fast(spark, sf), 200, min_size=10, sides=[1, 2]).drop("ts_us")


@query("running_volume", with_fast("SELECT instrument_id, seq, CAST(sum(quantity) OVER (PARTITION BY instrument_id ORDER BY seq) AS BIGINT) AS running_volume FROM trades"))
def _(spark, sf):
    return t.running_volume(fast(spark, sf)).select("instrument_id", "seq", "running_volume")


@query("tape_speed", with_fast("""SELECT instrument_id, seq, ts_us, round(sn / 5.0::DOUBLE, 6) AS trades_per_second, round(sq / 5.0::DOUBLE, 6) AS contracts_per_second, round(ln_ / 60.0::DOUBLE, 6) AS trades_per_second_long,
  round((sn / 5.0::DOUBLE) / (ln_ / 60.0::DOUBLE), 6) AS acceleration FROM (SELECT t.instrument_id, t.seq, any_value(t.ts_us) AS ts_us, count(*) AS ln_, count(*) FILTER (p.ts_us >= t.ts_us - 5000000) AS sn,
  sum(p.quantity) FILTER (p.ts_us >= t.ts_us - 5000000) AS sq FROM trades t JOIN trades p ON p.instrument_id = t.instrument_id AND p.seq <= t.seq AND p.ts_us >= t.ts_us - 60000000 GROUP BY t.instrument_id, t.seq)"""))
def _(spark, sf):
    out = t.tape_speed(fast(spark, sf))
    return out.select("instrument_id", "seq", "ts_us", *[F.round(x, 6).alias(x) for x in out.columns[3:]])
