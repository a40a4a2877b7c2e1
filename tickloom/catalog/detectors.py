"""Detectors, with thresholds that suit the density of the test tape."""

from pyspark.sql import functions as F

from tickloom.catalog.bars import BARS, minute_bars
from tickloom.catalog.base import fast, query, shared, with_fast
from tickloom.operators import detectors as d
from tickloom.plans.by_instrument import by_instrument

S_LARGE = d.LargeTrade(fixed=40, percentile=0.98, window=500)
S_SWEEP = d.Sweep(min_levels=3, max_gap_us=8_000_000, min_volume=30)
S_ABSORB = d.Absorption(min_volume=60, max_move=3, window_us=20_000_000)
S_ICE = d.Iceberg(ratio=2.0, min_executed=80)
S_REPL = d.Replenishment(times=2, min_size=5, window_us=1_800_000_000)
S_STOP = d.StopRun(lookback_us=300_000_000, burst=2.0, short_us=10_000_000, cooldown_us=60_000_000)
S_REGIME = d.MarketRegime(window_us=10_000_000, quiet=0.2, normal=0.4, fast=0.6)
S_DIV = d.DeltaDivergence(10)


def show(df, **measures):
    return df.select(
        "instrument_id", "seq", F.unix_micros("ts").alias("ts_us"), "price_ticks", "bias",
        *[F.round(F.col("measurements")[k], 4).alias(v) for k, v in measures.items()],
    )


LARGE = """large AS (SELECT *, CASE WHEN n >= 20 THEN greatest(40, p) ELSE 40 END AS threshold FROM (SELECT *, len(l) AS n, list_sort(l)[greatest(1, CAST(ceil(0.98::DOUBLE * len(l)) AS BIGINT))] AS p FROM (
  SELECT *, list(quantity) OVER (PARTITION BY instrument_id ORDER BY seq ROWS BETWEEN 500 PRECEDING AND 1 PRECEDING) AS l FROM trades))
  WHERE quantity >= 40 AND (n IS NULL OR n < 20 OR quantity >= p))"""


@query("large_trade", with_fast("""SELECT instrument_id, seq, ts_us, price_ticks, CASE aggressor WHEN 1 THEN 'Bullish' ELSE 'Bearish' END AS bias,
  CAST(quantity AS DOUBLE) AS size, CAST(threshold AS DOUBLE) AS threshold FROM large""", LARGE))
def _(spark, sf):
    return show(d.large_trade(fast(spark, sf), S_LARGE), size="size", threshold="threshold")


@query("large_trade_by_instrument", with_fast("""SELECT instrument_id, seq, ts_us, price_ticks, CASE aggressor WHEN 1 THEN 'Bullish' ELSE 'Bearish' END AS bias,
  CAST(quantity AS DOUBLE) AS size, CAST(CASE instrument_id WHEN 1 THEN threshold ELSE greatest(60, threshold) END AS DOUBLE) AS threshold FROM large WHERE quantity >= CASE instrument_id WHEN 1 THEN 40 ELSE 60 END""", LARGE))
def _(spark, sf):
    by = {1: S_LARGE, 2: d.LargeTrade(fixed=60, percentile=0.98, window=500)}
    return show(by_instrument(d.large_trade, [fast(spark, sf)], by), size="size", threshold="threshold")


GO = "a.side = x.a AND x.t - a.t <= 8000000 AND CASE WHEN x.a = 1 THEN x.p >= a.p ELSE x.p <= a.p END"
LEVELS = f"CASE WHEN {GO} THEN a.levels + CASE WHEN x.p <> a.p THEN 1 ELSE 0 END ELSE 1 END"
VOLUME = f"CASE WHEN {GO} THEN a.vol + x.q ELSE x.q END"
FIRE = f"({GO}) AND {LEVELS} >= 3 AND {VOLUME} >= 30"
SWEEP = f"""sweep_l AS (SELECT instrument_id, list({{'s': seq, 't': ts_us, 'p': price_ticks, 'q': quantity, 'a': aggressor}} ORDER BY seq) AS l FROM trades WHERE aggressor > 0 GROUP BY 1),
sweeps AS (SELECT instrument_id, unnest(list_reduce(l, lambda a, x: {{'side': CASE WHEN {FIRE} THEN 0 ELSE x.a END, 't': x.t, 'p': x.p, 'levels': {LEVELS}, 'vol': {VOLUME},
   'sp': CASE WHEN {GO} THEN a.sp ELSE x.p END, 'st': CASE WHEN {GO} THEN a.st ELSE x.t END,
   'f': CASE WHEN {FIRE} THEN list_append(a.f, {{'seq': x.s, 'ts_us': x.t, 'price_ticks': x.p, 'side': x.a, 'levels': {LEVELS}, 'volume': {VOLUME}, 'sp': a.sp, 'st': a.st}}) ELSE a.f END}},
   {{'side': 0, 't': 0::BIGINT, 'p': 0::BIGINT, 'levels': 0, 'vol': 0::BIGINT, 'sp': 0::BIGINT, 'st': 0::BIGINT,
     'f': []::STRUCT(seq BIGINT, ts_us BIGINT, price_ticks BIGINT, side INTEGER, levels INTEGER, volume BIGINT, sp BIGINT, st BIGINT)[]}}).f, recursive := true) FROM sweep_l)"""


@query("sweep", with_fast("""SELECT instrument_id, seq, ts_us, price_ticks, CASE side WHEN 1 THEN 'Bullish' ELSE 'Bearish' END AS bias, CAST(levels AS DOUBLE) AS levels, CAST(volume AS DOUBLE) AS volume,
  CAST(abs(price_ticks - sp) + 1 AS DOUBLE) AS spanned, round((ts_us - st) / 1000.0::DOUBLE, 4) AS ms FROM sweeps""", SWEEP))
def _(spark, sf):
    return show(d.sweep(fast(spark, sf), S_SWEEP), levels="levels", volume="volume", ticksSpanned="spanned", durationMs="ms")


NEW = "a.st IS NULL OR x.t - a.st > 20000000 OR greatest(a.hi, x.p) - least(a.lo, x.p) > 3"
BUY = f"CASE WHEN {NEW} THEN 0 ELSE a.b END + CASE WHEN x.a = 1 THEN x.q ELSE 0 END"
SELL = f"CASE WHEN {NEW} THEN 0 ELSE a.s END + CASE WHEN x.a = 2 THEN x.q ELSE 0 END"
HOLD = f"NOT (CASE WHEN {NEW} THEN false ELSE a.fired END) AND ({BUY}) + ({SELL}) >= 60"
ABSORB = f"""absorb_l AS (SELECT instrument_id, list({{'s': seq, 't': ts_us, 'p': price_ticks, 'q': quantity, 'a': aggressor}} ORDER BY seq) AS l FROM trades GROUP BY 1),
absorbs AS (SELECT instrument_id, unnest(list_reduce(l, lambda a, x: {{'st': CASE WHEN {NEW} THEN x.t ELSE a.st END, 'ap': CASE WHEN {NEW} THEN x.p ELSE a.ap END,
   'hi': CASE WHEN {NEW} THEN x.p ELSE greatest(a.hi, x.p) END, 'lo': CASE WHEN {NEW} THEN x.p ELSE least(a.lo, x.p) END, 'b': {BUY}, 's': {SELL},
   'fired': CASE WHEN {NEW} THEN false ELSE a.fired END OR {HOLD},
   'f': CASE WHEN {HOLD} THEN list_append(a.f, {{'seq': x.s, 'ts_us': x.t, 'price_ticks': CASE WHEN {NEW} THEN x.p ELSE a.ap END, 'b': {BUY}, 's': {SELL},
        'move': CASE WHEN {NEW} THEN 0 ELSE greatest(a.hi, x.p) - least(a.lo, x.p) END}}) ELSE a.f END}},
   {{'st': NULL::BIGINT, 'ap': 0::BIGINT, 'hi': 0::BIGINT, 'lo': 0::BIGINT, 'b': 0::BIGINT, 's': 0::BIGINT, 'fired': false,
     'f': []::STRUCT(seq BIGINT, ts_us BIGINT, price_ticks BIGINT, b BIGINT, s BIGINT, move BIGINT)[]}}).f, recursive := true) FROM absorb_l)"""


@query("absorption", with_fast("""SELECT instrument_id, seq, ts_us, price_ticks, CASE WHEN b >= s THEN 'Bearish' ELSE 'Bullish' END AS bias, CAST(b + s AS DOUBLE) AS total, CAST(b AS DOUBLE) AS buy,
  CAST(s AS DOUBLE) AS sell, CAST(move AS DOUBLE) AS move FROM absorbs""", ABSORB))
def _(spark, sf):
    return show(d.absorption(fast(spark, sf), S_ABSORB), totalVolume="total", buyVolume="buy", sellVolume="sell", moveTicks="move")


ICE = """ice AS (SELECT * FROM (SELECT *, sum(CASE WHEN type = 5 THEN quantity END) OVER w AS executed, max(CASE WHEN type <> 5 THEN quantity END) OVER w AS displayed
  FROM tape WHERE quantity > 0 WINDOW w AS (PARTITION BY instrument_id, price_ticks ORDER BY seq)) WHERE type = 5 AND displayed > 0 AND executed >= 80 AND executed >= 2 * displayed
  QUALIFY row_number() OVER (PARTITION BY instrument_id, price_ticks ORDER BY seq) = 1)"""


@query("iceberg", with_fast("""SELECT instrument_id, seq, ts_us, price_ticks, CASE aggressor WHEN 1 THEN 'Bearish' ELSE 'Bullish' END AS bias, CAST(executed AS DOUBLE) AS executed, CAST(displayed AS DOUBLE) AS displayed,
  round(executed / displayed, 4) AS ratio, round(least(1, executed / (displayed * 2)), 4) AS confidence FROM ice""", ICE))
def _(spark, sf):
    return show(d.iceberg(fast(spark, sf), S_ICE), executed="executed", maxDisplayed="displayed", ratio="ratio", confidence="confidence")


LATE = "a.t0 IS NOT NULL AND x.t - a.t0 > 1800000000"
RESTORE = "a.t0 IS NOT NULL AND x.q >= 5 AND a.dep"
COUNT = f"CASE WHEN {LATE} THEN 0 ELSE a.c END + 1"
REPL = f"""repl_l AS (SELECT instrument_id, type, price_ticks, list({{'s': seq, 't': ts_us, 'q': quantity}} ORDER BY seq) AS l FROM tape WHERE type IN (6, 7) GROUP BY ALL),
repls AS (SELECT instrument_id, type, price_ticks, unnest(list_reduce(l, lambda a, x: {{'t0': CASE WHEN a.t0 IS NULL OR ({LATE}) THEN x.t ELSE a.t0 END,
   'dep': CASE WHEN x.q = 0 THEN true WHEN {RESTORE} THEN false ELSE a.dep END,
   'c': CASE WHEN {RESTORE} THEN CASE WHEN {COUNT} >= 2 THEN 0 ELSE {COUNT} END WHEN {LATE} THEN 0 ELSE a.c END,
   'f': CASE WHEN ({RESTORE}) AND {COUNT} >= 2 THEN list_append(a.f, {{'seq': x.s, 'ts_us': x.t, 'q': x.q}}) ELSE a.f END}},
   {{'t0': NULL::BIGINT, 'dep': false, 'c': 0, 'f': []::STRUCT(seq BIGINT, ts_us BIGINT, q BIGINT)[]}}).f, recursive := true) FROM repl_l)"""


@query("replenishment", with_fast("SELECT instrument_id, seq, ts_us, price_ticks, CASE type WHEN 6 THEN 'Bullish' ELSE 'Bearish' END AS bias, CAST(q AS DOUBLE) AS size FROM repls", REPL))
def _(spark, sf):
    return show(d.replenishment(fast(spark, sf), S_REPL), size="size")


STOP = """stop_w AS (SELECT t.instrument_id, t.seq, any_value(t.ts_us) AS ts_us, any_value(t.price_ticks) AS price_ticks, any_value(t.quantity) AS quantity, count(p.seq) AS n, max(p.price_ticks) AS hi, min(p.price_ticks) AS lo,
  sum(p.quantity) / 30.0::DOUBLE AS avg_burst, any_value(t.quantity) + coalesce(sum(p.quantity) FILTER (p.ts_us >= t.ts_us - 10000000), 0) AS short_volume
  FROM trades t LEFT JOIN trades p ON p.instrument_id = t.instrument_id AND p.seq < t.seq AND p.ts_us >= t.ts_us - 300000000 GROUP BY t.instrument_id, t.seq),
stop_c AS (SELECT *, price_ticks >= hi + 1 AS up FROM stop_w WHERE n >= 10 AND short_volume >= 2 * avg_burst AND (price_ticks >= hi + 1 OR price_ticks <= lo - 1)),
stop_l AS (SELECT instrument_id, list({'s': seq, 't': ts_us} ORDER BY seq) AS l FROM stop_c GROUP BY 1),
stop_f AS (SELECT instrument_id, unnest(list_reduce(l, lambda a, x: {'t': CASE WHEN a.t IS NULL OR x.t - a.t >= 60000000 THEN x.t ELSE a.t END,
  'f': CASE WHEN a.t IS NULL OR x.t - a.t >= 60000000 THEN list_append(a.f, x.s) ELSE a.f END}, {'t': NULL::BIGINT, 'f': []::BIGINT[]}).f) AS seq FROM stop_l),
stops AS (SELECT c.* FROM stop_c c JOIN stop_f USING (instrument_id, seq))"""


@query("stop_run", with_fast("""SELECT instrument_id, seq, ts_us, price_ticks, CASE WHEN up THEN 'Bullish' ELSE 'Bearish' END AS bias, CAST(CASE WHEN up THEN hi ELSE lo END AS DOUBLE) AS swing,
  CAST(abs(price_ticks - CASE WHEN up THEN hi ELSE lo END) AS DOUBLE) AS break_ticks, CAST(short_volume AS DOUBLE) AS short_volume, round(avg_burst, 4) AS avg_burst FROM stops""", STOP))
def _(spark, sf):
    return show(d.stop_run(fast(spark, sf), S_STOP), swing="swing", breakTicks="break_ticks", shortVolume="short_volume", avgBurst="avg_burst")


REGIME = """reg_w AS (SELECT t.instrument_id, t.seq, t.ts_us, t.price_ticks, count(*) FILTER (p.type = 5) / 10.0::DOUBLE AS tps, count(*) FILTER (p.type <> 5) / 10.0::DOUBLE AS ups,
  list(p.price_ticks ORDER BY p.seq) FILTER (p.type = 5) AS l FROM tape t JOIN tape p ON p.instrument_id = t.instrument_id AND p.seq <= t.seq AND p.ts_us >= t.ts_us - 10000000 GROUP BY ALL),
reg AS (SELECT *, CASE WHEN tps <= 0.2 THEN 'Quiet' WHEN tps <= 0.4 THEN 'Normal' WHEN tps <= 0.6 THEN 'Fast' ELSE 'Extreme' END AS regime FROM reg_w),
quotes AS (SELECT instrument_id, seq, last_value(CASE WHEN type = 6 THEN price_ticks END IGNORE NULLS) OVER w AS bid, last_value(CASE WHEN type = 7 THEN price_ticks END IGNORE NULLS) OVER w AS ask
  FROM tape WINDOW w AS (PARTITION BY instrument_id ORDER BY seq)),
regimes AS (SELECT * FROM (SELECT *, coalesce(lag(regime) OVER (PARTITION BY instrument_id ORDER BY seq), 'Quiet') AS was FROM reg) JOIN quotes USING (instrument_id, seq) WHERE regime <> was)"""


@query("market_regime", with_fast("""SELECT instrument_id, seq, ts_us, price_ticks, 'None' AS bias, tps, ups,
  round(CASE WHEN coalesce(len(l), 0) < 2 THEN 0 ELSE sqrt(list_sum([(l[i + 1] - l[i]) * (l[i + 1] - l[i]) for i in range(1, len(l))]) / (len(l) - 1.0::DOUBLE)) END, 4) AS vol,
  CAST(CASE WHEN bid > 0 AND ask > 0 THEN ask - bid ELSE 0 END AS DOUBLE) AS spread FROM regimes""", REGIME))
def _(spark, sf):
    return show(d.market_regime(fast(spark, sf), S_REGIME), tradesPerSecond="tps", bookUpdatesPerSecond="ups", realizedVolTicks="vol", spreadTicks="spread")


PRIOR = "OVER (PARTITION BY instrument_id ORDER BY idx ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING)"
DIV = f"""div0 AS (SELECT *, first_value(delta) OVER (PARTITION BY instrument_id ORDER BY idx) AS _x, max(high) {PRIOR} AS hi, min(low) {PRIOR} AS lo,
  list({{'p': high, 'd': delta}}) {PRIOR} AS hl, list({{'p': low, 'd': delta}}) {PRIOR} AS ll FROM bars),
divs AS (SELECT *, high > hi AND delta < hd AS down FROM (SELECT *, list_filter(hl, lambda x: x.p = hi)[1].d AS hd, list_filter(ll, lambda x: x.p = lo)[1].d AS ld FROM div0 WHERE idx >= 10)
  WHERE (high > hi AND delta < hd) OR (low < lo AND delta > ld))"""


@query("delta_divergence", with_fast("""SELECT instrument_id, last_seq AS seq, end_us AS ts_us, CASE WHEN down THEN high ELSE low END AS price_ticks, CASE WHEN down THEN 'Bearish' ELSE 'Bullish' END AS bias,
  CAST(delta AS DOUBLE) AS cur_delta, CAST(CASE WHEN down THEN hd ELSE ld END AS DOUBLE) AS swing_delta FROM divs""", BARS, DIV))
def _(spark, sf):
    return show(d.delta_divergence(minute_bars(spark, sf), S_DIV), curDelta="cur_delta", swingDelta="swing_delta")


SETTINGS = {
    "Large Trade": S_LARGE, "Sweep": S_SWEEP, "Absorption": S_ABSORB, "Iceberg": S_ICE, "Replenishment": S_REPL,
    "Stop-Run": S_STOP, "Market Regime": S_REGIME, "Delta Divergence": S_DIV,
}
ALL = """detections AS (SELECT 'Large Trade' AS detector, instrument_id, seq, ts_us, price_ticks FROM large UNION ALL SELECT 'Sweep', instrument_id, seq, ts_us, price_ticks FROM sweeps
  UNION ALL SELECT 'Absorption', instrument_id, seq, ts_us, price_ticks FROM absorbs UNION ALL SELECT 'Iceberg', instrument_id, seq, ts_us, price_ticks FROM ice
  UNION ALL SELECT 'Replenishment', instrument_id, seq, ts_us, price_ticks FROM repls UNION ALL SELECT 'Stop-Run', instrument_id, seq, ts_us, price_ticks FROM stops
  UNION ALL SELECT 'Market Regime', instrument_id, seq, ts_us, price_ticks FROM regimes UNION ALL SELECT 'Delta Divergence', instrument_id, last_seq, end_us, CASE WHEN down THEN high ELSE low END FROM divs)"""
_PARTS = (BARS, LARGE, SWEEP, ABSORB, ICE, REPL, STOP, REGIME, DIV, ALL)


def detections(spark, sf):
    return shared(spark, sf, "detections", lambda: d.detect_all(fast(spark, sf), minute_bars(spark, sf), settings=SETTINGS))


@query("detect_all", with_fast("SELECT * FROM detections", *_PARTS))
def _(spark, sf):
    return detections(spark, sf).select("detector", "instrument_id", "seq", F.unix_micros("ts").alias("ts_us"), "price_ticks")


@query("detection_counts", with_fast("SELECT detector, count(*) AS detections FROM detections GROUP BY 1", *_PARTS))
def _(spark, sf):
    return d.detection_counts(detections(spark, sf))


@query("recent_detections", with_fast("SELECT detector, instrument_id, seq FROM detections ORDER BY ts_us DESC, seq DESC, detector, instrument_id LIMIT 100", *_PARTS))
def _(spark, sf):
    return d.recent(detections(spark, sf), 100).select("detector", "instrument_id", "seq")
