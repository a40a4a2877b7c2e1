"""Order-by-order books over order events derived from the tape."""

from pyspark.sql import functions as F

from tickloom.catalog.base import POSITION, fast, position, query, shared, with_fast
from tickloom.operators import orders as o

# eight consecutive events belong to one order; the first adds it
TYPE = """CASE WHEN seq % 1511 = 700 THEN 14 WHEN seq % 3001 = 1200 THEN 10 WHEN seq % 8 = 0 THEN 1
  WHEN k % 5 = 0 THEN 2 WHEN k % 5 = 1 THEN 4 WHEN k % 5 = 2 AND seq % 3 = 0 THEN 3 WHEN k % 5 = 3 THEN 1 WHEN k % 5 = 4 THEN 2 ELSE 4 END"""
PRICE = "80000 + {order} % 20 + CASE WHEN k % 5 = 4 THEN 1 + k % 3 ELSE 0 END"
QTY = "CASE WHEN k % 17 = 0 THEN 0 ELSE 1 + v0 % 9 END"


def order_events(spark, sf):
    def build():
        k = F.unix_micros("receive_ts") - F.col("ts_us")
        base = fast(spark, sf).withColumns({"k": k, "v0": F.col("quantity"), "order_id": F.expr("seq div 8")})
        return base.withColumns({
            "type": F.expr(TYPE).cast("int"), "side": (F.col("order_id") % 2 + 1).cast("int"),
            "price_ticks": F.expr(PRICE.format(order="order_id")).cast("long"), "quantity": F.expr(QTY).cast("long"),
        }).drop("k", "v0")

    return shared(spark, sf, "order-events", build)


ALIVE = "a.size > 0"
LEFT = "greatest(0, a.size - CASE WHEN x.q > 0 THEN x.q ELSE a.size END)"
SIZE = f"""CASE x.t WHEN 1 THEN CASE WHEN a.size > 0 OR x.q <= 0 THEN a.size ELSE x.q END WHEN 3 THEN 0 WHEN 2 THEN CASE WHEN a.size > 0 THEN greatest(x.q, 0) ELSE 0 END ELSE CASE WHEN a.size > 0 THEN {LEFT} ELSE 0 END END"""
FRESH = "((x.t = 1 AND a.size = 0 AND x.q > 0) OR (x.t = 2 AND a.size > 0 AND x.p <> a.price))"
OUTCOME = "CASE WHEN x.t = 1 THEN CASE WHEN x.q <= 0 THEN 'ignored' WHEN a.size > 0 THEN 'duplicate' ELSE 'changed' END WHEN a.size > 0 THEN 'changed' ELSE 'unknown' END"


def _kept(new: str, old: str) -> str:
    return f"CASE WHEN ({SIZE}) = 0 THEN 0 WHEN {FRESH} THEN {new} ELSE {old} END"


MBO = f"""mbo AS (SELECT instrument_id, seq, order_id, CAST({TYPE} AS INTEGER) AS type, CAST(order_id % 2 + 1 AS INTEGER) AS side, {PRICE.format(order='order_id')} AS price_ticks, {QTY} AS quantity
  FROM (SELECT * EXCLUDE (quantity), quantity AS v0, seq // 8 AS order_id FROM tape)),
mbo_e AS (SELECT *, count(*) FILTER (type = 10) OVER (PARTITION BY instrument_id ORDER BY seq) AS epoch FROM mbo WHERE type IN (1, 2, 3, 4, 10)),
mbo_l AS (SELECT instrument_id, epoch, order_id, list({{'s': seq, 't': type, 'd': side, 'p': price_ticks, 'q': quantity}} ORDER BY seq) AS l FROM mbo_e WHERE type < 10 GROUP BY ALL),
mbo_f AS (SELECT instrument_id, epoch, order_id, unnest(list_reduce(l, lambda a, x: {{'side': {_kept('x.d', 'a.side')}, 'price': {_kept('x.p', 'a.price')}, 'size': {SIZE}, 'prio': {_kept('x.s', 'a.prio')},
   'out': list_append(a.out, {{'from_seq': x.s, 'outcome': {OUTCOME}, 'side': {_kept('x.d', 'a.side')}, 'price_ticks': {_kept('x.p', 'a.price')}, 'size': {SIZE}, 'priority_seq': {_kept('x.s', 'a.prio')}}})}},
   {{'side': 0, 'price': 0::BIGINT, 'size': 0::BIGINT, 'prio': 0::BIGINT, 'out': []::STRUCT(from_seq BIGINT, outcome VARCHAR, side INTEGER, price_ticks BIGINT, size BIGINT, priority_seq BIGINT)[]}}).out, recursive := true) FROM mbo_l),
orders AS (SELECT f.*, coalesce(min(n.from_seq), min(r.seq)) AS to_seq FROM mbo_f f LEFT JOIN mbo_f n ON n.instrument_id = f.instrument_id AND n.epoch = f.epoch AND n.order_id = f.order_id AND n.from_seq > f.from_seq AND n.outcome = 'changed'
  LEFT JOIN mbo_e r ON r.type = 10 AND r.instrument_id = f.instrument_id AND r.epoch = f.epoch + 1 GROUP BY ALL),
live AS (SELECT * FROM orders WHERE outcome = 'changed' AND size > 0 AND from_seq <= {POSITION} AND (to_seq IS NULL OR to_seq > {POSITION}))"""


def lifecycles(spark, sf):
    return shared(spark, sf, "orders", lambda: o.mbo_orders(order_events(spark, sf)))


@query("mbo_orders", with_fast("SELECT * FROM orders", MBO))
def _(spark, sf):
    return o.mbo_orders(order_events(spark, sf))


@query("mbo_levels", with_fast("SELECT instrument_id, side, price_ticks, CAST(sum(size) AS BIGINT) AS size, count(*) AS orders FROM live GROUP BY ALL", MBO))
def _(spark, sf):
    return o.mbo_levels(lifecycles(spark, sf), position(spark, sf))


@query("mbo_queue", with_fast("SELECT instrument_id, side, price_ticks, row_number() OVER (PARTITION BY instrument_id, side, price_ticks ORDER BY priority_seq) AS position, order_id, size, priority_seq FROM live", MBO))
def _(spark, sf):
    return o.mbo_queue(lifecycles(spark, sf), position(spark, sf))


@query("mbo_diagnostics", with_fast("""SELECT instrument_id, count(*) FILTER (outcome = 'unknown') AS unknown_orders, count(*) FILTER (outcome = 'duplicate') AS duplicate_adds,
  CASE WHEN any_value(held) = 14 THEN 'sequence gap' END AS held_reason FROM orders LEFT JOIN (SELECT instrument_id, arg_max(type, seq) AS held FROM mbo WHERE type IN (10, 14) GROUP BY 1) USING (instrument_id) GROUP BY 1""", MBO))
def _(spark, sf):
    return o.mbo_diagnostics(lifecycles(spark, sf), order_events(spark, sf))
