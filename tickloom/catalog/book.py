"""Order books."""

from pyspark.sql import functions as F

from tickloom.catalog.base import POSITION, fast, position, query, shared, with_fast
from tickloom.catalog.profile import AREA, PROFILE, session_profile
from tickloom.operators import book as k
from tickloom.operators import profile as p

SPECIAL = """CASE WHEN seq % 1013 = 500 THEN 10 WHEN seq % 1511 = 700 THEN 14 WHEN seq % 2003 = 900 THEN 8 WHEN seq % 2003 = 950 THEN 9 ELSE type END"""
SIZE = "CASE WHEN seq % 211 = 5 THEN -1 ELSE quantity END"


def disturbed(spark, sf):
    """The tape with clears, gaps, snapshots and negative sizes in it."""
    return shared(spark, sf, "disturbed", lambda: fast(spark, sf).withColumns(
        {"type": F.expr(SPECIAL).cast("int"), "quantity": F.expr(SIZE).cast("long")}))


DISTURBED = f"""rough AS (SELECT * REPLACE ({SPECIAL} AS type, {SIZE} AS quantity) FROM tape),
rows0 AS (SELECT instrument_id, seq, ts_us, type, side, price_ticks, quantity AS size FROM rough WHERE type IN (8, 10) OR (type IN (6, 7) AND quantity >= 0)),
rows AS (SELECT *, count(*) FILTER (type IN (8, 10)) OVER (PARTITION BY instrument_id ORDER BY seq) AS epoch FROM rows0),
resets AS (SELECT instrument_id, epoch - 1 AS epoch, seq AS reset FROM rows WHERE type IN (8, 10)),
intervals AS (SELECT instrument_id, epoch, side, price_ticks, size, seq AS from_seq, coalesce(nxt, reset) AS to_seq FROM
  (SELECT *, lead(seq) OVER (PARTITION BY instrument_id, epoch, side, price_ticks ORDER BY seq) AS nxt FROM rows WHERE type IN (6, 7)) LEFT JOIN resets USING (instrument_id, epoch) WHERE size > 0),
best AS (SELECT r.instrument_id, r.seq, max(i.price_ticks) FILTER (i.side = 1) AS best_bid, min(i.price_ticks) FILTER (i.side = 2) AS best_ask
  FROM rough r LEFT JOIN intervals i ON i.instrument_id = r.instrument_id AND i.from_seq <= r.seq AND (i.to_seq IS NULL OR i.to_seq > r.seq) GROUP BY ALL)"""


def _asof_sql(at: str) -> str:
    return f"SELECT instrument_id, side, price_ticks, size FROM intervals WHERE from_seq <= {at} AND (to_seq IS NULL OR to_seq > {at})"


@query("book_levels_asof", with_fast(_asof_sql("(SELECT max(seq) FROM tape)") + " UNION ALL " + _asof_sql(POSITION).replace("side,", "side + 10 AS side,"), DISTURBED))
def _(spark, sf):
    """At the end of the tape, and (sides shown as 11, 12) in its middle."""
    tape = disturbed(spark, sf)
    return k.book_levels_asof(tape).unionByName(
        k.book_levels_asof(tape, position(spark, sf)).withColumn("side", F.col("side") + 10))


@query("level_intervals", with_fast("SELECT * FROM intervals", DISTURBED))
def _(spark, sf):
    return k.level_intervals(disturbed(spark, sf))


@query("best_bid_ask", with_fast("SELECT instrument_id, seq, best_bid, best_ask, best_ask - best_bid AS spread FROM best WHERE seq IN (SELECT seq FROM tape WHERE type = 5)", DISTURBED))
def _(spark, sf):
    """Best prices at every trade."""
    samples = fast(spark, sf).where("type = 5").select("instrument_id", "seq")
    return k.best_bid_ask(disturbed(spark, sf), samples)


@query("cumulative_depth", with_fast("""SELECT instrument_id, side, CAST(sum(size) AS BIGINT) AS depth, count(*) AS levels FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id, side ORDER BY CASE side WHEN 1 THEN -price_ticks ELSE price_ticks END) AS r FROM
  (""" + _asof_sql("(SELECT max(seq) FROM tape)") + ")) WHERE r <= 10 GROUP BY ALL", DISTURBED))
def _(spark, sf):
    return k.cumulative_depth(k.book_levels_asof(disturbed(spark, sf)), 10)


VALIDITY = """st0 AS (SELECT *, last_value(CASE type WHEN 8 THEN true WHEN 9 THEN false END IGNORE NULLS) OVER w AS snap,
  last_value(CASE WHEN type = 14 THEN true WHEN type IN (8, 9, 10) THEN false END IGNORE NULLS) OVER w AS gap FROM rough WINDOW w AS (PARTITION BY instrument_id ORDER BY seq)),
st AS (SELECT *, last_value(CASE WHEN type = 8 THEN 'rebuilding from snapshot' WHEN type = 9 THEN 'ok' WHEN type = 10 THEN 'awaiting snapshot' WHEN type = 14 THEN 'sequence gap'
  WHEN type IN (6, 7) AND quantity < 0 THEN 'negative size rejected' WHEN type IN (6, 7) AND NOT coalesce(snap, false) AND NOT (%s) THEN 'ok' END IGNORE NULLS) OVER (PARTITION BY instrument_id ORDER BY seq) AS r FROM st0)"""
VALID = """SELECT instrument_id, seq, type, best_bid, best_ask, CASE WHEN r IS NULL THEN 'awaiting snapshot' WHEN r <> 'ok' THEN r WHEN best_bid >= best_ask THEN 'crossed book' END AS reason
  FROM st JOIN best USING (instrument_id, seq)"""


@query("book_validity", with_fast(VALID, DISTURBED, VALIDITY % "coalesce(gap, false)"))
def _(spark, sf):
    return k.book_validity(disturbed(spark, sf))


@query("book_validity_loose", with_fast(VALID, DISTURBED, VALIDITY % "false"))
def _(spark, sf):
    return k.book_validity(disturbed(spark, sf), sticky_gap=False)


GRID = 250


def checkpoints(spark, sf):
    return shared(spark, sf, "book-checkpoints", lambda: k.book_checkpoints(disturbed(spark, sf), GRID))


@query("book_checkpoints", with_fast(f"""SELECT g.instrument_id, g.before_seq, list({{'price_ticks': price_ticks, 'size': size}} ORDER BY price_ticks DESC) FILTER (side = 1) AS bids,
  list({{'price_ticks': price_ticks, 'size': size}} ORDER BY price_ticks) FILTER (side = 2) AS asks
  FROM (SELECT DISTINCT instrument_id, seq // {GRID} * {GRID} AS before_seq FROM rows) g JOIN intervals i ON i.instrument_id = g.instrument_id AND from_seq < before_seq AND (to_seq IS NULL OR to_seq >= before_seq)
  GROUP BY ALL""".replace("FILTER (side = 1) AS bids", "FILTER (side = 1) AS b0").replace("FILTER (side = 2) AS asks", "FILTER (side = 2) AS a0").join(
      ["SELECT instrument_id, before_seq, len(coalesce(b0, [])) AS n_bids, len(coalesce(a0, [])) AS n_asks, b0[1].price_ticks AS top_bid, a0[1].price_ticks AS top_ask, a0[1].size AS top_ask_size, md5(coalesce(array_to_string(list_transform(b0, lambda x: x.price_ticks || ':' || x.size), ','), '')) AS bids_md5, md5(coalesce(array_to_string(list_transform(a0, lambda x: x.price_ticks || ':' || x.size), ','), '')) AS asks_md5 FROM (", ")"]), DISTURBED))
def _(spark, sf):
    out = checkpoints(spark, sf)
    return out.select(
        "instrument_id", "before_seq", F.size("bids").cast("long").alias("n_bids"), F.size("asks").cast("long").alias("n_asks"),
        F.get("bids", F.lit(0))["price_ticks"].alias("top_bid"), F.get("asks", F.lit(0))["price_ticks"].alias("top_ask"),
        F.get("asks", F.lit(0))["size"].alias("top_ask_size"),
        *[F.md5(F.array_join(F.transform(side, lambda x: F.concat_ws(":", x["price_ticks"].cast("string"), x["size"].cast("string"))), ",")).alias(f"{side}_md5") for side in ("bids", "asks")],
    )


@query("book_restore", with_fast(_asof_sql(POSITION), DISTURBED))
def _(spark, sf):
    tape = disturbed(spark, sf)
    return k.book_restore(checkpoints(spark, sf), tape, position(spark, sf))


@query("dom_ladder", with_fast("""SELECT instrument_id, price_ticks, bid_size, ask_size, CAST(sum(bid_size) OVER (PARTITION BY instrument_id ORDER BY price_ticks) AS BIGINT) AS cumulative_bid,
  CAST(sum(ask_size) OVER (PARTITION BY instrument_id ORDER BY price_ticks DESC) AS BIGINT) AS cumulative_ask, traded_bid, traded_ask, traded_bid + traded_ask AS traded, traded_ask - traded_bid AS delta,
  price_ticks = poc AS is_poc, price_ticks = vah AS is_vah, price_ticks = val AS is_val FROM (
  SELECT m.instrument_id, m.price_ticks, coalesce(b.size, 0) AS bid_size, coalesce(a.size, 0) AS ask_size, coalesce(l.sell, 0) AS traded_bid, coalesce(l.buy, 0) AS traded_ask, poc, vah, val
  FROM (SELECT instrument_id, unnest(range((bb + ba) // 2 - 25, (bb + ba) // 2 + 26)) AS price_ticks FROM (SELECT instrument_id, max(price_ticks) FILTER (side = 1) AS bb, min(price_ticks) FILTER (side = 2) AS ba FROM ends GROUP BY 1)) m
  LEFT JOIN ends b ON b.side = 1 AND b.instrument_id = m.instrument_id AND b.price_ticks = m.price_ticks LEFT JOIN ends a ON a.side = 2 AND a.instrument_id = m.instrument_id AND a.price_ticks = m.price_ticks
  LEFT JOIN levels l ON l.instrument_id = m.instrument_id AND l.price_ticks = m.price_ticks LEFT JOIN area ON area.instrument_id = m.instrument_id)""",
    DISTURBED, f"ends AS ({_asof_sql('(SELECT max(seq) FROM tape)')})", PROFILE, AREA))
def _(spark, sf):
    levels = k.book_levels_asof(disturbed(spark, sf))
    profile = session_profile(spark, sf)
    return k.dom_ladder(levels, profile, p.value_area(profile), 25)


PULL = """pull_l AS (SELECT instrument_id, type - 5 AS side, price_ticks, list(quantity ORDER BY seq) AS l FROM tape WHERE type IN (6, 7) GROUP BY ALL),
pulls AS (SELECT instrument_id, side, price_ticks, list_reduce(l, lambda a, x: {'l': x, 'p': a.p + CASE WHEN a.l IS NOT NULL AND x < a.l THEN a.l - x ELSE 0 END,
  's': a.s + CASE WHEN x > a.l THEN x - a.l ELSE 0 END, 'r': a.r + CASE WHEN x > a.l AND a.d AND x > 1 THEN 1 ELSE 0 END,
  'd': CASE WHEN a.l IS NULL THEN x <= 1 WHEN x < a.l AND x <= 1 THEN true WHEN x > a.l AND a.d AND x > 1 THEN false ELSE a.d END},
  {'l': NULL::BIGINT, 'p': 0::BIGINT, 's': 0::BIGINT, 'r': 0::BIGINT, 'd': false}) AS z FROM pull_l)"""


@query("pull_stack", with_fast("SELECT instrument_id, CAST(side AS INTEGER) AS side, price_ticks, z.p AS pulled, z.s AS stacked, z.r AS replenishments FROM pulls", PULL))
def _(spark, sf):
    return k.pull_stack(fast(spark, sf))
