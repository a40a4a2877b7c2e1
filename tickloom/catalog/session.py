"""Recording, replay, session state, review tables, registries."""

from pyspark.sql import functions as F

from tickloom.catalog.bars import BARS, minute_bars
from tickloom.catalog.base import POSITION, days, fast, position, query, shared, with_days, with_fast
from tickloom.catalog.book import _asof_sql
from tickloom.catalog.calendar import DATED
from tickloom.catalog.detectors import _PARTS, detections
from tickloom.catalog.flow import CVD
from tickloom.catalog.footprint import levels as footprint_levels
from tickloom.catalog.footprint import LV
from tickloom.catalog.profile import PROFILE
from tickloom.functions import registry
from tickloom.operators import digests, flow, review, session
from tickloom.operators.quality import trades
from tickloom.plans.materialize import materialize, shared_folder
from tickloom.sources import recording as r

_recordings: dict[tuple, str] = {}


def recording(spark, sf, name="recording"):
    """Path of the days tape recorded in parts."""
    slot = (spark.sparkContext.applicationId, sf, name)
    if slot not in _recordings:
        import uuid

        path = f"{shared_folder(spark)}/tickloom-{name}-{uuid.uuid4().hex}"
        r.record_session(days(spark, sf), path, max_records=500)
        _recordings[slot] = path
    return _recordings[slot]


CONTRACT = "CASE instrument_id WHEN 1 THEN 'NQM4' ELSE 'ESM4' END"


def plain(df):
    return df.select("instrument_id", "seq", F.unix_micros("ts").alias("ts_us"), "type", "price_ticks", "quantity")


PLAIN = "instrument_id, seq, ts_us, type, price_ticks, quantity"


@query("scan_session", with_days(f"SELECT {PLAIN}, {CONTRACT} AS contract, trading_date AS date FROM dated WHERE instrument_id = 1 AND trading_date IN (DATE '2024-01-09', DATE '2024-01-10')", DATED))
def _(spark, sf):
    df = r.scan_session(spark, recording(spark, sf), "NQM4", ["2024-01-09", "2024-01-10"])
    return df.select(
        "instrument_id", "seq", F.unix_micros("ts").alias("ts_us"), "type", "price_ticks", "quantity", "contract", "date")


@query("record_session", with_days(f"SELECT {PLAIN} FROM tape"))
def _(spark, sf):
    """What was recorded, read back whole."""
    return plain(r.scan_session(spark, recording(spark, sf)))


FROM_US, TO_US = 1_704_844_800_000_000, 1_705_276_800_000_000  # 2024-01-10, 2024-01-15


def _at(us):
    return F.timestamp_micros(F.lit(us))


@query("replay_range", with_days(f"SELECT {PLAIN} FROM tape WHERE ts_us BETWEEN {FROM_US} AND (SELECT max(ts_us) FROM tape WHERE ts_us < {TO_US})"))
def _(spark, sf):
    tape = r.scan_session(spark, recording(spark, sf))
    return plain(r.replay_range(tape, _at(FROM_US), _at(TO_US), closed="left"))


@query("replay_range_closed", with_days(f"SELECT {PLAIN} FROM tape WHERE ts_us >= {FROM_US} AND ts_us <= (SELECT max(ts_us) FROM tape WHERE ts_us < {TO_US})"))
def _(spark, sf):
    """Both ends count (the end is the time of an event), in replay order."""
    tape = r.scan_session(spark, recording(spark, sf))
    last = tape.where(F.col("ts") < _at(TO_US)).agg(F.max("ts")).first()[0]
    return plain(r.replay_range(tape, _at(FROM_US), F.lit(last), ordered=True))


@query("historical_trades", with_days(f"SELECT {PLAIN} FROM tape WHERE type = 5 AND instrument_id = 2 AND ts_us >= {FROM_US} AND ts_us < {TO_US}"))
def _(spark, sf):
    tape = r.scan_session(spark, recording(spark, sf))
    return plain(r.historical_trades(tape, "ESM4", _at(FROM_US), _at(TO_US)))


@query("count_events", with_days("SELECT count(*) AS events FROM tape"))
def _(spark, sf):
    return r.count_events(r.scan_session(spark, recording(spark, sf)))


@query("count_by_type", with_days("SELECT type, count(*) AS n FROM tape GROUP BY 1"))
def _(spark, sf):
    return r.count_by_type(r.scan_session(spark, recording(spark, sf)))


def _damaged(spark, sf):
    """A recording with a truncated part and the leftover of an interrupted write."""
    slot = (spark.sparkContext.applicationId, sf, "damaged")
    if slot not in _recordings:
        path = recording(spark, sf, "damaged")
        jvm = spark.sparkContext._jvm
        Path = jvm.org.apache.hadoop.fs.Path
        folder = f"{path}/venue=CME/root=NQ/contract=NQM4/date=2024-01-09"
        files = Path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        for name, content in [("events-damaged.parquet", b"PAR1\x00"), ("events-9999.parquet.tmp", b"x")]:
            out = files.create(Path(f"{folder}/{name}"), True)
            out.write(bytearray(content))
            out.close()
    return _recordings[slot]


@query("scan_skip_corrupt", with_days(f"SELECT {PLAIN} FROM tape"))
def _(spark, sf):
    """The unreadable part is skipped, everything else is there."""
    return plain(r.scan_session(spark, _damaged(spark, sf), skip_corrupt=True))


@query("part_health", with_days("""SELECT 'venue=CME/root=' || CASE instrument_id WHEN 1 THEN 'NQ/contract=NQM4' ELSE 'ES/contract=ESM4' END || '/date=' || trading_date AS folder,
  CASE WHEN instrument_id = 1 AND trading_date = DATE '2024-01-09' THEN 1 ELSE 0 END::BIGINT AS corrupt, CASE WHEN instrument_id = 1 AND trading_date = DATE '2024-01-09' THEN 1 ELSE 0 END::BIGINT AS leftovers,
  (count(*) + 499) // 500 AS least_valid FROM dated GROUP BY instrument_id, trading_date""", DATED))
def _(spark, sf):
    out = r.part_health(spark, _damaged(spark, sf))
    # a folder's events fill at least so many parts of 500; slices of the sequence may start further ones
    events = r.scan_session(spark, _damaged(spark, sf), skip_corrupt=True).groupBy("contract", "date").count()
    least = events.select(
        F.format_string("venue=CME/root=%s/contract=%s/date=%s", F.substring("contract", 1, 2), "contract", F.col("date").cast("string")).alias("folder"),
        F.expr("(count + 499) div 500").alias("least"),
    )
    checked = out.join(least, "folder").where((F.col("valid") == F.col("parts") - F.col("corrupt")) & (F.col("valid") >= F.col("least")))
    return checked.select("folder", "corrupt", "leftovers", F.col("least").alias("least_valid"))


# -- session state --------------------------------------------------------------

STATE = f"""state AS (SELECT instrument_id, count(*) AS events, count(*) FILTER (type = 5) AS trades FROM tape GROUP BY 1),
quotes AS (SELECT instrument_id, side, price_ticks, arg_max(quantity, seq) AS size FROM tape WHERE type IN (6, 7) GROUP BY ALL HAVING size > 0),
best AS (SELECT instrument_id, max(price_ticks) FILTER (side = 1) AS best_bid, min(price_ticks) FILTER (side = 2) AS best_ask FROM quotes GROUP BY 1),
traded AS (SELECT instrument_id, CAST(sum(CASE aggressor WHEN 1 THEN quantity WHEN 2 THEN -quantity ELSE 0 END) AS BIGINT) AS cvd, arg_max(price_ticks, seq) AS last_close,
  CAST(round_even(CAST(sum(price_ticks * quantity) AS DOUBLE) / CAST(sum(quantity) AS DOUBLE) * 1000, 0) AS BIGINT) AS vwap_milli, count(DISTINCT ts_us // 60000000) - 1 AS completed_bars FROM trades GROUP BY 1),
pocs AS (SELECT instrument_id, first(price_ticks ORDER BY total DESC, price_ticks DESC) AS poc FROM levels WHERE total > 0 GROUP BY 1)"""


@query("session_state", with_fast("SELECT * FROM state JOIN best USING (instrument_id) JOIN traded USING (instrument_id) JOIN pocs USING (instrument_id)", PROFILE, STATE))
def _(spark, sf):
    return session.session_state(fast(spark, sf))


@query("session_digest", with_fast("""SELECT instrument_id, md5(concat_ws('|', events, trades, coalesce(CAST(best_bid AS VARCHAR), ''), coalesce(CAST(best_ask AS VARCHAR), ''), cvd, coalesce(CAST(poc AS VARCHAR), ''),
  coalesce(CAST(last_close AS VARCHAR), ''), completed_bars, vwap_milli)) AS digest
  FROM state JOIN best USING (instrument_id) JOIN traded USING (instrument_id) JOIN pocs USING (instrument_id)""", PROFILE, STATE))
def _(spark, sf):
    return session.session_digest(session.session_state(fast(spark, sf)))


@query("verify_reproducible", "SELECT CAST(i AS INTEGER) AS instrument_id, true AS is_same FROM (SELECT DISTINCT user_id % 2 + 1 AS i FROM events)")
def _(spark, sf):
    return session.verify_reproducible(fast(spark, sf)).select("instrument_id", "is_same")


LEAF = 512
CHANGED, LOST = "seq % 9973 = 4321", "seq % 7001 = 6500"


@query("tampered_slice", with_fast(f"""SELECT instrument_id, slice, events, events - lost AS other_events FROM (SELECT *, row_number() OVER (PARTITION BY instrument_id ORDER BY slice) AS n FROM
  (SELECT instrument_id, seq // {LEAF} AS slice, count(*) AS events, count(*) FILTER ({LOST}) AS lost, count(*) FILTER ({LOST} OR {CHANGED}) AS hit FROM tape GROUP BY ALL) WHERE hit > 0) WHERE n = 1"""))
def _(spark, sf):
    """Where a copy of the tape with a few changed and lost events parts from it."""
    tape = fast(spark, sf)
    copy = tape.where(f"NOT ({LOST})").withColumn("quantity", F.expr(f"quantity + CASE WHEN {CHANGED} THEN 1 ELSE 0 END"))
    mine, theirs = (materialize(digests.leaves(t.repartition(n, "price_ticks"), LEAF), "leaves") for t, n in ((tape, 3), (copy, 5)))
    return digests.first_difference(mine, theirs, fan=8)


@query("tape_digests", with_fast(f"""SELECT instrument_id, slice, count(*) AS events, CAST(sum(CAST('0x' || substr(h, 1, 15) AS BIGINT)) AS VARCHAR) AS sum_a, CAST(sum(CAST('0x' || substr(h, 16, 15) AS BIGINT)) AS VARCHAR) AS sum_b FROM
  (SELECT instrument_id, seq // {LEAF} AS slice, md5(concat_ws('|', seq, ts_us, type, side, price_ticks, quantity, aggressor)) AS h FROM tape) GROUP BY ALL"""))
def _(spark, sf):
    """Leaves of two halves of the tape, added up."""
    tape = fast(spark, sf)
    columns = ("seq", "ts_us", "type", "side", "price_ticks", "quantity", "aggressor")
    halves = [digests.leaves(tape.where(f"seq % 2 = {i}"), LEAF, columns) for i in (0, 1)]
    return digests.appended(*halves).withColumns({c: F.col(c).cast("string") for c in ("sum_a", "sum_b")})


@query("market_snapshot", with_fast(f"""SELECT 'bars' AS part, instrument_id, bar_id AS a, volume AS b FROM bars WHERE first_seq <= {POSITION}
  UNION ALL SELECT 'profile', instrument_id, price_ticks, CAST(sum(quantity) AS BIGINT) FROM trades WHERE seq <= {POSITION} AND aggressor > 0 GROUP BY ALL
  UNION ALL SELECT 'tape', instrument_id, seq, quantity FROM (SELECT * FROM trades WHERE seq <= {POSITION} ORDER BY ts_us DESC, seq DESC, instrument_id LIMIT 60)
  UNION ALL SELECT 'cvd', instrument_id, 0, CAST(sum(CASE aggressor WHEN 1 THEN quantity WHEN 2 THEN -quantity ELSE 0 END) AS BIGINT) FROM trades WHERE seq <= {POSITION} GROUP BY ALL
  UNION ALL SELECT 'book', instrument_id, side * 1000000000 + price_ticks, size FROM (SELECT instrument_id, side, price_ticks, arg_max(quantity, seq) AS size FROM tape WHERE type IN (6, 7) AND seq <= {POSITION} GROUP BY ALL HAVING size > 0)
  UNION ALL SELECT 'dom', instrument_id, 0, 31 FROM (SELECT DISTINCT instrument_id FROM tape)""", BARS))
def _(spark, sf):
    """Contents of the parts; of the ladder, its rungs."""
    parts = session.market_snapshot(fast(spark, sf), position(spark, sf), minute_bars(spark, sf), prints=60, rungs=15)
    shown = {
        "bars": parts["bars"].select("instrument_id", F.col("bar_id").alias("a"), F.col("volume").alias("b")),
        "profile": parts["profile"].where("total > 0").select("instrument_id", F.col("price_ticks").alias("a"), F.col("total").alias("b")),
        "tape": parts["tape"].select("instrument_id", F.col("seq").alias("a"), F.col("quantity").alias("b")),
        "cvd": parts["cvd"].select("instrument_id", F.lit(0).cast("long").alias("a"), F.col("cvd").alias("b")),
        "book": parts["book"].select("instrument_id", (F.col("side").cast("long") * 1_000_000_000 + F.col("price_ticks")).alias("a"), F.col("size").alias("b")),
        "dom": parts["dom"].groupBy("instrument_id").agg(F.lit(0).cast("long").alias("a"), F.count(F.lit(1)).alias("b")),
    }
    out = None
    for name, part in shown.items():
        one = part.select(F.lit(name).alias("part"), "instrument_id", "a", "b")
        out = one if out is None else out.unionByName(one)
    return out


# -- review tables ----------------------------------------------------------------

ROOT = "CASE WHEN user_id % 2 = 0 THEN 'NQ' ELSE 'ES' END"


def saves(spark, sf):
    """Every activity of a user taken as a save of that user's note."""
    return spark.read.parquet(f"{sf}/events.parquet").select(
        F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.col("ts").cast("timestamp_ntz").alias("created"),
        F.expr(ROOT).alias("root"), F.concat(F.expr(ROOT), F.lit("M4")).alias("contract"),
        F.concat(F.col("event_type"), F.lit(', "seen"')).alias("text"),
        F.array(F.col("event_type"), F.concat(F.lit("d"), (F.col("event_id") % 7).cast("string"))).alias("tags"),
    )


SAVES = f"""saves AS (SELECT user_id AS id, event_id AS version, ts AS created, {ROOT} AS root, {ROOT} || 'M4' AS contract, event_type || ', "seen"' AS text, [event_type, 'd' || event_id % 7] AS tags FROM events)"""


@query("upsert_latest", f"WITH {SAVES} SELECT id, max(version) AS version, epoch_us(arg_min(created, version)) AS created_us, arg_min(root, version) AS root, arg_min(contract, version) AS contract, arg_max(text, version) AS text, arg_max(tags, version) AS tags FROM saves GROUP BY id")
def _(spark, sf):
    from tickloom.sources.tape import utc_micros

    out = review.upsert_latest(saves(spark, sf), "id", "version", ["text", "tags"])
    return out.withColumn("created_us", utc_micros("created")).drop("created")


@query("review_query", f"WITH {SAVES} SELECT id, version, root, contract, text FROM saves WHERE root = 'NQ' AND contract = 'NQM4' AND list_contains(tags, 'purchase') AND created >= TIMESTAMP '2024-01-05' AND created < TIMESTAMP '2024-01-13'")
def _(spark, sf):
    out = review.review_query(saves(spark, sf), "NQ", "NQM4", "purchase", "2024-01-05", "2024-01-12")
    return out.select("id", "version", "root", "contract", "text")


def annotations(spark, sf):
    k = F.unix_micros("receive_ts") - F.col("ts_us")
    return fast(spark, sf).where("type <> 5").select(
        F.col("seq").alias("id"), F.col("price_ticks").alias("entry_ticks"),
        F.when(k % 7 != 0, F.col("price_ticks") - k % 5).alias("stop_ticks"),
        F.when(k % 11 != 0, F.col("price_ticks") + 1 + k % 13).alias("target_ticks"),
    )


@query("risk_reward", with_fast("""SELECT seq AS id, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 AND k % 5 <> 0 THEN round((1 + k % 13) / CAST(k % 5 AS DOUBLE), 6) END AS risk_reward FROM tape WHERE type <> 5"""))
def _(spark, sf):
    return review.risk_reward(annotations(spark, sf)).select("id", F.round("risk_reward", 6).alias("risk_reward"))


@query("bookmark_context", with_fast("""SELECT b.id, b.instrument_id, b.replay_us, arg_max(c.cvd, c.seq) AS cvd, any_value(m.bar_id) AS bar_id, any_value(m."close") AS "close" FROM
  (SELECT seq AS id, instrument_id, ts_us + 1500000 AS replay_us FROM tape WHERE type = 7) b LEFT JOIN cvd c ON c.instrument_id = b.instrument_id AND c.ts_us <= b.replay_us
  ASOF LEFT JOIN bars m ON m.instrument_id = b.instrument_id AND m.start_us <= b.replay_us GROUP BY b.id, b.instrument_id, b.replay_us""", BARS, CVD))
def _(spark, sf):
    marks = fast(spark, sf).where("type = 7").select(
        F.col("seq").alias("id"), "instrument_id", (F.col("ts_us") + 1_500_000).alias("replay_us"))
    deltas = flow.cvd(trades(fast(spark, sf)).select("instrument_id", "seq", "ts_us", "aggressor", "quantity"))
    return review.bookmark_context(marks, minute_bars(spark, sf), deltas)


@query("export_review", f"WITH {SAVES} SELECT CAST(id AS VARCHAR) AS id, text, array_to_string(tags, '|') AS tags FROM saves")
def _(spark, sf):
    """Notes written as CSV and read back."""
    import uuid

    path = f"{shared_folder(spark)}/tickloom-export-{uuid.uuid4().hex}"
    review.export_review(saves(spark, sf), path, "csv")
    return spark.read.option("header", True).option("escape", '"').csv(path).select("id", "text", "tags")


@query("export_json", f"WITH {SAVES} SELECT id, text, tags FROM saves")
def _(spark, sf):
    import uuid

    path = f"{shared_folder(spark)}/tickloom-export-{uuid.uuid4().hex}"
    review.export_review(saves(spark, sf).drop("created"), path, "json")
    return spark.read.schema("id bigint, text string, tags array<string>").json(path)


@query("export_annotations", with_fast("""SELECT CAST(seq AS VARCHAR) AS id, CASE WHEN k % 7 <> 0 AND k % 11 <> 0 AND k % 5 <> 0 THEN printf('%.2f', (1 + k % 13) / CAST(k % 5 AS DOUBLE)) END AS risk_reward, 'true' AS manual_unverified
  FROM tape WHERE type <> 5"""))
def _(spark, sf):
    """Annotations written as CSV, missing risk/reward as empty fields, and read back."""
    import uuid

    path = f"{shared_folder(spark)}/tickloom-export-{uuid.uuid4().hex}"
    review.export_review(review.risk_reward(annotations(spark, sf)), path, "csv")
    return spark.read.option("header", True).option("escape", '"').csv(path).select("id", "risk_reward", "manual_unverified")


@query("export_bookmarks", with_fast("SELECT seq AS id, instrument_id, ts_us + 1500000 AS replay_us FROM tape WHERE type = 7"))
def _(spark, sf):
    """Bookmarks written as JSON lines and read back."""
    import uuid

    path = f"{shared_folder(spark)}/tickloom-export-{uuid.uuid4().hex}"
    review.export_review(fast(spark, sf).where("type = 7").select(F.col("seq").alias("id"), "instrument_id", (F.col("ts_us") + 1_500_000).alias("replay_us")), path, "json")
    return spark.read.schema("id bigint, instrument_id int, replay_us bigint").json(path)


# -- registries --------------------------------------------------------------------

@query("registered_indicators", with_fast("""SELECT instrument_id, idx, CASE WHEN idx >= 19 THEN CAST(max(high) OVER r AS DOUBLE) END AS dc_upper, CASE WHEN idx >= 19 THEN CAST(min(low) OVER r AS DOUBLE) END AS dc_lower,
  CAST("close" - lag("close", 10) OVER w AS DOUBLE) AS momentum, round(100.0::DOUBLE * ("close" - lag("close", 9) OVER w) / lag("close", 9) OVER w, 4) AS roc
  FROM bars WINDOW w AS (PARTITION BY instrument_id ORDER BY idx), r AS (PARTITION BY instrument_id ORDER BY idx ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""", BARS))
def _(spark, sf):
    """Indicators found by their ids in any case, one on top of the other."""
    bars = minute_bars(spark, sf)
    for id in ("DC", "roc", "Mom"):
        bars = registry.run_indicator(id, bars)
    return bars.select("instrument_id", "idx", *[F.col(x).cast("double").alias(x) for x in ("dc_upper", "dc_lower", "momentum")], F.round("roc", 4).alias("roc"))


@query("registered_bars", with_fast("""SELECT 'time' AS name, instrument_id, bar_id, count(*) AS trades FROM assigned GROUP BY ALL
  UNION ALL SELECT 'tick', instrument_id, bar_id, count(*) FROM (SELECT *, (row_number() OVER (PARTITION BY instrument_id ORDER BY seq) - 1) // 50 AS bar_id FROM trades) GROUP BY ALL""", BARS))
def _(spark, sf):
    """Bar builders found by name."""
    out = None
    for name, size in (("time", 60_000_000), ("tick", 50)):
        one = registry.BARS[name](fast(spark, sf), size).select(F.lit(name).alias("name"), "instrument_id", "bar_id", "trades")
        out = one if out is None else out.unionByName(one)
    return out


@query("registered_detectors", with_fast("SELECT detector, count(*) AS detections FROM detections GROUP BY 1", *_PARTS))
def _(spark, sf):
    """Detections per registered detector that has any."""
    from tickloom.operators.detectors import detection_counts

    return detection_counts(detections(spark, sf))


@query("preset_cells", with_fast("""SELECT instrument_id, bar_id, price_ticks, CAST(total AS DOUBLE) AS metric, round(total / CAST(greatest(1, max(total) OVER w) AS DOUBLE), 6) AS intensity,
  round(abs(delta) / CAST(greatest(1, max(abs(delta)) OVER w) AS DOUBLE), 6) AS background FROM pub WINDOW w AS (PARTITION BY instrument_id, bar_id)""", BARS, LV))
def _(spark, sf):
    out = registry.preset_cells(footprint_levels(spark, sf), "volume + delta hybrid")
    return out.withColumns({"intensity": F.round("intensity", 6), "background": F.round("background", 6)})
