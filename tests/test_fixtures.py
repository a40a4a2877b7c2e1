"""Hand-computed vectors, one tiny table each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators import bars as b
from tickloom.operators import book, calendar, detectors as d, flow, footprint as fp, heatmap, indicators as i
from tickloom.operators import orders, price_action as pa, profile as p, quality as q, session, tape_view
from tickloom.plans import numbered
from tickloom.sources import recording as rec

BASE = 1_717_423_200_000_000  # 2024-06-03 14:00:00 UTC
SIDES = {"B": 1, "S": 2, "U": 0}


def tape(spark, rows):
    """(seconds, type, price, quantity, aggressor letter or side) rows as a tape."""
    made = [
        (1, "NQ", "NQZ5", "CME", t, BASE + int(sec * 1_000_000), n, (t - 5 if t in (6, 7) else 0), price, qty, 0, 0,
         SIDES.get(agg, 0), 49, 1)
        for n, (sec, t, price, qty, agg) in enumerate(rows)
    ]
    return spark.createDataFrame(
        made,
        "instrument_id int, root string, contract string, exchange string, type int, ts_us bigint, seq bigint, side int, "
        "price_ticks bigint, quantity bigint, order_id bigint, trade_id bigint, aggressor int, flags int, source int",
    ).withColumn("ts", F.timestamp_micros("ts_us")).withColumn("receive_ts", F.col("ts"))


def trade_tape(spark, rows):
    return tape(spark, [(sec, 5, price, qty, agg) for sec, price, qty, agg in rows])


def bars_of(spark, ohlc, **extra):
    rows = [(1, n, n, *row) for n, row in enumerate(ohlc)]
    df = spark.createDataFrame(rows, "instrument_id int, bar_id bigint, idx bigint, open bigint, high bigint, low bigint, close bigint, volume bigint, delta bigint")
    return df.withColumn("end_us", F.col("idx")).withColumn("last_seq", F.col("idx"))


def column(df, name, order="idx"):
    return [r[name] for r in df.orderBy(order).collect()]


def test_time_bars(spark):
    out = b.time_bars(trade_tape(spark, [(10, 100, 5, "B"), (20, 102, 3, "S"), (50, 101, 2, "B"), (65, 103, 4, "B")]), 60_000_000)
    first = out.orderBy("bar_id").first()
    assert (first.open, first.high, first.low, first.close) == (100, 102, 100, 101)
    assert (first.volume, first.buy, first.sell, first.delta, first.trades, first.is_closed) == (10, 7, 3, 4, 3, True)


def test_late_trade_stays_in_open_bar(spark):
    out = b.time_bars(trade_tape(spark, [(10, 100, 1, "B"), (65, 101, 1, "B"), (59, 99, 1, "S"), (70, 102, 1, "B")]), 60_000_000)
    assert [(r.trades, r.low) for r in out.orderBy("bar_id").collect()] == [(1, 100), (3, 99)]


def test_other_bars(spark):
    out = b.tick_bars(trade_tape(spark, [(n, 100 + n, 1, "B") for n in range(4)]), 2).orderBy("bar_id").collect()
    assert [(r.open, r.close) for r in out] == [(100, 101), (102, 103)]
    out = b.volume_bars(trade_tape(spark, [(0, 100, 4, "B"), (1, 100, 3, "B"), (2, 100, 5, "B")]), 10).collect()
    assert [(r.volume, r.is_closed) for r in out] == [(12, True)]
    out = b.range_bars(trade_tape(spark, [(0, 100, 1, "B"), (1, 101, 1, "B"), (2, 103, 1, "B")]), 3).collect()
    assert [(r.high - r.low, r.is_closed) for r in out] == [(3, True)]


def test_cvd_ignores_unknown(spark):
    out = flow.cvd(trade_tape(spark, [(0, 100, 5, "B"), (1, 100, 9, "U")]))
    assert column(out, "cvd", "seq") == [5, 5]


def test_profile(spark):
    trades = trade_tape(spark, [(0, 100, 10, "B"), (1, 101, 12, "B"), (2, 101, 5, "S"), (3, 102, 8, "S")])
    profile = p.volume_profile(trades)
    area = p.value_area(profile).first()
    assert (area.poc, area.val, area.vah) == (101, 100, 101)
    assert profile.where("price_ticks = 101").first().delta == 7


def test_vwap(spark):
    last = flow.vwap(trade_tape(spark, [(0, 100, 10, "B"), (1, 102, 10, "B")]), bands=[1]).orderBy(F.desc("seq")).first()
    assert (last.vwap, last.sd, last.lower_1, last.upper_1) == (101, 1, 100, 102)
    assert flow.vwap(trade_tape(spark, [(0, 100, 10, "B")]).where("seq < 0")).count() == 0


def test_anchored_vwap(spark):
    trades = trade_tape(spark, [(0, 100, 10, "B"), (1, 102, 10, "B"), (2, 200, 10, "B")])
    anchors = spark.createDataFrame([(1, 2)], "instrument_id int, anchor_seq bigint")
    assert [r.vwap for r in flow.vwap_anchored(trades.select("instrument_id", "seq", "price_ticks", "quantity"), anchors).collect()] == [200]


FOOTPRINT = [(100, 9, 1), (101, 2, 10), (102, 8, 3), (103, 20, 4), (104, 5, 0), (105, 0, 6), (99, 0, 7)]


def footprint(spark, cells, ohlc, closed=True):
    rows = [(0, 5, price, qty, agg) for price, ask, bid in cells for qty, agg in ((ask, "B"), (bid, "S")) if qty]
    assigned = tape(spark, rows).withColumn("bar_id", F.lit(0).cast("long"))
    bar = spark.createDataFrame([(1, 0, *ohlc, closed)], "instrument_id int, bar_id bigint, open bigint, high bigint, low bigint, close bigint, is_closed boolean")
    return fp.footprint_levels(assigned), bar


def test_footprint_bar(spark):
    levels, bar = footprint(spark, FOOTPRINT, (100, 105, 99, 104))
    out = fp.footprint_bar(levels, bar, fp.FootprintSettings()).first()
    assert (out.poc, out.max_delta, out.min_delta) == (103, 16, -8)
    flagged = {l.price_ticks: l for l in out.levels}
    # 104 outweighs the bid below it too: 5 against 4 is not enough, 20 against 3 at 103 is
    assert [x for x, l in flagged.items() if l.buy_imbalance] == [103]
    assert [x for x, l in flagged.items() if l.sell_imbalance] == [105]
    assert [x for x, l in flagged.items() if l.is_zero_print] == [104]
    assert (out.unfinished_high, out.unfinished_low) == ("Confirmed", "None")
    assert sum(l.ask for l in out.levels) == 44 and sum(l.bid for l in out.levels) == 31


def test_footprint_poc_tie(spark):
    levels, bar = footprint(spark, [(100, 5, 5), (104, 6, 4)], (100, 104, 100, 103))
    assert fp.footprint_poc(levels, bar).first().poc == 104


def test_stacked_zones(spark):
    levels, _ = footprint(spark, [(100, 1, 1), (101, 10, 1), (102, 10, 1), (103, 10, 1)], (100, 103, 100, 103))
    s = fp.FootprintSettings()
    zones = fp.stacked_zones(fp.imbalance_flags(levels, s), s).where("side = 'Buy'").collect()
    assert [(z.low, z.high, z.levels) for z in zones] == [(100, 103, 4)]


def test_imbalance_markers(spark):
    cells = [(100, 9, 0), (99, 0, 2), (101, 0, 10), (102, 1, 0), (105, 5, 0)]
    levels, _ = footprint(spark, cells, (100, 105, 99, 105))
    found = {(m.side, m.price_ticks) for m in fp.imbalance_markers(levels, 3.0, 1).collect()}
    assert {("Buy", 100), ("Sell", 101), ("Buy", 105)} <= found


def closes(spark, values):
    return bars_of(spark, [(v, v, v, v, 1, 0) for v in values])


def test_averages(spark):
    assert column(i.sma(closes(spark, [1, 2, 3, 4, 5]), "close", 3), "sma") == [None, None, 2, 3, 4]
    assert column(i.ema(closes(spark, [1, 2, 3, 4, 5]), "close", 3), "ema") == [None, None, 2, 3, 4]
    assert column(i.wma(closes(spark, [1, 2, 3, 4]), "close", 3), "wma")[2:] == pytest.approx([14 / 6, 20 / 6])
    assert column(i.rma(closes(spark, [1, 2, 3, 4]), "close", 3), "rma")[2:] == pytest.approx([2, 8 / 3])
    assert column(i.ema(closes(spark, [3, 1, 2]), "close", 1), "ema") == [3, 1, 2]


def test_long_average_over_blocks(spark):
    values = [80000 + (n * 37) % 101 for n in range(2000)]
    for p in (2, 3, 20):
        y, expected = None, []
        for n, v in enumerate(values):
            y = sum(values[:p]) / p if n == p - 1 else (y + (v - y) * 2 / (p + 1) if n >= p else None)
            expected.append(y)
        got = column(i.ema(closes(spark, values), "close", p), "ema")
        assert got[:p - 1] == [None] * (p - 1)
        assert got[p - 1:] == pytest.approx(expected[p - 1:], abs=1e-6)


def test_chaikin(spark):
    out = i.chaikin_ad(bars_of(spark, [(100, 110, 90, 110, 100, 0), (110, 110, 110, 110, 50, 0)]))
    assert column(out, "chaikin_ad") == [100, 100]


def test_fair_value_gap(spark):
    gap = pa.fair_value_gap(bars_of(spark, [(95, 100, 95, 100, 1, 0), (101, 108, 101, 108, 1, 0), (104, 112, 104, 112, 1, 0)])).first()
    assert (gap.direction, gap.top, gap.bottom, gap.size) == ("Bullish", 104, 100, 4)


def daily(spark, rows):
    made = [(1, dt.date(2024, 6, 3) + dt.timedelta(days=n), n, *row) for n, row in enumerate(rows)]
    return spark.createDataFrame(made, "instrument_id int, trading_date date, idx bigint, open bigint, high bigint, low bigint, close bigint")


def test_session_gap(spark):
    rows = [(100, 100, 100, 100), (112, 112, 112, 100), (92, 100, 92, 100), (100, 100, 100, 100)]
    out = pa.session_gap(daily(spark, rows)).orderBy("trading_date").collect()
    assert [(r.direction, r.size) for r in out] == [("Bullish", 12), ("Bearish", 8), ("None", 0)]


def test_average_daily_range(spark):
    out = pa.average_daily_range(daily(spark, [(1000, 120, 100, 0), (1000, 140, 100, 0), (1000, 130, 100, 0)]), 3)
    last = out.orderBy(F.desc("trading_date")).first()
    assert (last.adr, last.up_target, last.down_target) == (30, 1015, 985)


def test_opening_range_breakout(spark):
    trades = trade_tape(spark, [(0, 100, 1, "B"), (1, 110, 1, "B"), (2, 95, 1, "B"), (60, 108, 1, "B"), (61, 111, 1, "B")])
    out = pa.opening_range_breakout(trades, F.lit(BASE + 30_000_000), ["instrument_id"]).collect()
    assert [(r.seq, r.direction) for r in out] == [(4, "Bullish")]


def test_tpo(spark):
    trades = trade_tape(spark, [(300, 100, 1, "B"), (1200, 101, 1, "B"), (2100, 100, 1, "B")])
    tpo = p.tpo_profile(trades, F.lit(BASE))
    assert {r.price_ticks: (r.tpo, r.letters) for r in tpo.collect()} == {100: (2, "AB"), 101: (1, "A")}
    assert p.tpo_poc(tpo).first().poc == 100
    assert p.bracket_count(tpo).first().brackets == 2


def test_large_trade(spark):
    out = d.large_trade(trade_tape(spark, [(0, 100, 10, "B"), (1, 100, 80, "B")]), d.LargeTrade(50, percentile=None)).collect()
    assert [(r.seq, r.bias, r.measurements["size"]) for r in out] == [(1, "Bullish", 80)]


def test_sweep(spark):
    s = d.Sweep(3, 1_000_000, 10)
    out = d.sweep(trade_tape(spark, [(0, 100, 5, "B"), (0, 101, 5, "B"), (0, 102, 5, "B")]), s).collect()
    assert [(r.bias, r.measurements["levels"]) for r in out] == [("Bullish", 3)]
    slow = d.Sweep(3, 100_000, 10)
    assert d.sweep(trade_tape(spark, [(0, 100, 5, "B"), (1, 101, 5, "B"), (2, 102, 5, "B")]), slow).count() == 0


def test_absorption(spark):
    s = d.Absorption(100, 1, 5_000_000)
    out = d.absorption(trade_tape(spark, [(n * 0.2, 100, 15, "B") for n in range(10)]), s).collect()
    assert [r.bias for r in out] == ["Bearish"] and out[0].measurements["totalVolume"] >= 100
    assert d.absorption(trade_tape(spark, [(n * 0.2, 100 + 2 * n, 15, "B") for n in range(10)]), s).count() == 0


def test_iceberg(spark):
    rows = [(0, 7, 102, 20, "")] + [(n + 1, 5, 102, 15, "B") for n in range(10)]
    out = d.iceberg(tape(spark, rows), d.Iceberg(4.0, 100)).collect()
    assert len(out) == 1 and out[0].is_estimated and out[0].measurements["ratio"] >= 4 and "(Estimated)" in out[0].text


def test_replenishment(spark):
    sizes = [50, 0, 40, 0, 40, 0, 40]
    out = d.replenishment(tape(spark, [(n, 6, 100, s, "") for n, s in enumerate(sizes)]), d.Replenishment(3, 20, 30_000_000))
    assert [r.bias for r in out.collect()] == ["Bullish"]


def test_stop_run(spark):
    rows = [(n, 100 + n % 6, 2, "B") for n in range(20)] + [(40, 110, 80, "B")]
    assert [(r.seq, r.bias) for r in d.stop_run(trade_tape(spark, rows)).collect()] == [(20, "Bullish")]


def test_market_regime(spark):
    out = d.market_regime(trade_tape(spark, [(n * 0.01, 100, 1, "B") for n in range(60)])).orderBy("seq").collect()
    assert out and "Normal" in out[0].text


def test_delta_divergence(spark):
    rows = [(100, 100, 90, 95, 1, 40), (98, 98, 90, 95, 1, 10), (99, 99, 90, 95, 1, 10), (99, 99, 90, 95, 1, 10), (105, 105, 90, 95, 1, 8)]
    out = d.delta_divergence(bars_of(spark, rows), d.DeltaDivergence(3)).collect()
    assert [(r.seq, r.bias) for r in out if r.bias == "Bearish"] == [(4, "Bearish")] or out == []
    four = d.delta_divergence(bars_of(spark, rows), d.DeltaDivergence(4)).collect()
    assert [(r.seq, r.bias) for r in four] == [(4, "Bearish")]


def audit(spark, sequences, flags=S.HAS_SEQUENCE):
    df = spark.createDataFrame([(1, n, x, flags) for n, x in enumerate(sequences)], "instrument_id int, arrival bigint, seq bigint, flags int")
    return column(q.sequence_audit(df, "seq", "arrival"), "outcome", "arrival")


def test_sequence_audit(spark):
    assert audit(spark, [100, 101, 101, 50]) == ["Ok", "Ok", "Duplicate", "Duplicate"]
    assert audit(spark, [100, 105, 106]) == ["Ok", "Gap", "Ok"]
    assert audit(spark, [7], flags=0) == ["NoSequence"]


SNAPSHOT = [(0, 8, 0, 0, ""), (0, 6, 100, 10, ""), (0, 6, 99, 20, ""), (0, 7, 102, 15, ""), (0, 7, 103, 25, ""), (0, 9, 0, 0, "")]


def last_reason(spark, *more, **how):
    out = book.book_validity(tape(spark, SNAPSHOT + list(more)), **how)
    return out.orderBy(F.desc("seq")).first()


def test_book(spark):
    t = tape(spark, SNAPSHOT)
    depth = {r.side: r.depth for r in book.cumulative_depth(book.book_levels_asof(t), 2).collect()}
    assert depth == {1: 30, 2: 40}
    row = last_reason(spark)
    assert (row.best_bid, row.best_ask, row.reason) == (100, 102, None)
    assert last_reason(spark, (1, 6, 100, 0, "")).best_bid == 99
    assert last_reason(spark, (1, 7, 100, 5, "")).reason == "crossed book"
    assert last_reason(spark, (1, 6, 100, -5, "")).reason == "negative size rejected"
    assert last_reason(spark, (1, 14, 0, 0, "")).reason == "sequence gap"
    gap_then_update = [(1, 14, 0, 0, ""), (2, 6, 98, 5, "")]
    assert last_reason(spark, *gap_then_update).reason == "sequence gap"
    assert last_reason(spark, *gap_then_update, sticky_gap=False).reason is None


def test_restore_equals_replay(spark):
    rows = [(n, 6 + (n * 7) % 2, 100 + (n * 13) % 9, (n * 5) % 4, "") for n in range(400)]
    t = tape(spark, rows)
    cp = book.book_checkpoints(t, 50)
    for at in (49, 50, 199, 333):
        assert sorted(book.book_restore(cp, t, at).collect()) == sorted(book.book_levels_asof(t, at).collect())


def order_tape(spark, rows):
    made = [(1, n, *row) for n, row in enumerate(rows)]
    return spark.createDataFrame(made, "instrument_id int, seq bigint, type int, order_id bigint, side int, price_ticks bigint, quantity bigint")


def test_orders(spark):
    rows = [
        (1, 1, 1, 100, 10), (1, 2, 1, 100, 5), (1, 2, 1, 100, 9), (4, 1, 1, 100, 4), (2, 1, 1, 100, 3),
        (2, 2, 1, 101, 5), (1, 3, 1, 100, 7), (3, 9, 1, 100, 0), (4, 3, 1, 100, 7), (2, 1, 1, 101, 2),
    ]
    life = orders.mbo_orders(order_tape(spark, rows))
    queue = [(r.price_ticks, r.position, r.order_id, r.size) for r in orders.mbo_queue(life, 6).orderBy("price_ticks", "position").collect()]
    assert queue == [(100, 1, 1, 3), (100, 2, 3, 7), (101, 1, 2, 5)]
    end = [(r.position, r.order_id, r.size) for r in orders.mbo_queue(life, 9).orderBy("position").collect()]
    assert end == [(1, 2, 5), (2, 1, 2)]
    counts = orders.mbo_diagnostics(life, order_tape(spark, rows)).first()
    assert (counts.unknown_orders, counts.duplicate_adds, counts.held_reason) == (1, 1, None)


def test_order_statements_compose():
    import random

    rng = random.Random(3)
    for _ in range(3000):
        events = [(rng.choice([1, 2, 3, 4, 4]), rng.choice([1, 2]), rng.choice([100, 101]), rng.randint(0, 4), n) for n in range(rng.randint(1, 7))]
        for state in [orders.GONE, (1, 100, 3, 77), (2, 101, 6, 78), (1, 101, 1, 79)]:
            assert orders.composed(state, orders.statement(events)) == orders.after_all(state, events)


def test_sessions(spark):
    dates = spark.createDataFrame([(dt.date(2024, 6, 3),), (dt.date(2024, 1, 8),), (dt.date(2024, 6, 4),)], "trading_date date")

    def window(date, template):
        r = calendar.session_windows(dates, template).where(F.col("trading_date") == date).first()
        utc = dt.timezone.utc
        return tuple(dt.datetime.fromtimestamp(x / 1e6, utc).strftime("%m-%d %H:%M") for x in (r.start_us, r.end_us))

    assert window(dt.date(2024, 6, 3), "rth") == ("06-03 13:30", "06-03 20:00")
    assert window(dt.date(2024, 1, 8), "rth") == ("01-08 14:30", "01-08 21:00")
    assert window(dt.date(2024, 6, 4), "globex") == ("06-03 22:00", "06-04 21:00")
    evening = spark.createDataFrame([(1_717_455_600_000_000,)], "ts_us bigint")  # 2024-06-03 23:00 UTC
    assert calendar.trading_date(evening).first().trading_date == dt.date(2024, 6, 4)


def test_contracts(spark):
    names = spark.createDataFrame([("NQZ5",), (" esh25 ",), ("NQM2026",), ("NQF5",), ("CLZ5",), ("NQZ255",)], "symbol string")
    parsed = [(r.contract_root, r.contract_month, r.contract_year) for r in q.parse_contract(names).collect()]
    assert parsed == [("NQ", 12, 2025), ("ES", 3, 2025), ("NQ", 6, 2026), (None, None, None), (None, None, None), (None, None, None)]
    roots = spark.createDataFrame([("NQ",)], "root string")
    expiry = calendar.contract_calendar(roots, 2025, 2025).where("month = 12").first().expiry
    assert expiry == dt.date(2025, 12, 19)


def test_ticks_round_half_to_even(spark):
    prices = spark.createDataFrame([(1, "0.125"), (1, "0.375"), (1, "0.625")], "instrument_id int, price string")
    out = q.to_ticks(prices, S.instrument_specs(spark)).orderBy("price").collect()
    assert [r.ticks for r in out] == [0, 2, 2]


def test_heatmap_carries_forward(spark):
    t = tape(spark, [(0, 6, 100, 5, ""), (0.3, 7, 102, 7, ""), (1.1, 6, 100, 0, "")])
    cells = heatmap.liquidity_heatmap(heatmap.heat_intervals(t)).collect()
    assert {(c.col, c.side, c.price_ticks, c.size) for c in cells} == {
        *[(n, 1, 100, 5) for n in range(4)], *[(n, 2, 102, 7) for n in range(1, 5)]}


def test_tape_speed(spark):
    out = tape_view.tape_speed(trade_tape(spark, [(n, 100, 2, "B") for n in range(10)])).orderBy(F.desc("seq")).first()
    assert (out.trades_per_second, out.contracts_per_second) == (pytest.approx(6 / 5), pytest.approx(12 / 5))


def test_pull_stack(spark):
    sizes = [10, 4, 0, 8, 12]
    out = book.pull_stack(tape(spark, [(n, 6, 100, s, "") for n, s in enumerate(sizes)])).first()
    assert (out.pulled, out.stacked, out.replenishments) == (10, 12, 1)


def test_corrupt_part_is_skipped_and_reported(spark, tmp_path):
    path = str(tmp_path / "recording")
    rec.record_session(trade_tape(spark, [(n, 100, 1, "B") for n in range(30)]), path, max_records=10)
    folder = next((tmp_path / "recording").rglob("date=*"))
    (folder / "bad.parquet").write_bytes(b"PAR1\x00")
    with pytest.raises(Exception):
        rec.scan_session(spark, path).where("quantity > 0").collect()
    assert rec.scan_session(spark, path, skip_corrupt=True).count() == 30
    health = rec.part_health(spark, path).first()
    assert health.corrupt == 1 and health.valid == health.parts - 1


def test_state_does_not_depend_on_partitioning(spark):
    rows = [(n * 0.7, 5 + (n * 3) % 3, 100 + (n * 13) % 9, 1 + n % 5, "BSU"[n % 3]) for n in range(500)]
    t = tape(spark, rows)
    digests = {
        r.digest for k in (1, 7, 40) for r in session.session_digest(session.session_state(t.repartition(k))).collect()
    }
    assert len(digests) == 1


def test_slices_do_not_change_results(spark):
    rows = [(n * 0.7, 5 + (n * 3) % 3, 100 + (n * 13) % 9, 1 + n % 5, "BSU"[n % 3]) for n in range(700)]
    t = tape(spark, rows)
    runs = []
    for size in ("5", "64", "100000"):
        spark.conf.set("spark.tickloom.sliceRows", size)
        runs.append((
            sorted(b.volume_bars(t, 20).collect()), sorted(flow.cvd(q.trades(t)).select("seq", "cvd").collect()),
            sorted(book.best_prices(t).collect(), key=lambda r: r.seq),
        ))
    spark.conf.set("spark.tickloom.sliceRows", "64")
    assert runs[0] == runs[1] == runs[2]
