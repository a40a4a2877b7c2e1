"""Branches that the registered queries do not reach."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tests.test_fixtures import tape, trade_tape
from tickloom.operators import bars as b
from tickloom.operators import calendar, detectors, heatmap, quality, review
from tickloom.plans.materialize import shared_folder
from tickloom.streaming.steps import cvd_vwap_step

DAY = 24 * 3600


def test_oldest_column_is_kept(spark):
    rows = [(0.1, 6, 100, 5, "U"), (5000 * 0.25, 6, 101, 3, "U")]
    cells = heatmap.liquidity_heatmap(heatmap.heat_intervals(tape(spark, rows)))
    assert cells.agg(F.min("col"), F.countDistinct("col")).first()[0] == 0 and cells.select("col").distinct().count() > 4096
    kept = heatmap.heatmap_retention(heatmap.heat_intervals(tape(spark, rows)), 10)
    assert kept.agg(F.min("from_col")).first()[0] > 4900


def test_bars_closed_by_their_session(spark):
    trades = trade_tape(spark, [(10, 100, 1, "B"), (20, 101, 1, "B"), (DAY + 10, 102, 1, "B"), (DAY + 20, 103, 1, "S")])
    dated = trades.withColumn("day", F.to_date("ts"))
    for bars in (b.time_bars(dated, 3_600_000_000, "day"), b.tick_bars(dated, 3, "day"), b.volume_bars(dated, 100, "day"), b.range_bars(dated, 50, "day")):
        got = [(r.is_closed, r.trades) for r in bars.orderBy("first_seq").collect()]
        assert got == [(True, 2), (False, 2)]
    ends = [r.end_us - r.start_us for r in b.time_bars(dated, 3_600_000_000, "day").orderBy("first_seq").collect()]
    assert ends[0] < 3_600_000_000  # at its last trade, not at the end of the hour


def test_annotations_without_risk_reward(spark, tmp_path):
    df = spark.createDataFrame([("a", 1.5), ("b", None)], "id string, risk_reward double")
    review.export_review(df, str(tmp_path / "x"))
    lines = sorted(line for p in (tmp_path / "x").glob("part*.csv") for line in p.read_text().splitlines() if not line.startswith("id"))
    assert lines == ["a,1.50,true", "b,,true"]


def test_late_trades_go_on_from_their_date(spark):
    step = cvd_vwap_step(keep_days=3)
    first = trade_tape(spark, [(10, 100, 10, "B"), (DAY + 10, 100, 4, "B")])
    _, state = step(first, None)
    late = trade_tape(spark, [(30, 100, 3, "B"), (DAY + 30, 100, 1, "S"), (9 * DAY, 100, 7, "B")]).withColumn("seq", F.col("seq") + 100)
    out, state = step(late, state)
    assert [(r.cvd, r.is_too_late) for r in out.orderBy("seq").collect()] == [(13, False), (3, False), (7, False)]
    older = trade_tape(spark, [(50, 100, 2, "B")]).withColumn("seq", F.col("seq") + 200)
    out, _ = step(older, state)
    assert [(r.cvd, r.is_too_late) for r in out.collect()] == [(2, True)]


def test_roll_of_more_than_a_year(spark):
    dates = spark.createDataFrame([("NQ", dt.date(2024, 1, 10))], "root string, trading_date date")
    row = calendar.front_month(dates, roll_days=800).first()
    assert row.symbol == "NQH26" and row.days_to_expiry == 800


def test_roots_of_the_dimension(spark):
    names = spark.createDataFrame([("MNQZ5",), ("NQZ5",), ("CLH26",)], "symbol string")
    got = [r.contract_root for r in quality.parse_contract(names, roots=["NQ", "MNQ", "CL"]).collect()]
    assert got == ["MNQ", "NQ", "CL"]
    assert [r.contract_root for r in quality.parse_contract(names).collect()] == [None, "NQ", None]


def test_no_local_folder_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:
            master = "yarn"

            @staticmethod
            def getConf():
                return Conf()

    with pytest.raises(ValueError, match="share"):
        shared_folder(Cluster())


def test_shipping(spark):
    import tickloom

    tickloom.ship(spark)
    tickloom.ship(spark)
    assert "tickloom" in spark.range(1).select(F.udf(lambda _: __import__("tickloom").__name__)("id")).first()[0]


def test_levels_that_cannot_fire_have_no_windows(spark):
    """One level is restored twice, one once, one never."""
    quotes = [(100, 20), (100, 0), (100, 30), (100, 0), (100, 30), (101, 20), (101, 0), (101, 40), (102, 20), (102, 25)]
    df = tape(spark, [(float(n), 6, price, size, "U") for n, (price, size) in enumerate(quotes)])
    s = detectors.Replenishment(times=2, min_size=20, window_us=60_000_000)
    kept = detectors.replenishment_windows(df, s, least=s.times).select("price_ticks").distinct().collect()
    assert [r.price_ticks for r in kept] == [100]
    assert [(r.seq, r.price_ticks) for r in detectors.replenishment(df, s).collect()] == [(4, 100)]
