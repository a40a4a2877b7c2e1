"""Registries and per-instrument settings."""

import pytest

from tickloom.functions import registry as g
from tickloom.operators import footprint as fp
from tickloom.operators.detectors import DETECTORS


def test_listings(spark):
    assert g.list_indicators(spark).count() == 12
    studies = g.list_studies(spark).collect()
    assert len(studies) == 32 and {r.status for r in studies} == {"available"}
    assert g.list_presets(spark).count() == 12
    assert len(DETECTORS) == 8


def test_missing_data_is_named(spark):
    with pytest.raises(ValueError, match="high"):
        g.run_indicator("RSI", spark.range(3))


def test_presets_take_thresholds_of_the_instrument():
    assert g.PRESETS["Minimal"].for_root("ES").large_trade == 75
    assert g.PRESETS["Minimal"].for_root("NQ").min_imbalance == 2


def test_settings_are_clamped():
    s = fp.FootprintSettings(buy_ratio=0.5, stacked_count=99, large_trade=0, min_stack_volume=-4).validated()
    assert (s.buy_ratio, s.stacked_count, s.large_trade, s.min_stack_volume) == (1.01, 50, 1, 0)


def test_settings_table(spark):
    rows = {r.instrument_id: r.large_trade for r in fp.settings_table(spark, {1: fp.NQ, 2: fp.ES}).collect()}
    assert rows == {1: 45, 2: 75}


def test_thresholds_of_a_table_are_those_of_each_setting(spark):
    """Switches, policies and metrics that differ by instrument, against one pass per instrument."""
    import random

    from pyspark.sql import functions as F

    rng = random.Random(6)
    keys = {
        1: fp.FootprintSettings(horizontal=True, zero_denominator="extreme_imbalance", poc_metric="trades", large_trade=3),
        2: fp.FootprintSettings(diagonal=False, allow_one_gap=True, stacked_count=2, zero_print_exclude_extremes=False, min_imbalance=2),
        3: fp.FootprintSettings(zero_denominator="denominator_floor", denominator_floor=3, allow_one_gap=True, poc_metric="abs_delta", buy_ratio=1.5),
        4: fp.FootprintSettings(zero_denominator="ignore", min_stack_volume=9, unfinished_min=4, zero_print_min=3, poc_metric="bid"),
    }
    rows = [
        (k, bar, 100 + p, rng.randrange(6), rng.randrange(6), rng.randrange(2), 1 + rng.randrange(5), 1 + rng.randrange(6))
        for k in keys for bar in range(25) for p in range(12) if rng.random() < 0.8
    ]
    raw = spark.createDataFrame(rows, "instrument_id int, bar_id long, price_ticks long, bid long, ask long, unknown long, trades long, max_print long")
    levels = raw.withColumns({"total": F.col("bid") + F.col("ask"), "delta": F.col("ask") - F.col("bid")}).cache()
    bars = levels.groupBy(*fp.BAR).agg(
        F.min("price_ticks").alias("low"), F.max("price_ticks").alias("high"), F.max("price_ticks").alias("open"), F.min("price_ticks").alias("close"),
        (F.col("bar_id") < 20).alias("is_closed"), F.sum("delta").alias("_d"),
    ).drop("_d").cache()
    table = fp.settings_table(spark, keys)
    together = fp.footprint_bar(levels, bars, table)
    assert not [c for c in together.columns if c.startswith("_s_")]
    apart = [fp.footprint_bar(levels.where(F.col("instrument_id") == k), bars.where(F.col("instrument_id") == k), s) for k, s in keys.items()]
    want = [r for one in apart for r in one.select(together.columns).collect()]
    order = lambda rows: sorted(rows, key=lambda r: (r.instrument_id, r.bar_id))
    assert order(together.collect()) == order(want) and len(want) == 100
    # a table with some columns, nulls and values out of bounds: defaults and limits stand in
    some = spark.createDataFrame([(1, None, 0.1), (2, 7, 5.0)], "instrument_id int, min_imbalance long, buy_ratio double")
    got = {r.instrument_id: (r.min_imbalance, r.buy_ratio, r.stacked_count) for r in fp.validated_table(some).collect()}
    assert got == {1: (1, 1.01, 3), 2: (7, 5.0, 3)}


def test_table_functions_over_many_batches(spark):
    """Bars go on over Arrow batches, and partitions do not mix."""
    import numpy as np
    from pyspark.sql import functions as F

    from tickloom.functions.tables import register_table_functions
    from tickloom.operators import bars

    rng = np.random.default_rng(4)
    rows = [(k, i, i * 10, 100 + int(p), int(q), int(a)) for k, n in ((1, 500), (2, 77), (3, 1))
            for i, (p, q, a) in enumerate(zip(np.cumsum(rng.integers(-1, 2, n)), rng.integers(1, 9, n), rng.integers(0, 3, n)))]
    prints = spark.createDataFrame(rows, "instrument_id int, seq long, ts_us long, price_ticks long, quantity long, aggressor int")
    prints.createOrReplaceTempView("test_prints")
    assert register_table_functions(spark) == ["range_bars", "tick_bars", "volume_bars"]
    tape = prints.withColumns({"type": F.lit(5), "ts": F.timestamp_micros("ts_us")})
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        for name, size, build in (("tick_bars", 10, bars.tick_bars), ("volume_bars", 30, bars.volume_bars), ("range_bars", 3, bars.range_bars)):
            columns = ["instrument_id", "start_us", "end_us", "open", "high", "low", "close", "volume", "buy", "sell", "trades", "first_seq", "last_seq", "is_closed"]
            got = spark.sql(f"SELECT * FROM {name}({size}, TABLE(test_prints) PARTITION BY instrument_id ORDER BY seq)").select(*columns).collect()
            assert sorted(map(tuple, got)) == sorted(map(tuple, build(tape, size).select(*columns).collect()))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
