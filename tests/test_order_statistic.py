"""Order statistics of stretches against sorting, and large trades by a plain loop."""

import math
import time

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.operators import detectors
from tickloom.plans.order_statistic import OrderStatistic


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-20, 20), min_size=1, max_size=60), st.data())
def test_ranks_by_sorting(values, data):
    array = np.array(values)
    low = data.draw(st.lists(st.integers(0, len(values) - 1), min_size=1, max_size=20))
    high = [data.draw(st.integers(a + 1, len(values))) for a in low]
    rank = [data.draw(st.integers(0, b - a - 1)) for a, b in zip(low, high)]
    got = OrderStatistic(array).ranked(np.array(low), np.array(high), np.array(rank))
    assert got.tolist() == [sorted(values[a:b])[k] for a, b, k in zip(low, high, rank)]


def test_a_million_windows():
    size = np.random.default_rng(1).integers(1, 10_000, 1_000_000)
    at = np.arange(20, len(size))
    start = time.perf_counter()
    low = np.maximum(0, at - 500)
    got = OrderStatistic(size).ranked(low, at, np.ceil(0.98 * (at - low)).astype(np.int64) - 1)
    assert time.perf_counter() - start < 15
    for i in (0, 1000, 999_979):
        assert got[i] == np.sort(size[low[i]:at[i]])[math.ceil(0.98 * (at[i] - low[i])) - 1]


def test_every_print_a_candidate(spark):
    """Fixed size 1, so that all prints are compared with the percentile of those before."""
    sizes = np.random.default_rng(2).integers(1, 60, 700).tolist()
    rows = [(1, i, S.TRADE, 100, q, S.BUY, i) for i, q in enumerate(sizes)]
    tape = spark.createDataFrame(rows, "instrument_id int, seq long, type int, price_ticks long, quantity long, aggressor int, ts_us long").withColumn(
        "ts", F.timestamp_micros("ts_us"))
    setting = detectors.LargeTrade(fixed=1, percentile=0.9, window=50, warm_up=10)
    want = {}
    for i, q in enumerate(sizes):
        recent = sorted(sizes[max(0, i - 50):i])
        p = recent[math.ceil(0.9 * len(recent)) - 1] if len(recent) >= 10 else 1
        if q >= p:
            want[i] = float(max(1, p))
    got = {r.seq: r.measurements["threshold"] for r in detectors.large_trade(tape, setting).collect()}
    assert got == want
