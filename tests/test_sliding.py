"""Sliding windows against plain loops, and blocks bounded by rows."""

import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.plans import sliding


def plain(rows, width, short):
    out = {}
    for key in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == key]
        for t in {r[2] for r in mine}:
            inside = [r for r in mine if t - width <= r[2] < t]
            near = [r for r in mine if t - short <= r[2] < t]
            known = [r[3] for r in sorted(inside, key=lambda r: r[1]) if r[3] is not None]
            out[(key, t)] = (
                len(inside), sum(r[3] or 0 for r in near), max(known, default=None), min(known, default=None), known[0] if known else None,
            )
    return out


def found(spark, rows, width, short):
    df = spark.createDataFrame(rows, "name string, seq long, ts_us long, v long")
    v = F.col("v")
    got = sliding.before_window(
        df, ["name"], width, sums={"n": F.lit(1), "near": v}, maxs={"high": v}, mins={"low": v}, firsts={"head": v}, widths={"near": short},
    ).collect()
    assert len(got) == len({(r.name, r.ts_us) for r in got})
    return {(r.name, r.ts_us): (r.n, r.near, r.high, r.low, r.head) for r in got}


@pytest.mark.parametrize("slice_rows", [1, 3, 64])
def test_windows_by_plain_loops(spark, monkeypatch, slice_rows):
    monkeypatch.setattr(sliding, "slice_rows", lambda _: slice_rows)
    rng = random.Random(slice_rows)
    rows = []
    for key, n in (("a", 160), ("b", 40), ("c", 1)):
        ts = 1000
        for seq in range(n):
            # bursts and long silences
            ts += rng.choice([0, 0, 1, 1, 2, 30, 400 if rng.random() < 0.2 else 3])
            rows.append((key, seq * 2, ts, rng.choice([None, rng.randrange(-9, 9), rng.randrange(-9, 9)])))
    for width, short in ((50, 5), (1, 1), (10_000, 40)):
        assert found(spark, rows, width, short) == plain(rows, width, short)


def test_dense_second_in_small_blocks(spark, monkeypatch):
    """100,000 distinct times in one second, all in each other's window."""
    monkeypatch.setattr(sliding, "slice_rows", lambda _: 4096)
    df = spark.range(100_000).select(F.lit("a").alias("name"), F.col("id").alias("seq"), (F.col("id") * 10).alias("ts_us"), (F.col("id") % 1000).alias("v"))
    out = sliding.before_window(df, ["name"], 300_000_000, sums={"n": F.lit(1)}, maxs={"high": F.col("v")})
    total = out.agg(F.count("*"), F.sum("n"), F.sum(F.when(F.col("high") == 999, 1)), F.sum(F.col("high").isNull().cast("int"))).first()
    assert tuple(total) == (100_000, 100_000 * 99_999 // 2, 99_000, 1)


def test_blocks_meet_few_others():
    rng = np.random.default_rng(1)
    for width in (1, 100, 10_000, 10**9):
        edges = np.cumsum(rng.integers(1, rng.choice([2, 5000]), 400))
        blocks = pd.DataFrame({"name": "a", "_block": np.arange(200), "_low": edges[::2], "_high": edges[1::2], "n": 1})
        met = sliding._met(blocks, width, {"n": sliding.Sum}, ["name"])
        assert len(met) <= 2 * 200 and (met["_other"] <= met["_own"]).all()
