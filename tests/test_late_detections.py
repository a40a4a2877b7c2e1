"""Detections that late rows bring about in a later micro-batch."""

import random
from collections import Counter

from pyspark.sql import functions as F

from tests.test_fixtures import tape
from tickloom.catalog.detectors import SETTINGS
from tickloom.operators import detectors as d
from tickloom.streaming.steps import detectors_step


def told(df):
    return Counter((r.detector, r.seq, r.price_ticks, r.text) for r in df.collect())


def test_late_rows_bring_their_detections(spark, tmp_path):
    rng = random.Random(7)
    rows, price = [], 100
    for n in range(1200):
        price += rng.choice((-1, 0, 0, 1))
        kind = rng.choice((5, 5, 6, 7))
        burst = n % 200 > 150
        side = ("B" if burst else rng.choice("BSU")) if kind == 5 else "U"
        rows.append((n * (0.02 if burst else 0.05), kind, price + (n % 200 if burst else 0) // 10 if kind == 5 else 100 + n % 2, rng.choice((0, 5, 20, 60)), side))
    rows.sort(key=lambda r: r[0])
    whole = tape(spark, rows).cache()
    # of the youngest rows of the first two batches, some come one batch late
    held = (F.col("seq") % 7 == 3) | (F.col("seq") % 40 > 34)
    third = F.least(F.floor(F.col("seq") / 400), F.lit(2)).cast("int")
    batches = whole.withColumn("_b", F.when(held & (F.col("seq") % 400 > 340) & (third < 2), third + 1).otherwise(third)).cache()
    step, state, outs = detectors_step(SETTINGS, 10_000_000), None, []
    for k in range(3):
        out, after = step(batches.where(F.col("_b") == k).drop("_b"), state)
        out.write.parquet(f"{tmp_path}/out/{k}")
        outs.append(spark.read.parquet(f"{tmp_path}/out/{k}"))
        for name, table in after.items():
            table.write.parquet(f"{tmp_path}/state/{k}/{name}")
        state = {name: spark.read.parquet(f"{tmp_path}/state/{k}/{name}") for name in after}
    every = outs[0].unionByName(outs[1]).unionByName(outs[2])
    assert every.where("is_too_late").count() == 0
    net = told(every.where("not is_withdrawn"))
    net.subtract(told(every.where("is_withdrawn")))
    expected = Counter()
    for of, name in ((d.sweep, "Sweep"), (d.absorption, "Absorption"), (d.replenishment, "Replenishment"), (d.stop_run, "Stop-Run"), (d.market_regime, "Market Regime")):
        expected += told(of(whole, SETTINGS[name]))
    assert len({k[0] for k in expected}) >= 3
    assert +net == expected and min(net.values()) >= 0
    # some of them come out behind rows of the batch before
    first = batches.where("_b = 0").agg(F.max("seq")).first()[0]
    assert outs[1].where((F.col("seq") <= first) & ~F.col("is_withdrawn")).count() > 0
    # older than the history kept: told apart, not lost silently
    old = whole.where(F.col("seq") == 3)
    out, _ = step(old, state)
    assert [(r.detector, r.seq, r.is_too_late) for r in out.collect()] == [("Too Late", 3, True)]
