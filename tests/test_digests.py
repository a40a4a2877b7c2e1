"""Digest trees: order and partitioning do not matter, differences are found, appended events add up."""

import random

from pyspark.sql import functions as F

from tickloom.operators import digests
from tickloom.plans import materialize

NAMES = "instrument_id int, seq long, ts_us long, price_ticks long, quantity long"


def tape(spark, rows, parts=1):
    return spark.createDataFrame(rows, NAMES).repartition(parts)


def differing(one, other, fan):
    return sorted(map(tuple, digests.differing_slices(one, other, fan).select("instrument_id", "slice", "events", "other_events").collect()))


def test_differences_by_comparing_slices(spark):
    rng = random.Random(1)
    rows = [(k, i, i * 7, rng.choice([100, 101, None]), rng.randrange(5)) for k, n in ((1, 900), (2, 40)) for i in range(n)]
    mine = materialize(digests.leaves(tape(spark, rows, 4), 10), "leaves")
    assert differing(mine, digests.leaves(tape(spark, rows[::-1], 3), 10), 4) == []
    for fan in (4, 64):
        other = [r for r in rows if r[:2] not in ((1, 333), (2, 5))]
        other = [(*r[:4], r[4] + 1) if r[:2] == (1, 871) else r for r in other] + [(1, 4000, 1, 1, 1), (3, 2, 1, 1, 1), rows[17]]
        want = sorted([(1, 33, 10, 9), (1, 87, 10, 10), (1, 400, None, 1), (2, 0, 10, 9), (3, 0, None, 1), (1, 1, 10, 11)])
        theirs = materialize(digests.leaves(tape(spark, other, 2), 10), "leaves")
        assert differing(mine, theirs, fan) == want
        first = digests.first_difference(mine, theirs, fan).select("instrument_id", "slice").collect()
        assert sorted(map(tuple, first)) == [(1, 1), (2, 0), (3, 0)]


def test_appended_leaves(spark):
    rows = [(1, i, i, 100 + i % 3, i % 5) for i in range(200)]
    whole = digests.leaves(tape(spark, rows), 16)
    added = digests.appended(digests.leaves(tape(spark, rows[:77]), 16), digests.leaves(tape(spark, rows[77:]), 16))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, added.collect()))


def test_a_null_is_not_an_empty_text(spark):
    one, other = (digests.leaves(spark.createDataFrame([(1, 1, 1, v, 1)], NAMES), 10) for v in (None, 0))
    assert one.select("sum_a").first() != other.select("sum_a").first()
    assert digests.tree(one)[-1].count() == 1 and digests.height(one.where(F.lit(False))) == 0
