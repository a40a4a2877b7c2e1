"""Best prices: pieces of stretches against their sequences, covering maxima and whole books against a replay."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tickloom import schema as S
from tickloom.operators import book


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 70), st.lists(st.tuples(st.integers(0, 70), st.integers(0, 70), st.integers(-50, 50)), max_size=40))
def test_highest_over_ranges(count, ranges):
    clipped = [(min(a, count), min(b, count), v) for a, b, v in ranges]
    low, high, value = (np.array([r[i] for r in clipped], dtype=np.int64) for i in range(3))
    got = book.highest_over(count, low, high, value, -1000)
    assert got.tolist() == [max((v for a, b, v in clipped if a <= i < b), default=-1000) for i in range(count)]


@pytest.mark.parametrize("every, fan", [(2, 2), (3, 2), (8, 64)])
def test_pieces_cover_each_sequence_once(spark, monkeypatch, every, fan):
    monkeypatch.setattr(book, "FAN", fan)
    rng = random.Random(every)
    spans = [(i, a, a + rng.randrange(0, 60)) for i, a in enumerate(rng.randrange(0, 50) for _ in range(60))]
    made = book.pieces(spark.createDataFrame(spans, "id int, from_seq long, to_seq long"), every).collect()
    unit = lambda level: 1 if level == 0 else every * fan ** (level - 1)
    for i, a, b in spans:
        mine = [r for r in made if r.id == i]
        covered = sorted(x for r in mine for x in range(r.low * unit(r.level), r.high * unit(r.level)))
        assert covered == list(range(a, b))
        # a piece lies in its group, and there are at most two a level
        assert all(r.low // (every if r.level == 0 else fan) == r.group == (r.high - 1) // (every if r.level == 0 else fan) for r in mine)
        assert len(mine) <= 2 * book.LEVELS


def replayed(rows, points):
    """Plain replay; after each row the best prices."""
    out, at = {}, {}
    for key in {r[0] for r in rows} | {p[0] for p in points}:
        shown, todo = {}, sorted([(r[1], 0, r) for r in rows if r[0] == key] + [(p[1], 1, p) for p in points if p[0] == key])
        for seq, is_point, r in todo:
            if is_point:
                bids, asks = ([p for (s, p), n in shown.items() if s == side and n > 0] for side in (S.BID, S.ASK))
                out[(key, seq)] = (max(bids, default=None), min(asks, default=None))
            elif r[2] in (S.SNAPSHOT_START, S.BOOK_CLEAR):
                shown.clear()
            elif r[5] >= 0:
                shown[(S.BID if r[2] == S.BID_UPDATE else S.ASK, r[4])] = r[5]
    return out


@pytest.mark.parametrize("fan", [2, 64])
def test_best_prices_by_replay(spark, monkeypatch, fan):
    monkeypatch.setattr(book, "FAN", fan)
    monkeypatch.setattr(book, "slice_rows", lambda _: 4)
    rng = random.Random(fan)
    rows = []
    for key in (1, 2):
        for seq in range(0, 900, 3):
            kind = rng.choices([S.BID_UPDATE, S.ASK_UPDATE, S.BOOK_CLEAR], [50, 50, 0.5 if key == 1 else 0])[0]
            side = S.BID if kind == S.BID_UPDATE else S.ASK
            # now and then a level far away that stays for long
            price = rng.choice([100, 101, 102, 103]) + (side == S.ASK) * 2
            rows.append((key, seq, kind, side, price, rng.choice([0, 0, 5, 7, -1])))
    rows.append((3, 0, S.BID_UPDATE, S.BID, 50, 1))  # stands to the end, with nothing after it
    points = [(key, seq) for key in (1, 2) for seq in range(0, 950, 7)] + [(3, 899), (4, 5), (1, 14), (1, 14)]
    events = spark.createDataFrame(rows, "instrument_id int, seq long, type int, side int, price_ticks long, quantity long").selectExpr(
        "*", "timestamp_micros(seq) AS ts")
    found = book.best_prices(events, spark.createDataFrame(points, "instrument_id int, seq long")).collect()
    assert len(found) == len(points)
    want = replayed(rows, points)
    assert {(r.instrument_id, r.seq): (r.best_bid, r.best_ask) for r in found} == want


def test_snapshots_skip_slices_without_rows(spark):
    rows = [(1, 0, S.BID_UPDATE, S.BID, 10, 5), (1, 1_000_000, S.ASK_UPDATE, S.ASK, 12, 5), (1, 2_000_000, S.BID_UPDATE, S.BID, 10, 0), (1, 3_000_000, S.BID_UPDATE, S.BID, 9, 1)]
    events = spark.createDataFrame(rows, "instrument_id int, seq long, type int, side int, price_ticks long, quantity long").selectExpr(
        "*", "timestamp_micros(seq) AS ts")
    made = sorted((r._slice, r.side, r.price_ticks) for r in book.snapshots(book.book_rows(events), 10).collect())
    assert made == [(100_000, S.BID, 10), (200_000, S.BID, 10), (200_000, S.ASK, 12), (300_000, S.ASK, 12)]
