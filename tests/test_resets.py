"""Slice functions of restarting windows against row-by-row evaluation."""

import numpy as np
import pandas as pd
import pytest

from tickloom.plans import resets
from tickloom.plans.resets import FRESH, BandLimit, RangeLimit, SweepLimit, TimeLimit, VolumeLimit, after, composed_all, restarting, summary


def by_rows(kind, rows, a, b):
    out, start = [], None
    for i, r in enumerate(rows):
        if kind == "time" and start is not None and r.ts_us - rows[start].ts_us > a:
            start = None
        if kind == "at_least" and start is not None and r.ts_us - rows[start].ts_us >= a:
            start = None
        if kind == "band" and start is not None:
            prices = [x.price_ticks for x in rows[start:i + 1]]
            if r.ts_us - rows[start].ts_us > a or max(prices) - min(prices) > b:
                start = None
        if kind == "sweep" and start is not None and r.is_break:
            start = None
        if start is None:
            start = i
            out.append(i)
            if kind == "sweep":
                continue
        else:
            out.append(start)
        window = rows[start:i + 1]
        prices = [x.price_ticks for x in window]
        if kind == "volume" and sum(x.quantity for x in window) >= a:
            start = None
        if kind == "range" and max(prices) - min(prices) >= a:
            start = None
        if kind == "sweep" and sum(x.quantity for x in window) >= a and 1 + sum(x.is_step for x in window[1:]) >= b:
            start = None
    return out, start


LIMITS = {
    "volume": lambda a, b: VolumeLimit(a),
    "range": lambda a, b: RangeLimit(a),
    "time": lambda a, b: TimeLimit(a),
    "at_least": lambda a, b: TimeLimit(a, at_least=True),
    "band": lambda a, b: BandLimit(a, b),
    "sweep": lambda a, b: SweepLimit(a, b),
}


def tape(rng, n):
    return pd.DataFrame({
        "seq": np.arange(n) * 3 + 5,
        "ts_us": np.cumsum(rng.integers(0, 4, n)),
        "price_ticks": 80000 + np.cumsum(rng.integers(-1, 2, n)),
        "quantity": rng.integers(1, 8, n),
        "is_break": (rng.random(n) < 0.15).astype(int),
        "is_step": rng.integers(0, 2, n),
    })


def arrays(pdf):
    return {c: pdf[c].to_numpy(dtype=np.int64) for c in pdf.columns}


@pytest.mark.parametrize("kind", list(LIMITS))
def test_slices_agree_with_rows(kind):
    rng = np.random.default_rng(7)
    for _ in range(150):
        n, size = int(rng.integers(1, 90)), int(rng.integers(1, 30))
        a, b = int(rng.integers(1, 25)), int(rng.integers(1, 5))
        pdf = tape(rng, n)
        limit = LIMITS[kind](a, b)
        starts, _ = by_rows(kind, list(pdf.itertuples(index=False)), a, b)
        entry, functions = None, []
        for s in range(0, n, size):
            part = {c: x[s:s + size] for c, x in arrays(pdf).items()}
            length = len(part["seq"])
            at = 0
            if entry is not None and entry[0][0] != FRESH:
                first, gathered = limit.openings(part)
                hit = np.flatnonzero(limit.ends([int(x[0]) for x in entry[1:]], gathered))
                at = int(first[hit[0]]) if len(hit) else length
                assert starts[s:s + at] == [(entry[0][0] - 5) // 3] * at
            nxt = limit.next_start(part)
            while at < length:
                stop = min(int(nxt[at]), length)
                assert starts[s + at:s + stop] == [s + at] * (stop - at)
                at = stop
            f = summary(limit, part)
            if entry is None:
                entry = [np.array([x]) for x in [FRESH] + [0] * len(f.whole)]
            entry = after(limit, entry, f)
            functions.append(f)
        # the tree leads from the start to the same end, from every opening too
        whole = composed_all(limit, functions)
        assert whole.fresh == [int(x[0]) for x in entry]


@pytest.mark.parametrize("kind", list(LIMITS))
def test_composition_is_the_function_of_both(kind):
    """Any state that rows before can leave behind goes through the tree as it goes through the slices."""
    rng = np.random.default_rng(11)
    for _ in range(120):
        n, size = int(rng.integers(2, 120)), int(rng.integers(1, 20))
        limit = LIMITS[kind](int(rng.integers(1, 60)), int(rng.integers(1, 6)))
        rows = arrays(tape(rng, n))
        cut = int(rng.integers(1, n))
        before = {c: x[:cut] for c, x in rows.items()}
        functions = [summary(limit, {c: x[s:min(s + size, n)] for c, x in rows.items()}) for s in range(cut, n, size)]
        states = limit.states(before)
        reach = limit.next_start(before) > cut - 0  # windows begun at these rows are still open, or end before they go on
        at = np.flatnonzero(reach & (np.arange(cut) >= 0))
        if not len(at):
            continue
        entry = [before["seq"][at], *(m[at] for m in states)]
        one = entry
        for f in functions:
            one = after(limit, one, f)
        tree = after(limit, entry, composed_all(limit, functions))
        assert all((a == b).all() for a, b in zip(one, tree))


def test_nodes_keep_what_one_window_can_reach():
    """A node of many slices has no more openings than rows in a window, and one where windows soon agree has few."""
    rng = np.random.default_rng(3)
    rows = arrays(tape(rng, 4000))
    parts = [{c: x[s:s + 50] for c, x in rows.items()} for s in range(0, 4000, 50)]
    wide = composed_all(VolumeLimit(2000), [summary(VolumeLimit(2000), p) for p in parts])
    assert len(wide.leads[0]) <= 2000
    narrow = composed_all(VolumeLimit(10), [summary(VolumeLimit(10), p) for p in parts])
    assert len(narrow.leads[0]) <= 10


def test_states_of_a_long_slice_in_linear_time():
    n = 262_144
    rows = arrays(tape(np.random.default_rng(5), n))
    f = summary(VolumeLimit(10 ** 9), rows)  # nothing ends: every row could be the last
    assert len(f.leads[0]) == n
    both = composed_all(VolumeLimit(10 ** 9), [f] * 4)
    assert both.whole == [4 * f.whole[0]] and len(both.leads[0]) == 4 * n


@pytest.mark.parametrize("kind", list(LIMITS))
def test_several_levels_in_spark(spark, kind, monkeypatch):
    monkeypatch.setattr(resets, "FAN", 2)
    rng = np.random.default_rng(13)
    frames, expected = [], {}
    for key, n in (("a", 700), ("b", 90), ("c", 1)):
        pdf = tape(rng, n)
        a, b = 40, 3
        starts, _ = by_rows(kind, list(pdf.itertuples(index=False)), a, b)
        expected |= {(key, int(q)): int(pdf["seq"][s]) for q, s in zip(pdf["seq"], starts)}
        frames.append(pdf.assign(name=key))
    df = spark.createDataFrame(pd.concat(frames))
    got = {(r.name, r.seq): r.bar_id for r in restarting(df, ["name"], LIMITS[kind](a, b), rows=32).select("name", "seq", "bar_id").collect()}
    assert got == expected


@pytest.mark.parametrize("turn", [37, 160, 1])
@pytest.mark.parametrize("kind", ["time", "at_least", "band"])
def test_clocks_that_go_back(spark, kind, turn, monkeypatch):
    """Laps over the same times, shorter and longer than a slice, and a clock in no order at all."""
    monkeypatch.setattr(resets, "FAN", 2)
    rng = np.random.default_rng(turn)
    frames, expected = [], {}
    for key, n in (("a", 700), ("b", 90), ("c", 1)):
        pdf = tape(rng, n)
        ts = pdf["ts_us"].to_numpy()
        pdf["ts_us"] = ts[np.arange(n) % turn] if turn > 1 and n > turn else rng.permutation(ts)
        a, b = 40, 3
        starts, _ = by_rows(kind, list(pdf.itertuples(index=False)), a, b)
        expected |= {(key, int(q)): int(pdf["seq"][s]) for q, s in zip(pdf["seq"], starts)}
        frames.append(pdf.assign(name=key))
    df = spark.createDataFrame(pd.concat(frames))
    got = {(r.name, r.seq): r.bar_id for r in restarting(df, ["name"], LIMITS[kind](a, b), rows=32).select("name", "seq", "bar_id").collect()}
    assert got == expected


def test_a_clock_that_goes_back_by_whole_slices(spark):
    """Each slice in order, every one before the slice ahead of it."""
    pdf = pd.DataFrame({"seq": np.arange(96), "ts_us": np.concatenate([np.arange(32) + at for at in (200, 100, 0)]), "name": "a"})
    starts, _ = by_rows("time", list(pdf.assign(price_ticks=0, quantity=0).itertuples(index=False)), 10, 0)
    got = restarting(spark.createDataFrame(pdf), ["name"], TimeLimit(10), rows=32).orderBy("seq").collect()
    assert [r.bar_id for r in got] == starts
