"""Accumulators that restart: bars by volume or range, detector windows.

Where such a window ends depends on where it began, so neither a SQL window nor
a division of a running sum can say it, and one task per instrument would not
scale.  Each slice of a key is therefore summarised as a function from the
state it is entered with to the state it is left with:

* the *openings*: the rows at which a window carried in could end, what has
  been gathered up to each of them, and the state each of them leads to;
* what the whole slice gathers, for a window that runs through it.

Functions of neighbouring slices compose into the function of both, so they
form a tree: ``FAN`` neighbours become one node, level by level, until a key
has no more than ``FAN`` nodes.  The known state at the start of the tape is
then handed down the tree, and every slice is marked in parallel from its now
known entry state.  Openings leading to the same state are merged, and those no
window can reach any more are left out, so a node has at most as many openings
as there are rows in one window, mostly a handful; a task holds ``FAN`` nodes
of a key, however long the tape.  The result is exact in every case.
"""

from __future__ import annotations

from collections.abc import Sequence
from copy import copy

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.grouped import edges, grouped_map
from tickloom.plans.materialize import materialize, temporary_tables
from tickloom.plans.scan import slice_of, slice_rows, spread_over_tasks, whole

FRESH = -1  # no window open
FAN = 8  # neighbours that become one node of the tree
FAR = 1 << 61


Columns = dict[str, np.ndarray]  # the rows of one series, in order


def _extent(fits, price: np.ndarray) -> np.ndarray:
    """Per start, the first row at which high - low of the rows so far no longer fits (n: none)."""
    n = len(price)
    highs, lows = [price], [price]
    while 2 << (len(highs) - 1) <= n:
        span = 1 << (len(highs) - 1)
        highs.append(np.maximum(highs[-1][:-span], highs[-1][span:]))
        lows.append(np.minimum(lows[-1][:-span], lows[-1][span:]))
    at, high, low = np.arange(n), price.copy(), price.copy()
    for level in range(len(highs) - 1, -1, -1):
        span = 1 << level
        can = np.flatnonzero(at + span <= n)
        up = np.maximum(high[can], highs[level][at[can]])
        down = np.minimum(low[can], lows[level][at[can]])
        ok = fits(up - down)
        grown = can[ok]
        high[grown], low[grown] = up[ok], down[ok]
        at[grown] += span
    return at


def _later(ts: np.ndarray, reach: int) -> np.ndarray:
    """Per start, the first row behind it more than ``reach`` later (n: none); clocks may go back."""
    if (ts[1:] >= ts[:-1]).all():
        return np.searchsorted(ts, ts + reach, side="right")
    tops = [ts]
    while 2 << (len(tops) - 1) <= len(ts):
        span = 1 << (len(tops) - 1)
        tops.append(np.maximum(tops[-1][:-span], tops[-1][span:]))
    at = np.arange(len(ts))
    for level in range(len(tops) - 1, -1, -1):
        can = np.flatnonzero(at + (1 << level) <= len(ts))
        at[can[tops[level][at[can]] <= ts[can] + reach]] += 1 << level
    return at


def _suffix_sum(values: np.ndarray) -> np.ndarray:
    """Sum from each row to the last."""
    return np.cumsum(values[::-1])[::-1]


def _suffix_extremes(values: np.ndarray) -> list[np.ndarray]:
    return [f.accumulate(values[::-1])[::-1] for f in (np.maximum, np.minimum)]


# A limit tells where the next window starts (``next_start``), which rows can end a window carried in and what is gathered up
# to them (``openings``), what a window begun at each row has gathered by the end (``states``), and how a state grows over a
# slice (``through``), over a slice and a part of the next (``extend``), and at the least (``weakest``: of a window that runs
# into a slice nothing is known but that). ``ends`` tells which openings end a state; once one does, all later ones do.
# Limits by time leave out openings behind the first that ends every window begun no later than the slice. Where the clock of
# a series goes back (``goes_back``), a window may have begun later than that; then none is left out.

class VolumeLimit:
    """Ends with the row that brings the volume to ``limit``; the excess is not carried."""

    columns = ("quantity",)

    def __init__(self, limit: int):
        self.limit = int(limit)

    def next_start(self, rows):
        total = np.concatenate([[0], np.cumsum(rows["quantity"])])
        return np.searchsorted(total[1:], total[:-1] + self.limit, side="left") + 1

    def openings(self, rows):
        total = np.cumsum(rows["quantity"])
        at = np.arange(min(len(total), int(np.searchsorted(total, self.limit)) + 1))
        return at + 1, [total[at]]

    def states(self, rows):
        return [_suffix_sum(rows["quantity"])]

    def through(self, entry, whole):
        return [entry[0] + whole[0]]

    def extend(self, whole, gathered):
        return self.through(whole, gathered)

    def weakest(self, whole):
        return [0]

    def ends(self, entry, gathered):
        return entry[0] + gathered[0] >= self.limit


class RangeLimit:
    """Ends with the row that brings high - low to ``limit``."""

    columns = ("price_ticks",)

    def __init__(self, limit: int):
        self.limit = int(limit)

    def next_start(self, rows):
        return _extent(lambda spread: spread < self.limit, rows["price_ticks"]) + 1

    def openings(self, rows):
        price = rows["price_ticks"]
        high, low = np.maximum.accumulate(price), np.minimum.accumulate(price)
        new = np.concatenate([[True], (np.diff(high) != 0) | (np.diff(low) != 0)])
        at = np.flatnonzero(new[: int(np.searchsorted(high - low, self.limit)) + 1])
        return at + 1, [high[at], low[at]]

    def states(self, rows):
        return _suffix_extremes(rows["price_ticks"])

    def through(self, entry, whole):
        return [np.maximum(entry[0], whole[0]), np.minimum(entry[1], whole[1])]

    def extend(self, whole, gathered):
        return self.through(whole, gathered)

    def weakest(self, whole):
        return [-FAR, FAR]

    def ends(self, entry, gathered):
        return np.maximum(entry[0], gathered[0]) - np.minimum(entry[1], gathered[1]) >= self.limit


class TimeLimit:
    """The next window starts with the first row more than (or at least) ``width_us`` after the start."""

    columns = ("ts_us",)
    goes_back = False

    def __init__(self, width_us: int, at_least: bool = False):
        self.reach = int(width_us) - (1 if at_least else 0)

    def next_start(self, rows):
        nxt = _later(rows["ts_us"], self.reach)
        return np.where(nxt < len(nxt), nxt, len(nxt) + 1)

    def openings(self, rows):
        ts = rows["ts_us"]
        if self.goes_back:
            top = np.maximum.accumulate(ts)
            at = np.flatnonzero(np.concatenate([[True], np.diff(top) != 0]))
            return at, [top[at]]
        at = np.arange(min(len(ts), int(np.searchsorted(ts, ts[0] + self.reach, side="right")) + 1))
        return at, [ts[at]]

    def states(self, rows):
        return [rows["ts_us"]]

    def through(self, entry, whole):
        return entry

    def both(self, whole, other):
        return [max(whole[0], other[0])] if self.goes_back else whole

    def extend(self, whole, gathered):
        return [np.maximum(whole[0], gathered[0])]

    def weakest(self, whole):
        return [FAR] if self.goes_back else whole

    def ends(self, entry, gathered):
        return gathered[0] - entry[0] > self.reach


class BandLimit:
    """The next window starts when time runs out or the price leaves a band of ``ticks``."""

    columns = ("ts_us", "price_ticks")
    goes_back = False

    def __init__(self, width_us: int, ticks: int):
        self.width, self.ticks = int(width_us), int(ticks)

    def next_start(self, rows):
        ts = rows["ts_us"]
        late = _later(ts, self.width)
        far = _extent(lambda spread: spread <= self.ticks, rows["price_ticks"])
        nxt = np.minimum(late, far)
        return np.where(nxt < len(ts), nxt, len(ts) + 1)

    def openings(self, rows):
        ts, price = rows["ts_us"], rows["price_ticks"]
        high, low = np.maximum.accumulate(price), np.minimum.accumulate(price)
        if self.goes_back:
            top = np.maximum.accumulate(ts)
            at = np.flatnonzero(np.concatenate([[True], (np.diff(top) != 0) | (np.diff(high) != 0) | (np.diff(low) != 0)]))
            return at, [top[at], high[at], low[at]]
        surely = (ts - ts[0] > self.width) | (high - low > self.ticks)
        at = np.arange(int(np.argmax(surely)) + 1 if surely.any() else len(ts))
        return at, [ts[at], high[at], low[at]]

    def states(self, rows):
        return [rows["ts_us"], *_suffix_extremes(rows["price_ticks"])]

    def through(self, entry, whole):
        return [entry[0], np.maximum(entry[1], whole[1]), np.minimum(entry[2], whole[2])]

    def both(self, whole, other):
        return [max(whole[0], other[0]) if self.goes_back else whole[0], *self.through(whole, other)[1:]]

    def extend(self, whole, gathered):
        return [np.maximum(whole[0], gathered[0]), *self.through(whole, gathered)[1:]]

    def weakest(self, whole):
        return [FAR if self.goes_back else whole[0], -FAR, FAR]

    def ends(self, entry, gathered):
        spread = np.maximum(entry[1], gathered[1]) - np.minimum(entry[2], gathered[2])
        return (gathered[0] - entry[0] > self.width) | (spread > self.ticks)


class SweepLimit:
    """Ends with the row reaching both a volume and a number of price levels, or before a break.

    ``is_break`` marks rows that cannot continue the run of the row before;
    ``is_step`` marks rows at another price than the row before.
    """

    columns = ("quantity", "is_break", "is_step")
    AHEAD = 1 << 60

    def __init__(self, volume: int, levels: int):
        self.volume, self.levels = int(volume), int(levels)

    def next_start(self, rows):
        n = len(rows["seq"])
        total = np.concatenate([[0], np.cumsum(rows["quantity"])])
        steps = np.cumsum(rows["is_step"])
        by_volume = np.searchsorted(total[1:], total[:-1] + self.volume, side="left")
        by_levels = np.searchsorted(steps, steps + self.levels - 1, side="left")
        # a window needs at least two rows to be a run
        done = np.maximum(np.maximum(by_volume, by_levels), np.arange(n) + 1)
        breaks = np.append(np.flatnonzero(rows["is_break"]), n + 1)
        broken = breaks[np.searchsorted(breaks, np.arange(n), side="right")]
        return np.where(done < n, np.minimum(done + 1, broken), broken)

    def openings(self, rows):
        breaks = np.flatnonzero(rows["is_break"])
        first = int(breaks[0]) if len(breaks) else len(rows["seq"])
        total = np.cumsum(rows["quantity"])[:first]
        steps = np.cumsum(rows["is_step"])[:first]
        surely = (total >= self.volume) & (steps >= self.levels)
        if surely.any():
            at = np.arange(int(np.argmax(surely)) + 1)
            return at + 1, [total[at], steps[at]]
        starts = np.arange(first) + 1
        if len(breaks):
            starts = np.append(starts, first)
            total, steps = np.append(total, self.AHEAD), np.append(steps, self.AHEAD)
        return starts, [total, steps]

    def states(self, rows):
        # the first row of a window is a level of its own
        return [_suffix_sum(rows["quantity"]), _suffix_sum(rows["is_step"]) - rows["is_step"] + 1]

    def through(self, entry, whole):
        return [entry[0] + whole[0], entry[1] + whole[1]]

    def extend(self, whole, gathered):
        return self.through(whole, gathered)

    def weakest(self, whole):
        return [0, 0]

    def ends(self, entry, gathered):
        return (entry[0] + gathered[0] >= self.volume) & (entry[1] + gathered[1] >= self.levels)


def _exits(limit, rows: Columns) -> np.ndarray:
    """Row where the window left open at the end of the slice began, per possible start (n: none)."""
    n = len(rows["seq"])
    step = np.concatenate([limit.next_start(rows), [n + 1]])
    hop = np.where(step <= n, np.minimum(step, n), np.arange(n + 1))
    while True:
        farther = hop[hop]
        if (farther == hop).all():
            return hop
        hop = farther


@dataclass
class Function:
    """What a slice, or neighbouring slices, do to the state they are entered with: [start seq, measures...]."""

    gathered: list[np.ndarray]  # per measure, by opening
    leads: list[np.ndarray]  # per part of the state, by opening
    whole: list[int]
    fresh: list[int]

    def row(self) -> dict:
        return {"gathered": [x.tolist() for x in self.gathered], "leads": [x.tolist() for x in self.leads], "whole": self.whole, "fresh": self.fresh}

    @classmethod
    def of(cls, row: dict) -> Function:
        whole, fresh = ([int(x) for x in row[c]] for c in ("whole", "fresh"))
        gathered, leads = ([np.asarray(x, dtype=np.int64) for x in row[c]] for c in ("gathered", "leads"))
        return cls(gathered, leads, whole, fresh)


def _merged(gathered: list[np.ndarray], leads: list[np.ndarray]) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Neighbouring openings leading to the same state act as one, the last of them."""
    if not len(leads[0]):
        return gathered, leads
    keep = np.ones(len(leads[0]), dtype=bool)
    keep[:-1] = np.any([x[1:] != x[:-1] for x in leads], axis=0)
    return [g[keep] for g in gathered], [x[keep] for x in leads]


def summary(limit, rows: Columns) -> Function:
    """Function of one slice of one series."""
    seq = rows["seq"]
    n = len(seq)
    exits = _exits(limit, rows)
    starts, gathered = limit.openings(rows)
    measures = limit.states(rows)

    def state(at: np.ndarray) -> list[np.ndarray]:
        inside, safe = at < n, np.minimum(at, n - 1)
        return [np.where(inside, seq[safe], FRESH), *(np.where(inside, m[safe], 0) for m in measures)]

    whole_slice = [int(m[0]) for m in measures]
    if isinstance(limit, SweepLimit):
        whole_slice[1] = int(rows["is_step"].sum())
    if getattr(limit, "goes_back", False):
        whole_slice[0] = int(rows["ts_us"].max())
    gathered, leads = _merged([np.asarray(g, dtype=np.int64) for g in gathered], state(exits[starts]))
    return Function(gathered, leads, whole_slice, [int(x[0]) for x in state(exits[:1])])


def after(limit, entry: list[np.ndarray], f: Function) -> list[np.ndarray]:
    """States (arrays by part) after ``f`` is entered with ``entry``."""
    count, many = len(entry[0]), len(f.leads[0])
    low, high = np.zeros(count, dtype=np.int64), np.full(count, many)
    while (low < high).any():
        middle = (low + high) // 2
        ended = limit.ends(entry[1:], [g[np.minimum(middle, many - 1)] for g in f.gathered])
        going = low < high
        high = np.where(going & ended, middle, high)
        low = np.where(going & ~ended, middle + 1, low)
    passed = [entry[0], *limit.through(entry[1:], f.whole)]
    out = [np.where(low < many, x[np.minimum(low, many - 1)], p) for x, p in zip(f.leads, passed)] if many else passed
    return [np.where(entry[0] == FRESH, x, o).astype(np.int64) for x, o in zip(f.fresh, out)]


def _ends_surely(limit, f: Function) -> bool:
    """Whether no window runs through."""
    return len(f.leads[0]) > 0 and bool(limit.ends(limit.weakest(f.whole), [g[-1] for g in f.gathered]))


def composed(limit, f: Function, g: Function) -> Function:
    """``g`` after ``f``."""
    gathered, leads = f.gathered, after(limit, f.leads, g)
    if not _ends_surely(limit, f) and len(g.leads[0]):
        more = [np.broadcast_to(x, g.leads[0].shape) for x in limit.extend(f.whole, g.gathered)]
        surely = limit.ends(limit.weakest(f.whole), more)
        upto = int(np.argmax(surely)) + 1 if surely.any() else len(surely)
        gathered = [np.concatenate([a, b[:upto]]) for a, b in zip(gathered, more)]
        leads = [np.concatenate([a, b[:upto]]) for a, b in zip(leads, g.leads)]
    gathered, leads = _merged(gathered, leads)
    fresh = after(limit, [np.array([x]) for x in f.fresh], g)
    both = getattr(limit, "both", limit.through)
    return Function(gathered, leads, [int(x) for x in both(f.whole, g.whole)], [int(x[0]) for x in fresh])


def composed_all(limit, functions: list[Function]) -> Function:
    """All of them in order, by halves."""
    if len(functions) == 1:
        return functions[0]
    half = len(functions) // 2
    return composed(limit, composed_all(limit, functions[:half]), composed_all(limit, functions[half:]))


def _series(pdf: pd.DataFrame, within: list[str], columns: Sequence[str]):
    """Each series of a slice: where it lies, and its columns as arrays."""
    arrays = {c: pdf[c].to_numpy(dtype=np.int64) for c in columns}
    for lo, hi in edges(pdf, within):
        yield lo, hi, {c: a[lo:hi] for c, a in arrays.items()}


def _mark(limit, rows: Columns, entry: list[int]) -> np.ndarray:
    """Window ids of one slice of one series, from its entry state."""
    seq = rows["seq"]
    n, at = len(seq), 0
    start = np.empty(n, dtype=np.int64)
    if entry[0] != FRESH:
        starts, gathered = limit.openings(rows)
        hit = np.flatnonzero(limit.ends(entry[1:], gathered))
        at = int(starts[hit[0]]) if len(hit) else n
        start[:at] = entry[0]
    step = limit.next_start(rows)
    while at < n:
        stop = min(int(step[at]), n)
        start[at:stop] = seq[at]
        at = stop
    return start


def restarting(
    df: DataFrame,
    key: Sequence[str],
    limit,
    out: str = "bar_id",
    within: Sequence[str] = (),
    rows: int | None = None,
    initial: DataFrame | None = None,
) -> DataFrame:
    """Give each row the ``seq`` of the first row of its window.

    ``initial`` (key columns, ``_initial`` = [start seq, measures...]) gives windows
    already open before the first row.  The slice functions are worked out at
    once, in jobs of their own; the result is as lazy as any.

    Windows belong to ``key + within``.  A task gets one slice of a ``key`` with
    all its ``within`` values, which suits many small series (price levels)
    sharing a sequence; a slice stays bounded either way.
    """
    key, within = list(key), list(within)
    spark = df.sparkSession
    rows = rows or slice_rows(spark)
    kept = list(df.columns)
    sliced = df.withColumn("_slice", slice_of("seq", rows))
    if within:
        sliced = sliced.withColumn("_spread", spread_over_tasks(spark, within).cast("int"))
    types = {f.name: f.dataType.simpleString() for f in sliced.schema}
    lane = [*key, "_spread"] if within else key
    part, full = [*lane, "_slice"], [*lane, *within, "_slice"]
    head = ", ".join(f"{c} {types[c]}" for c in full)
    used = list(dict.fromkeys(["seq", *limit.columns]))
    timed = "ts_us" in limit.columns
    clock = ", _from bigint, _upto bigint, _back boolean" if timed else ""
    function = "gathered array<array<bigint>>, leads array<array<bigint>>, whole array<bigint>, fresh array<bigint>"

    def clock_of(series: Columns) -> dict:
        if not timed:
            return {}
        ts = series["ts_us"]
        return {"_from": int(ts.min()), "_upto": int(ts.max()), "_back": bool((ts[1:] < ts[:-1]).any())}

    def summarise(pdf: pd.DataFrame) -> pd.DataFrame:
        names = {c: pdf[c].tolist() for c in full}
        return pd.DataFrame(
            [
                {**{c: v[lo] for c, v in names.items()}, **summary(limit, series).row(), **clock_of(series)}
                for lo, _, series in _series(pdf, within, used)
            ]
        )

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        """Nodes of the next level; ``_up`` is their number."""
        records, nodes = pdf.to_dict("records"), []
        for lo, hi in edges(pdf, within):
            node = composed_all(limit, [Function.of(r) for r in records[lo:hi]])
            nodes.append({**{c: records[lo][c] for c in full}, "_slice": records[lo]["_up"], **node.row()})
        return pd.DataFrame(nodes)

    def handed(pdf: pd.DataFrame) -> pd.DataFrame:
        """Entry state of every node, from the one its parent (or the key) is entered with."""
        records, entries = pdf.to_dict("records"), []
        for lo, hi in edges(pdf, within):
            known = records[lo].get("_known")
            measures = len(records[lo]["fresh"])
            entry = [FRESH] + [0] * (measures - 1) if known is None else [int(x) for x in known]
            for row in records[lo:hi]:
                entries.append(entry)
                entry = [int(x[0]) for x in after(limit, [np.array([x]) for x in entry], Function.of(row))]
        made = pdf[full].copy()
        made["_entry"] = entries
        return made

    up = whole("_slice", FAN)

    def leaves() -> DataFrame:
        slim = sliced.select(*dict.fromkeys([*full, *used]))
        return materialize(grouped_map(slim, part, [*within, "seq"], summarise, f"{head}, {function}{clock}"), "windows")

    with temporary_tables(keep_last=True):
        levels = [leaves()]
        before = Window.partitionBy(*lane, *within).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        turned = F.col("_back") | F.coalesce(F.max("_upto").over(before) > F.col("_from"), F.lit(False)) if timed else F.lit(False)
        reach = levels[0].withColumn("_turned", turned).agg(F.max("_slice"), F.min("_slice"), F.max("_turned")).first()
        if reach[2]:
            limit = copy(limit)
            limit.goes_back = True
            levels = [leaves()]
        first, last = (reach[1], reach[0]) if reach[0] is not None else (0, 0)
        while last - first >= FAN:
            grown = levels[-1].withColumn("_up", up)
            nodes = grouped_map(grown, [*lane, "_up"], [*within, "_slice"], joined, f"{head}, {function}")
            levels.append(materialize(nodes, "windows"))
            first, last = first // FAN, last // FAN
        top = levels[-1]
        if initial is not None:
            top = top.join(initial.withColumnRenamed("_initial", "_known"), [*key, *within], "left")
        states = grouped_map(top, lane, [*within, "_slice"], handed, f"{head}, _entry array<bigint>")
        for level in reversed(levels[:-1]):
            parents = states.select(*lane, *within, F.col("_slice").alias("_up"), F.col("_entry").alias("_known"))
            below = level.withColumn("_up", up).join(parents, [*lane, *within, "_up"])
            states = grouped_map(below, [*lane, "_up"], [*within, "_slice"], handed, f"{head}, _entry array<bigint>")
        # one short row per slice; of several levels the functions go
        entries = states if len(levels) == 1 else materialize(states, "entries")

    def mark(pdf: pd.DataFrame) -> pd.DataFrame:
        entry = pdf["_entry"].to_numpy()
        pdf[out] = np.concatenate(
            [_mark(limit, series, [int(x) for x in entry[lo]]) for lo, _, series in _series(pdf, within, used)]
        )
        return pdf[[*kept, out]]

    body = ", ".join(f"{c} {types[c]}" for c in kept)
    return grouped_map(sliced.join(entries, full), part, [*within, "seq"], mark, f"{body}, {out} bigint")
