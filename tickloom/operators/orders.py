"""Order-by-order books.

An order's state depends on everything that happened to it, but only through
its side, price, size and queue position.  Each slice of the tape states, per
order, what it does to an order arriving unknown and to one arriving alive;
these short statements are composed in order, then every slice is evaluated
from its known entry states.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import groupby

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.plans import count_, first_, materialize, running
from tickloom.plans.grouped import grouped_map
from tickloom.plans.scan import slice_of, slice_rows

GONE = (0, 0, 0, 0)  # side, price, size, priority
KEPT = -2  # taken over from the entry state
ORDER = ["epoch", "order_id"]


def applied(state: tuple, event: tuple) -> tuple[tuple, str]:
    """State of an order after an event (type, side, price, quantity, seq), and what happened."""
    kind, side, price, quantity, seq = event
    alive = state[2] > 0
    if kind == S.ADD:
        if quantity <= 0:
            return state, "ignored"
        return (state, "duplicate") if alive else ((side, price, quantity, seq), "changed")
    if not alive:
        return state, "unknown"
    if kind == S.CANCEL:
        return GONE, "changed"
    if kind == S.MODIFY:
        if quantity <= 0:
            return GONE, "changed"
        if price != state[1]:
            return (side, price, quantity, seq), "changed"
        return (state[0], price, quantity, state[3]), "changed"
    left = state[2] - min(quantity if quantity > 0 else state[2], state[2])
    return (GONE if left <= 0 else (state[0], state[1], left, state[3])), "changed"


def after_all(state: tuple, events: list[tuple]) -> tuple:
    for event in events:
        state, _ = applied(state, event)
    return state


def is_final(event: tuple) -> bool:
    """Whether an event sets the size of a live order whatever it was: a cancel, a modification, an execution of all."""
    return event[0] in (S.CANCEL, S.MODIFY) or (event[0] == S.EXECUTE and event[3] <= 0)


def _resolved(state: tuple, side: int, priority: int) -> tuple:
    """``state`` with what it takes over from its entry filled in."""
    return (side if state[0] == KEPT else state[0], state[1], state[2], priority if state[3] == KEPT else state[3])


def last_states(events: list[tuple]) -> tuple[list[tuple], dict[int, tuple]]:
    """Where an order ends, in one pass from the back.

    The first result gives, per place, the state at the end of an order that is
    gone before the event there; the second, per modification, that of an order
    just modified, its side and priority ``KEPT``.  A live order meets next
    either the execution that fills it, found by binary search in the sums of
    executions, or the next final event; both lead to states already known.
    """
    n = len(events)
    filled = [0] * (n + 1)  # executed before each place
    for i, e in enumerate(events):
        filled[i + 1] = filled[i] + (e[3] if e[0] == S.EXECUTE and e[3] > 0 else 0)
    gone: list[tuple] = [GONE] * (n + 1)
    modified: dict[int, tuple] = {}
    final = n  # next final event

    def onward(side: int, price: int, size: int, priority: int, at: int) -> tuple:
        """End of an order alive before place ``at``."""
        done = bisect_left(filled, filled[at] + size, at, final + 1)
        if done <= final:  # filled by the event before ``done``
            return gone[done]
        if final == n:
            return (side, price, size - (filled[n] - filled[at]), priority)
        kind, new_side, new_price, quantity, seq = events[final]
        if kind != S.MODIFY or quantity <= 0:
            return gone[final + 1]
        return _resolved(modified[final], *((side, priority) if new_price == price else (new_side, seq)))

    for i in range(n - 1, -1, -1):
        kind, side, price, quantity, seq = events[i]
        gone[i] = onward(side, price, quantity, seq, i + 1) if kind == S.ADD and quantity > 0 else gone[i + 1]
        if kind == S.MODIFY and quantity > 0:
            modified[i] = onward(KEPT, price, quantity, KEPT, i + 1)
        if is_final(events[i]):
            final = i
    return gone, modified


def statement(events: list[tuple]) -> dict:
    """What a stretch of events does to an order, for every possible entry state."""
    gone, modified = last_states(events)
    head = next((i for i, e in enumerate(events) if is_final(e)), len(events))
    filled, thresholds, leads = 0, [], []
    for i, e in enumerate(events[:head]):
        if e[0] == S.EXECUTE:
            filled += e[3]
            if leads and leads[-1] == gone[i + 1]:  # fills that lead to one end act as the last of them
                thresholds[-1] = filled
            else:
                thresholds.append(filled)
                leads.append(gone[i + 1])
    out = {
        "unknown": list(gone[0]), "thresholds": thresholds, "leads": [list(x) for x in leads],
        "filled": filled, "price": -1, "same": None, "other": None,
    }
    if head < len(events):
        kind, side, price, quantity, seq = events[head]
        if kind == S.MODIFY and quantity > 0:
            out["price"] = price
            out["same"] = list(modified[head])
            out["other"] = list(_resolved(modified[head], side, seq))
        else:
            out["same"] = out["other"] = list(gone[head + 1])
    return out


def composed(state: tuple, s: dict) -> tuple:
    """State after a stretch described by its statement."""
    if state[2] <= 0:
        return tuple(int(x) for x in s["unknown"])
    hit = bisect_left(s["thresholds"], state[2])
    if hit < len(s["thresholds"]):
        return tuple(int(x) for x in s["leads"][hit])
    if s["same"] is None:
        return (state[0], state[1], state[2] - int(s["filled"]), state[3])
    end = tuple(int(x) for x in (s["same"] if state[1] == s["price"] else s["other"]))
    return _resolved(end, state[0], state[3])


def _by_order(pdf: pd.DataFrame, *extra: str):
    """(epoch, order id, extra values, events) of each order of a slice."""
    columns = [pdf[c].tolist() for c in (*ORDER, *extra, "type", "side", "price_ticks", "quantity", "seq")]
    width = len(ORDER) + len(extra)
    for (epoch, order), rows in groupby(zip(*columns), key=lambda row: row[:2]):
        rows = list(rows)
        yield epoch, order, rows[0][2:width], [row[width:] for row in rows]


def mbo_orders(df: DataFrame) -> DataFrame:
    """Lifecycle of every order.

    Rows with ``outcome='changed'`` give the order's side, price, size and queue
    priority from ``from_seq`` until ``to_seq`` (size 0: gone).  Repeated adds and
    events of unknown orders appear with their own outcome.
    """
    resets = F.col("type").isin(S.SNAPSHOT_START, S.BOOK_CLEAR)
    wanted = df.where(resets | F.col("type").isin(S.ADD, S.MODIFY, S.CANCEL, S.EXECUTE)).select(
        S.KEY, "seq", "type", "side", "price_ticks", "quantity", "order_id"
    )
    rows = running(wanted, [S.KEY], epoch=count_(resets))
    events = rows.where(~resets).withColumn("_slice", slice_of("seq", slice_rows(df.sparkSession)))
    part = [S.KEY, "_slice"]
    full = [S.KEY, *ORDER, "_slice"]
    head = "instrument_id int, epoch bigint, order_id bigint, _slice bigint"

    def state_slice(pdf: pd.DataFrame) -> pd.DataFrame:
        instrument, at = pdf[S.KEY].iloc[0], pdf["_slice"].iloc[0]
        return pd.DataFrame(
            [
                {S.KEY: instrument, "epoch": epoch, "order_id": order, "_slice": at, **statement(events)}
                for epoch, order, _, events in _by_order(pdf)
            ]
        )

    statements = grouped_map(
        events, part, [*ORDER, "seq"], state_slice,
        f"{head}, unknown array<bigint>, thresholds array<bigint>, leads array<array<bigint>>, filled bigint, "
        "price bigint, same array<bigint>, other array<bigint>",
    )

    def compose(batches):
        """Entry state of every statement; rows of an order follow one another, whatever batch they come in."""
        order, state = None, GONE
        for pdf in batches:
            entries = []
            for s in pdf.to_dict("records"):
                this = (s[S.KEY], s["epoch"], s["order_id"])
                if this != order:
                    order, state = this, GONE
                entries.append(list(state))
                state = composed(state, s)
            made = pdf[full].copy()
            made["_entry"] = entries
            yield made

    dealt = statements.repartition(S.KEY, *ORDER).sortWithinPartitions(*full)
    entries = dealt.mapInPandas(compose, f"{head}, _entry array<bigint>")

    def evaluate(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for epoch, order, (entry,), events in _by_order(pdf, "_entry"):
            state = tuple(int(x) for x in entry)
            for event in events:
                state, outcome = applied(state, event)
                out.append((epoch, order, event[4], outcome, *state))
        made = pd.DataFrame(
            out, columns=[*ORDER, "from_seq", "outcome", "side", "price_ticks", "size", "priority_seq"]
        )
        made.insert(0, S.KEY, pdf[S.KEY].iloc[0])
        return made

    changes = grouped_map(
        events.join(entries, full), part, [*ORDER, "seq"], evaluate,
        "instrument_id int, epoch bigint, order_id bigint, from_seq bigint, outcome string, side int, "
        "price_ticks bigint, size bigint, priority_seq bigint",
    )
    changes = materialize(changes, "order-changes")
    changed = F.when(F.col("outcome") == "changed", F.col("from_seq"))
    chained = running(changes, [S.KEY, *ORDER], order="from_seq", to_seq=first_(changed, exclusive=True))
    ends = rows.where(resets).select(S.KEY, (F.col("epoch") - 1).alias("epoch"), F.col("seq").alias("_reset"))
    return chained.join(ends, [S.KEY, "epoch"], "left").withColumn("to_seq", F.coalesce("to_seq", "_reset")).drop("_reset")


def _live(orders: DataFrame, at: int) -> DataFrame:
    return orders.where(
        (F.col("outcome") == "changed") & (F.col("size") > 0) & (F.col("from_seq") <= at)
        & (F.col("to_seq").isNull() | (F.col("to_seq") > at))
    )


def mbo_levels(orders: DataFrame, at: int) -> DataFrame:
    """Size and number of orders per level as of sequence ``at``."""
    return _live(orders, at).groupBy(S.KEY, "side", "price_ticks").agg(
        F.sum("size").alias("size"), F.count(F.lit(1)).alias("orders")
    )


def mbo_queue(orders: DataFrame, at: int) -> DataFrame:
    """Orders of each level in queue order as of ``at``."""
    queue = Window.partitionBy(S.KEY, "side", "price_ticks").orderBy("priority_seq")
    return _live(orders, at).select(
        S.KEY, "side", "price_ticks", F.row_number().over(queue).cast("long").alias("position"), "order_id", "size", "priority_seq"
    )


def mbo_diagnostics(orders: DataFrame, df: DataFrame) -> DataFrame:
    """Unknown-order and repeated-add counts, and whether a gap is still unresolved."""
    counts = orders.groupBy(S.KEY).agg(
        F.count_if(F.col("outcome") == "unknown").alias("unknown_orders"),
        F.count_if(F.col("outcome") == "duplicate").alias("duplicate_adds"),
    )
    held = df.where(F.col("type").isin(S.SNAPSHOT_START, S.SNAPSHOT_END, S.BOOK_CLEAR, S.SEQUENCE_GAP)).groupBy(S.KEY).agg(
        F.max_by("type", "seq").alias("_last")
    )
    return counts.join(held, S.KEY, "left").select(
        S.KEY, "unknown_orders", "duplicate_adds",
        F.when(F.col("_last") == S.SEQUENCE_GAP, "sequence gap")
        .when(F.col("_last") == S.SNAPSHOT_START, "rebuilding from snapshot").alias("held_reason"),
    )
