"""Order statements against event-by-event evaluation."""

import random
import time

from tickloom import schema as S
from tickloom.operators.orders import GONE, after_all, applied, composed, last_states, mbo_orders, statement


def random_events(rng, n):
    return [
        (rng.choices([S.ADD, S.MODIFY, S.CANCEL, S.EXECUTE], [3, 2, 1, 5])[0], rng.choice([1, 2]), rng.choice([10, 11, 12]), rng.randrange(-1, 7), i + 1)
        for i in range(n)
    ]


def test_statements_for_every_entry_state():
    rng = random.Random(1)
    for _ in range(400):
        events = random_events(rng, rng.randrange(1, 25))
        gone, _ = last_states(events)
        assert gone == [after_all(GONE, events[i:]) for i in range(len(events) + 1)]
        s = statement(events)
        for state in [GONE] + [(side, price, size, -7) for side in (1, 2) for price in (10, 11, 13) for size in (1, 2, 3, 5, 9, 30)]:
            assert composed(state, s) == after_all(state, events)


def test_many_events_of_one_order_in_one_slice():
    n = 262_144
    for events in (
        [(S.EXECUTE, 1, 10, 1, i) for i in range(n)],
        [((S.ADD, S.EXECUTE)[i % 2], 1, 10, 1 + i % 3, i) for i in range(n)],
        [(S.MODIFY, 1, 10 + i % 2, 5, i) for i in range(n)],
    ):
        start = time.perf_counter()
        s = statement(events)
        assert composed((1, 10, 7, 0), s) == after_all((1, 10, 7, 0), events)
        assert time.perf_counter() - start < 8


def test_orders_over_slices(spark):
    """One order with a third of all events, over many slices, besides short-lived ones."""
    rng = random.Random(2)
    rows, want = [], []
    lives: dict = {}
    for seq in range(3000):
        order = 7 if rng.random() < 0.35 else 100 + seq // 12
        kind, side, price, quantity, _ = random_events(rng, 1)[0]
        rows.append((1, seq, kind, order, side, price, quantity))
        state, outcome = applied(lives.get(order, GONE), (kind, side, price, quantity, seq))
        lives[order] = state
        want.append((order, seq, outcome, *state))
    df = spark.createDataFrame(rows, "instrument_id int, seq bigint, type int, order_id bigint, side int, price_ticks bigint, quantity bigint")
    got = mbo_orders(df).select("order_id", "from_seq", "outcome", "side", "price_ticks", "size", "priority_seq").collect()
    assert sorted(map(tuple, got)) == sorted(want)
