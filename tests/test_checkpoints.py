"""Book checkpoints: a level goes no further than the next reset."""

from pyspark.sql import functions as F

from tests.test_fixtures import tape
from tickloom.operators import book as k


def test_spans_end_at_resets(spark):
    # a clear every 50 events; each price is quoted once and never again
    rows = [(n, 10 if n % 50 == 49 else 6 + n % 2, 1000 + n, 5, "U") for n in range(1000)]
    events = k.book_rows(tape(spark, rows))
    spans, _ = k.standing_spans(events, 10)
    made = k.snapshots(events, 10)
    told = {(r._slice, r.price_ticks) for r in made.collect()}
    assert told == {(s, 1000 + n) for s in range(100) for n in range(s * 10 // 50 * 50, s * 10)}
    assert spans.agg(F.sum(F.col("_until") - F.col("_n"))).first()[0] == len(told)
