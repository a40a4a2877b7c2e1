"""Bar builders as table functions, callable from SQL text.

``SELECT * FROM tick_bars(50, TABLE(prints) PARTITION BY instrument_id ORDER BY seq)``

A partition is cut into bars as it streams by in Arrow batches; only the bar
still open is carried from one batch to the next.  One partition is one task:
for a whole tape use ``tickloom.operators.bars``, which slices instruments, or
partition by session as well.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.functions import arrow_udtf

from tickloom import schema as S
from tickloom.plans.resets import FRESH, RangeLimit, VolumeLimit, _mark

COLUMNS = ("bar_id", "start_us", "end_us", "open", "high", "low", "close", "volume", "buy", "sell", "trades", "first_seq", "last_seq")
RETURNS = "instrument_id int, " + ", ".join(f"{c} bigint" for c in COLUMNS) + ", is_closed boolean"
#: How two parts of one bar become one; the others keep what the first part says.
JOINED = {
    "end_us": lambda a, b: b, "high": max, "low": min, "close": lambda a, b: b, "last_seq": lambda a, b: b,
    **{c: (lambda a, b: a + b) for c in ("volume", "buy", "sell", "trades")},
}


def parts_of(start: np.ndarray, rows: dict[str, np.ndarray]) -> list[dict[str, int]]:
    """The bars of ordered rows, told apart by the sequence they start at."""
    at = np.flatnonzero(np.concatenate([[True], start[1:] != start[:-1]]))
    last = np.concatenate([at[1:], [len(start)]]) - 1
    quantity, price = rows["quantity"], rows["price_ticks"]
    columns = {
        "bar_id": start[at], "start_us": rows["ts_us"][at], "end_us": rows["ts_us"][last], "open": price[at],
        "high": np.maximum.reduceat(price, at), "low": np.minimum.reduceat(price, at), "close": price[last],
        "volume": np.add.reduceat(quantity, at),
        "buy": np.add.reduceat(np.where(rows["aggressor"] == S.BUY, quantity, 0), at),
        "sell": np.add.reduceat(np.where(rows["aggressor"] == S.SELL, quantity, 0), at),
        "trades": last - at + 1, "first_seq": rows["seq"][at], "last_seq": rows["seq"][last],
    }
    return [dict(zip(columns, map(int, values))) for values in zip(*columns.values())]


class BarBuilder:
    """Cuts one partition; ``limit_of`` and ``measures`` say what fills a bar."""

    @staticmethod
    def limit_of(size: int):
        return VolumeLimit(size)

    @staticmethod
    def measures(bar: dict[str, int]) -> list[int]:
        return [bar["volume"]]

    def __init__(self):
        self.instrument: int | None = None
        self.limit, self.bar = None, None

    def is_full(self, bar: dict[str, int]) -> bool:
        return self.measures(bar)[0] >= self.limit.limit

    def weights(self, rows: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
        return rows

    def eval(self, size: pa.Array, batch: pa.RecordBatch) -> Iterator[pa.Table]:
        if not batch.num_rows:
            return
        if self.limit is None:
            self.limit = self.limit_of(size[0].as_py())
        self.instrument = batch["instrument_id"][0].as_py()
        rows = {c: batch[c].to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seq", "ts_us", "price_ticks", "quantity", "aggressor")}
        entry = [FRESH] if self.bar is None else [self.bar["bar_id"], *self.measures(self.bar)]
        bars = parts_of(_mark(self.limit, self.weights(rows), entry), rows)
        if self.bar is not None:
            if bars[0]["bar_id"] == self.bar["bar_id"]:
                bars[0] = {c: JOINED[c](self.bar[c], v) if c in JOINED else self.bar[c] for c, v in bars[0].items()}
            else:
                bars.insert(0, self.bar)
        self.bar = None if self.is_full(bars[-1]) else bars.pop()
        if bars:
            yield self.table(bars, True)

    def terminate(self) -> Iterator[pa.Table]:
        if self.bar is not None:
            yield self.table([self.bar], False)

    def table(self, bars: list[dict[str, int]], is_closed: bool) -> pa.Table:
        columns = {"instrument_id": pa.array([self.instrument] * len(bars), pa.int32())}
        columns |= {c: pa.array([b[c] for b in bars], pa.int64()) for c in COLUMNS}
        return pa.table(columns | {"is_closed": pa.array([is_closed] * len(bars))})


@arrow_udtf(returnType=RETURNS)
class VolumeBars(BarBuilder):
    pass


@arrow_udtf(returnType=RETURNS)
class TickBars(BarBuilder):
    @staticmethod
    def measures(bar):
        return [bar["trades"]]

    def weights(self, rows):
        return rows | {"quantity": np.ones(len(rows["seq"]), dtype=np.int64)}


@arrow_udtf(returnType=RETURNS)
class RangeBars(BarBuilder):
    @staticmethod
    def limit_of(size):
        return RangeLimit(size)

    @staticmethod
    def measures(bar):
        return [bar["high"], bar["low"]]

    def is_full(self, bar):
        return bar["high"] - bar["low"] >= self.limit.limit


#: Name in SQL -> table function.
TABLE_FUNCTIONS = {"tick_bars": TickBars, "volume_bars": VolumeBars, "range_bars": RangeBars}


def register_table_functions(spark: SparkSession) -> list[str]:
    """Make the builders callable from the SQL of this session; returns their names."""
    for name, function in TABLE_FUNCTIONS.items():
        spark.udtf.register(name, function)
    return sorted(TABLE_FUNCTIONS)
