"""Sums and extremes over a sliding time window.

Rows are first pre-aggregated per (key, microsecond) and numbered, and every
``spark.tickloom.sliceRows`` of them form a block.  A window that ends in one
block begins in the same or in an earlier one, and is put together from three
parts: the end of the block it begins in, the blocks between, of which only
totals are needed, and the beginning of its own block.  Where windows begin
moves on with where they end, so all blocks together meet no more than about
two others each; a task holds one such pair.  No group depends on how many
events a second has or on how wide the window is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.plans.grouped import grouped_map
from tickloom.plans.materialize import materialize
from tickloom.plans.scan import numbered, slice_rows, whole

NOTHING = 1 << 62


class Sum:
    nothing = 0
    pick = np.add

    def __init__(self, values: pd.Series):
        self.values = values.fillna(0).to_numpy(dtype=np.int64)
        self.total = np.concatenate([[0], np.cumsum(self.values)])

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Of each range [low, high)."""
        return self.total[high] - self.total[low]


class Extreme:
    def __init__(self, values: pd.Series):
        self.values = values.fillna(self.nothing).to_numpy(dtype=np.int64)

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """By doubling tables: a range is covered by two overlapping ones of a power of two."""
        some = low < high
        out = np.full(len(low), self.nothing, dtype=np.int64)
        depth = np.frexp(np.where(some, high - low, 1).astype(float))[1] - 1
        table = self.values
        for d in range(int(depth.max()) + 1 if some.any() else 0):
            mine = some & (depth == d)
            out[mine] = self.pick(table[low[mine]], table[high[mine] - (1 << d)])
            if len(table) <= 1 << d:
                break
            table = self.pick(table[: -(1 << d)], table[1 << d:])
        return out


class Max(Extreme):
    nothing = -NOTHING
    pick = np.maximum


class Min(Extreme):
    nothing = NOTHING
    pick = np.minimum


class First:
    """The earliest value there is."""

    nothing = NOTHING

    def __init__(self, values: pd.Series):
        self.values = np.append(values.fillna(0).to_numpy(dtype=np.int64), self.nothing)
        where = np.where(values.notna().to_numpy(), np.arange(len(values)), len(values))
        self.next = np.append(np.minimum.accumulate(where[::-1])[::-1], len(values))

    def over(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        at = self.next[low]
        return np.where(at < high, self.values[at], self.nothing)

    @staticmethod
    def pick(one: np.ndarray, other: np.ndarray) -> np.ndarray:
        return np.where(one == First.nothing, other, one)


def _met(blocks: pd.DataFrame, width: int, kinds: dict[str, type], key: list[str]) -> pd.DataFrame:
    """For each block the blocks its windows begin in, with the totals of what lies between."""
    first, last = blocks["_low"].to_numpy(dtype=np.int64), blocks["_high"].to_numpy(dtype=np.int64)
    begin, end = (np.searchsorted(last, x - width, side="left") for x in (first, last))
    count = end - begin + 1
    own = np.repeat(np.arange(len(blocks)), count)
    other = np.arange(len(own)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(begin, count)
    number = blocks["_block"].to_numpy(dtype=np.int64)
    out = {k: blocks[k].to_numpy()[own] for k in key}
    out |= {"_own": number[own], "_other": number[other]}
    # windows that begin after the block before and not after this one
    out["_after"] = np.where(other > 0, last[np.maximum(other - 1, 0)], -NOTHING)
    out["_upto"] = last[other]
    for name, kind in kinds.items():
        out[f"_mid_{name}"] = kind(blocks[name]).over(np.minimum(other + 1, own), own)
    return pd.DataFrame(out)


def _window(pdf: pd.DataFrame, width: int, kinds: dict[str, type], key: list[str]) -> pd.DataFrame:
    """Windows of a block that begin in one other block, or in itself."""
    ends = pdf["_is_own"].to_numpy(dtype=bool)
    rows, other = pdf[ends], pdf[~ends]
    ts = rows["_ts"].to_numpy(dtype=np.int64)
    begin = ts - width
    mine = np.flatnonzero((begin > rows["_after"].iloc[0]) & (begin <= rows["_upto"].iloc[0])) if len(rows) else np.zeros(0, dtype=np.int64)
    alone = len(other) == 0
    low = np.searchsorted(ts if alone else other["_ts"].to_numpy(dtype=np.int64), begin[mine], side="left")
    out = {k: rows[k].to_numpy()[mine] for k in key} | {"_ts": ts[mine]}
    for name, kind in kinds.items():
        here = kind(rows[name])
        if alone:
            value = here.over(low, mine)
        else:
            parts = (kind(other[name]).over(low, np.full(len(low), len(other))), rows[f"_mid_{name}"].to_numpy(dtype=np.int64)[mine], here.over(np.zeros_like(mine), mine))
            value = reduce(kind.pick, parts)
        out[name] = value if kind is Sum else pd.array(value, dtype="Int64")
        if kind is not Sum:
            out[name][value == kind.nothing] = pd.NA
    return pd.DataFrame(out)


def before_window(
    df: DataFrame,
    key: Sequence[str],
    width_us: int,
    ts_us: str = "ts_us",
    sums: dict[str, Column] | None = None,
    maxs: dict[str, Column] | None = None,
    mins: dict[str, Column] | None = None,
    firsts: dict[str, Column] | None = None,
    seq: str = "seq",
    widths: dict[str, int] | None = None,
) -> DataFrame:
    """For each distinct timestamp t: aggregates over events with t - width <= ts < t.

    ``firsts`` gives the value of the earliest event of the window; ``widths``
    gives single aggregates a shorter window than ``width_us``.  Result has
    one row per (key, timestamp); sums are 0 and extremes NULL when empty.
    ``seq`` grows with ``ts_us`` within the key.
    """
    sums, maxs, mins, firsts = sums or {}, maxs or {}, mins or {}, firsts or {}
    key, shorter = list(key), widths or {}
    rows = slice_rows(df.sparkSession)
    kinds = {n: kind for some, kind in ((sums, Sum), (maxs, Max), (mins, Min), (firsts, First)) for n in some}
    at = [
        *[F.sum(c).cast("long").alias(n) for n, c in sums.items()],
        *[F.max(c).cast("long").alias(n) for n, c in maxs.items()],
        *[F.min(c).cast("long").alias(n) for n, c in mins.items()],
        *[F.min_by(c, F.when(c.isNotNull(), F.col(seq))).cast("long").alias(n) for n, c in firsts.items()],
    ]
    per_ts = df.groupBy(*key, F.col(ts_us).alias("_ts")).agg(*at, F.min(seq).alias("_seq"))
    # read by block, and once more for the windows of each width
    held = materialize(numbered(per_ts, key, order="_seq", name="_idx").withColumn("_block", whole("_idx", rows)).drop("_seq", "_idx"), "moments")
    types = {f.name: f.dataType.simpleString() for f in held.schema}
    head = ", ".join(f"{k} {types[k]}" for k in key)
    whole_of = [
        *[(F.sum if kind is Sum else F.max if kind is Max else F.min)(n).alias(n) for n, kind in kinds.items() if kind is not First],
        *[F.min_by(n, F.when(F.col(n).isNotNull(), F.col("_ts"))).alias(n) for n, kind in kinds.items() if kind is First],
    ]
    # one short row per block
    blocks = held.groupBy(*key, "_block").agg(F.min("_ts").alias("_low"), F.max("_ts").alias("_high"), *whole_of)

    def of_width(width: int, some: dict[str, type]) -> DataFrame:
        mids = ", ".join(f"_mid_{n} bigint" for n in some)
        met = grouped_map(
            blocks.select(*key, "_block", "_low", "_high", *some), key, ["_block"], lambda pdf: _met(pdf, width, some, key),
            f"{head}, _own bigint, _other bigint, _after bigint, _upto bigint, {mids}",
        )
        slim = held.select(*key, "_block", "_ts", *some)
        own = slim.withColumnRenamed("_block", "_own").join(met, [*key, "_own"]).withColumn("_is_own", F.lit(True))
        pairs = met.where("_own <> _other").select(*key, "_own", "_other")
        other = slim.withColumnRenamed("_block", "_other").join(pairs, [*key, "_other"]).withColumn("_is_own", F.lit(False))
        return grouped_map(
            own.unionByName(other, allowMissingColumns=True), [*key, "_own", "_other"], ["_ts"],
            lambda pdf: _window(pdf, width, some, key), f"{head}, _ts bigint, " + ", ".join(f"{n} bigint" for n in some),
        )

    by_width: dict[int, dict[str, type]] = {}
    for name, kind in kinds.items():
        by_width.setdefault(shorter.get(name, width_us), {})[name] = kind
    parts = [of_width(width, some) for width, some in by_width.items()]
    out = reduce(lambda one, more: one.join(more, [*key, "_ts"]), parts)
    return out.select(*key, F.col("_ts").alias(ts_us), *kinds)
