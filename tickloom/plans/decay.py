"""Exponential averages as discounted sums.

``y[n] = (1 - alpha) * y[n-1] + alpha * x[n]``, started with the mean of the
first ``period`` inputs, is the sum of all inputs so far discounted by
``(1 - alpha)`` per step.  Within a block of rows that is a window sum; what a
block inherits from the blocks before it is a single number, folded over one
row per block.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.plans.scan import whole

LONGEST_BLOCK = 1 << 14
SAFE_EXPONENT = 460.0  # e**460 is about 1e200, well inside a double


@dataclass(frozen=True)
class Average:
    """An exponential average of ``value`` whose first input is at position ``start``."""

    value: Column
    period: int
    alpha: float
    start: int = 0

    @property
    def ready(self) -> int:
        return self.start + self.period - 1


def block_size(wanted: list[Average]) -> int:
    """Rows per block: as many as the discount factors allow without overflow."""
    rates = [-math.log(1.0 - a.alpha) for a in wanted if a.alpha < 1.0]
    longest = min([LONGEST_BLOCK, *[int(SAFE_EXPONENT / r) for r in rates]])
    return max(longest, *[a.ready + 1 for a in wanted])


def ema(value: str | Column, period: int, start: int = 0) -> Average:
    return Average(F.col(value) if isinstance(value, str) else value, period, 2.0 / (period + 1), start)


def rma(value: str | Column, period: int, start: int = 0) -> Average:
    return Average(F.col(value) if isinstance(value, str) else value, period, 1.0 / period, start)


def averages(df: DataFrame, key: Sequence[str], index: str = "idx", **wanted: Average) -> DataFrame:
    """Add each average, NULL until it is ready; ``index`` is dense and 0-based."""
    key = list(key)
    size = block_size(list(wanted.values()))
    block = [*key, "_block"]
    upto = Window.partitionBy(*block).orderBy(index).rowsBetween(Window.unboundedPreceding, 0)
    at = F.col(index)
    within = F.pmod(at, F.lit(size)).cast("double")

    inputs = {}
    for name, a in wanted.items():
        x = a.value.cast("double")
        seed = F.sum(F.when(at >= a.start, x)).over(upto) / F.lit(float(a.period))
        inputs[f"_in_{name}"] = (
            F.when(at == a.ready, seed).when(at > a.ready, F.lit(a.alpha) * x).otherwise(0.0)
        )
    blocked = df.withColumn("_block", whole(index, size)).withColumns(inputs)

    def keep(a: Average) -> float:
        return 1.0 - a.alpha

    # alpha = 1 keeps nothing of the past: the average is the input itself
    inside = blocked.withColumns(
        {
            f"_here_{name}": (
                F.pow(F.lit(keep(a)), within)
                * F.sum(F.col(f"_in_{name}") * F.pow(F.lit(keep(a)), -within)).over(upto)
                if keep(a) > 0
                else F.col(f"_in_{name}")
            )
            for name, a in wanted.items()
        }
    )
    ends = inside.groupBy(*block).agg(
        *[F.max_by(f"_here_{name}", index).alias(name) for name in wanted]
    )
    types = {f.name: f.dataType.simpleString() for f in ends.schema}
    rates = {name: keep(a) ** size for name, a in wanted.items()}

    def inherit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_block", ignore_index=True)
        out = pdf[block].copy()
        for name, rate in rates.items():
            carried, value = [], 0.0
            for end in pdf[name].to_numpy():
                carried.append(value)
                value = end + rate * value
            out[f"_carry_{name}"] = carried
        return out

    carry = ends.groupBy(*key).applyInPandas(
        inherit,
        ", ".join([f"{c} {types[c]}" for c in block] + [f"_carry_{n} double" for n in wanted]),
    )
    return inside.join(carry, block).select(
        *df.columns,
        *[
            F.when(
                at >= a.ready,
                F.col(f"_here_{name}") + F.pow(F.lit(keep(a)), within + 1) * F.col(f"_carry_{name}"),
            ).alias(name)
            for name, a in wanted.items()
        ],
    )
