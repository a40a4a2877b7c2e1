"""Bounded look-back windows over hot keys.

A frame of the last ``depth`` rows needs only its own slice and the tail of the
slices before it, so tail rows are copied forward and dropped again afterwards.
``index`` is a dense 0-based position, hence a group never holds more than
``slice + depth`` rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tickloom.plans.scan import slice_of, slice_rows


def lookback(
    df: DataFrame,
    key: Sequence[str],
    depth: int,
    compute: Callable[[DataFrame, WindowSpec], DataFrame],
    index: str = "idx",
    rows: int | None = None,
) -> DataFrame:
    """Run ``compute(df, window)`` where window orders a slice with its look-back."""
    rows = rows or slice_rows(df.sparkSession)
    own = slice_of(index, rows)
    spread = df.withColumn(
        "_slice", F.explode(F.sequence(own, slice_of(F.col(index) + F.lit(depth), rows)))
    )
    window = Window.partitionBy(*key, "_slice").orderBy(index)
    out = compute(spread, window)
    return out.where(F.col("_slice") == own).drop("_slice")
