"""Running aggregates over hot keys.

A window over ``PARTITION BY instrument`` puts one instrument in one task.  A
tape can have a third of its rows in one instrument, so ordered operators here
work in two levels instead:

1. cut each key into slices of consecutive sequence numbers, at most
   ``spark.tickloom.sliceRows`` of them each, so a (key, slice) group is
   bounded whatever the skew;
2. aggregate each slice to one row (map-side combined), run a window over
   those few rows to get what precedes each slice, and add that carry to an
   ordinary window inside the slice.

This is exact for every associative running aggregate: sum, count, max, min,
last and next non-null value.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

SLICE_CONF = "spark.tickloom.sliceRows"
DEFAULT_SLICE_ROWS = 1 << 18


def slice_rows(spark: SparkSession) -> int:
    return int(spark.conf.get(SLICE_CONF, str(DEFAULT_SLICE_ROWS)))


def spread_over_tasks(spark: SparkSession, columns: Sequence[str]) -> Column:
    """Deal many small series out to as many groups as the session has shuffle partitions."""
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return F.pmod(F.xxhash64(*columns), F.lit(n))


def whole(value: str | Column, unit: int) -> Column:
    """Floor of value / unit in exact integer arithmetic."""
    col = F.col(value) if isinstance(value, str) else value
    return ((col - F.pmod(col, F.lit(unit))) / F.lit(unit)).cast("long")


def slice_of(order: str | Column, rows: int) -> Column:
    return whole(order, rows)


@dataclass(frozen=True)
class Run:
    """One running aggregate of ``value`` in tape order."""

    kind: str
    value: Column
    exclusive: bool = False  # leave out the current row
    reverse: bool = False  # run from the end of the tape

    def total(self, order: str) -> Column:
        if self.kind == "last":
            at = F.when(self.value.isNotNull(), F.col(order))
            return (F.min_by if self.reverse else F.max_by)(self.value, at)
        return getattr(F, self.kind)(self.value)

    def fold(self, value: Column) -> Column:
        if self.kind == "last":
            return F.last(value, ignorenulls=True)
        return getattr(F, self.kind)(value)

    def combine(self, carry: Column, inner: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(carry + inner, inner, carry)
        if self.kind == "max":
            return F.greatest(carry, inner)
        if self.kind == "min":
            return F.least(carry, inner)
        return F.coalesce(inner, carry)


def _column(value: str | Column) -> Column:
    return F.col(value) if isinstance(value, str) else value


def sum_(value: str | Column, **how) -> Run:
    return Run("sum", _column(value), **how)


def count_(when: Column | None = None, **how) -> Run:
    one = F.lit(1).cast("long")
    return Run("sum", one if when is None else F.when(when, one).otherwise(F.lit(0).cast("long")), **how)


def max_(value: str | Column, **how) -> Run:
    return Run("max", _column(value), **how)


def min_(value: str | Column, **how) -> Run:
    return Run("min", _column(value), **how)


def last_(value: str | Column, **how) -> Run:
    """Latest non-null value so far."""
    return Run("last", _column(value), **how)


def first_(value: str | Column, **how) -> Run:
    """Next non-null value, from here on."""
    return Run("last", _column(value), reverse=True, **how)


def running(
    df: DataFrame,
    key: Sequence[str],
    order: str = "seq",
    rows: int | None = None,
    **runs: Run,
) -> DataFrame:
    """Add one column per run; ``order`` is a bigint unique within ``key``."""
    key = list(key)
    rows = rows or slice_rows(df.sparkSession)
    part = [*key, "_slice"]
    sliced = df.withColumn("_slice", slice_of(order, rows))

    totals = sliced.groupBy(*part).agg(
        *[run.total(order).alias(f"_total_{name}") for name, run in runs.items()]
    )
    ahead = Window.partitionBy(*key).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy(*key).orderBy(F.col("_slice").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *part,
        *[
            run.fold(F.col(f"_total_{name}")).over(behind if run.reverse else ahead).alias(f"_carry_{name}")
            for name, run in runs.items()
        ],
    )

    def inside(run: Run):
        by = F.col(order).desc() if run.reverse else F.col(order)
        return Window.partitionBy(*part).orderBy(by).rowsBetween(
            Window.unboundedPreceding, -1 if run.exclusive else 0
        )

    # window first: its partitioning and order by (key, slice) serve the join as they are
    inner = sliced.withColumns(
        {f"_inner_{name}": run.fold(run.value).over(inside(run)) for name, run in runs.items()}
    )
    return inner.join(carry, part).select(
        *df.columns,
        *[run.combine(F.col(f"_carry_{name}"), F.col(f"_inner_{name}")).alias(name) for name, run in runs.items()],
    )


def previous(df: DataFrame, key: Sequence[str], order: str = "seq", following: bool = False, **columns: str | Column) -> DataFrame:
    """The one-row lag (or lead) of several columns, nulls included."""
    packed = F.struct(*[_column(value).alias(name) for name, value in columns.items()])
    run = Run("last", packed, exclusive=True, reverse=following)
    out = running(df, key, order, _neighbour=run)
    return out.select(*df.columns, *[F.col(f"_neighbour.{name}").alias(name) for name in columns])


def numbered(df: DataFrame, key: Sequence[str], order: str = "seq", name: str = "idx") -> DataFrame:
    """Dense 0-based position within the key."""
    return running(df, key, order, **{name: Run("sum", F.lit(1).cast("long"))}).withColumn(name, F.col(name) - 1)
