"""As-of lookups: for each left row, the latest right row at or before it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.plans.scan import last_, running


def asof(
    left: DataFrame, right: DataFrame, key: Sequence[str], on: str, columns: Sequence[str], rows: int | None = None
) -> DataFrame:
    """Add ``columns`` of ``right``; ``on`` is a bigint unique per key on each side.

    Both sides are interleaved in one order and the right values carried
    forward, so there is no range join and hot keys are sliced as usual.
    """
    order = 2 * F.col(on)
    packed = F.struct(*columns).alias("_right")
    both = left.withColumn("_order", order + 1).withColumn("_is_left", F.lit(True)).unionByName(
        right.select(*key, order.alias("_order"), packed), allowMissingColumns=True
    )
    out = running(both, key, order="_order", rows=rows, _found=last_("_right"))
    return out.where("_is_left").select(*left.columns, *[F.col(f"_found.{c}").alias(c) for c in columns])
