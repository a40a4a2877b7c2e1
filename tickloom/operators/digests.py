"""Digests of a tape that tell where two passes part.

A leaf is a slice of an instrument's sequence; its digest is a sum over its
events' hashes, so it depends neither on order nor on partitioning, and leaves
of appended events simply add up.  Nodes above digest their children in order,
``fan`` at a time.  Two tapes are compared from the roots down, where only the
children of nodes that differ are looked at.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.plans import materialize, whole
from tickloom.plans.materialize import temporary_tables

#: Columns of an event that its hash covers.
COVERED = ("seq", "ts_us", "type", "side", "price_ticks", "quantity", "order_id", "aggressor", "flags")
WIDE = "decimal(38,0)"
FAN = 64
SUMS = ("events", "sum_a", "sum_b")


def _hashes(columns: Sequence[str]) -> tuple[Column, Column]:
    """Two 60-bit numbers from the MD5 of an event's values (nulls told apart from empty)."""
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("~")) for c in columns])
    digest = F.md5(text)
    return tuple(F.conv(F.substring(digest, at, 15), 16, 10).cast(WIDE) for at in (1, 16))


def leaves(df: DataFrame, rows: int, columns: Sequence[str] = COVERED) -> DataFrame:
    """Per (instrument, slice of ``rows`` sequences): number of events and two sums of their hashes."""
    if "ts_us" in columns and "ts_us" not in df.columns:
        df = df.withColumn("ts_us", F.unix_micros("ts"))
    known = [c for c in columns if c in df.columns]
    a, b = _hashes(known)
    return df.groupBy(S.KEY, whole("seq", rows).alias("slice")).agg(
        F.count(F.lit(1)).alias("events"), F.sum(a).cast(WIDE).alias("sum_a"), F.sum(b).cast(WIDE).alias("sum_b")
    )


def appended(before: DataFrame, more: DataFrame) -> DataFrame:
    """Leaves of two disjoint sets of events together, without another pass over the first."""
    return before.unionByName(more).groupBy(S.KEY, "slice").agg(
        F.sum("events").alias("events"), *[F.sum(c).cast(WIDE).alias(c) for c in SUMS[1:]]
    )


def tree(leaf: DataFrame, fan: int = FAN, levels: int | None = None) -> list[DataFrame]:
    """Levels from the leaves up: instrument_id, node, digest; at the last every instrument has one node.

    ``levels`` fixes the height, so that trees of different tapes match.
    """
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in SUMS])
    out = [leaf.select(S.KEY, F.col("slice").alias("node"), F.md5(text).alias("digest"))]
    if levels is None:
        levels = height(leaf, fan)
    for _ in range(levels):
        child = F.struct("node", "digest")
        children = F.sort_array(F.collect_list(child))
        line = F.array_join(F.transform(children, lambda c: F.concat_ws(":", c["node"].cast("string"), c["digest"])), ",")
        out.append(out[-1].groupBy(S.KEY, whole("node", fan).alias("_up")).agg(F.md5(line).alias("digest")).withColumnRenamed("_up", "node"))
    return out


def height(leaf: DataFrame, fan: int = FAN) -> int:
    """Levels above the leaves until one node is left."""
    top = leaf.agg(F.max("slice")).first()[0] or 0
    out = 0
    while top:
        top, out = top // fan, out + 1
    return out


def differing_slices(one: DataFrame, other: DataFrame, fan: int = FAN) -> DataFrame:
    """Slices whose events are not the same in both sets of leaves: instrument_id, slice, events, other_events.

    ``one`` and ``other`` should be stored tables; every level only joins the
    children of nodes that differ.
    """
    levels = max(height(one, fan), height(other, fan))

    def unlike(a: DataFrame, b: DataFrame) -> DataFrame:
        both = a.join(b.withColumnRenamed("digest", "_other"), [S.KEY, "node"], "full")
        return both.where(~F.equal_null("digest", "_other")).select(S.KEY, "node")

    # each level is stored: a plan that nests them all would work out the lower ones again and again
    with temporary_tables(keep_last=True):
        mine, theirs = ([x[0], *(materialize(level, "digests") for level in x[1:])] for x in (tree(one, fan, levels), tree(other, fan, levels)))
        found = materialize(unlike(mine[-1], theirs[-1]), "differing")
        for a, b in zip(mine[-2::-1], theirs[-2::-1]):
            parents = found.select(S.KEY, F.col("node").alias("_up"))
            below = [x.withColumn("_up", whole("node", fan)).join(parents, [S.KEY, "_up"]).drop("_up") for x in (a, b)]
            found = materialize(unlike(*below), "differing")
    counts = [x.select(S.KEY, F.col("slice").alias("node"), F.col("events").alias(n)) for x, n in ((one, "events"), (other, "other_events"))]
    return found.join(counts[0], [S.KEY, "node"], "left").join(counts[1], [S.KEY, "node"], "left").withColumnRenamed("node", "slice")


def first_difference(one: DataFrame, other: DataFrame, fan: int = FAN) -> DataFrame:
    """The first slice of each instrument at which two sets of leaves part."""
    return differing_slices(one, other, fan).withColumn(
        "_n", F.row_number().over(Window.partitionBy(S.KEY).orderBy("slice"))
    ).where("_n = 1").drop("_n")
