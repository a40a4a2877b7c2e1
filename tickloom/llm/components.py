"""Connected components by joins: every node is hooked to the smallest neighbour until all components are stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, label: str = "cc") -> DataFrame:
    """``edges`` (u, v) to (node, root): every node that has an edge, with the smallest node of its component.

    One round replaces each edge (u, v) by (v, m) and (u, m), m the smallest of
    u and its neighbours. That keeps components together and about halves
    every distance, so rounds grow with the logarithm of the diameter. Minima
    are combined before their shuffle and stored before the join, where Spark
    can then split a node that a third of all edges meet in. Nothing but a
    count and a checksum comes to the driver.
    """
    now = scratch.keep(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{label}-0")
    seen, turn = None, 0
    while True:
        state = now.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if tuple(state) == seen or not state[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        seen, turn = tuple(state), turn + 1
        both = now.union(now.select("v", "u"))
        smallest = scratch.keep(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), f"{label}-min-{turn}")
        hooked = both.join(smallest, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = smallest.select("u", F.col("m").alias("v"))
        following = scratch.keep(hooked.union(own).where("u <> v").distinct(), f"{label}-{turn}")
        scratch.drop(f"{label}-{turn - 1}", f"{label}-min-{turn}")
        now = following
