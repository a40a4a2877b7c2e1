"""Intermediate tables in the cluster's shared folder, removed when their readers are through."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.plans.materialize import remove_table, shared_folder, write_table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class Scratch:
    """Named tables of one operator run.

    ``keep`` writes a DataFrame and reads it back, ``drop`` removes tables that
    later jobs no longer read. What the operator's result still reads stays.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = f"{shared_folder(spark)}/llm-{label}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        write_table(df, self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            remove_table(self.spark, self.path(name))


def ascii_lower(column: Column) -> Column:
    """A-Z to a-z, all else unchanged (``lower`` would fold other scripts too)."""
    return F.translate(column, UPPER, LOWER)


def hashed_sample(df: DataFrame, keys: list[str], rows: int, count: int) -> DataFrame:
    """At most ``rows`` of the ``count`` rows of ``df``: those with the smallest hash of ``keys``.

    Rows with a hash beyond any that can be chosen go first, so that partitions
    send on about twice the sample together, however many they are.
    """
    at = F.xxhash64(*keys)
    if count > 2 * rows:
        df = df.where(at < F.lit(-(1 << 63) + int((1 << 64) * 2 * rows / count)).cast("long"))
    return df.orderBy(at, *keys).limit(rows)


def row_key(text: Column) -> Column:
    """Second half of a row's key beside its id: rows that share an id but not a text stay apart, repeated rows share a result."""
    return F.xxhash64(F.coalesce(text, F.lit("")))


def same_row(left: DataFrame, right: DataFrame, how: str = "left") -> DataFrame:
    """Join on ``doc_id`` (null matches null) and ``row_key``, keeping the left side's copies of both."""
    other = right.select(*[right[c].alias(f"_{c}" if c in ("doc_id", "row_key") else c) for c in right.columns])
    return left.join(other, F.col("doc_id").eqNullSafe(F.col("_doc_id")) & (F.col("row_key") == F.col("_row_key")), how).drop("_doc_id", "_row_key")
