"""Recorded sessions: partitioned Parquet written in sequence order, read with pruning."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom import schema as S
from tickloom.operators.calendar import trading_date_of
from tickloom.plans.scan import slice_of, slice_rows

PARTITIONS = ["venue", "root", "contract", "date"]
RECORDED = T.StructType(
    [f for f in S.EVENT if f.name not in ("root", "contract")]
    + [T.StructField("venue", T.StringType()), T.StructField("root", T.StringType()),
       T.StructField("contract", T.StringType()), T.StructField("date", T.DateType())]
)


def as_recorded(df: DataFrame, venue: str = "CME") -> DataFrame:
    """Events in recording layout, with their trading date as partition."""
    us = F.col("ts_us") if "ts_us" in df.columns else F.unix_micros("ts")
    placed = df.withColumns({"venue": F.lit(venue), "date": trading_date_of(us)})
    return placed.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in RECORDED])


def record_session(df: DataFrame, path: str, max_records: int = 2_000_000, mode: str = "append") -> None:
    """Write immutable parts of at most ``max_records`` events (some 128 MB by default), in sequence order.

    A contract's day is spread over tasks by slices of its sequence, so a busy
    contract does not end up in one task.  The output committer publishes
    whole jobs only.
    """
    slice_col = slice_of("seq", slice_rows(df.sparkSession)).alias("_slice")
    placed = as_recorded(df).select("*", slice_col)
    (
        placed.repartition(*PARTITIONS, "_slice").sortWithinPartitions(*PARTITIONS, "seq").drop("_slice")
        .write.mode(mode).partitionBy(*PARTITIONS).option("maxRecordsPerFile", max_records).parquet(path)
    )


def scan_session(
    spark: SparkSession, path: str, contract: str | None = None, dates: Sequence[str] | None = None,
    skip_corrupt: bool = False,
) -> DataFrame:
    """Recorded events; contract and dates prune partitions, unreadable parts may be skipped."""
    reader = spark.read.schema(RECORDED)
    if skip_corrupt:
        reader = reader.option("ignoreCorruptFiles", "true")
    df = reader.parquet(path)
    if contract is not None:
        df = df.where(F.col("contract") == contract)
    if dates is not None:
        df = df.where(F.col("date").isin(*[pd.Timestamp(d).date() for d in dates]))
    return df


def replay_range(df: DataFrame, start: Column, end: Column, closed: str = "both", ordered: bool = False) -> DataFrame:
    """Events from ``start`` to ``end``; the end counts unless ``closed='left'``. ``ordered`` sorts them for replay.

    The range is also put on the ``date`` partition (a trading date is at most
    three days after its events), so that other days are not listed or read.
    """
    if "date" in df.columns:
        df = df.where(F.col("date").between(F.date_sub(F.to_date(start), 2), F.date_add(F.to_date(end), 4)))
    upper = F.col("ts") <= end if closed == "both" else F.col("ts") < end
    kept = df.where((F.col("ts") >= start) & upper)
    return kept.orderBy("ts", "seq", "instrument_id") if ordered else kept


def historical_trades(df: DataFrame, contract: str, start: Column, end: Column) -> DataFrame:
    """Trades of a contract in [start, end)."""
    return replay_range(df.where((F.col("contract") == contract) & (F.col("type") == S.TRADE)), start, end, "left")


def count_events(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("events"))


def count_by_type(df: DataFrame) -> DataFrame:
    return df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "type")


def _probe(batches):
    """Parquet magic at both ends and a plausible footer length, reading a few bytes per file."""
    from pyarrow import fs

    for pdf in batches:
        healthy = []
        for path, length in zip(pdf["path"], pdf["length"]):
            ok = False
            if length >= 12:
                where = path if "://" in path else path.replace("file:", "file://", 1)
                system, name = fs.FileSystem.from_uri(where)
                with system.open_input_file(name) as f:
                    head = f.read(4)
                    f.seek(length - 8)
                    tail = f.read(8)
                ok = head == b"PAR1" and tail[4:] == b"PAR1" and int.from_bytes(tail[:4], "little") <= length - 12
            healthy.append(ok)
        yield pdf.assign(is_valid=healthy)


def part_health(spark: SparkSession, path: str) -> DataFrame:
    """Per partition folder: parts, valid and corrupt ones, leftovers of interrupted writes."""
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    )
    is_part = F.col("path").endswith(".parquet")
    probed = files.where(is_part).repartition("path").mapInPandas(_probe, "path string, length bigint, is_valid boolean")
    leftover = files.where(F.col("path").endswith(".tmp")).select("path", "length", F.lit(None).cast("boolean").alias("is_valid"))
    folder = F.regexp_extract("path", r"(venue=[^/]+/root=[^/]+/contract=[^/]+/date=[^/]+)/[^/]+$", 1)
    return probed.unionByName(leftover).groupBy(folder.alias("folder")).agg(
        F.count("is_valid").alias("parts"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("corrupt"),
        F.count_if(F.col("is_valid").isNull()).alias("leftovers"),
    )


# Event types behind each subscription.
SUBSCRIPTIONS = {
    "trades": [S.TRADE],
    "top_of_book": [S.BID_UPDATE, S.ASK_UPDATE],
    "depth": [S.ADD, S.MODIFY, S.CANCEL, S.EXECUTE, S.BID_UPDATE, S.ASK_UPDATE],
    "control": [t for t in range(S.SNAPSHOT_START, S.SEQUENCE_GAP + 1)],
}


def live_source(
    spark: SparkSession, path: str, contracts: Sequence[str] | None = None,
    subscribe: Sequence[str] = ("trades", "depth", "control"), files_per_trigger: int = 8,
) -> DataFrame:
    """Events as they are recorded, narrowed to a subscription."""
    df = spark.readStream.schema(RECORDED).option("maxFilesPerTrigger", files_per_trigger).parquet(path)
    types = sorted({t for s in subscribe for t in SUBSCRIPTIONS[s]})
    df = df.where(F.col("type").isin(*types))
    return df if contracts is None else df.where(F.col("contract").isin(*contracts))
