"""Columns, codes and reference data of a market-event tape.

A tape is a DataFrame with one row per market event.  Two columns carry the
order: ``ts`` (exchange timestamp, UTC) and ``seq`` (exchange sequence, unique
per instrument and increasing with ``ts``).  Prices are integer ticks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEY = "instrument_id"
SEQ = "seq"

# Event type codes.
UNKNOWN_TYPE, ADD, MODIFY, CANCEL, EXECUTE, TRADE, BID_UPDATE, ASK_UPDATE = range(8)
SNAPSHOT_START, SNAPSHOT_END, BOOK_CLEAR = 8, 9, 10
SESSION_STATUS, INSTRUMENT_DEFINITION, CONNECTION_STATUS, SEQUENCE_GAP = 11, 12, 13, 14

# Sides and aggressors.
NO_SIDE, BID, ASK = 0, 1, 2
UNKNOWN, BUY, SELL = 0, 1, 2

# Bits of ``flags``.
AGGRESSOR_SUPPLIED, AGGRESSOR_INFERRED, IMPLIED, SNAPSHOT_ROW = 1, 2, 4, 8
HAS_SEQUENCE, HAS_TIMESTAMP, SYNTHETIC = 16, 32, 64

EVENT = T.StructType(
    [
        T.StructField("instrument_id", T.IntegerType()),
        T.StructField("root", T.StringType()),
        T.StructField("contract", T.StringType()),
        T.StructField("exchange", T.StringType()),
        T.StructField("type", T.IntegerType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("receive_ts", T.TimestampType()),
        T.StructField("seq", T.LongType()),
        T.StructField("side", T.IntegerType()),
        T.StructField("price_ticks", T.LongType()),
        T.StructField("quantity", T.LongType()),
        T.StructField("order_id", T.LongType()),
        T.StructField("trade_id", T.LongType()),
        T.StructField("aggressor", T.IntegerType()),
        T.StructField("flags", T.IntegerType()),
        T.StructField("source", T.IntegerType()),
    ]
)

DETECTION_COLUMNS = [
    "instrument_id", "detector", "seq", "ts", "price_ticks", "bias",
    "is_estimated", "text", "measurements",
]


def instrument_specs(spark: SparkSession) -> DataFrame:
    """Two listed instruments; extend by union with more rows."""
    return spark.createDataFrame(
        [(1, "NQ", "0.25", "20"), (2, "ES", "0.25", "50")],
        "instrument_id int, root string, tick string, point string",
    ).selectExpr(
        "instrument_id",
        "root",
        "cast(tick as decimal(18,6)) as tick_size",
        "cast(point as decimal(18,6)) as point_value",
        "cast(cast(tick as decimal(18,6)) * cast(point as decimal(18,6)) as decimal(18,6)) as tick_currency",
    )
