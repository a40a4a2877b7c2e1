"""Registration of queries and the SQL views their oracles share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tickloom.plans import materialize
from tickloom.sources.tape import recorded_tape

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


_tables: dict[tuple, DataFrame] = {}


def shared(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A derived table several queries start from, stored once per application."""
    slot = (spark.sparkContext.applicationId, sf_dir, name)
    if slot not in _tables:
        _tables[slot] = materialize(build(), name)
    return _tables[slot]


def fast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded_tape(spark, sf_dir, "fast")


def days(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recorded_tape(spark, sf_dir, "days")


#: Three fifths of the tape, whatever its length.
POSITION = "(SELECT max(seq) * 3 // 5 FROM tape)"


def position(spark: SparkSession, sf_dir: str) -> int:
    return fast(spark, sf_dir).agg({"seq": "max"}).first()[0] * 3 // 5


def _tape_sql(pace: str) -> str:
    us = "epoch_us(ts)"
    if pace == "fast":
        us = "1717421400000000 + (epoch_us(ts) - 1704067200000000) // 240"
    return f"""base AS (
  SELECT event_id AS seq, CAST(user_id % 2 + 1 AS INTEGER) AS instrument_id,
    CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CAST(floor(value) AS BIGINT) AS v,
    CASE event_type WHEN 'purchase' THEN 6 WHEN 'signup' THEN 7 ELSE 5 END AS type,
    CASE event_type WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 0 END AS aggressor,
    {us} AS ts_us
  FROM events),
tape AS (
  SELECT instrument_id, seq, ts_us, type, aggressor, k, v,
    CASE WHEN type = 5 THEN 0 ELSE type - 5 END AS side,
    CAST(80000 + SUM(v % 5 - 2) OVER (PARTITION BY instrument_id ORDER BY seq)
      + CASE type WHEN 5 THEN 0 WHEN 6 THEN -(1 + k % 5) ELSE 1 + k % 5 END AS BIGINT) AS price_ticks,
    CASE WHEN type <> 5 AND k % 4 = 0 THEN 0 ELSE 1 + v END AS quantity,
    48 + CASE WHEN type = 5 AND aggressor > 0 AND k % 3 = 0 THEN 2
              WHEN type = 5 AND aggressor > 0 THEN 1 ELSE 0 END AS flags
  FROM base),
trades AS (SELECT * FROM tape WHERE type = 5 AND quantity > 0)"""


TAPE_FAST = _tape_sql("fast")
TAPE_DAYS = _tape_sql("days")


def with_fast(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([TAPE_FAST, *ctes]) + "\n" + body


def with_days(body: str, *ctes: str) -> str:
    return "WITH " + ",\n".join([TAPE_DAYS, *ctes]) + "\n" + body


def with_fast_recursive(body: str, *ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join([TAPE_FAST, *ctes]) + "\n" + body
