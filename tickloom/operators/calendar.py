"""Trading dates, session windows and contract calendars (exchange local time: Chicago).

Everything is computed on zone-less timestamps with explicit zones, so results
do not depend on the session time zone of Spark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import schema as S

ZONE = "America/Chicago"
EPOCH = "TIMESTAMP_NTZ '1970-01-01 00:00:00'"

# Segments as (start, start day offset, end, end day offset).
TEMPLATES = {
    "globex": [("17:00", -1, "16:00", 0)],
    "rth": [("08:30", 0, "15:00", 0)],
    "eth": [("17:00", -1, "08:30", 0), ("15:00", 0, "16:00", 0)],
    "overnight": [("17:00", -1, "08:30", 0)],
}


def utc_ntz(us: Column) -> Column:
    """Zone-less UTC timestamp of microseconds since 1970."""
    return F.timestamp_add("MICROSECOND", us, F.expr(EPOCH))


def micros(ntz: Column) -> Column:
    return F.timestamp_diff("MICROSECOND", F.expr(EPOCH), ntz)


def chicago(us: Column) -> Column:
    return F.convert_timezone(F.lit("UTC"), F.lit(ZONE), utc_ntz(us))


def local_to_utc(local: Column) -> Column:
    """UTC of a Chicago wall-clock time.

    A time skipped in spring moves forward by the hour skipped; a time that
    occurs twice in autumn means the second (standard time) occurrence.
    """
    earlier = F.convert_timezone(F.lit(ZONE), F.lit("UTC"), local)
    later = F.timestamp_add("HOUR", F.lit(1), earlier)
    same_wall_clock = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), later) == local
    return F.when(same_wall_clock, later).otherwise(earlier)


def trading_date_of(us: Column) -> Column:
    """Evenings from 17:00 count to the next day, Saturdays to Monday."""
    local = chicago(us)
    day = F.date_add(F.to_date(local), F.when(F.hour(local) >= 17, 1).otherwise(0))
    return F.date_add(day, F.when(F.dayofweek(day) == 7, 2).otherwise(0))


def trading_date(df: DataFrame) -> DataFrame:
    us = F.col("ts_us") if "ts_us" in df.columns else F.unix_micros("ts")
    return df.withColumn("trading_date", trading_date_of(us))


def _at(date: Column, offset: int, clock: str) -> Column:
    midnight = F.date_add(date, offset).cast("timestamp_ntz")
    hours, minutes = (int(x) for x in clock.split(":"))
    return F.timestamp_add("MINUTE", F.lit(60 * hours + minutes), midnight)


def session_windows(dates: DataFrame, template: str | list[tuple[str, int, str, int]]) -> DataFrame:
    """UTC windows of each ``trading_date``; custom sessions pass their own segments."""
    name = template if isinstance(template, str) else "custom"
    segments = TEMPLATES[template] if isinstance(template, str) else template
    date = F.col("trading_date")
    structs = [
        F.struct(
            F.lit(i).alias("segment"),
            micros(local_to_utc(_at(date, so, start))).alias("start_us"),
            micros(local_to_utc(_at(date, eo, end))).alias("end_us"),
        )
        for i, (start, so, end, eo) in enumerate(segments)
    ]
    return dates.select("trading_date", F.explode(F.array(*structs)).alias("w")).select(
        "trading_date", F.lit(name).alias("template"), "w.segment", "w.start_us", "w.end_us"
    )


def tag_session(df: DataFrame, templates: list[str]) -> DataFrame:
    """Sessions each event falls into, by half-open windows of its own trading date.

    The windows of a date follow from the date alone, so they are computed as
    expressions on the row: no join, no shuffle.
    """
    dated = trading_date(df)
    us, date = F.col("ts_us"), F.col("trading_date")

    def within(template: str) -> Column:
        hit = F.lit(False)
        for start, so, end, eo in TEMPLATES[template]:
            hit = hit | (
                (us >= micros(local_to_utc(_at(date, so, start))))
                & (us < micros(local_to_utc(_at(date, eo, end))))
            )
        return hit

    names = [F.when(within(t), F.lit(t)) for t in templates]
    return dated.withColumn("sessions", F.array_compact(F.array(*names)))


def opening_range_window(dates: DataFrame, minutes: int) -> DataFrame:
    rth = session_windows(dates, "rth")
    return rth.select(
        "trading_date", "start_us", (F.col("start_us") + F.lit(minutes * 60_000_000)).alias("end_us")
    )


def initial_balance_window(dates: DataFrame, minutes: int = 60) -> DataFrame:
    return opening_range_window(dates, minutes)


def third_friday(year: Column, month: Column) -> Column:
    day_before = F.date_sub(F.make_date(year, month, F.lit(1)), 1)
    return F.date_add(F.next_day(day_before, "FRI"), 14)


def contract_calendar(roots: DataFrame, first_year: int, last_year: int) -> DataFrame:
    """Quarterly contracts of each ``root`` with their expiry (third Friday)."""
    years = F.explode(F.sequence(F.lit(first_year), F.lit(last_year)))
    months = F.explode(F.array(*[F.lit(m) for m in (3, 6, 9, 12)]))
    code = F.element_at(F.array(*[F.lit(c) for c in "HMUZ"]), (F.col("month") / 3).cast("int"))
    return (
        roots.select("root").distinct()
        .withColumn("year", years).withColumn("month", months)
        .withColumn("expiry", third_friday(F.col("year"), F.col("month")))
        .withColumn("symbol", F.concat("root", code, F.pmod("year", F.lit(100)).cast("string")))
    )


def front_month(dates: DataFrame, roll_days: int = 8) -> DataFrame:
    """Per (root, date): the first contract at least ``roll_days`` from expiry.

    A quarter's expiry is an expression of the date, so the few candidate
    quarters that ``roll_days`` can reach are compared on the row itself and no
    calendar is joined.
    """
    date = F.col("trading_date")
    quarter_start = F.trunc(date, "quarter")

    def candidate(i: int) -> Column:
        month = F.add_months(quarter_start, 3 * i + 2)
        return F.struct(
            third_friday(F.year(month), F.month(month)).alias("expiry"),
            F.year(month).alias("year"),
            F.month(month).alias("month"),
        )

    candidates = F.array(*[candidate(i) for i in range(max(5, roll_days // 89 + 3))])
    good = F.filter(candidates, lambda c: F.datediff(c["expiry"], date) >= roll_days)
    code = F.element_at(F.array(*[F.lit(c) for c in "HMUZ"]), (F.col("front.month") / 3).cast("int"))
    current = F.filter(candidates, lambda c: c["expiry"] >= date)
    return dates.withColumn("front", F.get(good, 0)).withColumn("nearest", F.get(current, 0)).select(
        *dates.columns,
        F.concat("root", code, F.pmod("front.year", F.lit(100)).cast("string")).alias("symbol"),
        F.col("front.expiry").alias("expiry"),
        F.datediff("front.expiry", "trading_date").alias("days_to_expiry"),
        (F.datediff("front.expiry", "trading_date") <= roll_days).alias("in_rollover_window"),
        (F.datediff("nearest.expiry", "trading_date") <= roll_days).alias("nearest_expiring"),
    )
