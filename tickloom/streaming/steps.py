"""Order-dependent operators continued across micro-batches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tickloom import schema as S
from tickloom.operators import bars as b
from tickloom.operators import detectors as d
from tickloom.operators import flow, quality
from tickloom.operators.calendar import trading_date_of
from tickloom.plans import materialize, running, sum_
from tickloom.plans.resets import RangeLimit, VolumeLimit, restarting
from tickloom.streaming.carry import Step, carried


def _clock(df: DataFrame) -> DataFrame:
    return df if "ts_us" in df.columns else df.withColumn("ts_us", F.unix_micros("ts"))


def clean_step(sequence: str = "seq", arrival: str = "seq") -> Step:
    """Duplicates dropped, gaps marked; counters are kept with the state."""

    def step(batch, before):
        known = before["sequences"] if before else None
        audited = quality.sequence_audit(batch, sequence, arrival, known)
        counts = audited.groupBy(S.KEY).agg(
            F.max(F.when(quality.has_flag(S.HAS_SEQUENCE), F.col(sequence))).alias("last_sequence"),
            F.count(F.lit(1)).alias("ingested"),
            F.count_if(F.col("outcome") == quality.GAP).alias("gaps"),
            F.count_if(F.col("outcome") == quality.DUPLICATE).alias("duplicates"),
        )
        if before:
            counts = counts.unionByName(before["sequences"]).groupBy(S.KEY).agg(
                F.max("last_sequence").alias("last_sequence"),
                *[F.sum(c).alias(c) for c in ("ingested", "gaps", "duplicates")],
            )
        return quality.clean_stream(batch, sequence, arrival, known), {"sequences": counts}

    return step


def stream_clean(stream: DataFrame, path: str, sequence: str = "seq", arrival: str = "seq") -> DataStreamWriter:
    return carried(stream, clean_step(sequence, arrival), path)


def bars_step(kind: str, size: int) -> Step:
    """Closed tick, volume or range bars; the open bar of each instrument is the state."""

    def step(batch, before):
        trades = b.trade_columns(batch)
        opened = before["open_bars"] if before else None
        initial = None
        if kind == "range":
            limit, measured = RangeLimit(size), [F.col("high"), F.col("low")]
        else:
            limit, measured = VolumeLimit(size), [F.col("trades") if kind == "tick" else F.col("volume")]
        if opened is not None:
            initial = opened.select(S.KEY, F.array(F.col("bar_id"), *measured).alias("_initial"))
        if kind == "tick":
            trades = trades.withColumns({"_quantity": F.col("quantity"), "quantity": F.lit(1).cast("long")})
        assigned = restarting(trades, [S.KEY], limit, initial=initial)
        if kind == "tick":
            assigned = assigned.withColumn("quantity", F.col("_quantity")).drop("_quantity")
        fresh = b.build_bars(assigned, kind)
        if opened is not None:
            both = fresh.unionByName(opened)
            fresh = both.groupBy(S.KEY, "bar_id").agg(
                F.first("kind").alias("kind"),
                F.min("start_us").alias("start_us"), F.max("end_us").alias("end_us"),
                F.min_by("open", "first_seq").alias("open"), F.max("high").alias("high"),
                F.min("low").alias("low"), F.max_by("close", "last_seq").alias("close"),
                *[F.sum(c).alias(c) for c in ("volume", "buy", "sell", "trades")],
                F.min("first_seq").alias("first_seq"), F.max("last_seq").alias("last_seq"),
                F.sum("delta").alias("delta"),
            )
        done = {
            "tick": F.col("trades") >= size, "volume": F.col("volume") >= size,
            "range": F.col("high") - F.col("low") >= size,
        }[kind]
        merged = materialize(fresh, f"stream-{kind}-bars")
        return merged.where(done), {"open_bars": merged.where(~done)}

    return step


def stream_threshold_bars(stream: DataFrame, path: str, kind: str, size: int) -> DataStreamWriter:
    return carried(stream, bars_step(kind, size), path)


SUMS = ["_cvd", "_v", "_pv", "_ppv"]


def cvd_vwap_step(keep_days: int | None = 7) -> Step:
    """Running delta and VWAP per trading date.

    The sums of every date within ``keep_days`` of an instrument's newest one
    are kept, so that late trades of an earlier date go on from where it
    stood. A trade older than that starts from nothing and is marked
    ``is_too_late``. With None every date is kept, one row each.
    """

    def step(batch, before):
        trades = b.trade_columns(batch).withColumn("trading_date", trading_date_of(F.col("ts_us")))
        key = [S.KEY, "trading_date"]
        parts = {"_cvd": flow.signed_quantity(), **flow._sums()}
        run = running(trades, key, **{n: sum_(c) for n, c in parts.items()})
        totals = trades.groupBy(*key).agg(*[F.sum(c).alias(n) for n, c in parts.items()])
        too_late = F.lit(False)
        if before:
            known = before["sums"]
            carry = known.select(*key, *[F.col(n).alias(f"_known{n}") for n in SUMS])
            newest = known.groupBy(S.KEY).agg(F.max("trading_date").alias("_newest"))
            run = run.join(carry, key, "left").join(newest, S.KEY, "left")
            if keep_days is not None:
                too_late = F.coalesce(F.date_diff("_newest", "trading_date") > keep_days, F.lit(False))
            for n in SUMS:
                run = run.withColumn(n, F.coalesce(F.col(n) + F.col(f"_known{n}"), F.col(n))).drop(f"_known{n}")
            totals = totals.unionByName(known).groupBy(*key).agg(*[F.sum(n).alias(n) for n in SUMS])
        run = run.withColumn("is_too_late", too_late).drop("_newest")
        last = totals.groupBy(S.KEY).agg(F.max("trading_date").alias("_newest"))
        is_kept = F.lit(True) if keep_days is None else F.date_diff("_newest", "trading_date") <= keep_days
        kept = totals.join(last, S.KEY).where(is_kept).select(
            *key, F.col("_cvd").cast("bigint").alias("_cvd"), F.col("_v").cast("bigint").alias("_v"),
            F.col("_pv").cast(flow.WIDE).alias("_pv"), F.col("_ppv").cast(flow.WIDE).alias("_ppv"),
        )
        out = flow._finish(run.withColumnRenamed("_cvd", "cvd"), ())
        return out, {"sums": kept}

    return step


def stream_cvd_vwap(stream: DataFrame, path: str, keep_days: int | None = 7) -> DataStreamWriter:
    return carried(stream, cvd_vwap_step(keep_days), path)


CONTEXT = ["instrument_id", "seq", "ts_us", "type", "price_ticks", "quantity", "aggressor"]


def _unsettled(windows: DataFrame, key: Sequence[str], window: str, settled: DataFrame) -> DataFrame:
    """Rows of the window that each key's last settled row is in, and all rows after it."""
    last = windows.join(settled, S.KEY).where(F.col("seq") <= F.col("last_seq")).groupBy(*key).agg(F.max(window).alias("_from"))
    return windows.join(last, [*key], "left").where(F.col("_from").isNull() | (F.col(window) >= F.col("_from"))).drop("_from")


def _recent(rows: DataFrame, width_us: int, settled: DataFrame) -> DataFrame:
    """Rows that look-backs of ``width_us`` from the last settled row on can reach."""
    near = F.col("last_us").isNull() | (F.col("ts_us") >= F.col("last_us") - width_us)
    return rows.join(settled, S.KEY, "left").where(near).drop("last_seq", "last_us")


def detectors_step(settings: dict[str, object] | None = None, lateness_us: int = 10_000_000) -> Step:
    """Sweep, absorption, replenishment, stop-run and regime.

    Rows more than ``lateness_us`` older than an instrument's newest one are
    settled. State holds the rows after the last settled one, the rows of the
    windows and sliding look-backs it is in, which levels are empty, the last
    settled stop-run and the detections told since. Late rows thus meet the
    rows around them: detections they bring about come out, and one told
    earlier that no longer holds comes out again as ``is_withdrawn``. A row at
    or before the last settled one comes out as ``Too Late``, ``is_too_late``.
    """
    s = {name: e.settings for name, e in d.DETECTORS.items()} | (settings or {})

    def step(batch, before):
        rows = _clock(batch).select(*CONTEXT)
        trade = (F.col("type") == S.TRADE) & (F.col("quantity") > 0)
        known = before["settled"] if before else None
        seen = known.select(S.KEY, "last_seq") if before else None
        late = None
        if before:
            placed = rows.join(seen, S.KEY, "left")
            is_late = F.coalesce(F.col("seq") <= F.col("last_seq"), F.lit(False))
            late, rows = placed.where(is_late).drop("last_seq"), placed.where(~is_late).drop("last_seq")

        def with_state(name: str, keep: Column | None = None) -> DataFrame:
            own = rows if keep is None else rows.where(keep)
            return own.unionByName(before[name].select(*CONTEXT)) if before else own

        def after(found: DataFrame, place: DataFrame) -> DataFrame:
            return found.join(place.select(S.KEY, "last_seq"), S.KEY, "left").where(F.col("seq") > F.coalesce("last_seq", F.lit(-1))).drop("last_seq")

        def restored(windows: DataFrame) -> DataFrame:
            return windows.withColumn("type", F.lit(S.TRADE)).select(*CONTEXT)

        runs = materialize(d.sweep_runs(with_state("sweep", trade), s["Sweep"]), "stream-sweep")
        bands = materialize(d.absorption_windows(with_state("absorption", trade), s["Absorption"]), "stream-absorption")
        is_quote = F.col("type").isin(S.BID_UPDATE, S.ASK_UPDATE)
        quotes = with_state("replenishment", is_quote)
        levels = materialize(
            d.replenishment_windows(quotes, s["Replenishment"], before["empty"] if before else None), "stream-levels"
        )
        stop_rows = with_state("stop", trade)
        stops = materialize(d.stop_run(stop_rows, s["Stop-Run"], seen, before["fires"] if before else None), "stream-stops")
        events = with_state("regime")
        found = d.sweeps_of(runs, s["Sweep"])
        for one in (
            d.absorptions_of(bands, s["Absorption"]), d.replenishments_of(levels, s["Replenishment"]), stops,
            d.market_regime(events, s["Market Regime"]),
        ):
            found = found.unionByName(one)
        found = found.withColumn("_told", F.to_json("measurements"))
        found = materialize(after(found, known) if before else found, "stream-found")
        out = found
        if before:
            same = [S.KEY, "detector", "seq", "price_ticks", "bias", "text", "_told"]
            out = found.join(before["told"], same, "left_anti").withColumn("is_withdrawn", F.lit(False)).unionByName(
                before["told"].join(found, same, "left_anti").withColumn("is_withdrawn", F.lit(True))
            )
        else:
            out = out.withColumn("is_withdrawn", F.lit(False))
        out = out.drop("_told").withColumn("is_too_late", F.lit(False))
        if before:
            unplaced = d._detection(late, "Too Late", F.lit("None"), F.lit("Older than the history kept"), {"quantity": F.col("quantity")})
            out = out.unionByName(unplaced.withColumns({"is_withdrawn": F.lit(False), "is_too_late": F.lit(True)}))

        newest = events.groupBy(S.KEY).agg(F.max("ts_us").alias("_end"))
        settled = events.join(newest, S.KEY).where(F.col("ts_us") < F.col("_end") - lateness_us).groupBy(S.KEY).agg(
            F.max(F.struct("seq", "ts_us")).alias("r")
        ).select(S.KEY, F.col("r.seq").alias("last_seq"), F.col("r.ts_us").alias("last_us"))
        if before:
            # the rows that come in may leave an instrument as it is
            settled = settled.unionByName(known).groupBy(S.KEY).agg(F.max("last_seq").alias("last_seq"), F.max("last_us").alias("last_us"))
        settled = materialize(settled, "stream-settled")

        open_levels = _unsettled(levels, d.QUOTED, "window_id", settled)
        first_open = open_levels.groupBy(*d.QUOTED).agg(F.min("seq").alias("_first"))
        signal = F.when(F.col("size") == 0, True).when(F.col("size") >= s["Replenishment"].min_size, False)
        earlier = levels.join(first_open, d.QUOTED).where(F.col("seq") < F.col("_first"))
        flags = earlier.where(signal.isNotNull()).groupBy(*d.QUOTED).agg(F.max_by(signal, "seq").alias("_empty"))
        fires = stops.join(settled, S.KEY).where(F.col("seq") <= F.col("last_seq")).groupBy(S.KEY).agg(
            F.max(F.struct("seq", F.unix_micros("ts").alias("us"))).alias("f")
        ).select(S.KEY, F.array("f.seq", "f.us").alias("_initial"))
        if before:
            # a level still in its first window of this batch keeps the flag it came with
            flags = flags.unionByName(before["empty"].join(flags, d.QUOTED, "left_anti"))
            fires = fires.unionByName(before["fires"].join(fires, S.KEY, "left_anti"))
        regime = _recent(events, s["Market Regime"].window_us, settled)
        # what stood before the look-back: the newest row of each type that is not in it
        others = events.join(regime.select(S.KEY, "seq"), [S.KEY, "seq"], "left_anti")
        latest = others.groupBy(S.KEY, "type").agg(F.max(F.struct("seq", *[c for c in CONTEXT if c not in (S.KEY, "seq", "type")])).alias("r"))
        latest = latest.select(S.KEY, "type", "r.*").select(*CONTEXT)
        return out, {
            "sweep": restored(_unsettled(runs, [S.KEY], "run_id", settled)),
            "absorption": restored(_unsettled(bands, [S.KEY], "window_id", settled)),
            "replenishment": open_levels.select(
                S.KEY, "seq", "ts_us", "type", "price_ticks", F.col("size").alias("quantity"), F.lit(0).alias("aggressor")
            ),
            "empty": flags,
            "stop": _recent(stop_rows, s["Stop-Run"].lookback_us, settled),
            "fires": fires,
            "regime": regime.unionByName(latest),
            "settled": settled,
            "told": after(found, settled),
        }

    return step


def stream_detectors(
    stream: DataFrame, path: str, settings: dict[str, object] | None = None, lateness_us: int = 10_000_000
) -> DataStreamWriter:
    return carried(stream, detectors_step(settings, lateness_us), path)


def stream_isolate_faults(stream: DataFrame, path: str) -> DataStreamWriter:
    """Rows that cannot be processed go to quarantine (with a reason) instead of failing the job."""

    def on_batch(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            good = F.coalesce(quality.is_valid_event(), F.lit(False))
            batch.where(good).write.mode("overwrite").parquet(f"{path}/out/batch_id={batch_id}")
            reason = (
                F.when(F.col(S.KEY).isNull() | F.col("seq").isNull() | F.col("ts").isNull(), "missing identity")
                .when(F.coalesce(~F.col("type").between(S.ADD, S.SEQUENCE_GAP), F.lit(True)), "unknown type")
                .otherwise("bad price or size")
            )
            batch.where(~good).withColumn("reason", reason).write.mode("overwrite").parquet(
                f"{path}/quarantine/batch_id={batch_id}"
            )
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(on_batch).option("checkpointLocation", f"{path}/checkpoint")
