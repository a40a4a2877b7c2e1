"""Order books as tables: sizes per level with the stretch of sequence they hold for.

Nothing is replayed.  A level is shown for stretches of the sequence; the best
price at a point is the highest (lowest) among the levels whose stretch covers
it, so best prices are a join of points with stretches, slice by slice.  A book
checkpoint is the last size of each level before a slice.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom import schema as S
from tickloom.plans import count_, first_, last_, materialize, previous, running
from tickloom.plans.grouped import grouped_map
from tickloom.plans.scan import slice_of, slice_rows

LEVEL = ["instrument_id", "side", "price_ticks"]


def _is_reset() -> Column:
    return F.col("type").isin(S.SNAPSHOT_START, S.BOOK_CLEAR)


def _is_update() -> Column:
    return F.col("type").isin(S.BID_UPDATE, S.ASK_UPDATE) | (
        F.col("type").isin(S.ADD, S.MODIFY, S.CANCEL) & F.col("side").isin(S.BID, S.ASK)
    )


def _size() -> Column:
    return F.when(F.col("type") == S.CANCEL, F.lit(0).cast("long")).otherwise(F.col("quantity"))


def book_rows(df: DataFrame) -> DataFrame:
    """Depth updates (side, price, size) and resets, each with the number of resets so far."""
    if "ts_us" not in df.columns:
        df = df.withColumn("ts_us", F.unix_micros("ts"))
    size = _size()
    side = F.when(F.col("type") == S.BID_UPDATE, S.BID).when(F.col("type") == S.ASK_UPDATE, S.ASK).otherwise(F.col("side"))
    rows = df.where(_is_reset() | (_is_update() & (size >= 0))).select(
        S.KEY, "seq", "ts_us", "type", side.cast("int").alias("side"), "price_ticks", size.alias("size")
    )
    return running(rows, [S.KEY], epoch=count_(_is_reset()))


def book_levels_asof(df: DataFrame, at: int | None = None) -> DataFrame:
    """Displayed size per level as of sequence ``at`` (the end if not given)."""
    rows = df if at is None else df.where(F.col("seq") <= at)
    resets = rows.where(_is_reset()).groupBy(S.KEY).agg(F.max("seq").alias("_reset"))
    size = _size()
    side = F.when(F.col("type") == S.BID_UPDATE, S.BID).when(F.col("type") == S.ASK_UPDATE, S.ASK).otherwise(F.col("side"))
    updates = rows.where(_is_update() & (size >= 0)).select(
        S.KEY, "seq", side.cast("int").alias("side"), "price_ticks", size.alias("size")
    )
    live = updates.join(resets, S.KEY, "left").where(F.col("seq") > F.coalesce("_reset", F.lit(-1)))
    return live.groupBy(*LEVEL).agg(F.max_by("size", "seq").alias("size")).where(F.col("size") > 0)


def level_intervals(df: DataFrame) -> DataFrame:
    """Each displayed size with the sequences [from_seq, to_seq) it holds for; open ends are NULL."""
    rows = book_rows(df)
    resets = rows.where(_is_reset()).select(S.KEY, (F.col("epoch") - 1).alias("epoch"), F.col("seq").alias("_reset"))
    updates = rows.where(~_is_reset())
    chained = running(updates, [*LEVEL, "epoch"], _next=first_("seq", exclusive=True))
    return chained.join(resets, [S.KEY, "epoch"], "left").where(F.col("size") > 0).select(
        S.KEY, "epoch", "side", "price_ticks", "size", F.col("seq").alias("from_seq"),
        F.coalesce("_next", "_reset").alias("to_seq"),
    )


def stretches(df: DataFrame) -> DataFrame:
    """When each level is shown, whatever its size: [from_seq, to_seq), open ends NULL.

    Only flips (an empty level shown, a shown one emptied) go on; they are
    stored, since their successors are looked up among them.
    """
    rows = book_rows(df)
    resets = rows.where(_is_reset()).select(S.KEY, (F.col("epoch") - 1).alias("epoch"), F.col("seq").alias("_reset"))
    updates = rows.where(~_is_reset()).select(*LEVEL, "epoch", "seq", (F.col("size") > 0).alias("shown"))
    seen = running(updates, [*LEVEL, "epoch"], _was=last_("shown", exclusive=True))
    flips = seen.where(F.col("shown") != F.coalesce("_was", F.lit(False))).drop("_was")
    ends = running(materialize(flips, "flips"), [*LEVEL, "epoch"], _next=first_("seq", exclusive=True))
    return ends.where("shown").join(resets, [S.KEY, "epoch"], "left").select(
        *LEVEL, F.col("seq").alias("from_seq"), F.coalesce("_next", "_reset").alias("to_seq")
    )


#: Neighbouring units of one level of ``pieces`` that make a unit of the next, and levels above the slices.
FAN, LEVELS = 64, 5


def pieces(spans: DataFrame, every: int) -> DataFrame:
    """Cut [from_seq, to_seq) at slice borders without a row for each slice between.

    The first and the last slice get a piece each.  The whole slices between
    form a range of larger units, which is cut the same way at every ``FAN``th
    of them, and so on: level 0 counts in sequences, level n in
    ``every * FAN ** (n - 1)``.  Gives level, group (of units), low, high.
    """
    cut, made = spans, []
    low, high = F.col("from_seq"), F.col("to_seq")
    for level in range(LEVELS + 1):
        size = every if level == 0 else FAN
        cut = cut.withColumns({f"_a{level}": low, f"_b{level}": high})
        a, b = F.col(f"_a{level}"), F.col(f"_b{level}")
        cut = cut.withColumns({f"_f{level}": slice_of(a, size), f"_l{level}": slice_of(b - 1, size)})
        first, last = F.col(f"_f{level}"), F.col(f"_l{level}")

        def piece(group: Column, low: Column, high: Column, level=level) -> Column:
            return F.struct(F.lit(level).alias("level"), group.alias("group"), low.alias("low"), high.alias("high"))

        one = F.when((a < b) & (first == last), piece(first, a, b))
        left = F.when((a < b) & (first < last), piece(first, a, (first + 1) * size))
        right = F.when((a < b) & (first < last), piece(last, last * size, b))
        made += [one, left, right]
        low, high = F.when(a < b, first + 1), F.when(a < b, last)
    cut = cut.withColumn("_p", F.explode(F.array_compact(F.array(*made))))
    return cut.select(*spans.columns, "_p.level", "_p.group", "_p.low", "_p.high")


def _covering(parts: DataFrame, slices: DataFrame) -> DataFrame:
    """Best prices among the levels that are shown throughout a slice, for each of ``slices`` (instrument_id, _slice)."""
    best = (
        parts.where("level > 0").withColumn("unit", F.explode(F.sequence("low", F.col("high") - 1)))
        .groupBy(S.KEY, "level", "unit").agg(*_best("price_ticks"))
    )
    units = F.array(*[F.struct(F.lit(n).alias("level"), slice_of("_slice", FAN ** (n - 1)).alias("unit")) for n in range(1, LEVELS + 1)])
    asked = slices.withColumn("_u", F.explode(units)).select(S.KEY, "_slice", "_u.level", "_u.unit")
    return asked.join(best, [S.KEY, "level", "unit"]).groupBy(S.KEY, "_slice").agg(
        F.max("best_bid").alias("best_bid"), F.min("best_ask").alias("best_ask")
    )


def _best(price: str) -> list[Column]:
    return [
        F.max(F.when(F.col("side") == S.BID, F.col(price))).alias("best_bid"),
        F.min(F.when(F.col("side") == S.ASK, F.col(price))).alias("best_ask"),
    ]


def highest_over(count: int, low: np.ndarray, high: np.ndarray, value: np.ndarray, nothing: int) -> np.ndarray:
    """At each of ``count`` places the highest value of the ranges [low, high) that cover it.

    A range is entered as two overlapping ranges of a power of two; these are
    then halved, longest first, down to single places.
    """
    some = low < high
    low, high, value = low[some], high[some], value[some]
    depth = np.frexp((high - low).astype(float))[1] - 1  # exponent of the largest power of two inside
    top = np.full(count, nothing, dtype=np.int64)
    for d in range(int(depth.max()) if len(depth) else 0, -1, -1):
        mine, width = depth == d, 1 << d
        for at in (low[mine], high[mine] - width):
            np.maximum.at(top, at, value[mine])
        if d:
            half = width >> 1
            moved = np.full(count, nothing, dtype=np.int64)
            moved[half:] = top[: count - half]
            # an entry stands for a range of ``width``; both its halves take it over
            top = np.maximum(top, moved)
    return top


NOTHING = -(1 << 62)


def _best_of_slice(columns: list[str]):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        """Best prices at the asked sequences of a slice, from the pieces of levels in it and what covers it."""
        low = pdf["low"].to_numpy(dtype=float, na_value=np.nan)
        asked = pdf[np.isnan(low) & pdf["seq"].notna().to_numpy()]
        part = pdf[~np.isnan(low)]
        cover = pdf[pdf["seq"].isna() & np.isnan(low)]
        out = asked[columns].copy()
        seq = asked["seq"].to_numpy(dtype=np.int64)
        bounds = [np.searchsorted(seq, part[c].to_numpy(dtype=np.int64)) for c in ("low", "high")]
        side, price = (part[c].to_numpy(dtype=np.int64) for c in ("side", "price_ticks"))
        for name, code, sign in (("best_bid", S.BID, 1), ("best_ask", S.ASK, -1)):
            mine = side == code
            best = highest_over(len(seq), bounds[0][mine], bounds[1][mine], sign * price[mine], NOTHING)
            over = cover[name].dropna() if len(cover) else cover
            if len(over):
                best = np.maximum(best, sign * int(over.iloc[0]))
            out[name] = pd.array(np.where(best == NOTHING, 0, sign * best), dtype="Int64")
            out.loc[best == NOTHING, name] = pd.NA
        return out

    return run


def best_prices(df: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """``points`` (instrument_id, seq, others) with the best bid and ask shown as of each, NULL where a side is empty.

    Without ``points``, after every depth update and reset. The points of a slice meet the levels shown in a part of it; what is shown
    throughout comes as one pair of prices.
    """
    every = slice_rows(df.sparkSession)
    if points is None:
        points = df.where(_is_reset() | (_is_update() & (_size() >= 0))).select(S.KEY, "seq")
    asked = points.withColumn("_slice", slice_of("seq", every))
    last = asked.groupBy(S.KEY).agg(F.max("seq").alias("_last"))
    # a level that stays to the end of the tape is shown up to the last point asked for
    shown = stretches(df).join(last, S.KEY).select(*LEVEL, "from_seq", F.coalesce("to_seq", F.col("_last") + 1).alias("to_seq"))
    parts = materialize(pieces(shown.where("from_seq < to_seq"), every), "pieces")
    inside = parts.where("level = 0").select(S.KEY, F.col("group").alias("_slice"), "side", "price_ticks", "low", "high")
    rows = asked.unionByName(inside, allowMissingColumns=True)
    if not parts.where("level > 0").isEmpty():  # on a tape of one or two slices nothing stands throughout one
        rows = rows.unionByName(_covering(parts, asked.select(S.KEY, "_slice").distinct()), allowMissingColumns=True)
    body = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema)
    return grouped_map(
        rows, [S.KEY, "_slice"], ["seq"], _best_of_slice(points.columns), f"{body}, best_bid bigint, best_ask bigint"
    )


def best_bid_ask(df: DataFrame, samples: DataFrame) -> DataFrame:
    """Best prices and spread as of sampled sequences (instrument_id, seq)."""
    return best_prices(df, samples).withColumn("spread", F.col("best_ask") - F.col("best_bid"))


def standing_spans(rows: DataFrame, every: int) -> tuple[DataFrame, DataFrame]:
    """Sizes with the slices (_n, _until] they stand before, no further than the next reset, and the slices that have rows."""
    sliced = rows.withColumn("_slice", slice_of("seq", every))
    in_order = Window.partitionBy(S.KEY).orderBy("_slice")
    # slices that have rows, numbered without gaps
    slices = sliced.groupBy(S.KEY, "_slice").agg(F.count_if(_is_reset()).alias("_resets")).select(
        S.KEY, "_slice", F.row_number().over(in_order).alias("_n"),
        F.coalesce(F.sum("_resets").over(in_order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("epoch"),
    )
    last = sliced.where(~_is_reset()).groupBy(*LEVEL, "_slice").agg(
        F.max_by(F.struct("size", "epoch"), "seq").alias("_l")
    )
    by_level = Window.partitionBy(*LEVEL).orderBy("_n")
    # what no slice begins with is reset before the slice after it
    ends = slices.groupBy(S.KEY, "epoch").agg(F.max("_n").alias("_end"))
    spans = (
        last.join(slices.select(S.KEY, "_slice", "_n"), [S.KEY, "_slice"]).withColumn("_until", F.lead("_n").over(by_level))
        .withColumn("epoch", F.col("_l.epoch")).join(ends, [S.KEY, "epoch"])
        .select(*LEVEL, "_l.size", "_n", F.least("_until", "_end").alias("_until"))
        .where((F.col("size") > 0) & (F.col("_until") > F.col("_n")))
    )
    return spans, slices.select(S.KEY, "_slice", "_n")


def snapshots(rows: DataFrame, every: int) -> DataFrame:
    """Levels standing before each slice of ``every`` sequences that has rows (from ``book_rows``)."""
    spans, slices = standing_spans(rows, every)
    standing = spans.withColumn("_n", F.explode(F.sequence(F.col("_n") + 1, F.col("_until"))))
    return standing.join(slices, [S.KEY, "_n"]).select(*LEVEL, "size", "_slice")


def cumulative_depth(levels: DataFrame, n: int) -> DataFrame:
    """Total size of the best ``n`` levels per side."""
    outward = F.when(F.col("side") == S.BID, -F.col("price_ticks")).otherwise(F.col("price_ticks"))
    best_first = Window.partitionBy(S.KEY, "side").orderBy(outward)
    return levels.withColumn("_rank", F.row_number().over(best_first)).where(F.col("_rank") <= n).groupBy(
        S.KEY, "side"
    ).agg(F.sum("size").alias("depth"), F.count(F.lit(1)).alias("levels"))


def size_at(levels: DataFrame, side: int, price: int) -> DataFrame:
    return levels.where((F.col("side") == side) & (F.col("price_ticks") == price)).select(S.KEY, "size")


#: What is said of a book; the first holds before any event.
REASONS = ("awaiting snapshot", "rebuilding from snapshot", "ok", "sequence gap", "negative size rejected")


def book_validity(df: DataFrame, sticky_gap: bool = True) -> DataFrame:
    """Why the book cannot be trusted after each event (NULL: valid).

    A gap invalidates it until the next snapshot; with ``sticky_gap=False`` the
    next update revalidates.
    """
    kind = F.col("type")
    is_bad = _is_update() & (F.col("quantity") < 0) & (kind != S.CANCEL)
    slim = df.select(S.KEY, "seq", "type", "side", "price_ticks", "quantity")
    states = running(
        slim, [S.KEY],
        in_snapshot=last_(F.when(kind == S.SNAPSHOT_START, True).when(kind == S.SNAPSHOT_END, False)),
        in_gap=last_(
            F.when(kind == S.SEQUENCE_GAP, True)
            .when(kind.isin(S.SNAPSHOT_START, S.SNAPSHOT_END, S.BOOK_CLEAR), False)
        ),
    )
    held = F.coalesce("in_snapshot", F.lit(False))
    if sticky_gap:
        held = held | F.coalesce("in_gap", F.lit(False))
    reason = (
        F.when(kind == S.SNAPSHOT_START, "rebuilding from snapshot")
        .when(kind == S.SNAPSHOT_END, "ok")
        .when(kind == S.BOOK_CLEAR, "awaiting snapshot")
        .when(kind == S.SEQUENCE_GAP, "sequence gap")
        .when(is_bad, "negative size rejected")
        .when(_is_update() & ~held, "ok")
    )
    # by number through the slices, by name at the end
    code = F.array_position(F.array(*map(F.lit, REASONS)), reason).cast("int")
    reasons = running(states.withColumn("_reason", F.nullif(code, F.lit(0))), [S.KEY], reason=last_("_reason"))
    priced = best_prices(df, reasons.select(S.KEY, "seq", "type", "reason"))
    crossed = F.col("best_bid") >= F.col("best_ask")
    named = F.element_at(F.array(*map(F.lit, REASONS)), F.coalesce("reason", F.lit(1)))
    return priced.withColumn("reason", named).withColumn(
        "reason", F.when(F.col("reason") != "ok", F.col("reason")).when(crossed, "crossed book")
    )


def book_checkpoints(df: DataFrame, every: int) -> DataFrame:
    """Both sides of the book before every ``every``-th sequence, as arrays."""
    level = F.struct("price_ticks", "size")
    return snapshots(book_rows(df), every).groupBy(S.KEY, (F.col("_slice") * every).alias("before_seq")).agg(
        F.sort_array(F.collect_list(F.when(F.col("side") == S.BID, level)), asc=False).alias("bids"),
        F.sort_array(F.collect_list(F.when(F.col("side") == S.ASK, level))).alias("asks"),
    )


def book_restore(checkpoints: DataFrame, df: DataFrame, at: int) -> DataFrame:
    """The book as of ``at`` from the nearest checkpoint and the events after it."""
    usable = checkpoints.where(F.col("before_seq") <= at + 1)
    nearest = usable.groupBy(S.KEY).agg(F.max("before_seq").alias("before_seq"))
    start = usable.join(nearest, [S.KEY, "before_seq"])

    def levels(column: str, code: int) -> Column:
        return F.transform(column, lambda l: F.struct(F.lit(code).alias("side"), l["price_ticks"].alias("price_ticks"), l["size"].alias("quantity")))

    standing = start.select(
        S.KEY, (F.col("before_seq") - 1).alias("seq"), F.explode(F.concat(levels("bids", S.BID), levels("asks", S.ASK))).alias("l")
    ).select(S.KEY, "seq", (F.col("l.side") + 5).alias("type"), "l.side", "l.price_ticks", "l.quantity")
    later = df.join(nearest, S.KEY, "left").where(
        (F.col("seq") >= F.coalesce("before_seq", F.lit(0))) & (F.col("seq") <= at)
    ).select(S.KEY, "seq", "type", "side", "price_ticks", "quantity")
    return book_levels_asof(standing.unionByName(later))


def dom_ladder(levels: DataFrame, profile: DataFrame, area: DataFrame, n: int) -> DataFrame:
    """``2n + 1`` prices around the middle of the book, top down, with depth and traded volume."""
    bid, ask = F.col("side") == S.BID, F.col("side") == S.ASK
    mid = levels.groupBy(S.KEY).agg(
        F.max(F.when(bid, F.col("price_ticks"))).alias("best_bid"), F.min(F.when(ask, F.col("price_ticks"))).alias("best_ask")
    ).where(F.col("best_bid").isNotNull() & F.col("best_ask").isNotNull())
    middle = F.floor((F.col("best_bid") + F.col("best_ask")) / 2).cast("long")
    rungs = mid.select(S.KEY, F.explode(F.sequence(middle - n, middle + n)).alias("price_ticks"))
    sizes = levels.groupBy(S.KEY, "price_ticks").agg(
        F.sum(F.when(bid, F.col("size"))).alias("bid_size"), F.sum(F.when(ask, F.col("size"))).alias("ask_size")
    )
    traded = profile.select(S.KEY, "price_ticks", F.col("sell").alias("traded_bid"), F.col("buy").alias("traded_ask"))
    zero = F.lit(0).cast("long")
    rows = rungs.join(sizes, [S.KEY, "price_ticks"], "left").join(traded, [S.KEY, "price_ticks"], "left").join(
        area, S.KEY, "left"
    ).fillna(0, ["bid_size", "ask_size", "traded_bid", "traded_ask"])
    down = Window.partitionBy(S.KEY).orderBy(F.col("price_ticks").desc()).rowsBetween(Window.unboundedPreceding, 0)
    up = Window.partitionBy(S.KEY).orderBy("price_ticks").rowsBetween(Window.unboundedPreceding, 0)

    def at(level: str) -> Column:
        return F.coalesce(F.col("price_ticks") == F.col(level), F.lit(False))

    return rows.select(
        S.KEY, "price_ticks", "bid_size", "ask_size",
        F.sum("bid_size").over(up).alias("cumulative_bid"), F.sum("ask_size").over(down).alias("cumulative_ask"),
        "traded_bid", "traded_ask", (F.col("traded_bid") + F.col("traded_ask")).alias("traded"),
        (F.col("traded_ask") - F.col("traded_bid")).alias("delta"),
        at("poc").alias("is_poc"), at("vah").alias("is_vah"), at("val").alias("is_val"),
    )


def pull_stack(df: DataFrame, threshold: int = 1) -> DataFrame:
    """Size pulled and stacked per level, and how often it came back after running out."""
    quotes = df.where(F.col("type").isin(S.BID_UPDATE, S.ASK_UPDATE)).select(
        S.KEY, (F.col("type") - 5).cast("int").alias("side"), "price_ticks", "seq",
        F.greatest(F.lit(0).cast("long"), "quantity").alias("size"),
    )
    chained = previous(quotes, LEVEL, _before="size")
    change = F.col("size") - F.col("_before")
    low = F.col("size") <= threshold
    # running out needs a decrease (or the first sighting); coming back an increase above the threshold
    signal = F.when(low & (F.col("_before").isNull() | (change < 0)), True).when(~low & (change > 0), False)
    flagged = running(chained.withColumn("_change", change), LEVEL, _was_low=last_(signal, exclusive=True))
    back = F.coalesce("_was_low", F.lit(False)) & ~low & (F.col("_change") > 0)
    zero = F.lit(0).cast("long")
    return flagged.groupBy(*LEVEL).agg(
        F.sum(F.when(F.col("_change") < 0, -F.col("_change")).otherwise(zero)).alias("pulled"),
        F.sum(F.when(F.col("_change") > 0, F.col("_change")).otherwise(zero)).alias("stacked"),
        F.count_if(back).alias("replenishments"),
    )
