"""Exact substring deduplication over sampled suffixes of UTF-8 bytes.

Every string of ``length`` bytes has one anchor: of the ``LEAD``-byte tokens
that lie in it, the rightmost with the smallest hash. Equal strings have their
anchors at the same place, so only suffixes that start at anchors are looked
at, about one in 180 bytes. An anchor answers for a short interval of starts;
the bytes of all strings that start there are its context.

1. Contexts are counted by 128-bit hashes. One that stands anywhere twice is
   repeated as a whole; exact copies end here and are never compared.
2. Prefilters, by hash. A string that reaches over an anchor holds 200 bytes to
   its right, or 200 to its left and the token; of distinct contexts, only
   those that share such a half with another can share a string, and their
   bytes are fetched. Strings that begin less than a step (25 bytes)
   apart share all but 24 bytes, their core; only starts whose core another context
   has, too, go on.
3. The suffixes at the anchors are range-partitioned at sampled splitters, by
   all their bytes and then by the bytes to their left, read backwards, and
   every bucket is sorted by multikey quicksort. What neighbours have in common
   (the longest common prefix) says which suffixes agree for how long; a second
   order of the bucket, by the left sides, says the same to the left. A start
   is repeated if another suffix agrees for all it needs to the right and to
   the left. Starts that need more than half of their bytes to the left are
   found the same way with the sides exchanged.
4. A run of suffixes that agree may go on in the next bucket. Strings of runs
   that reach a bucket's end are compared across buckets: one row for each
   different string, not for each suffix that has it.
5. Repeated starts are brought back to the documents, and what their strings
   cover is removed.

A token, or a passage, that a third of all texts share is split over buckets
like any other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rolling import BASES, RUN_BYTES, VALUES, mixed, prefix_sums, spans, text_runs
from tickloom.llm.scratch import Scratch, row_key
from tickloom.llm.sketch import BLOCK_SCHEMA, Sketch, merged_sketch, sketch_batches

LENGTH, LEAD = 400, 32
#: Bits of an anchor's order that hold its place; the rest is its token's hash.
PLACE_BITS = 34
CELLS = 1 << 26
#: Steps that a string's bytes are cut into; starts of one step have a core in common.
STEPS = 16
#: Bytes of suffixes that a bucket holds on average.
BUCKET_BYTES = 4 << 20
NO_ID = -(1 << 63)

ANCHOR_SCHEMA = "id long, row_key long, first int, starts int, c1 long, c2 long, right long, left long"
CONTEXT_SCHEMA = "c1 long, c2 long, least int, most int, right binary, left binary"
CORE_SCHEMA = "c1 long, c2 long, step int, core long"
COMPARED_SCHEMA = "c1 long, c2 long, low int, high int, ahead int, h1 long, h2 long"


def sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours, from running minima of blocks in both directions."""
    count = len(keys) - width + 1
    blocks = -(-len(keys) // width)
    padded = np.full(blocks * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(keys)] = keys
    grid = padded.reshape(blocks, width)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:count], ahead[width - 1: width - 1 + count])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, lead: int = LEAD) -> dict[str, np.ndarray]:
    """Anchors of a run of texts: text number, anchor, first and last start it answers for, hashes of context and halves."""
    none = {n: np.zeros(0, np.int64) for n in ("text", "anchor", "first", "last", "c1", "c2", "right", "left")}
    if len(data) < length:
        return none
    sums = [prefix_sums(VALUES[data], base) for base in BASES[:2]]
    at = np.arange(len(data) - lead + 1)
    hashes = mixed(spans(sums[0], at, at + lead, BASES[0]))
    low = np.uint64((1 << PLACE_BITS) - 1)
    order = (hashes & ~low) | (low - at.astype(np.uint64))
    chosen = (low - (sliding_least(order, length - lead + 1) & low)).astype(np.int64)
    start = np.arange(len(chosen))
    text = np.searchsorted(offsets, start, "right") - 1
    valid = start + length <= offsets[text + 1]
    start, text, chosen = start[valid], text[valid], chosen[valid]
    if not len(start):
        return none
    new = np.ones(len(start), bool)
    new[1:] = (chosen[1:] != chosen[:-1]) | (text[1:] != text[:-1])
    begin = np.flatnonzero(new)
    end = np.concatenate((begin[1:], [len(start)])) - 1
    first, last, anchor, text = start[begin], start[end], chosen[begin], text[begin]
    shape = mixed(((anchor - first) << 20 | (last - first)).astype(np.uint64))
    context = [mixed(spans(s, first, last + length, b) ^ shape).view(np.int64) for s, b in zip(sums, BASES, strict=False)]
    half = length // 2
    # a half that no start of this anchor reaches is null: 0 marks it
    right = np.where(anchor - last <= half, mixed(spans(sums[0], anchor, np.minimum(anchor + half, len(data)), BASES[0])), 0).view(np.int64)
    left = np.where(anchor - first > half, mixed(spans(sums[0], np.maximum(anchor - half, 0), anchor + lead, BASES[0]) + np.uint64(1)), 0).view(np.int64)
    return {"text": text, "anchor": anchor, "first": first, "last": last, "c1": context[0], "c2": context[1], "right": right, "left": left}


def _owner_hash(c1: np.ndarray, ids: np.ndarray, keys: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of one place of one context."""
    out = c1.astype(np.int64).view(np.uint64)
    for part in (ids, keys, first.astype(np.int64)):
        out = mixed(out ^ part.astype(np.int64).view(np.uint64))
    return out


def _anchor_rows(length: int, lead: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = (batch[c].to_numpy() for c in ("id", "row_key"))
            for rows, data, offsets in text_runs(batch):
                found = anchors(data, offsets, length, lead)
                row = rows[found["text"]]
                columns = {
                    "id": ids[row], "row_key": keys[row], "first": (found["first"] - offsets[found["text"]]).astype(np.int32),
                    "starts": (found["last"] - found["first"] + 1).astype(np.int32), "c1": found["c1"], "c2": found["c2"],
                }
                arrays = {n: pa.array(c) for n, c in columns.items()}
                for side in ("right", "left"):
                    arrays[side] = pa.array(found[side], mask=found[side] == 0)
                yield pa.RecordBatch.from_pydict(arrays)

    return run


def _owner_sketch(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch_batches((_owner_hash(*(b[c].to_numpy() for c in ("c1", "id", "row_key", "first"))) for b in batches), cells)

    return run


def _context_rows(length: int, lead: int, wanted):
    """Bytes of the contexts whose place passes the sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch: Sketch = wanted.value
        for batch in batches:
            ids, keys = (batch[c].to_numpy() for c in ("id", "row_key"))
            for rows, data, offsets in text_runs(batch):
                found = anchors(data, offsets, length, lead)
                row = rows[found["text"]]
                local = (found["first"] - offsets[found["text"]]).astype(np.int32)
                pick = np.flatnonzero(sketch.passes(_owner_hash(found["c1"], ids[row], keys[row], local)))
                view = data.tobytes() if len(pick) else b""
                out: list[tuple] = []
                for i in pick:
                    first, last, anchor = (int(found[n][i]) for n in ("first", "last", "anchor"))
                    out.append((int(found["c1"][i]), int(found["c2"][i]), anchor - last, anchor - first, view[anchor: last + length], view[first: anchor][::-1]))
                if out:
                    types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["c1", "c2", "least", "most", "right", "left"])

    return run


def step_of(length: int) -> int:
    return max(1, length // STEPS)


def bounded_parts(batch: pa.RecordBatch, length: int) -> Iterator[pa.RecordBatch]:
    """Rows of contexts (under twice ``length`` bytes each) that have about RUN_BYTES together."""
    rows = max(1, RUN_BYTES // (2 * length))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def string_hashes(strings: list[bytes], length: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Two hashes of strings of ``length`` bytes, in runs (first, behind the last)."""
    count = max(1, RUN_BYTES // length)
    for at in range(0, len(strings), count):
        some = strings[at: at + count]
        data, begin = np.frombuffer(b"".join(some), np.uint8), np.arange(len(some)) * length
        yield at, at + len(some), *(mixed(spans(prefix_sums(VALUES[data], b), begin, begin + length, b)).view(np.int64) for b in BASES[1:])


def _core_rows(length: int):
    """Hash of the core of every step of starts that a context has; starts are told by the bytes they have to the left of the anchor."""
    size = step_of(length)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bounded_parts(batch, length):
                least, most = (part[c].to_numpy().astype(np.int64) for c in ("least", "most"))
                contexts = [left.as_py()[::-1] + right.as_py() for left, right in zip(part["left"], part["right"], strict=True)]
                data = np.frombuffer(b"".join(contexts), np.uint8)
                sums = prefix_sums(VALUES[data], BASES[1])
                anchor = np.cumsum([0, *map(len, contexts[:-1])]) + most
                which, step = _steps(least, most, size)
                begin = anchor[which] - size * step
                core = mixed(spans(sums, begin, begin + length - size + 1, BASES[1]))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(part["c1"].to_numpy()[which]), pa.array(part["c2"].to_numpy()[which]), pa.array(step.astype(np.int32)), pa.array(core.view(np.int64))],
                    names=["c1", "c2", "step", "core"],
                )

    return run


def _steps(least: np.ndarray, most: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and step, for each step that reaches into least..most."""
    count = most // size - least // size + 1
    which = np.repeat(np.arange(len(least)), count)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(count) - count - least // size, count)


def multikey_quicksort(strings: list[bytes]) -> list[int]:
    """Order of byte strings: three-way partition by one 8-byte word at a time, deeper only where words are equal."""
    if not strings:
        return []
    width = -(-max(map(len, strings)) // 8) or 1
    words = np.frombuffer(b"".join(s.ljust(8 * width, b"\0") for s in strings), ">u8").astype(np.uint64).reshape(len(strings), width)
    order, todo = [], [(np.arange(len(strings)), 0)]
    while todo:
        rows, depth = todo.pop()
        if len(rows) <= 32 or depth == width:
            order += sorted(rows.tolist(), key=strings.__getitem__)
            continue
        column = words[rows, depth]
        pivot = np.sort(column[:: max(1, len(rows) // 31)])[-1 - len(column[:: max(1, len(rows) // 31)]) // 2]
        for part, below in ((column > pivot, depth), (column == pivot, depth + 1), (column < pivot, depth)):
            if part.any():
                todo.append((rows[part], below))
    return order


def common_prefixes(strings: list[bytes], order: np.ndarray, longest: int) -> np.ndarray:
    """For each place of the order how many bytes its string shares with the one before (0 for the first), ``longest`` at most."""
    sizes = np.array([min(len(strings[i]), longest) for i in order], np.int64)
    grid = np.frombuffer(b"".join(strings[i][:longest].ljust(longest, b"\0") for i in order), np.uint8).reshape(len(order), longest)
    out = np.zeros(len(order), np.int64)
    for at in range(1, len(order), 4096):
        part = slice(at, min(len(order), at + 4096))
        unlike = grid[part] != grid[at - 1: part.stop - 1]
        out[part] = np.where(unlike.any(axis=1), unlike.argmax(axis=1), longest)
    out[1:] = np.minimum(out[1:], np.minimum(sizes[1:], sizes[:-1]))
    return out


def _ordered(strings: list[bytes], longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Place of each string in the sorted order, and the common prefixes by place."""
    order = np.array(multikey_quicksort(strings), np.int64)
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return place, common_prefixes(strings, order, longest)


def _intervals(which: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted (context, offset) pairs as intervals of neighbouring offsets."""
    new = np.ones(len(which), bool)
    new[1:] = (which[1:] != which[:-1]) | (offset[1:] != offset[:-1] + 1)
    begin = np.flatnonzero(new)
    end = np.concatenate((begin[1:], [len(which)])) - 1 if len(begin) else begin
    return which[begin], offset[begin], offset[end]


def compare_bucket(right: list[bytes], left: list[bytes], least: np.ndarray, most: np.ndarray, steps: np.ndarray, length: int, reverse: bool):
    """Repeated starts among the suffixes of a bucket, and the strings of its outer runs.

    A start is told by how many bytes it has ahead of the anchor, ``least`` to
    ``most``; only those of ``steps`` (bits) count. ``left`` is read backwards
    from the anchor. Buckets are cut by the right side or, with ``reverse``, by
    the left. Yields per number of bytes ahead: rows with a repeated start, and
    of each different outer string one row, and whether it is repeated here.
    """
    main, other = (left, right) if reverse else (right, left)
    place, shared = _ordered([m + o for m, o in zip(main, other, strict=True)], length)
    back, alike = _ordered(other, length)
    top, size = len(main) - 1, step_of(length)
    for ahead in range(int(least.min()), int(most.max()) + 1):
        rows = np.flatnonzero((least <= ahead) & (ahead <= most) & (steps >> (ahead // size) & 1 == 1))
        if not len(rows):
            continue
        need = ahead if reverse else length - ahead
        # neighbours agree in the bytes needed of each side
        run, side = np.cumsum(shared < need), np.cumsum(alike < length - need)
        mine = run[place[rows]]
        _, first, kind, count = np.unique(mine * (top + 2) + side[back[rows]], return_index=True, return_inverse=True, return_counts=True)
        outer = first[(mine[first] == run[0]) | (mine[first] == run[top])]
        again = count[kind] > 1
        yield ahead, rows[again], rows[outer], again[outer]


def _compare(length: int):
    """Buckets of suffixes: intervals of repeated starts (low, high), and strings of outer runs (ahead, h1, h2; without c1 where repeated already)."""
    def rows(c1: np.ndarray, c2: np.ndarray, known: np.ndarray | None = None, **more: np.ndarray) -> pa.RecordBatch:
        columns = {n: pa.array(c, pa.int64(), mask=known) for n, c in (("c1", c1), ("c2", c2))}
        for name, kind in (("low", pa.int32()), ("high", pa.int32()), ("ahead", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64())):
            columns[name] = pa.array(more[name].astype(kind.to_pandas_dtype()), kind) if name in more else pa.nulls(len(c1), kind)
        return pa.RecordBatch.from_pydict(columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        for reverse in (0, 1):
            part = table.filter(pa.array(table["reverse"].to_numpy() == reverse))
            if not part.num_rows:
                continue
            c1, c2, least, most, steps = (part[c].to_numpy().astype(np.int64) for c in ("c1", "c2", "least", "most", "steps"))
            right, left = part["right"].to_pylist(), part["left"].to_pylist()
            found: list[tuple[np.ndarray, np.ndarray]] = []
            for ahead, repeated, outer, known in compare_bucket(right, left, least, most, steps, length, bool(reverse)):
                found.append((repeated, most[repeated] - ahead))
                strings = [left[i][:ahead][::-1] + right[i][: length - ahead] for i in outer]
                for a, b, h1, h2 in string_hashes(strings, length):
                    yield rows(c1[outer[a:b]], c2[outer[a:b]], known[a:b], ahead=np.full(b - a, ahead), h1=h1, h2=h2)
            which, offset = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64),) * 2
            by = np.lexsort((offset, which))
            at, lows, highs = _intervals(which[by], offset[by])
            yield rows(c1[at], c2[at], low=lows, high=highs)

    return run


def _removed(length: int, with_bytes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, lows, highs in zip(*(batch[c] for c in ("doc_id", "text", "lows", "highs")), strict=True):
                data = (text.as_py() or "").encode()
                pieces, at, removed, runs = [], 0, 0, 0
                if lows.is_valid:
                    low, high = (x.values.to_numpy() for x in (lows, highs))
                    end = -1
                    for i in np.argsort(low, kind="stable").tolist():
                        a, b = int(low[i]), int(high[i]) + length
                        if a > end:
                            if end >= 0:
                                at = end
                            pieces.append(data[at:a])
                            runs, end, at = runs + 1, a, a
                        if b > end:
                            removed += b - end
                            end = b
                    at = end if end >= 0 else 0
                pieces.append(data[at:])
                left = b"".join(pieces)
                rows.append((doc_id.as_py(), len(data), removed, runs, hashlib.sha256(left).hexdigest(), left if with_bytes else None))
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, types, strict=True)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    return run


def repeated_starts(base: DataFrame, scratch: Scratch, length: int, lead: int, cells: int) -> DataFrame:
    """Intervals of starts whose string also starts elsewhere, per row: id, row_key, lows, highs (arrays)."""
    spark = base.sparkSession
    found = scratch.keep(base.mapInArrow(_anchor_rows(length, lead), ANCHOR_SCHEMA), "anchors")
    # one row per distinct context, with one of its places
    distinct = scratch.keep(found.groupBy("c1", "c2").agg(
        F.count("*").alias("n"), F.min(F.struct("id", "row_key", "first")).alias("at"), F.min("starts").alias("starts"), F.min("right").alias("right"), F.min("left").alias("left")
    ), "distinct")
    halves = distinct.select("c1", "n", "at", F.explode(F.array(
        F.struct(F.lit(0).alias("side"), F.col("right").alias("half")), F.struct(F.lit(1).alias("side"), F.col("left").alias("half"))
    )).alias("h")).select("c1", "at", "h.side", "h.half").where("half IS NOT NULL")
    shared = scratch.keep(halves.groupBy("side", "half").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared")
    owners = scratch.keep(halves.join(shared, ["side", "half"]).select("c1", "at.id", "at.row_key", "at.first"), "owners")
    wanted = spark.sparkContext.broadcast(merged_sketch(owners.mapInArrow(_owner_sketch(cells), BLOCK_SCHEMA), 1, cells))
    contexts = scratch.keep(base.mapInArrow(_context_rows(length, lead, wanted), CONTEXT_SCHEMA).dropDuplicates(["c1", "c2"]), "contexts")
    wanted.destroy()
    scratch.drop("shared", "owners")
    cores = scratch.keep(contexts.mapInArrow(_core_rows(length), CORE_SCHEMA), "cores")
    shared = scratch.keep(cores.groupBy("step", "core").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "shared_cores")
    # bits of the steps whose starts may be repeated; nearer ones by the right side, farther ones by the left
    alive = cores.join(shared, ["step", "core"]).groupBy("c1", "c2").agg(F.bit_or(F.expr("shiftleft(1L, step)")).alias("steps"))
    middle = length // 2 // step_of(length)
    sides = F.array(*[
        F.struct(F.lit(reverse).alias("reverse"), F.col("steps").bitwiseAND(F.lit(mask)).alias("steps"))
        for reverse, mask in ((0, (1 << middle) - 1), (1, ~((1 << middle) - 1)))
    ])
    chosen = contexts.join(alive, ["c1", "c2"]).select("c1", "c2", "least", "most", "right", "left", F.explode(sides).alias("s")).where("s.steps <> 0")
    key = F.when(F.col("reverse") == 0, F.concat("right", "left")).otherwise(F.concat("left", "right"))
    chosen = scratch.keep(chosen.select("c1", "c2", "least", "most", "right", "left", "s.reverse", "s.steps"), "chosen")
    size = chosen.agg(F.sum(F.octet_length("right") + F.octet_length("left"))).first()[0] or 0
    buckets = max(spark.sparkContext.defaultParallelism, -(-size // BUCKET_BYTES))
    compared = scratch.keep(chosen.repartitionByRange(buckets, "reverse", key).mapInArrow(_compare(length), COMPARED_SCHEMA), "compared")
    inside = compared.where("high IS NOT NULL").select("c1", "c2", "low", "high")
    # strings of runs that reach the end of a bucket, one row each; those seen in two buckets, or twice in one
    outer = compared.where("high IS NULL")
    again = scratch.keep(outer.groupBy("ahead", "h1", "h2").agg(F.count("*").alias("n")).where("n > 1").drop("n"), "again")
    most = contexts.select("c1", "c2", "most")
    across = outer.where("c1 IS NOT NULL").join(again, ["ahead", "h1", "h2"]).join(most, ["c1", "c2"]).select("c1", "c2", (F.col("most") - F.col("ahead")).alias("low")).withColumn("high", F.col("low"))
    whole = distinct.where("n > 1").select("c1", "c2", F.lit(0).alias("low"), (F.col("starts") - 1).alias("high"))
    single = distinct.where("n = 1").select("c1", "c2")
    parts = inside.union(across).join(single, ["c1", "c2"], "left_semi")
    repeated = scratch.keep(whole.union(parts).groupBy("c1", "c2").agg(F.collect_set(F.struct("low", "high")).alias("parts")), "repeated")
    each = found.join(repeated, ["c1", "c2"]).select("id", "row_key", "first", F.explode("parts").alias("p"))
    return each.select("id", "row_key", (F.col("first") + F.col("p.low")).alias("low"), (F.col("first") + F.col("p.high")).alias("high")).groupBy("id", "row_key").agg(
        F.collect_list("low").alias("lows"), F.collect_list("high").alias("highs")
    )


def deduplicate(docs: DataFrame, length: int = LENGTH, lead: int = LEAD, cells: int = CELLS, with_bytes: bool = False) -> DataFrame:
    """Remove from each row of ``docs`` (doc_id, text) every byte of a ``length``-byte string that starts anywhere else too.

    Returns doc_id, n_bytes, n_removed, n_spans (maximal removed runs),
    kept_sha256 and, with ``with_bytes``, kept (binary: a cut may fall inside a
    character).

    Null and empty texts have no bytes; texts shorter than ``length`` keep all.
    Rows are texts of their own: repeated rows, and rows without an id, are
    copies of each other like any other texts. An empty table gives no rows.
    ``cells`` (a power of two) only sets how many contexts are fetched in vain.
    """
    scratch = Scratch(docs.sparkSession, "suffixes")
    base = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id"), row_key(F.col("text")).alias("row_key"), "text")
    starts = scratch.keep(repeated_starts(base, scratch, length, lead, cells), "starts")
    scratch.drop("anchors", "distinct", "contexts", "cores", "shared_cores", "chosen", "compared", "again", "repeated")
    joined = base.join(starts, ["id", "row_key"], "left").select(F.expr(f"nullif(id, {NO_ID + 1} - 1)").alias("doc_id"), "text", "lows", "highs")
    columns = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"] + ["kept"] * with_bytes
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    return joined.mapInArrow(_removed(length, with_bytes), schema).select(*columns)
