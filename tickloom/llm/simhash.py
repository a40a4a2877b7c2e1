"""SimHash near-duplicates: fingerprints within a few bits, found with pivot distance tables.

Fingerprints that differ in at most ``radius`` of 64 bits agree on all but
``radius`` of any set of disjoint bit blocks, so one of a few keys (the bits of
some blocks) brings them together. Inside a key's group every fingerprint has
a row of distances to fixed reference fingerprints (pivots); by the triangle
inequality two fingerprints are no nearer than their largest coordinate
difference, so pairs beyond the radius in any coordinate are discarded and the
rest verified.

No group is worked on whole: a key that many fingerprints share is dealt out
to chunks. Inside a chunk only a spanning forest leaves the task. After a
first round of components the chunks of a key are compared only where they
hold fingerprints outside the key's most common component, since fingerprints
already connected need no further link.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.components import connected_components
from tickloom.llm.scratch import Scratch, row_key

WORDS, RADIUS, SEED = 4, 4, 42
#: Fingerprints of one key that one task compares; larger groups are dealt out.
CHUNK = 512
PIVOTS = 24


def fingerprint(words: list[bytes], size: int = WORDS) -> int:
    """64-bit fingerprint of a list of words: a bit is set if it is in over half the hashes of all shingles."""
    from xxhash import xxh64_digest

    if not words:
        return 0
    data, n = b" ".join(words), max(1, len(words) - size + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[len(words) - n:] - 1).tolist()
    hashes = np.frombuffer(b"".join([xxh64_digest(data[a:b], SEED) for a, b in zip(starts, stops, strict=True)]), np.uint8)
    set_bits = np.zeros(64, np.int64)
    for at in range(0, n, 4096):  # long texts in bounded memory
        set_bits += np.unpackbits(hashes[8 * at: 8 * (at + 4096)].reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * set_bits > n).tobytes(), "big")


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _fingerprints(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = [_signed(fingerprint((text.as_py() or "").encode().lower().split(), size)) for text in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["row_key"], pa.array(prints, pa.int64())], names=["doc_id", "row_key", "print"])

    return run


def fingerprints(docs: DataFrame, size: int = WORDS) -> DataFrame:
    """doc_id, row_key, print (the 64 bits as a signed number), a row per row of ``docs`` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long"), row_key(F.col("text")).alias("row_key"), "text")
    return rows.mapInArrow(_fingerprints(size), "doc_id long, row_key long, print long")


def key_masks(radius: int, blocks: int) -> list[int]:
    """Signed masks: every choice of ``blocks - radius`` of ``blocks`` near-equal runs of bits."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    runs = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [_signed(sum(chosen)) for chosen in combinations(runs, blocks - radius)]


def blocks_for(count: int, radius: int = RADIUS) -> int:
    """Blocks such that random fingerprints share a key with few others; any number gives the same links."""
    extra = 1
    while extra < 4 and count > 1 << (64 * extra // (radius + extra) + 3):
        extra += 1
    return radius + max(extra, 2)


def pivots(count: int = PIVOTS) -> np.ndarray:
    """Reference fingerprints from a fixed generator."""
    return np.random.default_rng(0).integers(0, 1 << 64, count, dtype=np.uint64)


def distance_table(prints: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(prints ^ p) for p in pivots()], axis=1).astype(np.int8)


def within(prints: np.ndarray, table: np.ndarray, left: np.ndarray, right: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Of index pairs those within the radius: coordinates discard, the distance itself decides."""
    for coordinate in range(table.shape[1]):
        if not len(left):
            break
        column = table[:, coordinate]
        near = np.abs(column[left] - column[right]) <= radius
        left, right = left[near], right[near]
    near = np.bitwise_count(prints[left] ^ prints[right]) <= radius
    return left[near], right[near]


def forest(count: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each index over the pairs."""
    root = np.arange(count)
    while len(left):
        low = np.minimum(root[left], root[right])
        before = root.copy()
        for side in (left, right):
            np.minimum.at(root, root[side], low)
            np.minimum.at(root, side, low)
        root = root[root]
        if np.array_equal(root, before):
            break
    return root


def _groups(batches: Iterator[pa.RecordBatch], keys: list[str], values: list[str]) -> Iterator[tuple[np.ndarray, ...]]:
    """Runs of whole groups of a sorted stream: group number per row, then ``values``; a group is never cut."""
    held: dict[str, np.ndarray] | None = None

    def cut(cols: dict[str, np.ndarray], upto: int) -> tuple[np.ndarray, ...]:
        starts = np.zeros(upto, bool)
        for k in keys:
            starts[1:] |= cols[k][1:upto] != cols[k][:upto - 1]
        return np.cumsum(starts), *(cols[v][:upto] for v in values)

    for batch in batches:
        if not batch.num_rows:
            continue
        cols = {n: batch[n].to_numpy(zero_copy_only=False) for n in dict.fromkeys([*keys, *values])}
        if held is not None:
            cols = {n: np.concatenate((held[n], c)) for n, c in cols.items()}
        size = len(cols[keys[0]])
        differs = np.zeros(size, bool)
        for k in keys:
            differs |= cols[k] != cols[k][-1]
        upto = int(np.flatnonzero(differs)[-1]) + 1 if differs.any() else 0
        if upto:
            yield cut(cols, upto)
        held = {n: c[upto:] for n, c in cols.items()}
    if held is not None and len(held[keys[0]]):
        yield cut(held, len(held[keys[0]]))


def _edges(left: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(left, pa.int64()), pa.array(right, pa.int64())], names=["u", "v"])


def _link_inside(radius: int):
    """Spanning links of each (key, chunk) group of a sorted stream."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, signed in _groups(batches, ["mask", "key", "chunk"], ["print"]):
            shared = np.zeros(len(group), bool)
            same = group[1:] == group[:-1]
            shared[1:] |= same
            shared[:-1] |= same
            group, signed = group[shared], signed[shared]
            prints = signed.view(np.uint64)
            table, found, at, step = distance_table(prints), [], np.arange(len(group)), 1
            while True:
                at = at[at + step < len(group)]
                at = at[group[at + step] == group[at]]
                if not len(at):
                    break
                found.append(within(prints, table, at, at + step, radius))
                step += 1
            if found:
                root = forest(len(group), *(np.concatenate(side) for side in zip(*found, strict=True)))
                member = np.flatnonzero(root != np.arange(len(root)))
                yield _edges(signed[member], signed[root[member]])

    return run


def _link_across(radius: int):
    """Links between visitors and members of each (key, chunk, slice) group whose components differ, one per component pair."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, signed, root, visits in _groups(batches, ["mask", "key", "chunk", "slice"], ["print", "root", "visits"]):
            bounds = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                visitors, members = np.flatnonzero(visits[a:b]) + a, np.flatnonzero(~visits[a:b]) + a
                if not len(visitors) or not len(members):
                    continue
                rows = np.concatenate((visitors, members))
                prints = signed[rows].view(np.uint64)
                left, right = (x.ravel() for x in np.meshgrid(np.arange(len(visitors)), np.arange(len(visitors), len(rows)), indexing="ij"))
                apart = root[rows[left]] != root[rows[right]]
                left, right = within(prints, distance_table(prints), left[apart], right[apart], radius)
                if len(left):
                    pairs = np.unique(np.stack((root[rows[left]], root[rows[right]]), axis=1), axis=0)
                    yield _edges(pairs[:, 0], pairs[:, 1])

    return run


def link(prints: DataFrame, scratch: Scratch, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """(print, root) of distinct ``prints`` (print) that have a link: equal roots are connected by links within the radius."""
    keyed = prints.select("print", F.explode(F.array(*[
        F.struct(F.lit(i).alias("mask"), F.col("print").bitwiseAND(F.lit(m).cast("long")).alias("key")) for i, m in enumerate(key_masks(radius, blocks_for(prints.count(), radius)))
    ])).alias("k")).select("print", "k.mask", "k.key")
    sizes = keyed.groupBy("mask", "key").agg(F.count("*").alias("n"))
    hot = scratch.keep(sizes.where(F.col("n") > chunk).select("mask", "key", F.ceil(F.col("n") / chunk).cast("int").alias("chunks")), "hot")
    some_hot = not hot.isEmpty()
    dealt = keyed.withColumn("chunk", F.lit(0))
    if some_hot:
        dealt = keyed.join(hot, ["mask", "key"], "left").select(
            "mask", "key", F.coalesce(F.pmod(F.xxhash64("print"), F.col("chunks")), F.lit(0)).cast("int").alias("chunk"), "print"
        )
    by = ["mask", "key", "chunk"]
    inside = dealt.select("mask", "key", "chunk", "print").repartition(*by).sortWithinPartitions(*by, "print").mapInArrow(_link_inside(radius), "u long, v long")
    first = connected_components(inside, scratch, "inside")
    if not some_hot:
        return first.withColumnsRenamed({"node": "print"})
    # chunks of one key: whoever is outside the key's most common component visits all its chunks
    labelled = keyed.join(hot, ["mask", "key"]).join(first.withColumnRenamed("node", "print"), "print", "left")
    labelled = scratch.keep(labelled.select(
        "mask", "key", "print", "chunks", F.pmod(F.xxhash64("print"), F.col("chunks")).cast("int").alias("chunk"), F.coalesce("root", "print").alias("root")
    ), "labelled")
    counts = labelled.groupBy("mask", "key", "root").agg(F.count("*").alias("n"))
    common = counts.groupBy("mask", "key").agg(F.max(F.struct("n", F.col("root").alias("common"))).alias("m"), F.sum("n").alias("all"))
    common = scratch.keep(common.select(
        "mask", "key", "m.common", F.ceil((F.col("all") - F.col("m.n")) / chunk).cast("int").alias("slices")
    ).where("slices > 0"), "common")
    if common.isEmpty():
        return first.withColumnsRenamed({"node": "print"})
    rows = labelled.join(common, ["mask", "key"])
    visitors = rows.where("root <> common").select(
        "mask", "key", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("chunk"),
        F.pmod(F.xxhash64("print", F.lit(1)), F.col("slices")).cast("int").alias("slice"), "print", "root", F.lit(True).alias("visits"),
    )
    members = rows.select("mask", "key", "chunk", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "print", "root", F.lit(False).alias("visits"))
    by = ["mask", "key", "chunk", "slice"]
    across = visitors.unionByName(members).repartition(*by).sortWithinPartitions(*by).mapInArrow(_link_across(radius), "u long, v long")
    # roots linked to roots, and every print linked to its first root
    links = across.union(first.select(F.col("node").alias("u"), F.col("root").alias("v")))
    return connected_components(links, scratch, "all").withColumnsRenamed({"node": "print"})


def near_duplicates(docs: DataFrame, size: int = WORDS, radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """Groups of near-duplicates among ``docs`` (doc_id, text): doc_id, row_key, print, component_id (smallest id reachable).

    Null and empty texts have fingerprint zero, which links like any other.
    Repeated rows give repeated results. A row without an id takes part in
    linking; its component is named by the ids there are (null if none).
    An empty table gives no rows; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    marked = scratch.keep(fingerprints(docs, size), "prints")
    # copies share a fingerprint; one row stands for them
    owners = scratch.keep(marked.groupBy("print").agg(F.min("doc_id").alias("first")), "owners")
    rooted = owners.join(link(owners.select("print"), scratch, radius, chunk), "print", "left").select("print", "first", F.coalesce("root", "print").alias("root"))
    named = scratch.keep(rooted, "rooted")
    names = scratch.keep(named.groupBy("root").agg(F.min("first").alias("component_id")), "names")
    of_print = scratch.keep(named.join(names, "root").select("print", "component_id"), "components")
    return marked.join(of_print, "print").select("doc_id", "row_key", "print", "component_id")


def hex_print(column: str) -> Column:
    return F.lower(F.lpad(F.hex(column), 16, "0"))


def keep_first(docs: DataFrame, **how) -> DataFrame:
    """``docs`` without near-duplicates: of every component the document with its smallest id; all columns stay.

    A repeated row stays repeated. Rows without an id are kept only where
    their component has no id at all.
    """
    found = near_duplicates(docs, **how).where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    first = found.select(F.col("doc_id").alias("_doc_id"), F.col("row_key").alias("_row_key")).distinct()
    on = docs["doc_id"].cast("long").eqNullSafe(first["_doc_id"]) & (row_key(docs["text"]) == first["_row_key"])
    return docs.join(first, on, "left_semi")
