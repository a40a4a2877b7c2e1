"""Count-min sketches of 64-bit hashes, with counters that stop at two.

Two rows of ``cells`` counters each; a counter is two bits, "seen" and "seen
again", so partition sketches merge by bit operations in any order. They are
shuffled as compressed blocks of cells and merged as streams, a few blocks per
task. The merged sketch has a fixed size whatever the input; as it fills up it
lets more hashes through, never fewer.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.plans.materialize import shuffles_freed

ROWS = 2
#: Counters of each row: 2^28, of which one bit each (64 MB in all) is sent to the tasks.
CELLS = 1 << 28
#: Counters of one block.
BLOCK = 1 << 21
#: Hashes a task gathers before it writes their blocks.
FLUSH = 1 << 22

BLOCK_SCHEMA = "block int, seen binary, again binary"


def cells_of(hashes: np.ndarray, row: int, cells: int = CELLS) -> np.ndarray:
    """Counter of each hash in a row: other bits of the hash for each row."""
    return (hashes >> np.uint64(34 * row)) & np.uint64(cells - 1) if row == 0 else ((hashes * np.uint64(0x9FB21C651E98DF25)) >> np.uint64(20)) & np.uint64(cells - 1)


def blocks(hashes: np.ndarray, cells: int = CELLS) -> Iterator[tuple[int, bytes, bytes]]:
    """Compressed blocks of the sketch of ``hashes``; blocks without any are left out."""
    size = min(BLOCK, cells)
    for row in range(ROWS):
        at = np.sort(cells_of(hashes, row, cells).astype(np.uint32))
        new = np.ones(len(at), bool)
        new[1:] = at[1:] != at[:-1]
        again = np.zeros(len(at), bool)
        again[:-1] = ~new[1:]
        seen, again = at[new], at[new & again]
        for block in np.unique(seen // size):
            bits = []
            for some in (seen, again):
                a, b = np.searchsorted(some, (block * size, (block + 1) * size))
                flags = np.zeros(size, bool)
                flags[some[a:b] - block * size] = True
                bits.append(zlib.compress(np.packbits(flags).tobytes(), 1))
            yield row * (cells // size) + int(block), *bits


def sketch_batches(hash_runs: Iterator[np.ndarray], cells: int = CELLS) -> Iterator[pa.RecordBatch]:
    """Block rows of a task's hashes."""
    held, count = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        for block, seen, again in blocks(np.concatenate(held), cells):
            yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([seen], pa.binary()), pa.array([again], pa.binary())], names=["block", "seen", "again"])

    for hashes in hash_runs:
        if len(hashes):
            held.append(hashes)
            count += len(hashes)
        if count >= FLUSH:
            yield from flush()
            held, count = [], 0
    if count:
        yield from flush()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    merged: dict[int, list[np.ndarray]] = {}
    for batch in batches:
        for block, seen, again in zip(*(batch[c] for c in ("block", "seen", "again")), strict=True):
            new, twice = (np.frombuffer(zlib.decompress(x.as_py()), np.uint8) for x in (seen, again))
            if (have := merged.get(block.as_py())) is None:
                merged[block.as_py()] = [new.copy(), twice.copy()]
            else:
                have[1] |= twice | (have[0] & new)
                have[0] |= new
    for block, (seen, again) in merged.items():
        yield pa.RecordBatch.from_arrays(
            [pa.array([block], pa.int32()), pa.array([zlib.compress(seen.tobytes(), 1)], pa.binary()), pa.array([zlib.compress(again.tobytes(), 1)], pa.binary())],
            names=["block", "seen", "again"],
        )


class Sketch:
    """Merged bits of both rows: hashes whose counters reach the asked count pass."""

    def __init__(self, rows: list[np.ndarray], cells: int):
        self.rows, self.cells = rows, cells

    def passes(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for row, bits in enumerate(self.rows):
            at = cells_of(hashes, row, self.cells)
            out &= (bits[at >> np.uint64(3)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1) > 0
        return out


def merged_sketch(block_rows: DataFrame, least: int, cells: int = CELLS) -> Sketch:
    """Merge ``block_rows`` (BLOCK_SCHEMA) and bring the bits for ``least`` (1 or 2) to the driver: 2 * cells / 8 bytes at most."""
    size = min(BLOCK, cells)
    per_row = cells // size
    merged = block_rows.repartition("block").mapInArrow(_merge, BLOCK_SCHEMA).select("block", "seen" if least == 1 else "again")
    bits = [np.zeros(cells // 8, np.uint8) for _ in range(ROWS)]
    with shuffles_freed(block_rows.sparkSession):
        found = merged.collect()
    for block, packed in found:
        row, place = divmod(block, per_row)
        bits[row][place * size // 8: (place + 1) * size // 8] = np.frombuffer(zlib.decompress(packed), np.uint8)
    return Sketch(bits, cells)
