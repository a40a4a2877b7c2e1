"""Vectorised polynomial hashes over bytes and words of Arrow text columns, modulo 2^64.

Each byte has a fixed random value; a span's hash is the sum of its values
times powers of an odd base, taken from prefix sums, so any number of spans of
a buffer cost a few array operations.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

_ODD = 0x9E3779B97F4A7C15
#: Value of every byte, from a fixed generator.
VALUES = np.random.default_rng(7).integers(0, 1 << 64, 256, dtype=np.uint64)
BASES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)
#: Texts are worked on in runs of about this many bytes; a longer text is a run of its own.
RUN_BYTES = 1 << 20
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mixed(x: np.ndarray) -> np.ndarray:
    """Spread the information of all bits over all bits (low bits of polynomial hashes know little)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_ODD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def powers(base: int, count: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``base`` and of its inverse from 0 to ``count`` - 1 at least."""
    have = _powers.get(base)
    if have is None or len(have[0]) < count:
        size = max(count, RUN_BYTES * 2)
        have = tuple(np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)))) for b in (base, pow(base, -1, 1 << 64)))
        if size <= 1 << 24:
            _powers[base] = have
    return have


def prefix_sums(values: np.ndarray, base: int) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[k] * base^k over i <= k < j."""
    up, _ = powers(base, len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=out[1:])
    return out


def spans(sums: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Hash of each span, independent of where it stands."""
    _, down = powers(base, len(sums))
    return (sums[ends] - sums[starts]) * down[starts]


def text_runs(batch: pa.RecordBatch, column: str = "text", run_bytes: int = RUN_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of rows: (row numbers, UTF-8 bytes of the run, offsets of its texts). Null texts are empty."""
    array = batch[column]
    array = array.cast(pa.large_string()) if not pa.types.is_large_string(array.type) else array
    if array.null_count:
        array = array.fill_null("")
    n = len(array)
    if not n:
        return
    _, offset_buffer, data = array.buffers()
    offsets = np.frombuffer(offset_buffer, np.int64)[array.offset: array.offset + n + 1]
    values = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + run_bytes, "right")) - 1)
        last = min(last, n)
        yield np.arange(first, last), values[offsets[first]: offsets[last]], offsets[first: last + 1] - offsets[first]
        first = last


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (runs of bytes other than space and 9 to 13) of a run of texts: starts, ends, and each text's first word."""
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    before = np.zeros(len(data), bool)
    before[1:] = inside[:-1]
    after = np.zeros(len(data), bool)
    after[:-1] = inside[1:]
    edges = offsets[1:-1]
    before[edges[edges < len(data)]] = False
    ends_here = edges[edges > 0] - 1
    after[ends_here] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_windows(data: np.ndarray, offsets: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows of ``width`` words within single texts: text number, first word (within the text), and two hashes."""
    starts, ends, firsts = word_bounds(data, offsets)
    count = len(starts) - width + 1
    if count <= 0:
        none = np.zeros(0, np.int64)
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    words = mixed(spans(prefix_sums(VALUES[data], BASES[0]), starts, ends, BASES[0]))
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    at = np.flatnonzero(text[:count] == text[width - 1:])
    hashes = []
    for base in BASES[1:]:
        sums = prefix_sums(words, base)
        hashes.append(mixed(spans(sums, at, at + width, base)))
    return text[at], at - firsts[text[at]], *hashes
