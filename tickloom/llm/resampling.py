"""Importance resampling towards a target: hashed n-gram features, log-ratio gains, Gumbel draws.

Every feature (a run of words) has a bucket; a bucket's gain is the log ratio
of its smoothed shares in the target and in the raw corpus. A document's weight
is the sum of the gains of its features, and the documents with the highest
weight plus Gumbel noise are drawn, which samples without replacement in
proportion to the exponentiated weights.

Features are interned per run of texts in an open-addressed NumPy table: XXH64
keys, linear probing, equal keys verified by their bytes. A slot stores its
feature's bucket (one CRC32 for each distinct feature) and count; the slot of
every occurrence gathers the gains. Counts leave a task as one row per bucket.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.rolling import text_runs
from tickloom.llm.scratch import Scratch

BUCKETS, LONGEST, SEED = 10_000, 1, 2024
#: Words a document needs to be drawn; per cent of those drawn.
LEAST_WORDS, PER_CENT = 20, 10
#: Bytes of text interned in one table (a longer text has one of its own).
TABLE_BYTES = 4 << 20
#: Rows of one range of the ranking.
RANGE_ROWS = 1 << 20
SCORE_SCHEMA = "doc_id long, n_words long, n_features long, weight long, score long"

#: Bytes of words: digits, letters, and all of other scripts; and A-Z as a-z.
WORD_BYTE = np.zeros(256, bool)
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    WORD_BYTE[_low: _high + 1] = True
FOLDED = np.arange(256, dtype=np.uint8)
FOLDED[0x41: 0x5B] += 0x20


def word_text(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A run of texts as folded words with one space after each: bytes, word starts, word ends, and each text's first word."""
    inside = WORD_BYTE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    first[edges] = inside[edges]  # a text begins a word of its own
    begins = np.flatnonzero(first)
    firsts = np.searchsorted(begins, offsets)
    sizes = np.add.reduceat(inside, begins, dtype=np.int64) if len(begins) else np.zeros(0, np.int64)
    out = np.full(int(sizes.sum()) + len(sizes), 32, np.uint8)
    ends = np.cumsum(sizes + 1) - 1
    room = np.ones(len(out), bool)
    room[ends] = False
    out[room] = FOLDED[data[inside]]
    return out, ends - sizes, ends, firsts


def features(data: np.ndarray, offsets: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of 1 to ``longest`` words within single texts: bytes, starts, ends, text numbers, and words of each text."""
    out, starts, ends, firsts = word_text(data, offsets)
    text = np.repeat(np.arange(len(firsts) - 1), np.diff(firsts))
    spans = []
    for size in range(1, longest + 1):
        at = np.arange(max(0, len(starts) - size + 1))
        at = at[text[at] == text[at + size - 1]]
        spans.append((starts[at], ends[at + size - 1], text[at]))
    begin, end, owner = (np.concatenate(c) for c in zip(*spans, strict=True))
    return out, begin, end, owner, np.diff(firsts)


def equal_bytes(data: np.ndarray, one: np.ndarray, other: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Whether the ``sizes`` (at least 1) bytes at ``one`` and at ``other`` are the same."""
    if not len(sizes):
        return np.zeros(0, bool)
    first = np.cumsum(sizes) - sizes
    step = np.arange(int(sizes.sum()))
    unlike = data[step + np.repeat(one - first, sizes)] != data[step + np.repeat(other - first, sizes)]
    return ~np.logical_or.reduceat(unlike, first)


class Interned:
    """Open-addressed table of the features of one run of texts; its size is twice their number at least."""

    def __init__(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, buckets: int, keys: np.ndarray | None = None):
        from xxhash import xxh64_intdigest

        count = len(starts)
        view = memoryview(data.tobytes())
        if keys is None:
            keys = np.fromiter((xxh64_intdigest(view[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)), np.uint64, count)
        size = 1 << max(4, (2 * count).bit_length())
        mask = np.uint64(size - 1)
        owner = np.full(size, -1, np.int64)  # the occurrence that took the slot
        #: Slot of every occurrence.
        self.slots = np.empty(count, np.int64)
        todo, at = np.arange(count), (keys & mask).astype(np.int64)
        while len(todo):
            place = at[todo]
            free = owner[place] < 0
            owner[place[free]] = todo[free]
            holder = owner[place]
            same = keys[holder] == keys[todo]
            same &= ends[holder] - starts[holder] == ends[todo] - starts[todo]
            check = np.flatnonzero(same & (holder != todo))
            same[check] = equal_bytes(data, starts[holder[check]], starts[todo[check]], (ends - starts)[todo[check]])
            self.slots[todo[same]] = place[same]
            todo = todo[~same]
            at[todo] = (at[todo] + 1) & int(mask)
        #: Slots in use, and of every slot its bucket and how often its feature occurs.
        self.used = np.flatnonzero(owner >= 0)
        held = owner[self.used]
        self.bucket = np.zeros(size, np.int64)
        self.bucket[self.used] = np.fromiter((zlib.crc32(view[a:b]) % buckets for a, b in zip(starts[held].tolist(), ends[held].tolist(), strict=True)), np.int64, len(held))
        self.count = np.bincount(self.slots, minlength=size)


def _bucket_rows(buckets: int, longest: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, offsets in text_runs(batch, run_bytes=TABLE_BYTES):
                out, starts, ends, _, _ = features(data, offsets, longest)
                table = Interned(out, starts, ends, buckets)
                np.add.at(total, table.bucket[table.used], table.count[table.used])
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(total[some])], names=["bucket", "n"])

    return run


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """Occurrences of features per bucket over all ``texts`` (column text); ``buckets`` numbers, whatever the input."""
    rows = texts.select("text").mapInArrow(_bucket_rows(buckets, longest), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    everything, wanted = int(raw.sum()), int(target.sum())
    size = len(raw)
    return np.array([math.floor(1000 * math.log((t + 1.0) * (everything + size) / ((s + 1.0) * (wanted + size)))) for s, t in zip(raw.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int) -> int:
    """Thousandths of a Gumbel draw that depends on the id alone; a missing id counts as an empty one."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scores(gain, longest: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: np.ndarray = gain.value
        for batch in batches:
            ids = batch["doc_id"].to_pylist()
            for rows, data, offsets in text_runs(batch, run_bytes=TABLE_BYTES):
                out, starts, ends, text, words = features(data, offsets, longest)
                table = Interned(out, starts, ends, len(known))
                gathered = known[table.bucket][table.slots]
                weight = np.zeros(len(rows), np.int64)
                np.add.at(weight, text, gathered)
                some = [ids[r] for r in rows]
                score = weight + np.array([noise(i, seed) for i in some], np.int64)
                columns = (np.asarray(words, np.int64), np.bincount(text, minlength=len(rows)).astype(np.int64), weight, score)
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), *map(pa.array, columns)], names=["doc_id", "n_words", "n_features", "weight", "score"])

    return run


def ranked(scored: DataFrame, eligible: Column, order: list[Column], scratch: Scratch) -> DataFrame:
    """Stored rows of ``scored`` with their rank (from 1) among the ``eligible`` by ``order``; null for others.

    Rows are range-partitioned and numbered inside their range; the ranges'
    sizes give what stands before each. No task holds more than a range.
    """
    # ties beyond the order are cut by a number stored with the row, so that equal rows spread over ranges too
    held = scratch.keep(scored.withColumns({"_in": F.coalesce(eligible, F.lit(False)), "_tie": F.xxhash64(F.monotonically_increasing_id())}), "scored")
    by = [F.col("_in").desc(), *order, F.col("_tie")]
    ranges = max(held.sparkSession.sparkContext.defaultParallelism, -(-held.count() // RANGE_ROWS))
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = held.repartitionByRange(ranges, *by).sortWithinPartitions(*by).withColumns({"_range": F.spark_partition_id(), "_place": inside})
    placed = scratch.keep(placed, "placed")
    scratch.drop("scored")
    sizes = placed.where("_in").groupBy("_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row per range
    sizes = sizes.select("_range", before.alias("_before"))
    rank = F.when(F.col("_in"), F.col("_before") + F.col("_place") + 1).cast("long")
    return placed.join(F.broadcast(sizes), "_range", "left").withColumn("rank", rank).select(*scored.columns, "rank")


def resample(
    docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, least_words: int = LEAST_WORDS,
    per_cent: int = PER_CENT, seed: int = SEED,
) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (from 1; null if not drawn), per row of ``docs`` (doc_id, text), towards ``target`` (text).

    Of the rows with ``least_words`` words, ``per_cent`` per cent (rounded
    down) are drawn, ties going to the smaller id. Null and empty texts have
    no features and weight 0; repeated rows count and are drawn each; null ids
    come last among ties and draw noise like an empty id. An empty ``docs``
    gives no rows; an empty ``target`` counts no feature. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "resampling")
    gain = spark.sparkContext.broadcast(gains(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest)))
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scores(gain, longest, seed), SCORE_SCHEMA)
    out = ranked(scored, F.col("n_words") >= least_words, [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("n_features")], scratch)
    drawn = out.agg(F.count("rank")).first()[0] * per_cent // 100
    return out.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))


def oracle_sql(buckets: int = BUCKETS, least_words: int = LEAST_WORDS, per_cent: int = PER_CENT, seed: int = SEED) -> str:
    """For runs of one word. CRC32 is a fold over the bytes with its table made by rule."""
    step = "CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    fold = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({fold}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""WITH RECURSIVE t(i, c, k) AS (SELECT i, i, 0 FROM (SELECT unnest(range(256))::UBIGINT AS i) UNION ALL SELECT i, {step}, k + 1 FROM t WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS tab FROM t WHERE k = 8),
d AS (SELECT doc_id, {words} AS w FROM documents), b AS (SELECT {words} AS w FROM benchmark),
dw AS (SELECT doc_id, unnest(w) AS f FROM d), bw AS (SELECT unnest(w) AS f FROM b),
feat AS (SELECT f, hex(encode(f)) AS x FROM (SELECT f FROM dw UNION SELECT f FROM bw)),
code AS (SELECT f, xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(len(x) // 2), lambda i: CAST('0x' || substr(x, CAST(2 * i + 1 AS BIGINT), 2) AS UBIGINT))),
    lambda c, e: xor(c >> 8, tab[CAST((xor(c, e) & 255) + 1 AS BIGINT)])), 4294967295::UBIGINT) % {buckets} AS k FROM feat, tab),
raw AS (SELECT k, count(*) AS n FROM dw JOIN code USING (f) GROUP BY k), tgt AS (SELECT k, count(*) AS n FROM bw JOIN code USING (f) GROUP BY k),
g AS (SELECT k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM dw) + {buckets}) / ((coalesce(r.n, 0) + 1)::DOUBLE * ((SELECT count(*) FROM bw) + {buckets})))) AS BIGINT) AS gain
  FROM raw r FULL JOIN tgt t USING (k)),
wt AS (SELECT doc_id, CAST(sum(gain) AS BIGINT) AS weight FROM dw JOIN code USING (f) JOIN g USING (k) GROUP BY doc_id),
s AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{seed}:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM d LEFT JOIN wt USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM s WHERE n_features >= {least_words})
SELECT doc_id, n_features, weight, score, CASE WHEN rank <= (SELECT count(*) FROM r) * {per_cent} // 100 THEN CAST(rank AS BIGINT) END AS rank FROM s LEFT JOIN r USING (doc_id)"""
