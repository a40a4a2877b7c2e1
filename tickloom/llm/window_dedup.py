"""Substring deduplication by word windows, with a count-min prefilter.

1. Every task sketches the hashes of its windows; the merged sketch, of fixed
   size, overestimates how often a window occurs.
2. Windows estimated to occur again are grouped exactly (96-bit hashes) to
   the smallest document that starts them. Windows estimated once are unique.
3. A second sketch, of the windows found in several documents, picks the
   windows that are joined with their smallest document.
4. Words covered by a window of a smaller document are removed.

Texts are read three times and shuffled once, at the end; what is shuffled
before are hashes of windows that may repeat.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rolling import text_runs, word_windows
from tickloom.llm.scratch import Scratch, same_row
from tickloom.llm.sketch import BLOCK_SCHEMA, CELLS, Sketch, merged_sketch, sketch_batches

WIDTH = 13


def _hash_runs(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[np.ndarray]:
    for batch in batches:
        for _, data, offsets in text_runs(batch):
            yield word_windows(data, offsets, width)[2]


def _sketches(width: int, cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch_batches(_hash_runs(batches, width), cells)

    return run


def _stored_sketch(cells: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from sketch_batches((b["h1"].to_numpy(zero_copy_only=False).view(np.uint64) for b in batches), cells)

    return run


def _candidates(width: int, sketch, with_place: bool):
    """Windows that pass the sketch; without places, one row per window and document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: Sketch = sketch.value
        for batch in batches:
            ids, keys = (batch[c].to_numpy(zero_copy_only=False) for c in ("doc_id", "row_key"))
            for rows, data, offsets in text_runs(batch):
                text, place, h1, h2 = word_windows(data, offsets, width)
                keep = np.flatnonzero(known.passes(h1))
                text, place, h1, h2 = rows[text[keep]], place[keep], h1[keep], h2[keep]
                columns = {"h1": h1.view(np.int64), "h2": (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32), "doc_id": ids[text]}
                if with_place:
                    columns |= {"row_key": keys[text], "place": place.astype(np.int32)}
                yield pa.RecordBatch.from_pydict({n: pa.array(c) for n, c in columns.items()})

    return run


def _kept(width: int, with_text: bool):
    """Words and what is left of each text, given the first words of its repeated windows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text, places in zip(batch["doc_id"], batch["text"], batch["places"], strict=True):
                words = (text.as_py() or "").encode().split()
                kept = words
                if places.is_valid and len(places):
                    edge = np.zeros(len(words) + 1, np.int64)
                    starts = np.unique(places.values.to_numpy())
                    np.add.at(edge, starts, 1)
                    np.add.at(edge, starts + width, -1)
                    kept = [w for w, covered in zip(words, np.cumsum(edge[:-1]).tolist(), strict=True) if not covered]
                left = b" ".join(kept)
                rows.append((doc_id.as_py(), len(words), len(words) - len(kept), hashlib.sha256(left).hexdigest(), left.decode() if with_text else None))
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 5, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"],
            )

    return run


def deduplicate(docs: DataFrame, width: int = WIDTH, cells: int = CELLS, with_text: bool = False) -> DataFrame:
    """Remove from each row of ``docs`` (doc_id, text) the words of windows that also start in a smaller doc_id.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the remaining words
    joined by one space) and, with ``with_text``, kept.

    Null and empty texts have no words; texts shorter than a window keep all.
    Rows without an id neither lose words nor make others lose any. Rows of
    one id count as one document, so repeated rows lose nothing to each other.
    ``cells`` (a power of two) only sets how many windows are grouped in vain.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "windows")
    # the key only tells texts of one id apart, so a short one does
    base = docs.select(F.col("doc_id").cast("long"), F.hash(F.coalesce("text", F.lit(""))).alias("row_key"), "text")
    known = base.where("doc_id IS NOT NULL")
    estimate = spark.sparkContext.broadcast(merged_sketch(known.select("text").mapInArrow(_sketches(width, cells), BLOCK_SCHEMA), 2, cells))
    maybe = known.mapInArrow(_candidates(width, estimate, False), "h1 long, h2 int, doc_id long")
    exact = maybe.groupBy("h1", "h2").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").drop("last")
    repeated = scratch.keep(exact, "repeated")
    estimate.destroy()
    chosen = spark.sparkContext.broadcast(merged_sketch(repeated.select("h1").mapInArrow(_stored_sketch(cells), BLOCK_SCHEMA), 1, cells))
    placed = known.mapInArrow(_candidates(width, chosen, True), "h1 long, h2 int, doc_id long, row_key int, place int")
    # the repeated windows are stored, so that Spark may split a window that many documents hold
    later = placed.join(repeated, ["h1", "h2"]).where("doc_id > first").select("doc_id", "row_key", "place")
    places = scratch.keep(later.groupBy("doc_id", "row_key").agg(F.collect_list("place").alias("places")), "places")
    chosen.destroy()
    scratch.drop("repeated")
    columns = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string"
    return same_row(base, places).select("doc_id", "text", "places").mapInArrow(_kept(width, with_text), schema).select(*columns)
