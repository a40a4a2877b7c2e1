"""Packing by power-of-two decomposition.

A document of n tokens is cut into pieces whose lengths are the powers of two
that sum to n, none above the sequence length: 4096, 4096, ..., then the binary
digits of what is left, longest first. Pieces of one length form a bucket and
each is a sequence of its own, so no sequence crosses documents and none is
padded. Tokens are those of a public vocabulary file, then one end token.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.scratch import Scratch

MAX_TOKENS, END = 4096, 2
#: Numbering is spread over this many shards per piece length; their counts (shards x 13 rows) are what is broadcast.
SHARDS = 1024
#: Words whose ids a worker remembers, and the longest such word in bytes: together some 200 MB at most.
MEMO_WORDS, MEMO_BYTES = 1_000_000, 64

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds(dict):
    """Ids of white-space separated words as little-endian bytes.

    The vocabulary's rules (normal form, folding, splitting) never look across
    white space, so a text's ids are those of its words in a row.
    """

    def __init__(self, path: str):
        # a task has one core; read by the library at each call
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, words: list[bytes]) -> list[bytes]:
        """Ids of each word, from one text of all of them; a token belongs to the word in which it starts."""
        texts = [word.decode("utf-8", "replace") for word in words]
        found = self.tokenizer.encode(" ".join(texts), add_special_tokens=False)
        begins = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
        owner = np.searchsorted(begins, np.array([start for start, _ in found.offsets], np.int64), "right") - 1
        cuts = np.cumsum([0, *np.bincount(owner, minlength=len(texts))]) * 4
        ids = np.array(found.ids, "<u4").tobytes()
        return [ids[i:j] for i, j in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]

    def text(self, data: bytes) -> bytes:
        words = data.split()
        fresh = [word for word in set(words) if word not in self]
        if fresh:
            if len(self) + len(fresh) > MEMO_WORDS:
                self.clear()
                fresh = list(set(words))
            self.update(zip(fresh, self.encode(fresh), strict=True))
        ids = b"".join(map(self.__getitem__, words))
        for word in fresh:
            if len(word) > MEMO_BYTES:
                del self[word]
        return ids


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def piece_lengths(tokens: int, limit: int = MAX_TOKENS) -> list[int]:
    """Powers of two that sum to ``tokens``, longest first, none above ``limit`` (itself a power of two)."""
    whole, rest = divmod(tokens, limit)
    return [limit] * whole + [1 << bit for bit in reversed(range(rest.bit_length())) if rest >> bit & 1]


def _cut(path: str, limit: int, with_ids: bool):
    end = np.array([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_ids(path)
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"] + ["ids"] * with_ids
        for batch in batches:
            columns: list[list] = [[] for _ in names]
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                ids = memo.text((text.as_py() or "").encode()) + end
                total, start = len(ids) // 4, 0
                for length in piece_lengths(total, limit):
                    piece = ids[4 * start: 4 * (start + length)]
                    for column, value in zip(columns, (doc_id, start, length, zlib.crc32(piece), total, piece), strict=False):
                        column.append(value)
                    start += length
            types = [pa.int64()] * 5 + [pa.binary()] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def pack(docs: DataFrame, vocabulary: str, limit: int = MAX_TOKENS, with_ids: bool = False) -> DataFrame:
    """Pieces of all rows of ``docs`` (doc_id, text): doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``with_ids`` adds the ids themselves (little-endian 32-bit). Sequences are
    numbered from 0, shortest bucket first. A sequence is one piece, so
    ``offset`` is 0.

    Null and empty texts are one piece, the end token. Repeated rows are packed
    each; null ids are kept; an empty table gives no pieces; other columns are
    ignored.
    """
    if limit & (limit - 1):
        raise ValueError("the sequence length must be a power of two")
    scratch = Scratch(docs.sparkSession, "packing")
    pieces = scratch.keep(
        docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_cut(vocabulary, limit, with_ids), SCHEMA + ", ids binary" * with_ids), "pieces"
    ).withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(SHARDS)))
    # how many sequences stand before each (length, shard)
    sizes = pieces.groupBy("length", "shard").agg(F.count("*").alias("n"))
    before = Window.orderBy("length", "shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    place = Window.partitionBy("length", "shard").orderBy("doc_id", "start", "ids_crc32")
    numbered = pieces.withColumn("place", F.row_number().over(place) - 1)
    return numbered.join(F.broadcast(offsets), ["length", "shard"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("place")).cast("long").alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"), *["ids"] * with_ids,
    )
