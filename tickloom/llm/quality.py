"""Text quality by random-indexing word vectors and a two-layer network.

A text is a sequence of units: runs of letters and digits (case folded), runs
of other visible characters, and marks of form (all capitals, a word again, a
number). Every unit hashes to a slot. A slot's index vector is sparse, ternary
and fixed by its number; its context vector is the sum of the index vectors of
the units around it in all documents, so that word vectors come from one pass
that only adds, whatever the vocabulary. A document is the mean of the vectors
of its units, frequent units weighing less, and a two-layer network in NumPy
turns it into a probability, whose temperature is fitted on labelled rows that
the network was not trained on.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rolling import BASES, VALUES, mixed, prefix_sums, spans, text_runs
from tickloom.llm.scratch import Scratch, hashed_sample
from tickloom.llm.toxicity import held_out

#: Slots that units hash to, numbers in a vector, those of an index vector that are not zero, and units around that make a context.
SLOTS, SIZE, SPARSE, REACH = 1 << 14, 64, 4, 2
#: Labelled rows of each class that the network is trained on, at most (those with the smallest hash of the id); one part in
#: HOLD of them is kept for the temperature.
SAMPLE_ROWS, HOLD = 10_000, 5
#: Units rarer than this share of all weigh about the same.
RARE = 1e-3
HIDDEN, EPOCHS, STEP, DECAY, BATCH = 32, 40, 3e-3, 1e-4, 128
#: Slots of one block of context sums as it is shuffled, and groups that sum a block before the last sum.
BLOCK, FAN = 512, 16
#: Marks have slots of their own, before all others.
CAPITALS, AGAIN, NUMBER, RUN, MARKS = 0, 1, 2, 3, 8
#: Units pooled at a time.
POOLED = 1 << 15
LIMIT = 0.3

BLOCK_SCHEMA = "block int, part int, sums binary"

SPACE, WORD, SIGN = 0, 1, 2
CLASS = np.full(256, SIGN, np.uint8)
CLASS[[32, *range(9, 14)]] = SPACE
for _low, _high in ((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)):
    CLASS[_low: _high + 1] = WORD


def folded(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with Latin capitals (A-Z and those of the two-byte range C3 80 to C3 9E) made small; which were capitals, which small letters."""
    after = np.zeros(len(data), bool)
    after[1:] = data[:-1] == 0xC3
    capital = (data >= 0x41) & (data <= 0x5A) | after & (data >= 0x80) & (data <= 0x9E) & (data != 0x97)
    small = (data >= 0x61) & (data <= 0x7A) | after & (data >= 0x9F) & (data <= 0xBF)
    return data + np.uint8(0x20) * capital, capital, small


def units(data: np.ndarray, offsets: np.ndarray, slots: int = SLOTS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Units of a run of texts, a mark right behind the unit it is about: slots, text numbers, and places of the unit among those that are no marks."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    kind = CLASS[data]
    new = np.ones(len(data), bool)
    new[1:] = kind[1:] != kind[:-1]
    edges = offsets[1:-1]
    new[edges[edges < len(data)]] = True
    starts = np.flatnonzero(new)
    ends = np.concatenate((starts[1:], [len(data)])).astype(np.int64)
    kinds = kind[starts]
    seen = kinds != SPACE
    starts, ends, kinds = starts[seen], ends[seen], kinds[seen]
    text = np.searchsorted(offsets, starts, "right") - 1
    plain, capital, small = folded(data)
    hashes = mixed(spans(prefix_sums(VALUES[plain], BASES[0]), starts, ends, BASES[0]))
    slot = (hashes % np.uint64(slots - MARKS)).astype(np.int64) + MARKS

    def inside(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return total[ends] - total[starts]

    word = kinds == WORD
    digits = inside((data >= 0x30) & (data <= 0x39))
    number = word & (digits == ends - starts)
    slot[number] = NUMBER
    again = np.zeros(len(starts), bool)
    at = np.flatnonzero(word & ~number)
    again[at[1:]] = (hashes[at[1:]] == hashes[at[:-1]]) & (text[at[1:]] == text[at[:-1]])
    marks = [
        (CAPITALS, np.flatnonzero(word & (inside(capital) > 1) & (inside(small) == 0))),
        (AGAIN, np.flatnonzero(again)),
        (RUN, np.flatnonzero(~word & (ends - starts > 1))),
    ]
    place = np.concatenate([np.arange(len(starts)), *(rows for _, rows in marks)])
    every = np.concatenate([slot, *(np.full(len(rows), mark) for mark, rows in marks)])
    order = np.argsort(place, kind="stable")
    return every[order], text[place[order]], place[order]


def index_vectors(slots: int = SLOTS, size: int = SIZE) -> tuple[np.ndarray, np.ndarray]:
    """Of every slot the places that are not zero, and their signs, from a fixed generator."""
    random = np.random.default_rng(11)
    return random.integers(0, size, (slots, SPARSE)), random.choice(np.array([-1, 1]), (slots, SPARSE))


def context_sums(slot: np.ndarray, text: np.ndarray, place: np.ndarray, sums: np.ndarray, vectors: tuple[np.ndarray, np.ndarray]) -> None:
    """Add the index vectors around every unit to its row of ``sums`` (the last column counts units)."""
    where, sign = vectors
    slots, width = sums.shape
    for step in range(1, REACH * 2 + 1):  # marks take places too
        one, other = slice(None, -step), slice(step, None)
        near = (text[one] == text[other]) & (place[other] - place[one] <= REACH)
        a, b = slot[one][near], slot[other][near]
        to, around = np.concatenate((a, b)), np.concatenate((b, a))
        cells = (to * width)[:, None] + where[around]
        sums += np.bincount(cells.ravel(), weights=sign[around].ravel(), minlength=sums.size).astype(np.int64).reshape(slots, width)
    sums[:, -1] += np.bincount(slot, minlength=slots)


def _sum_rows(slots: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, vectors = np.zeros((slots, SIZE + 1), np.int64), index_vectors(slots)
        part, seen = 0, False
        for batch in batches:
            for _, data, offsets in text_runs(batch):
                if len(data):
                    part = zlib.crc32(data[:4096].tobytes()) % FAN
                    context_sums(*units(data, offsets, slots), sums, vectors)
                    seen = True
        if seen:
            held = [(b // BLOCK, part, zlib.compress(sums[b: b + BLOCK].tobytes(), 1)) for b in range(0, slots, BLOCK)]
            yield _blocks(held)

    return run


def _blocks(rows: list[tuple]) -> pa.RecordBatch:
    types = (pa.int32(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=["block", "part", "sums"])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of the blocks of a task, a few blocks at a time in memory."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for block, sums in zip(batch["block"].to_pylist(), batch["sums"], strict=True):
            more = np.frombuffer(zlib.decompress(sums.as_py()), np.int64)
            held[block] = held[block] + more if block in held else more
    if held:
        yield _blocks([(block, 0, zlib.compress(sums.tobytes(), 1)) for block, sums in held.items()])


def word_sums(docs: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Context sums and counts of all slots over all ``docs``; their size is fixed by ``slots``."""
    rows = docs.select("text").mapInArrow(_sum_rows(slots), BLOCK_SCHEMA)
    # two rounds, so that the tasks of many files do not meet in as few tasks as there are blocks
    for key in (("block", "part"), ("block",)):
        rows = rows.repartition(*key).mapInArrow(_add_blocks, BLOCK_SCHEMA)
    out = np.zeros((slots, SIZE + 1), np.int64)
    for r in rows.select("block", "sums").collect():
        out[r.block * BLOCK: (r.block + 1) * BLOCK] += np.frombuffer(zlib.decompress(bytes(r.sums)), np.int64).reshape(-1, SIZE + 1)
    return out


def word_vectors(sums: np.ndarray) -> np.ndarray:
    """Per slot its index vector and its context direction (what all contexts have in common taken off), weighted by rarity."""
    slots = len(sums)
    where, sign = index_vectors(slots)
    own = np.zeros((slots, SIZE))
    np.add.at(own, (np.arange(slots)[:, None], where), sign)
    count = sums[:, -1:].astype(float)
    context = sums[:, :-1] / np.maximum(count, 1)
    mean = (context * count).sum(0) / max(1.0, count.sum())
    context = np.where(count > 0, context - mean, 0)
    norm = np.linalg.norm(context, axis=1, keepdims=True)
    share = count / max(1.0, count.sum())
    weight = RARE / (RARE + share)
    weight[:MARKS] = 1
    both = np.concatenate((own / math.sqrt(SPARSE), context / np.maximum(norm, 1e-9)), axis=1)
    return (both * weight).astype(np.float32)


def pooled(data: np.ndarray, offsets: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean vector of every text of a run, and how many units it has (logarithm); texts without any have zeros."""
    slot, text, _ = units(data, offsets, len(vectors))
    count = len(offsets) - 1
    out = np.zeros((count, vectors.shape[1]))
    for first in range(0, len(slot), POOLED):
        part = text[first: first + POOLED]
        new = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1])))
        out[part[new]] += np.add.reduceat(vectors[slot[first: first + POOLED]], new, axis=0, dtype=np.float64)
    size = np.bincount(text, minlength=count)[:, None]
    return np.concatenate((out / np.maximum(size, 1), np.log1p(size) / 10), axis=1)


@dataclass
class Network:
    """Two layers over standardised inputs; a few hundred kB with its word vectors."""

    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    first: np.ndarray
    second: np.ndarray
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        hidden = np.tanh(_with_one((x - self.mean) / self.scale) @ self.first)
        return _with_one(hidden) @ self.second

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -30, 30)))


def _with_one(x: np.ndarray) -> np.ndarray:
    return np.concatenate((x, np.ones((len(x), 1))), axis=1)


def train(x: np.ndarray, y: np.ndarray, weight: np.ndarray, vectors: np.ndarray) -> Network:
    """Adam on the weighted cross entropy, from fixed starting values."""
    random = np.random.default_rng(5)
    mean, scale = x.mean(0), np.maximum(x.std(0), 1e-3)
    prior = float(np.clip((weight * y).sum() / weight.sum(), 1e-3, 1 - 1e-3))
    net = Network(vectors, mean, scale, random.normal(0, 1 / math.sqrt(x.shape[1]), (x.shape[1] + 1, HIDDEN)), np.zeros(HIDDEN + 1))
    net.second[:-1] = random.normal(0, 0.1, HIDDEN)
    net.second[-1] = math.log(prior / (1 - prior))
    z = _with_one((x - mean) / scale)
    moments = [(np.zeros_like(w), np.zeros_like(w)) for w in (net.first, net.second)]
    step = 0
    for epoch in range(EPOCHS):
        order = random.permutation(len(z))
        rate = STEP * (1 - epoch / EPOCHS)
        for at in range(0, len(order), BATCH):
            rows = order[at: at + BATCH]
            hidden = np.tanh(z[rows] @ net.first)
            wide = _with_one(hidden)
            miss = weight[rows] * (1 / (1 + np.exp(-np.clip(wide @ net.second, -30, 30))) - y[rows]) / len(rows)
            back = np.outer(miss, net.second[:-1]) * (1 - hidden ** 2)
            step += 1
            for w, g, (m, v) in zip((net.first, net.second), (z[rows].T @ back, wide.T @ miss), moments, strict=True):
                g = g + DECAY * w
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                w -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def fit_temperature(logits: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float:
    """The temperature with the least weighted cross entropy, by golden-section search over its logarithm."""
    def loss(log_t: float) -> float:
        z = np.clip(logits / math.exp(log_t), -30, 30)
        return float((weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).sum())

    low, high, cut = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - cut * (high - low), low + cut * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return math.exp((low + high) / 2)


def _pooled_rows(vectors):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in text_runs(batch):
                x = pooled(data, offsets, vectors.value).astype(np.float32)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.ravel()))
                part = batch.slice(int(rows[0]), len(rows))
                yield pa.RecordBatch.from_arrays([part["digest"], part["label"], flat], names=["digest", "label", "x"])

    return run


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample_rows: int = SAMPLE_ROWS, slots: int = SLOTS) -> Network:
    """Network from word vectors of all ``docs`` (doc_id, text) and the rows that ``labels`` (doc_id, ``label``) marks, those held out left aside.

    An id labelled more than once has the label 1 if any says so; null labels
    and ids, and equal texts with equal labels after the first, are left aside.
    Without rows of both classes every text scores what the labels say on
    average, one half without any.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "quality")
    marked = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull()).where(~held_out(F.col("doc_id")))
        .groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("label"))
    )
    marked = scratch.keep(marked, "marked")
    class_rows = dict(marked.groupBy("label").count().collect())
    one, other = (hashed_sample(marked.where(F.col("label") == t), ["_id"], sample_rows, class_rows.get(t, 0)) for t in (1, 0))
    # at most 2 * sample_rows rows of two numbers
    chosen = docs.select("doc_id", "text").join(F.broadcast(one.union(other)), F.col("doc_id") == F.col("_id"))
    chosen = scratch.keep(chosen.select("text", "label", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest")).dropDuplicates(["digest", "label"]), "chosen")
    vectors = word_vectors(word_sums(docs, slots))
    sent = spark.sparkContext.broadcast(vectors)
    # bounded by the sample: 2 * sample_rows vectors
    rows = sorted(chosen.mapInArrow(_pooled_rows(sent), "digest string, label int, x array<float>").collect(), key=lambda r: (r.digest, r.label))
    width = vectors.shape[1] + 1
    y = np.array([r.label for r in rows], float)
    share = {t: int((y == t).sum()) for t in (0, 1)}
    if not all(share.values()):
        prior = float(y.mean()) if len(y) else 0.5
        flat = Network(vectors, np.zeros(width), np.ones(width), np.zeros((width + 1, HIDDEN)), np.zeros(HIDDEN + 1))
        flat.second[-1] = math.log((prior + 1e-3) / (1 - prior + 1e-3))
        return flat
    x = np.array([r.x for r in rows], float)
    weight = np.array([class_rows.get(r.label, 1) / share[r.label] for r in rows])
    weight *= len(rows) / weight.sum()
    hold = np.array([zlib.crc32(r.digest.encode()) % HOLD == 0 for r in rows])
    enough = all((y[~hold] == t).any() and (y[hold] == t).any() for t in (0, 1))
    net = train(x[~hold], y[~hold], weight[~hold], vectors) if enough else train(x, y, weight, vectors)
    if enough:
        net.temperature = fit_temperature(net.logits(x[hold]), y[hold], weight[hold])
    return net


def _scored(network, limit: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net: Network = network.value
        for batch in batches:
            for rows, data, offsets in text_runs(batch):
                score = net.probability(pooled(data, offsets, net.vectors))
                part = batch["doc_id"].slice(int(rows[0]), len(rows))
                yield pa.RecordBatch.from_arrays([part, pa.array(score), pa.array((score >= limit).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return run


def score(docs: DataFrame, network: Network, limit: float = LIMIT) -> DataFrame:
    """doc_id, score (0 to 1) and predicted (score >= ``limit``), per row of ``docs`` (doc_id, text).

    Null and empty texts have no units and are scored as such. Repeated rows
    give repeated results; null ids are kept; an empty table gives no rows;
    other columns are ignored.
    """
    known = docs.sparkSession.sparkContext.broadcast(network)
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_scored(known, limit), "doc_id long, score double, predicted int")
