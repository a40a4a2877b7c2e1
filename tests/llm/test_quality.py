"""Quality classifier: units by a plain tokenizer, context sums by a plain loop, held-out accuracy, edge cases."""

import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.conftest import SMALL
from tickloom.llm import quality, queries
from tickloom.llm.rolling import text_runs

DOCS = "doc_id long, text string"


def run_of(texts):
    (_, data, offsets), = text_runs(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}))
    return data, offsets


def test_units_of_a_text():
    texts = ["The CAT cat!! 12 É ÉTÉ été", "", None, "été --- a a A", "   \n"]
    slot, text, place = quality.units(*run_of(texts))
    by_text = {t: [(s if s < quality.MARKS else "w", int(p)) for s, x, p in zip(slot.tolist(), text, place) if x == t] for t in range(5)}
    base = place[text == 3].min()
    assert [s for s, _ in by_text[0]] == ["w", "w", quality.CAPITALS, "w", quality.AGAIN, "w", quality.RUN, quality.NUMBER, "w", "w", quality.CAPITALS, "w", quality.AGAIN]
    assert by_text[1] == by_text[2] == by_text[4] == []
    assert [s for s, _ in by_text[3]] == ["w", "w", quality.RUN, "w", "w", quality.AGAIN, "w", quality.AGAIN]
    # one word, one slot, whatever its case and its text
    assert slot[(text == 3) & (place == base)][0] == slot[(text == 0) & (slot >= quality.MARKS)][-1]


def test_context_sums_by_a_plain_loop():
    data, offsets = run_of(["one two two THREE", "two one", "x" * 300 + " !! y"])
    slots = 64
    slot, text, place = quality.units(data, offsets, slots)
    where, sign = quality.index_vectors(slots)
    plain = np.zeros((slots, quality.SIZE + 1), np.int64)
    for i in range(len(slot)):
        plain[slot[i], -1] += 1
        for j in range(len(slot)):
            if i != j and text[i] == text[j] and abs(place[i] - place[j]) <= quality.REACH and abs(i - j) <= 2 * quality.REACH:
                for k in range(quality.SPARSE):
                    plain[slot[i], where[slot[j], k]] += sign[slot[j], k]
    sums = np.zeros_like(plain)
    quality.context_sums(slot, text, place, sums, (where, sign))
    assert (sums == plain).all()


def test_word_sums_cover_all_rows_however_dealt(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "GAMMA", "!!"]) for _ in range(rng.randrange(30)))) for i in range(200)] + [(None, None), (3, "")]
    docs = spark.createDataFrame(rows, DOCS)
    one, many = (quality.word_sums(docs.repartition(n), 1 << 10) for n in (1, 7))
    assert (one == many).all()
    words = sum(len(re.findall(r"\w+|!!", t or "")) for _, t in rows)
    # marks are units too
    assert one[quality.MARKS:, -1].sum() == words


def test_held_out_rows_and_edges(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(2, 7))) for _ in range(300)]

    def text(good):
        body = [rng.choice(words) for _ in range(rng.randrange(5, 60))]
        return " ".join(body) if good else " ".join(w + rng.choice(["***", "%%%"]) for w in body)

    rows = [(i, text(i % 4), "x", i) for i in range(800)]
    marks = [(i, int(bool(i % 4)), 0) for i in range(800)] + [(None, 1, 1), (5, None, 0)]
    rows += [(None, "alone", "x", 1), (9000, "", "x", 1), (9001, None, "x", 1), (9002, "word " * 200_000, "x", 1), (7, rows[7][1], "x", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label string, quality long")  # columns that clash with the labels'
    labels = spark.createDataFrame(marks, "doc_id long, quality int, text int")
    scored = quality.score(docs, quality.learn(docs, labels, sample_rows=300)).withColumn("held", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in scored)
    seen = [r for r in scored if r.held and r.doc_id < 800]
    assert len(seen) > 100 and sum(r.predicted == int(bool(r.doc_id % 4)) for r in seen) >= 0.97 * len(seen)
    twins = [r.score for r in scored if r.doc_id == 7]
    assert len(twins) == 2 and twins[0] == twins[1]


def test_labels_of_held_out_rows_change_nothing(spark):
    docs, labels = (queries.table(spark, SMALL, n) for n in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    flipped = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    one, other = ({r.doc_id: round(r.score, 9) for r in quality.score(docs, quality.learn(docs, x)).collect()} for x in (labels, flipped))
    assert one == other


def test_without_labels_and_rows(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert [r.score for r in quality.score(docs, quality.learn(docs, labels)).collect()] == [0.5, 0.5]
    none = docs.limit(0)
    assert quality.score(none, quality.learn(none, labels)).collect() == []


def test_temperature():
    rng = np.random.default_rng(0)
    z = rng.normal(0, 2, 20_000)
    y = (rng.random(20_000) < 1 / (1 + np.exp(-z))).astype(float)
    # logits three times too steep
    assert abs(quality.fit_temperature(3 * z, y, np.ones(len(z))) - 3) < 0.15
