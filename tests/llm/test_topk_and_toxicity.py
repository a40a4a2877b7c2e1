"""Top-k search against all scores; segments against their definition; held-out accuracy."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tickloom.llm import topk, toxicity
from tickloom.llm.queries import table, toxicity_model
from tests.conftest import SMALL

VECTORS = "vec_id long, embedding array<float>, label int, q int, dims string"


def brute(rows, k, every):
    usable = {(i, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, *_ in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v)}
    out = Counter()
    for i, v in usable:
        if i % every == 0:
            scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j) for j, w in usable if j != i and len(w) == len(v))
            out.update((i, rank, j, -s) for rank, (s, j) in enumerate(scored[:k], 1))
    return out


@pytest.mark.parametrize(("seed", "blocks"), [(1, (8192, 2048)), (2, (60, 7))])
def test_top_k(spark, seed, blocks):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)], 1, 2, "d") for i in range(400)]
    rows += [(1000 + i, list(rows[7][1]), 1, 2, "d") for i in range(40)]  # ties
    rows += [(500, None, 1, 2, "d"), (501, [1.0, None, 1.0, 1.0, 1.0, 1.0], 1, 2, "d"), (502, [float("nan")] * 6, 1, 2, "d"), (503, [float("inf")] * 6, 1, 2, "d"),
             (504, [], 1, 2, "d"), (None, [9.0] * 6, 1, 2, "d"), (510, [1.0, 2.0], 1, 2, "d"), (511, [1.0, 3.0], 1, 2, "d"), (520, [1.0, 2.0, 3.0], 1, 2, "d"),
             (530, [-0.001] * 6, 1, 2, "d"), (540, [100_000.0] * 6, 1, 2, "d"), rows[0]]
    found = topk.top_k(spark.createDataFrame(rows, VECTORS).repartition(3), k=5, every=10, candidates=blocks[0], queries=blocks[1])
    assert Counter(map(tuple, found.collect())) == brute(rows, 5, 10)


def test_reading_stops_early():
    rng = np.random.default_rng(1)
    items = np.round(rng.standard_normal((3000, 4)) ** 3 * 256).astype(np.int64)
    queries = items[:50]
    read = {}
    found = topk.nearest(queries, np.arange(50), items, np.arange(3000), 5, read)
    assert len(found) < 50 * 75
    # few components with heavy tails: most queries stop in the first half of the lists
    assert len(read) == 50 and np.median(list(read.values())) <= 0.5
    for q in range(50):
        scores = items @ queries[q]
        best = sorted((-s, i) for i, s in enumerate(scores.tolist()) if i != q)[:5]
        assert sorted((-s, i) for a, i, s in found if a == q)[:5] == best


def test_no_vectors(spark):
    assert topk.top_k(spark.createDataFrame([], VECTORS)).collect() == []
    assert topk.top_k(spark.createDataFrame([(50, [1.0], 1, 1, "d")], VECTORS)).collect() == []


def segments_by_definition(scores, first=0):
    """The best segment, then the same to its left and right."""
    best = max(((sum(scores[a:b]), a - b, a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=(0, 0, 0, 0))
    total, _, a, b = max(((sum(scores[a:b]), -(b - a), a, b) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)), default=best)
    if total <= 0:
        return []
    return segments_by_definition(scores[:a], first) + [(first + a, first + b - 1, total)] + segments_by_definition(scores[b:], first + b)


def test_maximal_segments():
    rng = random.Random(5)
    for _ in range(200):
        # powers keep all sums different, so that the definition has one answer
        scores = [rng.choice([-0.25, -0.25, rng.random() + 0.1]) for _ in range(rng.randint(0, 24))]
        places = [i for i, s in enumerate(scores) if s > 0]
        found = toxicity.maximal_segments(places, [scores[i] for i in places], -0.25)
        expected = segments_by_definition(scores)
        assert [(a, b) for a, b, _ in found] == [(a, b) for a, b, _ in expected]
        assert all(math.isclose(x[2], y[2]) for x, y in zip(found, expected, strict=True))


def test_rate():
    shares, scores = np.array([0.01, 0.002]), np.array([3.0, 5.0])
    rate = toxicity.rate_of(shares, scores, -0.25)
    assert math.isclose((shares * np.exp(rate * scores)).sum() + 0.988 * math.exp(-0.25 * rate), 1, rel_tol=1e-6)


def test_held_out(spark):
    """Labels of held-out rows are never learned from, and are met."""
    import zlib

    ids = [*range(50), None]
    got = {r.i: r.h for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", toxicity.held_out(F.col("i")).alias("h")).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 5 == 0 for i in ids}
    rng = random.Random(3)
    plain, bad = [f"w{i}" for i in range(300)], ["vile", "nasty", "awful"]
    docs, labels = [], []
    for i in range(1500):
        words = [rng.choice(plain) for _ in range(rng.randint(3, 80))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(2):
                words.insert(rng.randrange(len(words)), rng.choice(bad))
        docs.append((i, " ".join(words), "t", 1.0))
        labels.append((i, toxic))
    schema = "doc_id long, text string, token string, score double"
    frame = spark.createDataFrame([*docs, (9000, None, "t", 1.0), (9001, "", "t", 1.0), (None, "vile nasty awful", "t", 1.0), docs[0]], schema)
    marks = spark.createDataFrame([(i, 1, int(t)) for i, t in labels] + [(None, 1, 1), (3, 1, None), (5, 1, 0), (5, 1, 0)], "doc_id long, quality int, toxic int")
    model = toxicity.learn(frame, marks)
    rows = toxicity.score(frame, model).collect()
    truth = dict(labels)
    held = [r for r in rows if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert len(held) > 200 and sum(r.predicted == truth[r.doc_id] for r in held) > 0.97 * len(held)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows) and len(rows) == 1504
    assert {r.predicted for r in rows if r.doc_id in (9000, 9001)} == {0} and {r.predicted for r in rows if r.doc_id is None} == {1}
    swapped = marks.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learn(frame, swapped) == model
    kept = toxicity.drop_toxic(frame, model)
    assert kept.schema == frame.schema and kept.count() == sum(1 - r.predicted for r in rows)


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = toxicity.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.predicted for r in toxicity.score(docs, model).collect()] == [0]
    assert toxicity.score(docs.where("false"), model).collect() == []


def test_given_tables(spark):
    model = toxicity_model(spark, SMALL)
    scored = toxicity.score(table(spark, SMALL, "documents"), model)
    assert scored.count() == table(spark, SMALL, "documents").count()
