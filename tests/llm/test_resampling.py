"""Importance resampling: the table against a dictionary, whole results against plain Python, edge cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import resampling
from tickloom.llm.rolling import text_runs
from tickloom.llm.scratch import Scratch

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, longest):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [" ".join(words[i: i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, buckets=10_000, longest=1, least=20, per_cent=10, seed=2024):
    place = lambda f: zlib.crc32(f.encode()) % buckets
    raw = Counter(place(f) for _, t in docs for f in plain_features(t, longest)[1])
    goal = Counter(place(f) for t in target for f in plain_features(t, longest)[1])
    total, wanted = sum(raw.values()), sum(goal.values())
    out = []
    for doc_id, text in docs:
        words, feats = plain_features(text, longest)
        weight = sum(math.floor(1000 * math.log((goal[b] + 1) * (total + buckets) / ((raw[b] + 1) * (wanted + buckets)))) for b in map(place, feats))
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([doc_id, len(words), len(feats), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    order = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    ranks = {id(r): i + 1 for i, r in enumerate(order[: len(order) * per_cent // 100])}
    return [(*r, ranks.get(id(r))) for r in out]


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_against_plain_python(spark, longest):
    rng = random.Random(longest)
    words = ["the", "THE", "été", "Été", "a1", "日本", "x" * 40, "zz"] + ["".join(rng.choice("abc") for _ in range(3)) for _ in range(30)]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "-", "  "]) for _ in range(rng.randrange(40)))
    docs = [(i, text()) for i in range(300)] + [(301, None), (302, ""), (303, "?!"), (304, "long " * 60_000), (None, "only words " * 12)]
    target = [text() for _ in range(40)] + [None, "", "long long"]
    got = resampling.resample(
        spark.createDataFrame([(d, t, 1, "x") for d, t in docs], "doc_id long, text string, score int, weight string").repartition(5),
        spark.createDataFrame([(t,) for t in target], "text string"), longest=longest, per_cent=30,
    ).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(plain_resample(docs, target, longest=longest, per_cent=30), key=repr)


def test_repeated_rows_are_drawn_each(spark):
    docs = [(1, "same words here " * 10)] * 40 + [(i, f"other {i} " * 12) for i in range(2, 62)]
    rows, goal = spark.createDataFrame(docs, "doc_id long, text string"), ["same words"] * 50
    for per_cent in (10, 50, 90):
        got = resampling.resample(rows, spark.createDataFrame([(t,) for t in goal], "text string"), per_cent=per_cent).collect()
        assert sorted(map(tuple, got), key=repr) == sorted(plain_resample(docs, goal, per_cent=per_cent), key=repr)
        assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, per_cent + 1))


def test_equal_keys_are_told_apart_by_bytes():
    (_, data, offsets), = text_runs(pa.RecordBatch.from_pydict({"text": ["aa bb aa cc bb aa ccc", "bb"]}))
    out, starts, ends, text, words = resampling.features(data, offsets, 1)
    table = resampling.Interned(out, starts, ends, 10_000, keys=np.full(len(starts), 5, np.uint64))
    found = [bytes(out[a:b]).decode() for a, b in zip(starts, ends)]
    assert dict(zip(found, table.slots.tolist())).keys() == {"aa", "bb", "cc", "ccc"}
    assert len({(f, s) for f, s in zip(found, table.slots.tolist())}) == 4 == len(set(table.slots.tolist()))
    assert {f: int(table.count[s]) for f, s in zip(found, table.slots)} == Counter(found)
    assert {f: int(table.bucket[s]) for f, s in zip(found, table.slots)} == {f: zlib.crc32(f.encode()) % 10_000 for f in found}
    assert text.tolist() == [0] * 7 + [1] and words.tolist() == [7, 1]


def test_ranges_are_joined_in_order(spark, monkeypatch):
    monkeypatch.setattr(resampling, "RANGE_ROWS", 7)
    rows = spark.createDataFrame([(i, i % 5) for i in range(100)] + [(None, 3), (4, None)], "doc_id long, score long")
    from pyspark.sql import functions as F

    got = resampling.ranked(rows, F.col("score") > 0, [F.col("score").desc(), F.col("doc_id").asc_nulls_last()], Scratch(spark, "test")).collect()
    inside = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in inside] == list(range(1, 82)) and len(got) == 102
    assert [(r.score, r.doc_id) for r in inside] == sorted(((r.score, r.doc_id) for r in inside), key=lambda x: (-x[0], x[1] is None, x[1] or 0))


def test_empty_tables(spark):
    docs, none = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([], "doc_id long, text string")
    assert resampling.resample(none, docs).collect() == []
    assert [(r.n_features, r["rank"]) for r in resampling.resample(docs, none).collect()] == [(2, None)]
