"""SimHash groups against all pairs, in groups large enough to be dealt out to chunks."""

import random
from collections import Counter

import numpy as np
import pytest
import xxhash

from tickloom.llm import simhash
from tickloom.llm.components import connected_components
from tickloom.llm.scratch import Scratch

SCHEMA = "doc_id long, text string, print string, root int"


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    count = [sum(xxhash.xxh64_intdigest(s, 42) >> bit & 1 for s in shingles) for bit in range(64)]
    return sum(1 << bit for bit in range(64) if 2 * count[bit] > len(shingles)) if words else 0


def components(prints, radius):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def test_texts(spark):
    rng = random.Random(2)
    words = ["Alpha", "beta", "ÉTÉ", "gamma", "x", "delta,", "of"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(50)]
    texts += [t + " tail" for t in texts[:20]] + texts[:5] + ["", None, " \t", "one two", "ONE two", "long " * 30_000]
    rows = [(i, t, "p", 1) for i, t in enumerate(texts)]
    rows += [rows[3], (None, texts[4], "p", 1)]
    found = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA).repartition(3))
    prints = [fingerprint(t) for _, t, *_ in rows]
    group = components(prints, 4)
    smallest = {}
    for (i, *_), g in zip(rows, group, strict=True):
        if i is not None:
            smallest[g] = min(smallest.get(g, i), i)
    got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in found.select("doc_id", simhash.hex_print("print").alias("fingerprint"), "component_id").collect())
    assert got == Counter((i, f"{p:016x}", smallest.get(g)) for (i, *_), p, g in zip(rows, prints, group, strict=True))
    kept = simhash.keep_first(spark.createDataFrame(rows, SCHEMA))
    assert kept.columns == ["doc_id", "text", "print", "root"]
    assert {r.doc_id for r in kept.collect()} == {i for i, g in zip([r[0] for r in rows], group, strict=True) if smallest.get(g) == i}


@pytest.mark.parametrize(("seed", "near"), [(1, 2), (2, 5), (3, 9)])
def test_dense_groups(spark, seed, near):
    """Hundreds of fingerprints around a few centres, so that keys are shared by far more than a chunk."""
    rng = random.Random(seed)
    prints = set()
    for _ in range(3):
        centre = rng.getrandbits(64)
        for _ in range(150):
            p = centre
            for _ in range(rng.randint(0, near)):
                p ^= 1 << rng.randrange(64)
            prints.add(p)
    prints |= {rng.getrandbits(64) for _ in range(50)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "print long")
    found = dict(simhash.link(df, Scratch(spark, "test"), 4, chunk=16).select("print", "root").collect())
    group, mine = components(prints, 4), [found.get(p, p) for p in signed]
    assert len(set(zip(group, mine, strict=True))) == len(set(group)) == len(set(mine))


def test_keys_miss_no_link():
    rng = random.Random(3)
    for blocks in (6, 7, 8):
        masks = simhash.key_masks(4, blocks)
        for _ in range(300):
            a = rng.getrandbits(64)
            b = a
            for bit in rng.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & (m % (1 << 64)) == b & (m % (1 << 64)) for m in masks)


def test_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 101), (7, 3)]
    found = dict(connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect())
    assert {k: found.get(k, k) for k in range(61)} == dict.fromkeys(range(61), 0) and found == {**dict.fromkeys(range(1, 61), 0), 101: 100}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(none).collect() == [] and simhash.keep_first(none).collect() == []
