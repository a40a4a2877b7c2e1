"""Substring deduplication against brute force: word windows and byte strings."""

import hashlib
import os
import random
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import suffixes, window_dedup

SCHEMA = "doc_id long, text string, lang string, h1 long, suffix string"


def rows_of(texts, ids=None):
    return [(i, t, "en", 1, "x") for i, t in zip(ids or range(len(texts)), texts, strict=True)]


def random_texts(seed, count=60, letters="ab c", most=160):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(letters) for _ in range(rng.randint(0, most))) for _ in range(count)]
    shared = ["".join(rng.choice("xyz é") for _ in range(70)) for _ in range(3)]
    for i in range(0, count, 3):  # copies, near copies and shared passages
        texts[i] = texts[i][:40] + rng.choice(shared)[rng.randint(0, 20):] + texts[i][40:]
    return [*texts, texts[0], texts[0], texts[3] + "q", "", None, "a " * 300]


def windows_brute(rows, width):
    words = [(i, (t or "").encode().split()) for i, t, *_ in rows]
    first = {}
    for i, ws in words:
        if i is not None:
            for at in range(len(ws) - width + 1):
                k = tuple(ws[at:at + width])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, ws in words:
        gone = set()
        for at in range(len(ws) - width + 1):
            if i is not None and first[tuple(ws[at:at + width])] < i:
                gone.update(range(at, at + width))
        kept = b" ".join(w for p, w in enumerate(ws) if p not in gone)
        out.append((i, len(ws), len(gone), hashlib.sha256(kept).hexdigest()))
    return Counter(out)


def bytes_brute(rows, length):
    data = [(i, (t or "").encode()) for i, t, *_ in rows]
    count = Counter(d[at:at + length] for _, d in data for at in range(len(d) - length + 1))
    out = []
    for i, d in data:
        gone = [False] * len(d)
        for at in range(len(d) - length + 1):
            if count[d[at:at + length]] > 1:
                gone[at:at + length] = [True] * length
        runs = sum(g and not (p and gone[p - 1]) for p, g in enumerate(gone))
        out.append((i, len(d), sum(gone), runs, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=True) if not g)).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize(("seed", "cells"), [(1, 1 << 22), (2, 1 << 6)])
def test_windows(spark, seed, cells):
    rows = rows_of(random_texts(seed, letters="abc  "))
    rows += [rows[0], rows[3], (None, rows[0][1], "en", 1, "x")]
    found = window_dedup.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(5), width=3, cells=cells)
    assert Counter(map(tuple, found.collect())) == windows_brute(rows, 3)


@pytest.mark.parametrize(("seed", "length", "lead", "letters"), [(1, 24, 4, "ab "), (2, 40, 8, "abcdefgh é"), (3, 30, 15, "ab")])
def test_suffixes(spark, monkeypatch, seed, length, lead, letters):
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 2000)
    rows = rows_of(random_texts(seed, letters=letters))
    rows += [rows[5], (None, rows[1][1], "en", 1, "x")]
    found = suffixes.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(5), length, lead, 1 << 12)
    assert Counter(map(tuple, found.collect())) == bytes_brute(rows, length)


def test_hot_token(spark, monkeypatch):
    """One token shared by all texts, each of which differs elsewhere: its run goes over many buckets."""
    monkeypatch.setattr(suffixes, "BUCKET_BYTES", 1000)
    rng = random.Random(5)
    middle = "".join(rng.choice("mnopq") for _ in range(60))
    texts = ["".join(rng.choice("ab") for _ in range(50)) + middle[: rng.randint(30, 60)] + "".join(rng.choice("cd") for _ in range(50)) for _ in range(80)]
    rows = rows_of(texts)
    found = suffixes.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(4), 30, 6, 1 << 16)
    assert Counter(map(tuple, found.collect())) == bytes_brute(rows, 30)


def test_passages_at_the_length_of_the_contract(spark):
    """Passages of over 50 words in two documents, or twice in one: removed from 400 bytes on, all else is left alone."""
    rng = random.Random(9)
    passage = lambda size: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(size))[:size]
    sizes = [310, 399, 400, 401, 900]
    planted = [passage(n) for n in sizes]
    assert all(len(p.split()) > 50 for p in planted)
    texts = [f"{passage(700)}{before}{p}{after}{passage(500)}" for p in planted for before, after in ("12", "34")]
    own = passage(450)
    rows = rows_of([*texts, f"1{own}2{passage(300)}3{own}4", passage(2000), planted[1], passage(399) * 2])
    found = [tuple(r) for r in suffixes.deduplicate(spark.createDataFrame(rows, SCHEMA).repartition(4), cells=1 << 12).collect()]
    removed = {i: n for i, _, n, *_ in found}
    assert [removed[i] for i in range(len(rows))] == [0, 0, 0, 0, 400, 400, 401, 401, 900, 900, 900, 0, 0, 0]
    assert Counter(found) == bytes_brute(rows, 400)


def test_common_prefixes_and_order():
    rng = random.Random(3)
    strings = ["".join(rng.choice("ab") for _ in range(rng.randrange(12))).encode() for _ in range(300)] + [b"", b"\0", b"\0\0", "é".encode()]
    order = np.array(suffixes.multikey_quicksort(strings))
    assert [strings[i] for i in order] == sorted(strings)
    shared = suffixes.common_prefixes(strings, order, 8)
    plain = [0] + [len(os.path.commonprefix([strings[a], strings[b]])) for a, b in zip(order, order[1:])]
    assert shared.tolist() == [min(8, n) for n in plain]


def test_outer_strings_are_told_once():
    """Many suffixes that go on alike: a bucket tells each string of its outer runs once."""
    count, length = 500, 32
    right, left = [b"p" * length] * count, [b"q" * 16 + bytes([65 + i % 26, 65 + i // 26]) + b"r" * 10 for i in range(count)]
    least, most, steps = np.zeros(count, int), np.full(count, 20), np.full(count, (1 << 17) - 1)
    told = {ahead: len(outer) for ahead, _, outer, _ in suffixes.compare_bucket(right, left, least, most, steps, length, False)}
    assert all(told[a] == 1 for a in range(17)) and told[17] == 26 and told[18] == count


def test_remaining_text(spark):
    rows = rows_of(["a b c d e", "x a b c d y", "z"])
    kept = {r.doc_id: r.kept for r in window_dedup.deduplicate(spark.createDataFrame(rows, SCHEMA), width=3, cells=1 << 12, with_text=True).collect()}
    assert kept == {0: "a b c d e", 1: "x y", 2: "z"}
    bytes_kept = {r.doc_id: bytes(r.kept) for r in suffixes.deduplicate(spark.createDataFrame(rows, SCHEMA), 7, 3, 1 << 12, with_bytes=True).collect()}
    assert bytes_kept == {0: b"e", 1: b"x y", 2: b"z"}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert window_dedup.deduplicate(none, cells=1 << 12).collect() == []
    assert suffixes.deduplicate(none, cells=1 << 12).collect() == []
