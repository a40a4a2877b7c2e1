"""Fill-in-the-middle: the skip list against sums, outputs against plain slices, exact round trips, edge cases."""

import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tickloom.llm import fim


def plain(doc_id, text, seed=7, rate=100, first=50):
    text = text or ""
    lines = re.findall(r"[^\n]*\n|[^\n]+", text)
    h = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * i: 8 * i + 8], 16) for i in range(4))
    n = len(lines)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= rate:
        return doc_id, n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(lines[:a]), "".join(lines[a:b]), "".join(lines[b:])
    if h4 % 100 < first:
        return doc_id, n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return doc_id, n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 500), max_size=300))
def test_skip_list_reaches_every_rank(widths):
    lanes = fim.SkipList(widths)
    assert [lanes.points_before(r) for r in range(len(widths) + 1)] == [sum(widths[:r]) for r in range(len(widths) + 1)]


def test_lanes_are_sparse():
    lanes = fim.SkipList([3] * 50_000)
    sizes = [len(units) for units, _, _ in lanes.lanes]
    assert sizes[-1] == 50_000 and sizes[0] <= 8 and all(2 * a < b for a, b in zip(sizes[:-1], sizes[1:]) if b > 32)
    assert all(sum(units) == 50_000 and sum(points) == 150_000 for units, points, _ in lanes.lanes)


@settings(max_examples=300, deadline=None)
@given(st.integers(0, 10**12) | st.none(), st.text(alphabet="ab\n\r<PSM>é😀", max_size=60))
def test_rows_against_plain_slices(doc_id, text):
    assert fim.rearranged(doc_id, text) == plain(doc_id, text)
    assert fim.rearranged(doc_id, text, 3, 60, 20) == plain(doc_id, text, 3, 60, 20)


def test_round_trip_and_edges(spark):
    rng = random.Random(4)
    texts = ["", None, "\n", "\n\n\n", "one line", "a <P> b\nc", "x<M>", "\r\n é😀\n", "<\nP>\n<P", "line\n" * 50_000, "x" * 300_000]
    texts += ["".join(rng.choice("ab\n é") for _ in range(rng.randrange(80))) for _ in range(200)]
    rows = [(i, t, "out", 5) for i, t in enumerate(texts)] + [(None, "null id\nof two lines", "out", 5), (3, "\n\n\n", "out", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    made = fim.transform(docs)
    assert sorted(map(tuple, made.collect()), key=repr) == sorted((plain(i, t) for i, t, *_ in rows), key=repr)
    back = made.select(fim.restored(F.col("output"), F.col("form")).alias("t")).collect()
    assert sorted(r.t for r in back) == sorted(t or "" for _, t, *_ in rows)
    assert {"plain", "psm", "spm"} == {r.form for r in made.collect()}
    digests = fim.digest_columns(made).collect()
    assert sorted(r.restored_sha256 for r in digests) == sorted(hashlib.sha256((t or "").encode()).hexdigest() for _, t, *_ in rows)
    assert fim.transform(docs.limit(0)).collect() == []
