"""Packing and archives: exact round trips."""

import hashlib
import io
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from tickloom.llm import packing, warc
from tickloom.llm.queries import vocabulary
from tickloom.llm.scratch import Scratch

DOCS = "doc_id long, text string, start int, ids string, shard int"
TEXTS = ["", None, "Hello, World's end", "été É 123 4.5 <|endoftext|> x", "word " * 9000, "a" * 5000, "it 's can 't\tx\x0by z", "same", "same"]


def test_packing(spark):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    rows = [(i, t, 0, "x", 1) for i, t in enumerate(TEXTS)] + [(7, "same", 0, "x", 1), (None, "no id", 0, "x", 1)]
    limit = 1024
    found = packing.pack(spark.createDataFrame(rows, DOCS).repartition(3), vocabulary(), limit, with_ids=True).collect()
    expected = Counter((i, tuple(tokenizer.encode(t or "", add_special_tokens=False).ids) + (2,)) for i, t, *_ in rows)
    pieces = defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4")
        assert len(ids) == r.length and r.length & (r.length - 1) == 0 and r.length <= limit and r.offset == 0
        assert r.ids_crc32 == zlib.crc32(bytes(r.ids))
        pieces[r.doc_id].append((r.start, r.length, ids.tolist(), r.doc_tokens))
    assert sorted(r.sequence_id for r in found) == list(range(len(found)))
    by_sequence = [r.length for r in sorted(found, key=lambda r: r.sequence_id)]
    assert by_sequence == sorted(by_sequence)
    for (i, ids), copies in expected.items():
        mine = sorted(pieces[i], key=lambda p: p[0])[::copies]
        assert [x for p in mine for x in p[2]] == list(ids) and {p[3] for p in mine} == {len(ids)}
        assert len(pieces[i]) == copies * len(packing.piece_lengths(len(ids), limit))
    plain = packing.pack(spark.createDataFrame(rows, DOCS), vocabulary(), limit)
    assert Counter((r.doc_id, r.start, r.ids_crc32) for r in plain.collect()) == Counter((r.doc_id, r.start, r.ids_crc32) for r in found)


def test_piece_lengths():
    for n in (1, 2, 3, 4095, 4096, 4097, 100_000):
        lengths = packing.piece_lengths(n)
        assert sum(lengths) == n and lengths == sorted(lengths, reverse=True) and len({x for x in lengths if x < 4096}) == sum(x < 4096 for x in lengths)
    with pytest.raises(ValueError, match="power of two"):
        packing.pack(None, "", 1000)


def test_pack_nothing(spark):
    assert packing.pack(spark.createDataFrame([], DOCS), vocabulary()).collect() == []


PAGES = "page_id long, url string, html string, digest string, first long, size long"


def pages(spark, count=60):
    html = [f"<html><p>{'page %d ' % (i % 20) * 12}é</p></html>" for i in range(count)]
    rows = [(i, f"http://example.org/ü {i}\r\nX: y", h, "d", 1, 2) for i, h in enumerate(html)]
    rows += [(100, None, None, "d", 1, 2), (101, "u", "", "d", 1, 2), (102, "u", "short", "d", 1, 2), (103, "u", "short", "d", 1, 2),
             (None, "u", html[3], "d", 1, 2), (104, "u", "x" * 3_000_000, "d", 1, 2), (105, "u", "\r\n\r\nWARC/1.1\r\n\r\n" * 20, "d", 1, 2), rows[0], rows[25]]
    return rows, spark.createDataFrame(rows, PAGES).repartition(4)


@pytest.mark.parametrize("trained", [True, False])
def test_round_trip(spark, trained):
    rows, df = pages(spark)
    scratch = Scratch(spark, "test")
    archives = warc.write_archives(df, scratch.path("warc"), None if trained else b"")
    found = warc.read_archives(spark, archives)
    first = {}
    for i, _, h, *_ in rows:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    expected = Counter()
    for i, _, h, *_ in rows:
        data = (h or "").encode()
        revisit = len(data) >= 100 and first[h] != i
        expected[i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[h] if revisit else None, None] += 1
    assert Counter(map(tuple, warc.page_rows(found).collect())) == expected
    payloads = Counter(bytes(r.payload) for r in found.where("record_type = 'response'").collect())
    assert set(payloads) == {(h or "").encode() for _, _, h, *_ in rows}
    assert sum(r.records for r in archives.collect()) == found.count() - archives.count()  # beside one warcinfo each


def test_no_pages(spark):
    scratch = Scratch(spark, "test")
    archives = warc.write_archives(spark.createDataFrame([], PAGES), scratch.path("warc"))
    assert archives.collect() == [] and warc.read_archives(spark, archives).collect() == []


def test_damage():
    digest = hashlib.sha256(b"payload").hexdigest()
    good = warc.page_record(1, "u", b"payload", 7, digest, None)
    assert warc.parse(good)["problem"] is None
    assert warc.parse(good.replace(b"payload", b"Payload"))["problem"] == "digest of the payload"
    assert warc.parse(good[:-2])["problem"] == "length of the block"
    assert warc.parse(good.replace(b"WARC/1.1", b"WARC/9"))["problem"] == "no WARC header"
    assert warc.parse(good.replace(b"WARC-Date", b"WARC-Dote"))["problem"] == "no warc-date"
    assert warc.parse(b"")["problem"] == "no WARC header"
    cut = io.BytesIO(zstandard.ZstdCompressor().compress(good)[:-3])
    with pytest.raises(ValueError, match="inside a frame"):
        list(warc.frames(cut))


def test_leading_dictionary():
    samples = [f"<html>{i} some text that repeats {i * 7}</html>".encode() * 10 for i in range(300)]
    dictionary = warc.train(samples)
    assert dictionary
    frame = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)).compress(samples[0])
    for stored in (dictionary, zstandard.ZstdCompressor().compress(dictionary)):  # plain or compressed
        archive = struct.pack("<II", warc.DICTIONARY_FRAME, len(stored)) + stored + frame + frame
        assert list(warc.frames(io.BytesIO(archive))) == [samples[0], samples[0]]
    with pytest.raises(zstandard.ZstdError):
        list(warc.frames(io.BytesIO(frame)))
