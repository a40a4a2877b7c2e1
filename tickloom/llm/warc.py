"""WARC archives compressed with Zstandard, one frame per record.

An archive starts with a skippable frame that holds the dictionary (itself a
Zstandard frame), then a ``warcinfo`` record, then the records. Readers decode
one frame at a time in bounded memory and check version line, mandatory
headers, lengths, trailing line ends and digests; what fails a check is
returned with the reason, never dropped.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.scratch import Scratch, hashed_sample

#: Fixed values of the formats: frame types, record version.
DICTIONARY_FRAME, ZSTD_FRAME = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
VERSION = b"WARC/1.1"
CRLF = b"\r\n"

#: Payloads below this are stored each; only longer ones are recorded as revisits.
REVISIT_BYTES = 100
#: Archive size at which a task starts the next one.
ARCHIVE_BYTES = 256 << 20
#: The dictionary is trained on at most this many payloads (those with the smallest hashes), at most so many characters of each.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 16_384, 64 << 10
LEVEL, CHUNK = 3, 1 << 20
DATE = "1970-01-01T00:00:00Z"

RECORD_SCHEMA = (
    "path string, record_type string, record_id string, target_uri string, refers_to string, payload_digest string, "
    "payload_bytes long, payload binary, problem string"
)


def train(samples: list[bytes]) -> bytes:
    """Dictionary bytes, empty where there is too little to train on."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _urn(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def _page_id(urn: str) -> int | None:
    digits = urn.removeprefix("<urn:page:").removesuffix(">")
    return None if digits in ("none", "") else int(digits)


def record(kind: str, record_id: str, block: bytes, headers: list[tuple[str, str]], date: str = DATE) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", record_id), ("WARC-Date", date), *headers, ("Content-Length", str(len(block)))]
    return VERSION + CRLF + b"".join(f"{name}: {value}\r\n".encode() for name, value in lines) + CRLF + block + CRLF + CRLF


def _http(payload_bytes: int) -> bytes:
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {payload_bytes}\r\n\r\n".encode()


def page_record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, first: int | None) -> bytes:
    """A response, or (``first`` set) a revisit: the same HTTP headers without the payload."""
    headers = [("WARC-Target-URI", quote(url or "about:blank", safe="%/:?#[]@!$&'()*+,;=~-._")), ("WARC-Payload-Digest", f"sha256:{digest}"),
               ("Content-Type", "application/http;msgtype=response")]
    if first is None:
        return record("response", _urn(page_id), _http(size) + payload, headers)
    headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(first))]
    return record("revisit", _urn(page_id), _http(size), headers)


class ArchiveWriter:
    """Archives of one task, each closed at ARCHIVE_BYTES; names are unique to the attempt, so a retried task leaves the
    files of the lost attempt unlisted."""

    def __init__(self, folder: str, part: int, dictionary: bytes):
        self.filesystem, self.folder = fs.FileSystem.from_uri(folder)
        self.filesystem.create_dir(self.folder, recursive=True)
        self.base, self.part, self.dictionary, self.stream, self.done = folder.rstrip("/"), part, dictionary, None, []
        using = {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True, **using)

    def add(self, data: bytes) -> None:
        if self.stream is None:
            self.name, self.size, self.records = f"part-{self.part:05d}-{uuid.uuid4().hex}.warc.zst", 0, 0
            self.stream = self.filesystem.open_output_stream(f"{self.folder}/{self.name}")
            if self.dictionary:
                packed = zstandard.ZstdCompressor(level=LEVEL).compress(self.dictionary)
                self._put(struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed)
            self._put(self.compressor.compress(record("warcinfo", f"<urn:uuid:{uuid.uuid4()}>", b"format: WARC File Format 1.1\r\n", [("Content-Type", "application/warc-fields")])))
        self._put(self.compressor.compress(data))
        self.records += 1
        if self.size >= ARCHIVE_BYTES:
            self.close()

    def _put(self, data: bytes) -> None:
        self.stream.write(data)
        self.size += len(data)

    def close(self) -> None:
        if self.stream is not None:
            self.stream.close()
            self.done.append((f"{self.base}/{self.name}", self.records, self.size))
            self.stream = None


def _writer(folder: str, dictionary: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive = ArchiveWriter(folder, TaskContext.get().partitionId(), dictionary)
        for batch in batches:
            for row in zip(*(batch[c] for c in ("page_id", "url", "html", "size", "digest", "first")), strict=True):
                page_id, url, html, size, digest, first = (x.as_py() for x in row)
                archive.add(page_record(page_id, url, None if html is None else html.encode(), size, digest, first))
        archive.close()
        paths, records, sizes = zip(*archive.done, strict=True) if archive.done else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(paths, pa.string()), pa.array(records, pa.int64()), pa.array(sizes, pa.int64())], names=["path", "records", "bytes"]
        )

    return run


def write_archives(pages: DataFrame, folder: str, dictionary: bytes | None = None) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives below ``folder``; returns their list (path, records, bytes).

    ``folder`` must be visible to all executors. Of equal payloads of at least
    REVISIT_BYTES the one with the smallest page_id is a response, the others
    revisits of it. A null html is an empty payload, a null url about:blank;
    pages without an id are stored and, unless another page has their payload,
    responses. Repeated rows are stored each, as responses where their id is
    the smallest. An empty table gives no archive.
    """
    scratch = Scratch(pages.sparkSession, "warc")
    html = F.coalesce("html", F.lit(""))
    base = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.octet_length(html).cast("long").alias("size"), F.sha2(html, 256).alias("digest"))
    if dictionary is None:
        some = base.where("size > 0").select("page_id", "digest", F.substring("html", 1, SAMPLE_CHARS).alias("html"))
        samples = hashed_sample(some, ["page_id", "digest"], SAMPLE_PAGES, some.count())
        dictionary = train([row.html.encode() for row in samples.collect()])
    # combined before the shuffle, stored so that a payload that many pages share can be split in the join
    firsts = scratch.keep(
        base.where(F.col("size") >= REVISIT_BYTES).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "firsts"
    )
    marked = base.join(firsts, "digest", "left")
    is_revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = marked.select(
        "page_id", "url", F.when(~is_revisit, F.col("html")).alias("html"), "size", "digest", F.when(is_revisit, F.col("first")).alias("first"),
    )
    return scratch.keep(rows.mapInArrow(_writer(folder, dictionary), "path string, records long, bytes long"), "archives")


def frames(stream) -> Iterator[bytes]:
    """Decoded frames of an open archive, one at a time; the leading dictionary is loaded first if there is one."""
    head = stream.read(8)
    decompressor, pending = zstandard.ZstdDecompressor(), head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == DICTIONARY_FRAME:
        dictionary = stream.read(struct.unpack("<I", head[4:])[0])
        if dictionary[:4] == ZSTD_FRAME:
            dictionary = zstandard.ZstdDecompressor().decompress(dictionary)
        decompressor, pending = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)), b""
    while True:
        pending = pending or stream.read(CHUNK)
        if not pending:
            return
        frame, parts = decompressor.decompressobj(), []
        while not frame.eof:
            if not pending:
                pending = stream.read(CHUNK)
                if not pending:
                    raise ValueError("the archive ends inside a frame")
            parts.append(frame.decompress(pending))
            pending = frame.unused_data if frame.eof else b""
        yield b"".join(parts)


def _fields(head: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n"))
    return {name.strip().lower(): value.strip() for name, _, value in pairs}


def parse(data: bytes) -> dict:
    """One record; ``problem`` names the first check that failed, null if none did."""
    out = dict.fromkeys(("record_type", "record_id", "target_uri", "refers_to", "payload_digest", "payload_bytes", "payload", "problem"))
    head, gap, rest = data.partition(CRLF + CRLF)
    version, _, lines = head.partition(CRLF)
    if not gap or version != VERSION:
        return out | {"problem": "no WARC header"}
    fields = _fields(lines)
    out |= {"record_type": fields.get("warc-type"), "record_id": fields.get("warc-record-id"), "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to")}
    missing = [name for name in ("warc-type", "warc-record-id", "warc-date", "content-length") if name not in fields]
    if missing:
        return out | {"problem": f"no {missing[0]}"}
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or rest[-4:] != CRLF + CRLF:
        return out | {"problem": "length of the block"}
    if out["record_type"] not in ("response", "revisit"):
        return out
    http, gap, payload = rest[:-4].partition(CRLF + CRLF)
    http_fields = _fields(http.partition(CRLF)[2])
    if not gap or not http_fields.get("content-length", "").isdigit():
        return out | {"problem": "no HTTP header"}
    out |= {"payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha256:"), "payload_bytes": int(http_fields["content-length"])}
    if out["record_type"] == "revisit":
        return out | {"problem": "payload in a revisit" if payload else None if out["refers_to"] else "no warc-refers-to"}
    out["payload"] = payload
    if len(payload) != out["payload_bytes"]:
        return out | {"problem": "length of the payload"}
    return out | {"problem": None if hashlib.sha256(payload).hexdigest() == out["payload_digest"] else "digest of the payload"}


def _reader(with_payload: bool):
    names = [column.split()[0] for column in RECORD_SCHEMA.split(", ")]
    types = {"payload_bytes": pa.int64(), "payload": pa.binary()}

    def batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types.get(n, pa.string())) for n in names], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for one in batches:
            for path in one["path"].to_pylist():
                filesystem, place = fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with filesystem.open_input_stream(place) as stream:
                    for data in frames(stream):
                        row = parse(data) | {"path": path}
                        row["payload"] = row["payload"] if with_payload else None
                        rows.append(row)
                        size += len(row["payload"] or b"") + 400
                        if size > 8 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                yield batch(rows)

    return run


def read_archives(spark: SparkSession, archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the archives listed in ``archives`` (path), one row each; see RECORD_SCHEMA."""
    paths = archives.select("path").where("path IS NOT NULL")
    # a number of its own: Spark would read a list this short in one task
    return paths.repartition(max(1, paths.count()), "path").mapInArrow(_reader(with_payload), RECORD_SCHEMA)


def page_rows(records: DataFrame) -> DataFrame:
    """Records of pages back as rows: page_id, payload_bytes, payload_digest, record_type, refers_to, problem."""
    def id_of(column: str):
        return F.regexp_extract(column, r"^<urn:page:(-?\d+)>$", 1)

    def number(column: str):
        return F.when(id_of(column) != "", id_of(column)).cast("long")

    return records.where("record_type IN ('response', 'revisit') OR problem IS NOT NULL").select(
        number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "problem",
    )
