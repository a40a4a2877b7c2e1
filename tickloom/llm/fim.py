"""Fill-in-the-middle: texts cut at two line boundaries and put in another order.

The cuts are ranks of lines, the output needs places in the text. An indexable
skip list over the lines leads from one to the other: every link of a lane
carries how many lines and how many code points it skips, so that a descent
that adds up the widths of the links it takes arrives at a rank together with
the code points before it. Which lines stand on the upper lanes is a hash of
their number, so a rebuilt list is the same list.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.llm.rolling import mixed

#: Marks of the parts.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Seed of the draws; per cent of the texts transformed, and of those written suffix first.
SEED, RATE, SUFFIX_FIRST = 7, 100, 50
#: A node of one lane stands on the next with one chance in 2^LANE_BITS.
LANE_BITS = 2
#: Output leaves a task in batches of about this many characters.
BATCH_CHARS = 4 << 20
SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


class SkipList:
    """Nodes in order, each with a width; lanes from the sparsest to the one with all nodes.

    A lane is three lists: units and points that each link skips, and the link
    of the lane below that starts at the same node.
    """

    def __init__(self, widths: list[int]):
        count = len(widths)
        points = np.concatenate(([0], np.cumsum(np.asarray(widths, np.int64))))
        rank = np.arange(1, count, dtype=np.uint64)
        luck = mixed(rank)
        nodes = np.arange(count + 1)  # starts of the links, and the end
        self.lanes: list[tuple[list[int], list[int], list[int]]] = []
        below = None
        while True:
            down = [] if below is None else np.searchsorted(below, nodes[:-1]).tolist()
            self.lanes.insert(0, (np.diff(nodes).tolist(), np.diff(points[nodes]).tolist(), down))
            low = np.uint64((1 << LANE_BITS * len(self.lanes)) - 1)
            stays = (rank[(luck & low) == 0]).astype(np.int64)
            if len(nodes) <= 2 or len(stays) + 2 >= len(nodes):
                break
            below, nodes = nodes, np.concatenate(([0], stays, [count]))

    def points_before(self, rank: int) -> int:
        """Code points of the first ``rank`` nodes."""
        units = points = link = 0
        for lane_units, lane_points, down in self.lanes:
            while link < len(lane_units) and units + lane_units[link] <= rank:
                units += lane_units[link]
                points += lane_points[link]
                link += 1
            if units == rank:
                return points
            link = down[link] if down else link
        return points


def line_widths(text: str) -> list[int]:
    """Code points of every line, its line feed included."""
    widths = [len(line) + 1 for line in text.split("\n")]
    widths[-1] -= 1
    return widths if widths[-1] else widths[:-1]


def draws(doc_id: int | None, seed: int) -> tuple[int, int, int, int]:
    """Four 32-bit numbers that depend on the id alone; a missing id counts as an empty one."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[i: i + 4], "big") for i in (0, 4, 8, 12))


def rearranged(doc_id: int | None, text: str, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> tuple:
    """One row of SCHEMA."""
    h1, h2, h3, h4 = draws(doc_id, seed)
    widths = line_widths(text)
    n = len(widths)
    if not text or h3 % 100 >= rate or any(mark in text for mark in (PREFIX, SUFFIX, MIDDLE)):
        return doc_id, n, "plain", None, None, text
    lines = SkipList(widths)
    a, b = (lines.points_before(rank) for rank in sorted((h1 % (n + 1), h2 % (n + 1))))
    before, between, after = text[:a], text[a:b], text[b:]
    if h4 % 100 < suffix_first:
        return doc_id, n, "spm", a, b - a, f"{SUFFIX}{after}{PREFIX}{before}{MIDDLE}{between}"
    return doc_id, n, "psm", a, b - a, f"{PREFIX}{before}{SUFFIX}{after}{MIDDLE}{between}"


def _rows(seed: int, rate: int, suffix_first: int):
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"], strict=True):
                rows.append(rearranged(doc_id, text.as_py() or "", seed, rate, suffix_first))
                held += len(rows[-1][-1])
                if held >= BATCH_CHARS:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return run


def transform(docs: DataFrame, seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> DataFrame:
    """doc_id, n (lines), form (plain, psm, spm), prefix_chars, middle_chars (code points) and output, per row of ``docs`` (doc_id, text).

    ``rate`` per cent of the texts are cut, ``suffix_first`` per cent of those
    have their suffix first. Null and empty texts, and texts that hold a mark,
    stay plain with null lengths. Rows that share an id are cut by the same
    draws, repeated rows give repeated results, a null id draws like an empty
    one; an empty table gives no rows; other columns are ignored.
    """
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_rows(seed, rate, suffix_first), SCHEMA)


def restored(output: Column, form: Column) -> Column:
    """The text again, from a transformed one and its form."""
    parts = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}")
    psm = F.concat(F.get(parts, F.lit(1)), F.get(parts, F.lit(3)), F.get(parts, F.lit(2)))
    spm = F.concat(F.get(parts, F.lit(2)), F.get(parts, F.lit(3)), F.get(parts, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest_columns(transformed: DataFrame) -> DataFrame:
    """SHA-256 of the output and of the text rebuilt from it, in place of the output."""
    return transformed.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"),
    )


def oracle_sql(seed: int = SEED, rate: int = RATE, suffix_first: int = SUFFIX_FIRST) -> str:
    draw = ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT) AS h{i + 1}" for i in range(4))
    return rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
l AS (SELECT doc_id, text, regexp_extract_all(text, '[^\n]*\n|[^\n]+') AS u, {draw} FROM d),
c AS (SELECT *, CAST(len(u) AS BIGINT) AS n,
  CASE WHEN text = '' OR contains(text, '{PREFIX}') OR contains(text, '{SUFFIX}') OR contains(text, '{MIDDLE}') OR h3 % 100 >= {rate} THEN 'plain'
    WHEN h4 % 100 < {suffix_first} THEN 'spm' ELSE 'psm' END AS form,
  least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM l),
p AS (SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:], ''), '') AS suf FROM c),
o AS (SELECT *, CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{PREFIX}' || pre || '{SUFFIX}' || suf || '{MIDDLE}' || mid
  ELSE '{SUFFIX}' || suf || '{PREFIX}' || pre || '{MIDDLE}' || mid END AS output FROM p)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(pre) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(mid) AS BIGINT) END AS middle_chars,
  sha256(output) AS output_sha256, sha256(CASE form WHEN 'plain' THEN output ELSE pre || mid || suf END) AS restored_sha256 FROM o"""
