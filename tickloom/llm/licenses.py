"""Licence scans: canonical text digests joined to the digests of known licences.

A text is canonicalised with built-in functions only: letters folded, lines
that only state a copyright dropped, punctuation and white space reduced to
single spaces, spelling variants made equal; of a whole text also its title and
what follows the end of the terms are dropped. Its SHA-256 is then an exact
lookup key, so the scan is a hash join whatever the number of licences.

Two units are looked up: the whole text, and each of its lines (a notice such
as "Released under the MIT License." inside prose is a line of its own).
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.llm.scratch import Scratch, ascii_lower, row_key, same_row

#: Known texts may be broadcast up to this many rows (one digest and a name each).
BROADCAST_ROWS = 100_000

#: Lines that only state a copyright: the word or the sign with a year or another sign behind it, or the reservation alone.
#: Applied per line, after folding; only the line feed ends a line.
COPYRIGHT_LINE = (
    r"^[\x20\t#*/;-]*(?:copyright[\x20:,]*(?:\(c\)|©|[12][0-9]{3})[^\n]*|(?:\(c\)|©)[\x20:,]*[12][0-9]{3}[^\n]*|all rights reserved[.\x20\t]*)$"
)
#: What counts as punctuation: ASCII other than letters, digits and the line feed, and common typographic marks.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F«»‘’“”–—…]+"
#: Equivalent spellings (variant, canonical), whole words, applied in this order.
SPELLINGS = (
    (" licence", " license"), (" sub license", " sublicense"), (" sub licence", " sublicense"), (" sublicence", " sublicense"),
    (" non commercial", " noncommercial"), (" authorisation", " authorization"), (" authorised", " authorized"),
    (" organisation", " organization"), (" recognised", " recognized"), (" favour", " favor"),
    (" behaviour", " behavior"), (" fulfil ", " fulfill "), (" per cent", " percent"),
    (" copyright owner", " copyright holder"), (" cc by ", " creative commons attribution "),
    (" gnu gpl ", " gnu general public license "), (" https ", " http "), (" v ", " version "), (" v1", " version 1"), (" v2", " version 2"), (" v3", " version 3"), (" v4", " version 4"),
)
#: Short notices and texts of public licences.
NOTICES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at\n\nhttp://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)
#: Phrases that differ between copies of one licence (variant, canonical), whole words of a canonical text.
PHRASES = (
    (" 51 franklin street fifth floor boston ma 02110 1301 usa ", " "), (" 51 franklin st fifth floor boston ma 02110 1301 usa ", " "),
    (" 59 temple place suite 330 boston ma 02111 1307 usa ", " "), (" 675 mass ave cambridge ma 02139 usa ", " "),
    (" the authors and contributors ", " the copyright holders and contributors "), (" the author and contributors ", " the copyright holders and contributors "),
    (" the authors or contributors ", " the copyright holder or contributors "), (" the author or contributors ", " the copyright holder or contributors "),
)
#: Spellings of several words, which a line break may part, are replaced again in a whole text.
PARTED = (*((v, c) for v, c in SPELLINGS if " " in v.strip()), *PHRASES)
#: Titles over licence texts, in canonical form.
TITLES = (
    "mit license", "mit license mit", "mit", "isc license", "isc license isc", "isc", "bsd zero clause license", "zero clause bsd", "bsd 0 clause license",
    "0bsd", "bsd license", "bsd 2 clause license", "2 clause bsd license", "bsd 2 clause simplified license", "simplified bsd license", "bsd 2 clause",
    "bsd 3 clause license", "3 clause bsd license", "bsd 3 clause new or revised license", "new bsd license", "bsd 3 clause", "zlib license",
    "boost software license version 1 0 august 17th 2003", "boost software license 1 0", "bsl 1 0", "unlicense",
    "apache license version 2 0 january 2004 http www apache org licenses", "gnu general public license version 3 29 june 2007",
    "gnu general public license version 2 june 1991", "gnu general public license version 1 february 1989",
    "gnu lesser general public license version 2 1 february 1999", "gnu lesser general public license version 3 29 june 2007",
    "gnu library general public license version 2 june 1991", "mozilla public license version 2 0", "mozilla public license version 1 1",
    "creative commons legal code cc0 1 0 universal", "attribution sharealike 4 0 international",
)
#: A title at the start of a text that goes on, and what stands behind the terms.
TITLE_FIRST = "^(?:the )?(?:" + "|".join(sorted(TITLES, key=len, reverse=True)) + ") "
TERMS_END = " end of terms and conditions .*$"


def license_texts() -> dict[str, str]:
    """Texts of public licences by name, without the copyright lines of any one project; a file of ``license_texts`` each."""
    folder = files("tickloom.llm") / "license_texts"
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


def _forms(text: str) -> tuple[str, ...]:
    """The text, and with its numbered paragraphs unnumbered, as they stand behind bullets."""
    return tuple(dict.fromkeys((text, re.sub(r"(?m)^[0-9]\. ", "", text) if len(text) < 2000 else text)))


KNOWN = (*NOTICES, *((name, form) for name, text in license_texts().items() for form in _forms(text)))


def canonical_lines(text: Column) -> Column:
    """Canonical form that keeps line breaks; null gives an empty text."""
    out = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "(?md)" + COPYRIGHT_LINE, "")
    # every word stands between spaces, so that spellings are replaced as words
    out = F.concat(F.lit(" "), F.replace(F.regexp_replace(out, PUNCTUATION, " "), F.lit("\n"), F.lit(" \n ")), F.lit(" "))
    for variant, spelling in SPELLINGS:
        out = F.replace(out, F.lit(variant), F.lit(spelling))
    return out


def whole(canonical: Column) -> Column:
    """One line of the canonical lines, without title and without what follows the terms."""
    out = F.regexp_replace(canonical, r"[\x20\n]+", " ")
    for variant, phrase in PARTED:
        out = F.replace(out, F.lit(variant), F.lit(phrase))
    return F.trim(F.regexp_replace(F.regexp_replace(F.ltrim(out), TITLE_FIRST, " "), TERMS_END, ""))


def line(canonical: Column) -> Column:
    return F.trim(F.regexp_replace(canonical, r"\x20+", " "))


def known_digests(known: DataFrame) -> DataFrame:
    """(license_id, text) to one row per digest; of licences with equal digests the smallest name stands."""
    form = whole(canonical_lines(F.col("text")))
    return (
        known.select("license_id", form.alias("form")).where("form <> ''")
        .groupBy(F.sha2("form", 256).alias("digest")).agg(F.min("license_id").alias("license_id"), F.max(F.length("form")).alias("length"))
    )


def scan(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Licences of each row of ``docs`` (doc_id, text): whole text and single lines.

    Returns doc_id, text_digest (of the canonical text), license_id (of the
    whole text, null if unknown), line_licenses (names found on lines, sorted,
    comma-joined, empty if none) and n_license_lines.

    Null and empty texts have the digest of the empty text and no licence;
    repeated rows give repeated results; null ids are kept; other columns are
    ignored; empty inputs give an empty result or no licence.
    """
    digests = known_digests(known)
    # the bounds only skip lines that no known text can equal
    bound = digests.agg(F.count("*"), F.min("length"), F.max("length")).first()
    digests = digests.drop("length")
    if bound[0] <= BROADCAST_ROWS:
        digests = F.broadcast(digests)
    base = docs.select("doc_id", row_key(F.col("text")).alias("row_key"), canonical_lines(F.col("text")).alias("canonical"))
    candidates = F.filter(F.transform(F.split("canonical", "\n"), line), lambda x: F.length(x).between(bound[1] or 0, bound[2] or 0))
    # the canonical form is made once; digests stand in for it from here on
    units = Scratch(docs.sparkSession, "licenses").keep(base.select(
        "doc_id", "row_key", F.sha2(whole(F.col("canonical")), 256).alias("text_digest"), F.transform(candidates, lambda x: F.sha2(x, 256)).alias("lines"),
    ), "units")
    found = (
        units.select("doc_id", "row_key", F.explode("lines").alias("digest")).join(digests, "digest")
        .groupBy("doc_id", "row_key", "license_id").agg(F.count("*").alias("n"))
        .groupBy("doc_id", "row_key").agg(F.sum("n").alias("n"), F.array_join(F.array_sort(F.collect_list("license_id")), ",").alias("line_licenses"))
    )
    # a repeated row has counted its lines once for each copy
    copies = units.groupBy("doc_id", "row_key").agg(F.count("*").alias("copies"))
    found = same_row(found, copies, "inner").select("doc_id", "row_key", (F.col("n") / F.col("copies")).cast("long").alias("n_license_lines"), "line_licenses")
    texts = units.drop("lines")
    texts = texts.join(digests, texts["text_digest"] == digests["digest"], "left").drop("digest")
    return same_row(texts, found).select(
        "doc_id", "text_digest", "license_id", F.coalesce("line_licenses", F.lit("")).alias("line_licenses"),
        F.coalesce("n_license_lines", F.lit(0)).cast("long").alias("n_license_lines"),
    )


def known_licenses(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(KNOWN), "license_id string, text string")


def _sql_canonical(text: str) -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    out = f"regexp_replace(translate(coalesce({text}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {quote("(?m)" + COPYRIGHT_LINE)}, '', 'g')"
    out = f"' ' || replace(regexp_replace({out}, {quote(PUNCTUATION)}, ' ', 'g'), chr(10), ' ' || chr(10) || ' ') || ' '"
    for variant, spelling in SPELLINGS:
        out = f"replace({out}, {quote(variant)}, {quote(spelling)})"
    return out


def _sql_whole(canonical: str) -> str:
    out = rf"regexp_replace({canonical}, '[\x20\n]+', ' ', 'g')"
    for variant, phrase in PARTED:
        out = f"replace({out}, '{variant}', '{phrase}')"
    return f"trim(regexp_replace(regexp_replace(ltrim({out}), '{TITLE_FIRST}', ' '), '{TERMS_END}', ''))"


def oracle_sql() -> str:
    """Literals keep their line breaks."""
    rows = ", ".join("({}, {})".format(*("'" + x.replace("'", "''") + "'" for x in row)) for row in KNOWN)
    return rf"""WITH known(license_id, text) AS (VALUES {rows}),
digests AS (SELECT sha256({_sql_whole(_sql_canonical('text'))}) AS digest, min(license_id) AS license_id FROM known GROUP BY 1),
base AS (SELECT doc_id, {_sql_canonical('text')} AS canonical FROM documents),
lines AS (SELECT doc_id, sha256(trim(regexp_replace(unnest(string_split(canonical, chr(10))), '\x20+', ' ', 'g'))) AS digest FROM base),
found AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS line_licenses, count(*) AS n
  FROM lines JOIN digests USING (digest) GROUP BY doc_id),
texts AS (SELECT doc_id, sha256({_sql_whole('canonical')}) AS text_digest FROM base)
SELECT t.doc_id, t.text_digest, d.license_id, coalesce(f.line_licenses, '') AS line_licenses,
  CAST(coalesce(f.n, 0) AS BIGINT) AS n_license_lines
FROM texts t LEFT JOIN digests d ON d.digest = t.text_digest LEFT JOIN found f ON f.doc_id = t.doc_id"""
