"""Whole licence files as projects ship them: titled, re-wrapped, with a copyright line."""

import textwrap

import pytest

from tickloom.llm import licenses

TEXTS = licenses.license_texts()

#: As in many repositories.
MIT_FILE = """The MIT License (MIT)

Copyright (c) 2013 Some Person

Permission is hereby granted, free of charge, to any person obtaining a copy of
this software and associated documentation files (the "Software"), to deal in
the Software without restriction, including without limitation the rights to
use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of
the Software, and to permit persons to whom the Software is furnished to do so,
subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS
FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR
COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER
IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN
CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.
"""


def scanned(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = licenses.scan(rows, licenses.known_licenses(spark)).collect()
    return [r.license_id for r in sorted(found, key=lambda r: r.doc_id)]


def test_titled_and_rewrapped_files(spark):
    body = MIT_FILE.split("\n\n", 2)[2]
    paragraphs = [" ".join(p.split()) for p in body.split("\n\n")]
    texts = [MIT_FILE, MIT_FILE.replace("The MIT License (MIT)", "MIT License"), MIT_FILE.replace("The MIT License (MIT)", "The MIT License")]
    # some of these widths break right before "copyright", which makes a copyright line of the rest
    texts += ["MIT License\n\nCopyright 2020 A\n\n" + "\n\n".join(textwrap.fill(p, w) for p in paragraphs) for w in (60, 68, 72, 78, 90, 100)]
    assert scanned(spark, texts) == ["MIT"] * len(texts)


def test_whole_texts(spark):
    assert TEXTS.keys() >= {"Apache-2.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "CC-BY-SA-4.0", "MIT"}
    texts = [(name, f"{text}") for name, text in TEXTS.items()]
    texts += [(name, f"Copyright (c) 2020, Somebody\nAll rights reserved.\n\n{text}") for name, text in TEXTS.items()]
    assert scanned(spark, [t for _, t in texts]) == [name for name, _ in texts]


def test_texts_wrapped_anew(spark):
    """A line that begins with "copyright" inside a sentence is no copyright line."""
    texts = [(name, textwrap.fill(" ".join(text.split()), width, break_long_words=False)) for name, text in TEXTS.items() for width in (50, 60, 72, 79, 100)]
    assert scanned(spark, [t for _, t in texts]) == [name for name, _ in texts]


def test_variants_of_one_licence(spark):
    bsd, apache, gpl = TEXTS["BSD-2-Clause"], TEXTS["Apache-2.0"], TEXTS["GPL-2.0"]
    texts = [
        ("BSD-2-Clause", "The BSD 2-Clause License\n\nCopyright 2011 Somebody. All rights reserved.\n\n" + bsd.replace("1. ", "* ").replace("2. ", "* ")),
        ("BSD-2-Clause", bsd.replace("THE COPYRIGHT HOLDERS AND", "THE AUTHOR AND").replace("THE COPYRIGHT HOLDER OR", "THE AUTHOR OR").replace('"AS IS"', "``AS IS''")),
        ("Apache-2.0", apache.replace("http://", "https://")), ("Apache-2.0", apache[: apache.index("END OF TERMS AND CONDITIONS")]),
        ("GPL-2.0", gpl.replace("51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA", "59 Temple Place, Suite 330, Boston, MA 02111-1307 USA")),
    ]
    assert scanned(spark, [t for _, t in texts]) == [name for name, _ in texts]


@pytest.mark.parametrize("path, name", [
    ("Apache-2.0", "Apache-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("MPL-2.0", "MPL-2.0"),
])
def test_files_of_the_system(spark, path, name):
    try:
        text = open(f"/usr/share/common-licenses/{path}", encoding="utf-8").read()
    except FileNotFoundError:
        pytest.skip("not a Debian system")
    assert scanned(spark, [text]) == [name]


def test_other_texts_are_not_known(spark):
    assert scanned(spark, ["MIT License", MIT_FILE + "\nAnd one more condition.", TEXTS["GPL-3.0"][:5000]]) == [None] * 3
