"""Licence, decontamination and secret scans against brute force in plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict

from tickloom.llm import decontaminate, licenses, secrets

#: Extra columns named like what the operators make for themselves.
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row_key string, digest string, spans int, start int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "k", "d", 1, 2) for i, t, s in rows], SCHEMA).repartition(3)


# licences

def test_licenses(spark):
    mit = next(t for n, t in licenses.KNOWN if n == "MIT" and len(t) > 500)
    apache = next(t for n, t in licenses.KNOWN if n == "Apache-2.0" and len(t) < 60)
    rows = [
        (1, mit, "a"), (2, "Copyright (c) 2020 Someone\n\n" + mit.upper().replace(",", " , ").replace("LICENSE", "LICENCE"), "a"),
        (3, "prose here\nReleased under the MIT  licence!\nmore prose", "a"), (4, "prose " + apache, "a"), (5, None, "a"), (6, "", "a"),
        (7, f"{apache}\nReleased under the MIT License.\n{apache}", "a"), (7, f"{apache}\nReleased under the MIT License.\n{apache}", "a"), (None, apache, "a"),
        (8, "word " * 50_000, "a"), (9, "Copyright 2021 A\n© 2022 B", "a"),
    ]
    found = licenses.scan(frame(spark, rows), licenses.known_licenses(spark)).collect()
    assert Counter((r.doc_id, r.license_id, r.line_licenses, r.n_license_lines) for r in found) == Counter([
        (1, "MIT", "", 0), (2, "MIT", "", 0), (3, None, "MIT", 1), (4, None, "", 0), (5, None, "", 0), (6, None, "", 0),
        (7, None, "Apache-2.0,MIT", 3), (7, None, "Apache-2.0,MIT", 3), (None, "Apache-2.0", "Apache-2.0", 1), (8, None, "", 0), (9, None, "", 0),
    ])
    empty = hashlib.sha256(b"").hexdigest()
    assert {r.doc_id for r in found if r.text_digest == empty} == {5, 6, 9}


def test_licenses_of_nothing(spark):
    assert licenses.scan(frame(spark, []), licenses.known_licenses(spark)).collect() == []
    none = spark.createDataFrame([], "license_id string, text string")
    assert [r.license_id for r in licenses.scan(frame(spark, [(1, "x", "a")]), none).collect()] == [None]


# decontamination

def item_words(text):
    folded = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", folded)


def contamination_brute(rows, items, width):
    windows = defaultdict(set)
    for item, text in items:
        ws = item_words(text)
        for at in range(max(1, len(ws) - width + 1) if ws else 0):
            windows[tuple(ws[at:at + width])].add(str(item))
    sizes = {len(w) for w in windows}
    out = []
    for i, text, _ in rows:
        ws, hit, found = item_words(text), set(), set()
        for size in sizes:
            for at in range(len(ws) - size + 1):
                if (key := tuple(ws[at:at + size])) in windows:
                    hit.update(range(at, at + size))
                    found |= windows[key]
        out.append((i, len(ws), len(hit), len(found), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(ws)))
    return Counter(out)


def test_decontamination(spark, monkeypatch):
    rng = random.Random(4)
    vocabulary = ["a", "b", "C", "é", "d1", "the", "of"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(k, text(rng.choice((1, 2, 3, 5, 8, 12)))) for k in range(12)] + [(50, None), (51, "..."), (None, "a b c"), (9, "of THE of")]
    rows = [(i, text(rng.randint(0, 150)), "s") for i in range(40)]
    rows += [(100, None, "s"), (101, "", "s"), (102, "x" * 20_000, "s"), (103, items[0][1].upper(), "s"), rows[0], (None, rows[1][1], "s")]
    bench = spark.createDataFrame([(*x, "z", 1) for x in items], "item_id long, text string, window string, n int")
    expected = contamination_brute(rows, [x for x in items if x[0] is not None], 5)
    for limit in (100_000, 0):  # with and without broadcasts
        monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", limit)
        found = decontaminate.decontaminate(frame(spark, rows), bench, width=5).collect()
        assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.items), r.contaminated) for r in found) == expected


def test_windows_over_chunks(spark):
    rng = random.Random(6)
    words = [f"w{rng.randint(0, 400)}" for _ in range(1000)]
    items = [(k, " ".join(words[a:a + 30])) for k, a in enumerate((0, 50, 60, 120, 970))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, " ".join(words), "s"), (2, "q " * 70 + " ".join(words[55:75]) + " q" * 2000, "s")]
    found = decontaminate.decontaminate(frame(spark, rows), bench).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, tuple(r.items), r.contaminated) for r in found) == contamination_brute(rows, items, 13)
    kept = decontaminate.drop_contaminated(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns and [r.doc_id for r in kept.collect()] == [2]


def test_empty_benchmark(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    found = decontaminate.decontaminate(frame(spark, [(1, "a b", "s")]), bench).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in found] == [(2, 0, False)]
    assert decontaminate.decontaminate(frame(spark, []), bench).collect() == []


# secrets

BASE = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII), 2, 12),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), 0, 18), ("hex", re.compile(r"[0-9a-f]+"), 0, 16),
]


def base_spans(text):
    found = [(m.start(), k, m.end(), name) for k, (name, pattern, group, least) in enumerate(BASE)
             for m in pattern.finditer(text or "") if len(m[group]) >= least]
    return [f"{name}:{a}:{b}" for a, _, b, name in sorted(found)]


TEXTS = [
    "pässword=abcdefghijkl PassWord: 'AbCdEf123456' token=secret: abcdefghijklm", "é token==aaaaaaaaaaaaaa AKIAABCDEFGHIJKLMN AKIAAKIA AKIA",
    "0123456789abcdef 0123456789abcde deadbeefdeadbeefdeadbeef", "api_key = \"0123456789abcdef0123\" apikey:x secret=short", "", None, "no secrets here",
    "𝒳𝒴 password=𝒳 passwd=qwertyuiopas", "ghp_abcdefghijklmnopqrstuvwxyz0123456789", "password=" + "a" * 30_000, "paſſword=abcdefghijkl",
]


def test_secrets(spark):
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(TEXTS)] + [(1, TEXTS[1], "s1"), (None, TEXTS[2], None)]
    found = secrets.digest_columns(secrets.scan(frame(spark, rows))).collect()
    expected = Counter()
    for i, t, _ in rows:
        spans = base_spans(t)
        kinds = Counter(s.split(":")[0] for s in spans)
        expected[i, kinds["assign"], kinds["access"], kinds["hex"], hashlib.sha256(",".join(spans).encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in found) == expected
    by_id = {r.doc_id: r.spans for r in found}
    assert by_id[8] == "issued:0:40"
    assert all(set(base_spans(t)) <= set(by_id[i].split(",")) for i, t, _ in rows if base_spans(t))


def test_ownership_and_redaction(spark):
    rng = random.Random(1)
    copied, own = "password=exampleexample", "secret=" + "".join(rng.choice("0123456789abcdef") for _ in range(20))
    rows = [(i, f"see {copied} here", f"s{i % 3}") for i in range(6)] + [(10, f"a {own} b {copied}", "s9"), (11, f"{own}", "s9"), (12, None, "s9"), (13, "clean", "s9")]
    docs = frame(spark, rows)
    live = {r.doc_id: r.n_live for r in secrets.digest_columns(secrets.scan(docs)).collect()}
    assert live == {**dict.fromkeys(range(6), 0), 10: 2, 11: 2, 12: 0, 13: 0}  # assign and hex each
    cleaned = secrets.redact(docs)
    assert cleaned.schema == docs.schema
    texts = {r.doc_id: (r.text, r.n_chars, r.source, r.spans) for r in cleaned.collect()}
    assert texts[10] == (f"a <secret> b {copied}", len(f"a <secret> b {copied}"), "s9", 1)
    assert texts[11][0] == "<secret>" and texts[12][0] is None and texts[13][0] == "clean" and texts[3][0] == f"see {copied} here"


def test_no_rows_no_secrets(spark):
    assert secrets.scan(frame(spark, [])).collect() == []
    assert secrets.redact(frame(spark, [])).collect() == []
