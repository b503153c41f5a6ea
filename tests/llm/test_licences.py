"""Licence scans against a naive scan of the words, and the grammar of tags."""

import random
import re

import pytest

from siltstone.llm import licences

LONG = "word " * 30_000
ODD = [None, "", " ", "\n", "a", "\x1c\x1d", "漢字 かな", "😀😀", LONG, "cc by " * 5000, "same text here", "same text here"]


@pytest.mark.parametrize(("text", "value"), [
    ("MIT", (["mit"], 1)), ("MIT OR GPL-3.0-only", (["mit", "gpl-3.0-only"], 1)), ("MIT and GPL-2.0+", (["mit", "gpl-2.0+"], 3)),
    ("GPL-2.0 WITH Classpath-exception-2.0", (["gpl-2.0", "classpath-exception-2.0"], 2)), ("(MIT)", (["mit"], 1)), ("NONE", ([], 0)),
    ("(MIT OR GPL-3.0) AND CC-BY-NC-4.0", (["mit", "gpl-3.0", "cc-by-nc-4.0"], 4)), ("MIT OR GPL-3.0 AND CC-BY-NC-4.0", (["mit", "gpl-3.0", "cc-by-nc-4.0"], 1)),
    ("", None), ("MIT OR", None), ("(MIT", None), ("MIT)", None), ("MIT GPL", None), ("OR MIT", None), ("()", None), ("(A OR B) WITH C", None), ("Odd-1", None), ("LicenseRef-Odd", (["licenseref-odd"], 4)), ("MIT OR Odd-1", None), ("GPL-2.0 WITH Odd-1", None), ("MIT WITH MIT", None), ("Apache-2.0+", (["apache-2.0+"], 1)),
    ("DocumentRef-x:LicenseRef-y AND MIT", (["documentref-x:licenseref-y", "mit"], 4)),
])
def test_expressions(text, value):
    assert licences.evaluate(text) == value


@pytest.mark.parametrize(("line", "expression", "labels"), [
    ("<!-- SPDX-License-Identifier: MIT -->", "MIT", "mit"), ("-- SPDX-License-Identifier: MIT --", "MIT", "mit"), ("SPDX-License-Identifier: MIT-->", "MIT", "mit"),
    ("As told, SPDX-License-Identifier: MIT.", "MIT", "mit"), ("SPDX-License-Identifier: MIT and more words here", "MIT", "mit"),
    ("/* SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note */", "GPL-2.0-only WITH Linux-syscall-note", "gpl-2.0-only,linux-syscall-note"),
    ("# spdx license identifier : (MIT or Apache-2.0), see there", "(MIT or Apache-2.0)", "apache-2.0,mit"), ("SPDX-License-Identifier: 0BSD OR\nMIT", "0BSD", "0bsd"),
    ("SPDX-License-Identifier:\nMIT", None, ""), ("SPDX-License-Identifier: (MIT", None, ""), ("SPDX-License-Identifier: see the file", None, ""), ("SPDX license identifier", None, ""),
    ("SPDX-License-Identifier: See LICENSE file", None, ""), ("SPDX-License-Identifier: Copyright 2020 Foo", None, ""), ("SPDX-License-Identifier: MIT OR Foo-1.0", "MIT", "mit"),
    ("SPDX-License-Identifier: LicenseRef-Foo AND MIT", "LicenseRef-Foo AND MIT", "licenseref-foo,mit"), ("SPDX-License-Identifier: NOASSERTION", None, ""), ("é漢 SPDX-License-Identifier: MIT\r\nSPDX-License-Identifier: ISC", "MIT", "isc,mit"),
])
def test_tags(line, expression, labels):
    found = dict(zip(licences.COLUMNS, licences.scanner()(line), strict=True))
    assert (found["expression"], found["labels"]) == (expression, labels)
    assert found["burden"] == (licences.evaluate(expression)[1] if expression else None) or "\r" in line


@pytest.mark.parametrize(("line", "score"), [
    ("SPDX-License-Identifier: MIT", 0.99), ("SPDX-License-Identifier: MIT and more words", 0.99), ("SPDX-License-Identifier: MIT OR Foo-1.0", 0.5), ("SPDX-License-Identifier: Copyright 2020", 0.5),
    ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC OR Foo", 0.99), ("SPDX-License-Identifier: MIT\nSPDX-License-Identifier: Foo", 0.995),
])
def test_unknown_names_leave_doubt(line, score):
    assert dict(zip(licences.COLUMNS, licences.scanner()(line), strict=True))["score"] == pytest.approx(score)


def test_other_tables_of_names():
    names = licences.names_of(["Odd-1"], [])
    assert licences.evaluate("Odd-1", names) == (["odd-1"], 4) and licences.evaluate("MIT", names) is None


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def naive(text):
    """Every phrase at every word."""
    w = words_of(text)

    def places(phrase):
        p = phrase.split()
        return [i for i in range(len(w)) if w[i] == p[0] and w[i : i + len(p)] == p]

    base = [(i, label) for p, label in licences.BASE.items() for i in places(p)]
    doubt = {label: 1 - licences.BASE_SURE for _, label in base}
    for p, (label, sure) in licences.NOTICES.items():
        if places(p):
            doubt[label] = min(doubt.get(label, 1.0), 1 - sure)
    score = 1.0
    for x in doubt.values():
        score *= x
    first, last = min((i for i, _ in base), default=None), max((i for i, _ in base), default=None)
    return len(w), len(base), first, last, ",".join(sorted({x for _, x in base})), ",".join(sorted(doubt)), 1 - score if doubt else 0.0


def test_every_column_equals_the_naive_scan(spark):
    rng = random.Random(7)
    phrases = [*licences.BASE, *licences.NOTICES]
    texts = [*ODD, "Apache License, apache-license; MIT  License CC BY-NC", "gnu General\nPublic License v3 (Apache License)", "xcc by y", "cc bye", "cc by cc by", "MİT license", "émit license", "cc BY\x00sa"]
    for _ in range(150):
        parts = [rng.choice([rng.choice(phrases), rng.choice(phrases).upper().replace(" ", rng.choice(["-", "\n", "  "])), "plain", "license", "cc", "by", "gnu"]) for _ in range(rng.randrange(1, 9))]
        texts.append(rng.choice([" ", ", ", " / "]).join(parts))
    rows = [(i, t, "z", "y") for i, t in enumerate(texts)] + [(0, texts[20], "z", "y")] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, labels string, score string").repartition(4)
    got = [tuple(r) for r in licences.scan_licences(df).select("doc_id", *licences.COLUMNS[:7]).collect()]
    assert len(got) == len(rows)
    want = sorted(((r[0], *naive(r[1])) for r in rows), key=str)
    for a, b in zip(sorted(got, key=str), want, strict=True):
        assert a[:7] == b[:7] and a[7] == pytest.approx(b[7])


def test_nothing(spark):
    assert licences.scan_licences(spark.createDataFrame([], "doc_id long, text string")).count() == 0
