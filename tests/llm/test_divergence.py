"""Source divergence against plain integers."""

import itertools
import random
import re
from collections import Counter

import numpy as np

from siltstone.llm import divergence
from siltstone.llm.divergence import gain, shares

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOW = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def plain(rows, top=200):
    docs = [(lang or "", source or "", TERM.findall((text or "").translate(LOW))) for lang, source, text in rows]
    out = []
    for lang in {d[0] for d in docs}:
        df = Counter(t for la, _, terms in docs if la == lang for t in set(terms))
        kept = {t for t, n in df.items() if n >= 3}
        n = {s: Counter() for la, s, _ in docs if la == lang}
        for la, s, terms in docs:
            if la == lang:
                n[s].update(t for t in terms if t in kept)

        def share(c):
            return {t: 1 + 10**9 * (c[t] + 1) // (sum(c.values()) + len(kept)) for t in kept}

        q = share(sum(n.values(), Counter()))
        p = {s: share(c) for s, c in n.items()}
        for s in n:
            pairs = [(x, sum((p[s][t] - p[x][t]) ** 2 // p[x][t] for t in kept)) for x in n if x != s]
            terms = [(t, (p[s][t] - q[t]) ** 2 // q[t]) for t in kept if n[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                found.sort(key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, item, value, rank) for rank, (item, value) in enumerate(found[:most], 1)]
    return sorted(out)


def rows_of(rng, n):
    words = ["The", "the", "café", "über", "Ω", "ω", "a1b", "x-y", "漢字", "É", "z"] + [f"w{chr(97 + i)}" for i in range(20)]
    return [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", "s4", "é", None]), rng.choice([None, "", "12 34"]) if rng.random() < 0.2 else " ".join(rng.choices(words, k=rng.randint(1, 30)))) for _ in range(n)]


def docs_of(spark, rows):
    return spark.createDataFrame([(*r, "term", 7) for r in rows], "lang string, source string, text string, part string, n int").repartition(3)


def test_equals_plain_integers(spark, monkeypatch):
    rng = random.Random(2)
    for n, cells, kept, top in ((150, 2**20, 400_000, 200), (300, 30, 20, 3)):  # the second deals terms over many tiles and sends counts on often
        rows = rows_of(rng, n)
        for name, value in (("CELLS", cells), ("AT_ONCE", cells), ("KEPT", kept), ("SENT", cells)):
            monkeypatch.setattr(divergence, name, value)
        found = divergence.divergence(docs_of(spark, rows), top=top)
        assert found.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert sorted(tuple(r) for r in found.collect()) == plain(rows, top)


def test_tables_without_terms(spark):
    rows = [("en", "a", None), ("en", "b", "only once"), ("en", "c", "12"), ("de", None, ""), (None, None, None)]
    found = sorted(tuple(r) for r in divergence.divergence(docs_of(spark, rows)).collect())
    assert found == plain(rows) == sorted(("en", x, "pair", y, 0, r) for x in "abc" for r, y in enumerate(sorted({*"abc"} - {x}), 1))
    assert divergence.divergence(docs_of(spark, rows).limit(0)).collect() == []


def test_repeats_ties_and_a_long_text(spark):
    rows = [("en", "a", "x y x y"), ("en", "a", "x y x y"), ("en", "b", "y x"), ("en", "b", "z " * 50_000), ("en", "c", "z Z"), ("en", "c", "z")]
    assert sorted(tuple(r) for r in divergence.divergence(docs_of(spark, rows)).collect()) == plain(rows)


def test_shares_are_exact():
    cases = [(1, 3), (10**12, 3 * 10**12 + 7), (2**52 - 1, 2**52), (5, 5), *itertools.product((1, 999, 10**9 + 7), (10**9 + 7, 2**40))]
    n, total = (np.array(x, np.int64) for x in zip(*cases, strict=True))
    assert shares(n, total).tolist() == [1 + 10**9 * a // b for a, b in cases]
    assert gain(np.array([10**9 + 1]), np.array([1])).tolist() == [10**18]
