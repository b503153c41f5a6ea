"""Periodic runs against a plain search, period by period."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siltstone.llm import periods, queries

EDGES = [None, "", " \n", "a", "a a a a a", "a a a a a a", "b a a a a a a c", "a b a b a b a b", "a b a b a b a", "x " * 3000, "\x1c \x1c \x1c\t\x1c\x0b\x1c \x1c", "é é é é é é", "same same same same same same", "same same same same same same"]


def plain(words, exponent=4, shortest=6):
    """Maximal stretches that are equal to themselves q words on, for each q, if no smaller period holds."""
    out = []
    for q in range(1, len(words) // exponent + 1):
        equal = np.array([words[i] == words[i + q] for i in range(len(words) - q)] + [False])
        edge = np.flatnonzero(np.diff(np.r_[0, equal.astype(int)]))
        for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
            run = words[a : b + q]
            if len(run) >= max(shortest, exponent * q) and not any(run[r:] == run[:-r] for r in range(1, q)):
                out.append((a, len(run), q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def plant(doc_id, text):
    words = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode() if doc_id is not None else b"")
    g, n = h // 10, len(words)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_row(words):
    runs = plain(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
    told = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    return len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4), hashlib.sha256(told.encode()).hexdigest(), hashlib.sha256(kept).hexdigest()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=40), max_size=5), st.integers(1, 60), st.integers(2, 5))
def test_equals_the_plain_search(texts, together, exponent):
    old, periods.TOGETHER = periods.TOGETHER, together
    try:
        assert periods.find(texts, exponent, 3) == [plain(t, exponent, 3) for t in texts]
    finally:
        periods.TOGETHER = old


def test_periods_of_any_length():
    rng = random.Random(4)
    for n in (50, 400, 900):
        for p in (1, 2, 7, n // 9, n // 5, n // 4):
            seed = [b"%d" % rng.randrange(5) for _ in range(p)]
            words = [b"%d" % rng.randrange(9) for _ in range(n // 7)] + [seed[i % p] for i in range(n)] + [b"end"] * 3
            assert periods.find([words]) == [plain(words)]


def test_classes_hand_on_smaller_parts_only():
    """Of one word alone each length drops one place, so nothing but that moves: a long text takes no more than its words."""
    state, moved = periods.Refinement(np.zeros(3000, np.int64), 3000), 0
    while state.alive:
        state.refine()
        moved += len(state.moved) + len(state.dropped)
    assert moved <= 2 * 3000
    rng = np.random.default_rng(1)
    codes = np.tile(rng.integers(0, 3, 2000), 5)
    state, moved = periods.Refinement(codes, 2500), 0
    while state.alive and state.length < 2500:
        state.refine()
        moved += len(state.moved) + len(state.dropped)
    assert moved <= len(codes) * np.log2(len(codes))


def test_rows_of_any_kind(spark):
    rows = [(i, t, 5, "x") for i, t in enumerate(EDGES)] + [(None, "a a a a a a", 5, "x"), (3, "z z z z z z z z", 6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_words int, `run.s` string").repartition(3)
    out = periods.periodic_runs(docs)
    assert out.columns == ["doc_id", "n_words", "runs", "collapsed"]
    found = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["n_words"], [tuple(x) for x in r["runs"]], r["collapsed"]) for r in out.collect())
    want = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        runs = plain(words) if len(words) < 1000 else [(0, len(words), 1)]
        gone = {k for s, n, q in runs for k in range(s + q, s + n)}
        want.append((i is None, i or 0, len(words), runs, b" ".join(w for k, w in enumerate(words) if k not in gone).decode()))
    assert found == sorted(want)
    assert periods.periodic_runs(docs.limit(0)).collect() == []


def test_column_names_with_dots(spark):
    docs = spark.createDataFrame([(1, "a a a a a a a")], "`doc.id` long, `the text` string")
    assert periods.periodic_runs(docs, "doc.id", "the text").collect()[0]["collapsed"] == "a"


def test_query_equals_the_plain_search(spark):
    folder = "/root/testdata/sf0.001"
    texts = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op11_periodic_runs(spark, folder).collect()}
    assert len(found) == len(texts)
    assert any(r[0] for r in found.values())
    for doc_id, text in texts:
        words = plant(doc_id, text)
        if len(words) < 1500:
            assert found[doc_id] == plain_row(words), doc_id


@pytest.mark.parametrize("text", [None, "", "one", "a b c d e f g h i j", "b " * 40])
def test_planting(spark, text):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 10 == 0][:12] + [1, None]
    docs = spark.createDataFrame([(i, text) for i in ids], "i long, t string")
    for r in docs.select("i", periods.planted(F.col("t"), F.col("i")).alias("p")).collect():
        assert r["p"].encode().split() == plant(r["i"], text)
