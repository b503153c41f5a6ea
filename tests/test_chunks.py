"""Chunkers by what their results must have; whole tables are held against SQL with the other queries."""

import random

import pytest
import pyarrow as pa
from pyspark.sql import functions as F

from siltstone.operators import chunk

BLANKS = "".join(map(chr, range(33)))


def told(spark, texts, size, how="recursive", embed=None):
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(2)
    out = {i: [] for i in range(len(texts))}
    for r in chunk.chunked(df, "text", size, how, embed).orderBy("i", "pos").collect():
        assert r["pos"] == len(out[r["i"]])
        out[r["i"]].append(r["chunk"])
    return [out[i] for i in range(len(texts))]


def drawn(n, seed):
    rng = random.Random(seed)
    parts = ["word ", "sentence. ", "line\n", "\n\n", "longerword", "é. ", "\t", " "]
    return ["".join(rng.choices(parts, k=rng.randrange(80))) for _ in range(n)]


def test_known_pieces(spark):
    long = "\n\n".join(c * 300 for c in "ABC")
    found = told(spark, ["short", "a\n\n\n\nb", "", "  ", None, long], 350)
    assert found == [["short"], ["a\n\n\n\nb"], [], [], [], [c * 300 for c in "ABC"]]
    # every level leaves its separator behind the last part, and what has none is cut hard
    assert told(spark, ["x" * 25, "\t" * 12], 10) == [["x" * 10, "x" * 10, "x" * 5 + "\n."], ["", "."]]


@pytest.mark.parametrize("size", [12, 30, 60])
def test_recursive_pieces_hold_the_text(spark, size):
    texts = drawn(120, size)
    for text, pieces in zip(texts, told(spark, texts, size), strict=True):
        assert all(len(p) <= size and p == p.strip(BLANKS) for p in pieces)
        bare = lambda s: "".join(s.split()).replace(".", "")
        assert bare("".join(pieces)) == bare(text)
        if len(text) <= size:
            assert pieces == ([text.strip(BLANKS)] if text.strip(BLANKS) else [])


def by_cats():
    def embed(xs):
        return [[1.0, 0.0] if "cat" in x else [0.0, 1.0] for x in xs]

    return embed


def test_semantic_pieces(spark):
    cats = by_cats()
    # likenesses 1, 0, 1, 1: the lower quartile is 0 of them sorted at place 0, and nothing lies under it
    texts = ["A cat. The cat. One dog. Two dogs. Ten dogs.", "A cat. The cat. One dog. Two dogs. Ten dogs. Old dogs. New dogs.", "just one", "", None, " . ", "A cat.\n\nA cat"]
    assert told(spark, texts, 100, "semantic", cats) == [[texts[0]], ["A cat. The cat.", "One dog. Two dogs. Ten dogs. Old dogs. New dogs."], ["just one"], [""], [], ["."], ["A cat. A cat"]]
    assert told(spark, ["A cat. The cat."], 10, "semantic", cats) == [["A cat.", "The cat."]]
    values = spark.createDataFrame([([0.1, 0.5, 0.7, 0.9, 1.0],), ([],), ([3.0],)], "v array<double>")
    assert [r[0] for r in values.select(chunk.low_quartile(F.col("v"))).collect()] == [0.5, 0.0, 3.0]


def test_sentences_of_many_texts_are_embedded_together(spark, tmp_path, monkeypatch):
    seen = str(tmp_path / "calls")

    cats = by_cats()

    def embed(xs):
        with open(seen, "a") as f:
            f.write(f"{len(xs)}\n")
        return cats(xs)

    df = spark.createDataFrame([(i, "One cat. Two dogs. Three.") for i in range(50)], "i int, text string").coalesce(1)
    assert chunk.chunked(df, "text", 100, "semantic", embed).count() == 50 * 1
    assert max(map(int, open(seen).read().split())) == 150


def test_other_columns_stay(spark):
    df = spark.createDataFrame([(1, "a. b", "x", "y")], "`p.q` int, text string, told string, near string")
    for how in ("fixed", "recursive", "semantic"):
        out = chunk.chunked(df, "text", 100, how)
        assert out.columns == ["p.q", "told", "near", "pos", "chunk"] and out.collect()[0][0] == 1


def test_sentences_are_python_objects_call_by_call(spark, monkeypatch):
    """Vectors come in pieces of rows whose sentences fill a call, in their places, also where a row alone has more; never of a whole batch of rows."""
    monkeypatch.setattr(chunk, "EMBEDDED", 7)
    sizes = [0, 1, 3, 40, 2, 2, 2, 0, 7, 1]
    rows = [(i, [f"{i}-{k}" for k in range(n)]) for i, n in enumerate(sizes)] + [(99, None)]
    made = {}
    monkeypatch.setattr(chunk.F, "arrow_udf", lambda kind: lambda f: made.setdefault("f", f) and (lambda c: c))
    chunk.embed_lists(F.col("told"), lambda texts: [[float(len(texts)), float(t.partition("-")[2])] for t in texts])
    pieces = [x.to_pylist() for x in made["f"](iter([pa.array([r[1] for r in rows], pa.list_(pa.string()))]))]
    assert len(pieces) > 4 and all(sum(map(len, p)) <= 7 or len(p) == 1 for p in pieces)
    flat = [x for p in pieces for x in p]
    assert [[v[1] for v in x] for x in flat] == [[float(k) for k in range(n)] for n in [*sizes, 0]]
    assert max(v[0] for x in flat for v in x) <= 7
    monkeypatch.undo()
    df = spark.createDataFrame(rows, "i int, told array<string>").coalesce(1)
    got = {r[0]: r[1] for r in df.select("i", chunk.embed_lists(F.col("told"), lambda texts: [[float(t.partition("-")[2]), 1] for t in texts])).collect()}
    assert got == {i: [[float(k), 1.0] for k in range(len(t or []))] for i, t in rows}
