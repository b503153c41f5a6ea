"""Line dedup with short lines in it."""

import random

import corpus_pipeline
from siltstone.llm import common, lines

from test_operators import brute_lines


def test_short_lines_are_dropped_where_they_repeat(spark):
    texts = ["All rights reserved.\n\nLes.\na line of six words here", "Les.\n\n  All   rights reserved.\nLes\nAll rights kept.", None, "", "Les.\nnew\na line of six whole words here"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = [texts[0], "\nLes\nAll rights kept.", None, "", "new"]
    assert [r["text"] for r in corpus_pipeline.line_stage(spark, docs, "").orderBy("doc_id").collect()] == want
    # the operator's own limit leaves them alone
    assert [r["text"] for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == [*texts[:4], "Les.\nnew"]


def test_short_lines_against_brute_force(spark):
    rng = random.Random(8)
    words = ["a", "b", "c"]
    texts = ["\n".join(" ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 2, 3, 5, 6, 7, 9]))) for _ in range(rng.randrange(1, 6))) for _ in range(60)]
    seen, want = set(), []
    for t, u in zip(texts, brute_lines(texts), strict=True):
        # short lines by their first place; of the others what brute force leaves
        left, long = [], iter(x for x in u.split("\n") if len(x.split()) >= lines.LEAST_WORDS)
        nxt = next(long, None)
        for x in t.split("\n"):
            if len(x.split()) >= lines.LEAST_WORDS:
                if x == nxt:
                    left.append(x)
                    nxt = next(long, None)
            elif x not in seen or not x:
                left.append(x)
                seen.add(x)
        want.append("\n".join(left))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert [r["text"] for r in lines.dedup_lines(docs, least=1).orderBy("doc_id").collect()] == want


def test_clashing_names_and_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(30_000))
    texts = [long, long + " more", "x\n" + long.replace("w77 ", "v77 "), None, "", "a line of six words here\n" * 3, long]
    rows = [(i, t, *"abcdefghi") for i, t in enumerate(texts)]
    names = ["bits", "__may", "__slot", "__page", "__copy", "__gone", "N_LINES", "n_dropped", "id"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = lines.dedup_lines(docs, least=1).orderBy("doc_id")
    assert out.columns == [*docs.columns, "_n_lines", "_n_dropped"]
    got = out.collect()
    assert [r["text"] for r in got] == [long, "", "x", None, "", "a line of six words here\n", ""]
    assert all(tuple(r[2:11]) == tuple("abcdefghi") for r in got)
    assert [r["_n_dropped"] for r in got] == [0, 1, 1, 0, 0, 2, 1]


def test_ids_that_are_no_whole_numbers(spark):
    import pytest

    with pytest.raises(TypeError):
        lines.dedup_lines(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_a_frequent_line_meets_its_class_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 8)
    texts = [f"the frequent line of six words\nalone {i}\nseldom {i % 20}" for i in range(60)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(6)
    got = [r["text"] for r in lines.dedup_lines(docs, least=1).orderBy("doc_id").collect()]
    assert got == [texts[0], *(f"alone {i}" + f"\nseldom {i}" * (i < 20) for i in range(1, 60))]


def test_stored_tables_go_but_the_result_stays(spark):
    import os

    folder = spark.conf.get("spark.checkpoint.dir")
    before = set(os.listdir(folder)) if os.path.isdir(folder) else set()
    docs = spark.createDataFrame([(1, "a b\na b"), (2, "a b\nc")], "doc_id long, text string")
    out = lines.dedup_lines(docs, least=1)
    assert len({x for x in os.listdir(folder) if x.startswith("stored-")} - before) == 1
    assert sorted(r["text"] for r in out.collect()) == ["a b", "c"]


def test_keys_that_collide_lose_no_link(spark, monkeypatch):
    from pyspark.sql import functions as F

    rng = random.Random(3)
    texts = ["\n".join(" ".join(rng.choice("abc") for _ in range(rng.choice([6, 7, 8]))) for _ in range(3)) for _ in range(25)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for few in (1, 3, 40):
        monkeypatch.setattr(lines, "hashed", lambda *x, few=few: F.pmod(F.xxhash64(*x), F.lit(few)))
        assert [r["text"] for r in lines.dedup_lines(docs).orderBy("doc_id").collect()] == brute_lines(texts)
