"""Stored indexes: blocks of postings against all postings, and indexes that follow changes against ones made anew."""

import random

import pytest
from pyspark.sql import functions as F

from siltstone.api import Engine
from siltstone.operators import bm25, keywords
from siltstone.sources import store

SCHEMA = "namespace string, id long, summary string"
ALL = {"*"}


def texts(n, seed, first=0):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = []
    for i in range(first, first + n):
        own = rng.choices(words, weights, k=rng.choice([0, 1, 3, 9, 30, 120]))
        rows.append(("ab"[i % 2], i, " ".join(own + ["common"] * (i % 3))))
    return rows + [("a", first + n, None), ("b", first + n + 1, "...")]


QUESTIONS = [(0, "a", "w0 common"), (1, "b", "w3 w3 w17 W40"), (2, "a", "w59"), (3, "b", "nothing here"), (4, "a", ""), (5, "z", "w1"), (6, "b", "w1 w2 w5 w9 common w30 w31 w32"), (7, "b", "w0"), (8, "a", "common w59")]


def asked(spark):
    return spark.createDataFrame(QUESTIONS, "query_id long, namespace string, text string")


def plain(spark, rows, k):
    df = spark.createDataFrame(rows, SCHEMA)
    scored = bm25.batch_scores(bm25.postings(df), bm25.term_stats(df), asked(spark)).collect()
    out = {}
    for r in sorted(scored, key=lambda r: (r["query_id"], -round(r["score"], 9), r["id"])):
        out.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 9)))
    return {q: x[:k] for q, x in out.items()}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def same(got, want):
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(a == pytest.approx(b, abs=2e-9) for q in got for (_, a), (_, b) in zip(got[q], want[q], strict=True))


@pytest.mark.parametrize(("block", "k"), [(32_768, 5), (9, 5), (9, 1), (20, 500)])
def test_blocks_give_what_all_postings_give(spark, monkeypatch, block, k):
    monkeypatch.setattr(keywords, "SEGMENT", block)
    rows = texts(300, 1)
    index = keywords.Keywords(**keywords.build(spark.createDataFrame(rows, SCHEMA).repartition(3)))
    same(found(keywords.search(index, asked(spark), k)), plain(spark, rows, k))
    read, every = keywords.postings_read(index, asked(spark), k)
    assert read <= every and (k == 500 or read < every)
    assert index.blocks.agg(F.max("n")).first()[0] <= 3 * block


def test_changes_give_what_a_new_index_gives(spark):
    rows, more = texts(200, 2), texts(40, 3, first=1000)
    gone = [r for r in rows if r[1] % 7 == 0] + [r for r in more if r[1] % 5 == 0]
    df, come, left = (spark.createDataFrame(x, SCHEMA) for x in (rows, more, gone))
    base, added, taken = keywords.build(df), keywords.changes(come), keywords.changes(left)
    index = keywords.Keywords(base["blocks"], base["sums"], added["postings"], added["sums"], taken["postings"], taken["sums"])
    kept = [r for r in rows + more if r not in gone]
    want = plain(spark, kept, 6)
    same(found(keywords.search(index, asked(spark), 6)), want)
    same(found(keywords.search(keywords.Keywords(**index.rebuilt()), asked(spark), 6)), want)


def test_many_questions_meet_each_segment_at_once(spark, monkeypatch):
    rows, more = texts(200, 2), texts(40, 3, first=1000)
    gone = [r for r in rows if r[1] % 7 == 0] + [r for r in more if r[1] % 5 == 0]
    df, come, left = (spark.createDataFrame(x, SCHEMA) for x in (rows, more, gone))
    base, added, taken = keywords.build(df.repartition(3)), keywords.changes(come), keywords.changes(left)
    whole = keywords.Keywords(**base)
    changed = keywords.Keywords(base["blocks"], base["sums"], added["postings"], added["sums"], taken["postings"], taken["sums"])
    monkeypatch.setattr(keywords, "MANY", 0)
    monkeypatch.setattr(keywords, "_sums", None)  # a row for each question and posting is what this form does without
    for asked_rows, k in ((200_000, 500), (5, 1)):
        monkeypatch.setattr(keywords, "ASKED", asked_rows)
        same(found(keywords.search(whole, asked(spark), k)), plain(spark, rows, k))
        same(found(keywords.search(changed, asked(spark), 6)), plain(spark, [r for r in rows + more if r not in gone], 6))
    named = asked(spark).selectExpr("CASE WHEN query_id > 0 THEN CAST(query_id AS STRING) END AS query_id", "namespace", "text")
    assert {r["query_id"] for r in keywords.search(whole, named, 3).collect()} == {None, "1", "2", "6", "7", "8"}
    assert keywords.search(keywords.Keywords(**keywords.build(df.limit(0))), asked(spark), 3).count() == 0


@pytest.mark.parametrize("many", [0, 10**9])
def test_every_tenant_is_asked(spark, tmp_path, monkeypatch, many):
    """More tenants than a driver would list, some without a word of any question, against the registered SQL."""
    import duckdb

    from siltstone.plans import catalogue

    rng = random.Random(6)
    docs = [(i, " ".join(rng.choices(["north", "wind", "sun", "cloak"] if i % 9 else ["other"], k=5)), f"t{i % 1100}" if i % 50 else None, "s") for i in range(2500)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "The North wind"), (2, "sun, Sun and cloak"), (3, "nothing"), (4, None)], "item_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/benchmark.parquet")
    monkeypatch.setattr(keywords, "MANY", many)
    got = sorted(map(tuple, catalogue.QUERIES["keyword_index_batch"](spark, str(tmp_path)).collect()))
    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    want = sorted(con.execute(catalogue.ORACLE["keyword_index_batch"]).fetchall())
    assert len({r[1] for r in want}) > 1000 and [r[:3] + r[4:] for r in got] == [r[:3] + r[4:] for r in want]
    assert all(a[3] == pytest.approx(b[3], abs=2e-6) for a, b in zip(got, want, strict=True))


def test_questions_to_every_tenant_of_a_changed_index(spark, monkeypatch):
    rows, more = texts(60, 2), [("c", 900, "w1 w2 fresh"), ("a", 901, "fresh common")]
    base, added = keywords.build(spark.createDataFrame(rows, SCHEMA)), keywords.changes(spark.createDataFrame(more, SCHEMA))
    index = keywords.Keywords(base["blocks"], base["sums"], added["postings"], added["sums"])
    once = spark.createDataFrame([(1, "fresh w1"), (2, "common w0 w0")], "query_id long, text string")
    each = once.crossJoin(spark.createDataFrame([("a",), ("b",), ("c",)], "namespace string"))
    for many in (0, 10**9):
        monkeypatch.setattr(keywords, "MANY", many)
        got, want = (sorted(map(tuple, keywords.search(index, q, 4).select("query_id", "namespace", "rank", "id", "score").collect())) for q in (once, each))
        assert got == want and {(r[0], r[1]) for r in got} == {(1, "a"), (1, "b"), (1, "c"), (2, "a"), (2, "b")}


def test_a_segment_is_small_and_goes_in_batches(monkeypatch):
    from collections import Counter

    monkeypatch.setattr(keywords, "BATCH", 50)
    one = keywords.Segment()
    for space, i, text in sorted(texts(300, 4), key=lambda r: -r[1]):
        one.add(None if i == 7 else space, i, Counter((text or "").split()))
    postings = len(one.tf)
    held = sum(len(x) * x.itemsize for x in vars(one).values() if hasattr(x, "itemsize"))
    assert held <= 16 * postings + 16 * 302
    batches = list(one.blocks(5))
    assert len(batches) > postings / 100 and sum(sum(b.column("n").to_pylist()) for b in batches) == postings
    assert all(sum(b.column("n").to_pylist()) <= 50 or b.num_rows == 1 for b in batches)
    seen = [(s or "", t, a, b) for x in batches for s, t, a, b in zip(*(x.column(c).to_pylist() for c in keywords.HEAD[:4]), strict=True)]
    assert seen == sorted(set(seen))


def test_an_empty_index(spark):
    none = spark.createDataFrame([], SCHEMA)
    index = keywords.Keywords(**keywords.build(none))
    assert keywords.search(index, asked(spark), 3).count() == 0


NEWS = "namespace string, title string, url string, text string"
WORDS = ["금융위원회", "자본시장법", "공시", "배당", "apples", "pears", "plums"]


def news(spark, n, seed):
    rng = random.Random(seed)
    rows = [("ab"[i % 2], f"doc{seed}-{i % 9}", f"file://{seed}-{i}", " ".join(rng.choices(WORDS, k=6))) for i in range(n)]
    return spark.createDataFrame(rows, NEWS).dropDuplicates(["namespace", "title"])


def told(engine, question, namespace):
    return [(r["id"], round(r["score"], 9)) for r in engine.retrieve(question, namespace, ALL, 6).orderBy("rank0").collect()]


def test_an_engine_keeps_its_indexes_through_appends_and_deletes(spark, tmp_path, monkeypatch):
    e = Engine(spark, str(tmp_path / "e"), threshold=10**6)
    e.ingest(news(spark, 12, 1), ALL)
    assert e.store_indexes()
    e.ingest(news(spark, 8, 2), ALL)
    first = e.store.load().where("namespace = 'a'").orderBy("id").first()
    assert e.delete_article(first["id"], ALL) and e.delete_document("doc2-1", "b", ALL)
    e.store.compact()
    kinds = ("keywords", "vectors", "graph")
    assert all(len(e.store.index(x).added) == 1 and len(e.store.index(x).gone) == 2 for x in kinds)

    fresh = Engine(spark, str(tmp_path / "f"), threshold=10**6)
    fresh.store.adopt(e.store.load())
    questions = [("금융위원회 apples", "a"), ("자본시장법 배당", "b"), ("plums pears 공시", "b")]
    want = [told(fresh, q, ns) for q, ns in questions]  # without any index
    assert all(want) and [told(e, q, ns) for q, ns in questions] == want
    edges = [sorted(map(tuple, x.graph_tables(x.store.load())["edges"].select("namespace", "src", "dst", "edge_type", "cnt").collect())) for x in (e, fresh)]
    assert edges[0] == edges[1] and edges[0]

    from siltstone import api

    monkeypatch.setattr(api, "CHANGES", 2)
    e._settle()  # made anew from their own tables
    assert all(e.store.index(x).added == e.store.index(x).gone == [] for x in kinds)
    assert [told(e, q, ns) for q, ns in questions] == want
    cases = spark.createDataFrame([(q, q, ns) for q, ns in questions], "case_id string, question string, namespace string")
    many = {}
    for r in e.retrieve_all(cases, ALL, 6).orderBy("rank0").collect():
        many.setdefault(r["case_id"], []).append((r["id"], round(r["score"], 9)))
    assert [many[q] for q, _ in questions] == want


def test_an_index_that_nobody_follows_goes(spark, tmp_path):
    t = store.TieredStore(spark, str(tmp_path / "s"), threshold=10**6)
    rows = spark.createDataFrame([("t", "x", "a", "u")], "title string, summary string, namespace string, url string")
    t.append(rows)
    assert t.add_index("one", {"part": spark.range(3)}) and t.add_index("two", {"part": spark.range(4)})
    assert t.index("one").table("part").count() == 3 and t.index("none") is None
    t.compact()
    assert t.index("two").table("part").count() == 4
    t.append(rows, {"two": lambda df: {"part": df.select("id")}})
    assert t.index("one") is None and [r[0] for r in t.index("two").changes("added", "part").collect()] == [2]
    assert sorted(r[0] for r in t.index("two").now("part").collect()) == [0, 1, 2, 2, 3]
    t.delete([2], {"two": lambda df: {"part": df.select("id")}})
    assert sorted(r[0] for r in t.index("two").now("part").collect()) == [0, 1, 3]
    t.vacuum(keep=1)
    assert t.index("two").now("part").count() == 3
