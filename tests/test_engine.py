import json
import zipfile

import pytest
from pyspark.sql import functions as F

from siltstone.api import Engine
from siltstone.operators import bm25, evaluate, fusion, graph, vector
from siltstone.operators.glossary import Glossary, article_entities
from siltstone.schema import ARTICLE
from siltstone.sources import files, store, tabular
from siltstone.streaming import incremental

ALL = {"*"}


def arts(spark, rows):
    return spark.createDataFrame([(i, ns, f"doc{i}", s, "") for i, ns, s in rows], "id long, namespace string, title string, summary string, url string")


def test_bm25(spark):
    a = arts(spark, [(1, "default", "invoice number INV-2026-0042 due"), (2, "default", "vector search"), (3, "default", None), (4, "other", "invoice secret")])
    top = bm25.topk(bm25.scores(a.where("namespace = 'default'"), "INV-2026-0042"), 2).collect()
    assert [r["id"] for r in top] == [1]
    assert bm25.scores(a, "zzz").count() == 0 and bm25.scores(a, "").count() == 0
    asked = spark.createDataFrame([(7, "other", "secret invoice")], "query_id long, namespace string, text string")
    many = bm25.batch_scores(bm25.postings(a), bm25.term_stats(a), asked).collect()
    one = bm25.scores(a.where("namespace = 'other'"), "secret invoice").collect()
    assert [r["id"] for r in many] == [4] and abs(many[0]["score"] - one[0]["score"]) < 1e-12


def graph_of(spark, rows, doc=False):
    df = spark.createDataFrame(rows, "id long, namespace string, doc string, text string")
    found = article_entities(df)
    ents = found.join(df.select("id", "doc"), "id") if doc else found
    return ents, graph.links(graph.typed_edges(ents, Glossary().relation_table(spark)))


def ask_graph(spark, ents, steps, question, ns="default"):
    seeds = ents.where(F.col("entity").isin(sorted(Glossary().extract(question))) & (F.col("namespace") == ns)).select("namespace", "entity").distinct()
    return {r["id"]: r for r in graph.search(ents, steps, seeds).collect()}


def test_graph_hops(spark):
    rows = [(1, "default", "a", "금융위원회가 자본시장법을 고쳤다"), (2, "default", "b", "자본시장법과 상장지수펀드"), (3, "default", "c", "비가 온다")]
    ents, steps = graph_of(spark, rows)
    got = ask_graph(spark, ents, steps, "금융위원회")
    assert set(got) == {1, 2} and got[1]["score"] > got[2]["score"] > 0
    assert ask_graph(spark, ents, steps, "점심") == {}
    assert ask_graph(spark, ents, steps, "금융위원회", "other") == {}


def test_graph_links_a_document_across_chunks(spark):
    rows = [(1, "default", "a", "금융위원회가 자본시장법을 의결"), (2, "default", "b", "자본시장법에 근거"), (3, "default", "b", "상장지수펀드 요건")]
    ents, steps = graph_of(spark, rows)
    assert 3 not in ask_graph(spark, ents, steps, "금융위원회")
    ents, steps = graph_of(spark, rows, doc=True)
    assert 3 in ask_graph(spark, ents, steps, "금융위원회")


def test_graph_path(spark):
    ents, steps = graph_of(spark, [(1, "default", "a", "한국거래소가 코스피200을 산출"), (2, "default", "b", "코스피200은 지수")])
    path = ask_graph(spark, ents, steps, "한국거래소")[2]["path"]
    assert [p["type"] for p in path] == ["CALCULATES"]


def test_fusion_order_and_flags(spark):
    s = lambda rows: spark.createDataFrame(rows, "q long, id long, score double")
    v, k = s([(0, 1, 0.9), (0, 2, 0.8)]), s([(0, 2, 5.0), (0, 3, 4.0)])
    got = {r["id"]: r["score"] for r in fusion.hybrid(v, k, None, 5, ["q"]).collect()}
    assert got == pytest.approx({2: 1 / 62 + 1 / 61, 1: 1 / 61, 3: 1 / 62})
    assert [r["id"] for r in fusion.hybrid(v, None, None, 5, ["q"]).orderBy("rank0").collect()] == [1, 2]
    weighted = {r["id"]: r["score"] for r in fusion.hybrid(v, None, k, 5, ["q"]).collect()}
    assert weighted[3] == pytest.approx(2 / 62)


def test_knn(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, "a" if i % 2 else "b", [float(x) for x in rng.normal(size=8)]) for i in range(300)] + [(900, "a", [0.0] * 8), (901, "a", None), (902, "a", [1.0])]
    v = spark.createDataFrame(rows, "id long, namespace string, embedding array<float>").repartition(5)
    m = np.array([r[2] for r in rows[:300]], np.float32).astype(float)
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    exact = {(r["query_id"], r["rank"]): r["id"] for r in vector.knn(v, [(i, rows[i][2]) for i in (0, 7)], 5).collect()}
    for q in (0, 7):
        w = np.float64(rows[q][2])
        assert [exact[q, k + 1] for k in range(5)] == list(np.argsort(-(u @ w), kind="stable")[:5])
    assert vector.knn(v, [(1, rows[1][2], "a")], 3, within="namespace").where("id % 2 = 0 and id < 900").count() == 0


def test_tiers(spark, tmp_path):
    t = store.TieredStore(spark, str(tmp_path / "s"), 3)
    new = lambda n: spark.createDataFrame([(f"t{n}", "x", " ", "u")], "title string, summary string, namespace string, url string")
    for n in range(4):
        t.append(new(n))
    rows = t.load().orderBy("id").collect()
    assert [(r["id"], r["title"], r["namespace"]) for r in rows] == [(i + 1, f"t{i}", "default") for i in range(4)]
    assert store.exists(spark, f"{t.root}/{t.manifest()['cold']}") and t.hot_rows().count() == 1
    assert t.delete([2]) and not t.delete([2])
    assert sorted(r["id"] for r in t.load().collect()) == [1, 3, 4]
    assert store.read_parquet(spark, str(tmp_path / "none")).schema == ARTICLE


def test_a_store_of_json_and_two_writers(spark, tmp_path):
    a, b = (store.TieredStore(spark, str(tmp_path / "s"), 100, "json") for _ in range(2))
    new = lambda *ts: spark.createDataFrame([(t, "x\n\"y\"", "n", "u", [1.0, 2.5]) for t in ts], "title string, summary string, namespace string, url string, embedding array<float>")
    assert [r["id"] for r in a.append(new("b", "a", "c")).orderBy("title").collect()] == [1, 2, 3]
    # another writer is first: the second one begins again after it
    real, raced = a._commit, []

    def late(now, **changes):
        if not raced:
            raced.append(b.append(new("d", "e")).count())
        return real(now, **changes)

    a._commit = late
    assert sorted(r["id"] for r in a.append(new("f")).collect()) == [6] and raced == [2]
    rows = a.load().orderBy("id").collect()
    assert [(r["id"], r["title"]) for r in rows] == list(zip(range(1, 7), "abcdef", strict=True)) and rows[0]["summary"] == 'x\n"y"' and rows[0]["embedding"] == [1.0, 2.5]
    before = a.load()
    a._commit = real
    assert a.compact() and a.manifest()["hot"] == [] and before.count() == 6
    assert a.delete(spark.createDataFrame([(2,), (2,), (99,)], "id long")) and a.load().count() == 5
    # what no manifest of the last two names is gone
    named = {f for n in a._numbers() for f in [a.manifest(n)["cold"], *a.manifest(n)["hot"]]}
    assert {x for x in store.listed(spark, a.root) if x != "manifests"} == named - {None} and len(a._numbers()) == 2
    with pytest.raises(ValueError):
        store.TieredStore(spark, str(tmp_path / "s"), 1, "xml")


def test_many_rows_get_ids_in_order(spark):
    rows = spark.range(5000).selectExpr("concat('t', lpad(id, 5, '0')) AS title", "'n' AS namespace", "'u' AS url", "'s' AS summary").repartition(7)
    got = store.numbered_from(rows, 10).orderBy("id").select("id", "title").collect()
    assert [tuple(r) for r in got] == [(11 + i, f"t{i:05}") for i in range(5000)]


def test_json_tier(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"id": 1, "title": "t", "summary": "s", "embedding": [1, 2.5]}]))
    r = store.read_json(spark, str(tmp_path / "a.json")).first()
    assert (r["id"], r["namespace"], r["embedding"]) == (1, "default", [1.0, 2.5])


def workbook(path):
    rows = ['<row r="1"><c r="A1" t="inlineStr"><is><t>Title</t></is></c></row>', '<row r="3"><c r="A3" t="s"><v>0</v></c><c r="B3" t="s"><v>1</v></c></row>', '<row r="4"><c r="A4" t="inlineStr"><is><t> Q1, a </t></is></c><c r="B4"><v>5.0</v></c></row>', '<row r="5"><c r="B5" t="inlineStr"><is><t> </t></is></c></row>', '<row r="6"><c r="A6" t="inlineStr"><is><t>Q2</t></is></c><c r="B6"><v>7</v></c></row>']
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(rows)}</sheetData></worksheet>')
        z.writestr("xl/sharedStrings.xml", '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>Orbiting Body</t></si><si><t>Net $</t></si></sst>')


def test_tables(spark, tmp_path):
    (tmp_path / "r.csv").write_text('quarter,Revenue (M),region\nQ1,1.5,"a, b"\nQ2,2.5,c\n')
    df = tabular.load(spark, "rev", str(tmp_path / "r.csv"))
    assert df.columns == ["quarter", "revenue_m", "region"]
    got = tabular.ask_table(spark, "rev", "sum?", lambda p: "```sql\nSELECT sum(revenue_m) AS s FROM rev;\n```")
    assert got["rows"] == [[4.0]] and got["columns"] == ["s"]
    assert "error" in tabular.ask_table(spark, "rev", "?", lambda p: "SELECT nope FROM rev")
    workbook(tmp_path / "b.XLSX")
    x = tabular.load(spark, "sheet", str(tmp_path / "b.XLSX"), 2)
    assert x.dtypes == [("orbiting_body", "string"), ("net", "bigint")] and [tuple(r) for r in x.collect()] == [("Q1, a", 5), ("Q2", 7)]
    with pytest.raises(ValueError):
        tabular.load(spark, "no good", str(tmp_path / "r.csv"))


def test_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("hello")
    (tmp_path / "b.html").write_text("<html><style>x</style><p>Tom &amp; Ann</p></html>")
    with zipfile.ZipFile(tmp_path / "c.hwpx", "w") as z:
        z.writestr("Preview/PrvText.txt", "안녕")
    with zipfile.ZipFile(tmp_path / "d.hwpx", "w") as z:
        z.writestr("x", "")
    (tmp_path / "e.bin").write_bytes(b"\0")
    (tmp_path / "f.docx").write_bytes(b"broken")
    got = {r["name"]: r for r in files.read_files(spark, str(tmp_path)).collect()}
    assert [got[n]["text"] for n in ("a.txt", "b.html", "c.hwpx", "d.hwpx")] == ["hello", "Tom & Ann", "안녕", ""]
    assert got["e.bin"]["status"] == "no extractor" and got["f.docx"]["status"].startswith("failed") and got["c.hwpx"]["route"] == "HWPX"


def test_engine(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), generate=lambda p: "answer to a@b.org", threshold=100)
    texts = spark.createDataFrame([("", "law", "file://law", "금융위원회가 자본시장법을 고쳤다"), ("", "fund", "file://fund", "자본시장법에 따라 상장지수펀드(ETF) 상장"), ("z", "law", "file://law", "hidden words")], "namespace string, title string, url string, text string")
    assert e.ingest(texts, ALL).count() == 3 and e.ingest(texts, ALL).count() == 0
    assert e.count({"default"}) == 2 and e.count(set()) == 0 and e.count(ALL, "z") == 1
    assert e.documents({"z"}).count() == 1
    got = e.ask("금융위원회와 ETF", None, {"default"})
    assert len(got["sources"]) == 2 and got["log_id"] == 1
    row = e.log().first()
    assert row["answer"] == "answer to [EMAIL]" and row["pii_count"] == 1
    e.feedback(1, "up")
    assert {k: v.count() for k, v in e.stats(ALL).items()} == {"totals": 1, "by_model": 1, "by_source_type": 1, "feedback": 1}
    with pytest.raises(PermissionError):
        e.ask("x", "z", {"default"})
    with pytest.raises(LookupError):
        e.ask("x", "empty", ALL)
    assert e.graph_stats(ALL).count() == 1 and e.index_stats(ALL).count() == 2
    for how in ("none", "llm", "cross"):
        assert e.ask("ETF", None, {"default"}, how=how)["sources"]
    assert e.summarize(1, {"default", "z"}).startswith("answer")
    assert e.delete_document("law", None, {"default"}) and not e.delete_article(99, ALL)
    assert e.count(ALL) == 2


def test_sweep(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), threshold=100)
    e.ingest(spark.createDataFrame([("", "a", "file://a", "apples are red"), ("", "b", "file://b", "pears are green"), ("", "c", "file://c", "plums are blue")], "namespace string, title string, url string, text string"), ALL)
    (tmp_path / "g.json").write_text(json.dumps([{"case_id": "x", "question": "apples red", "namespace": "default", "keywords": ["Apples"], "title_part": None}, {"case_id": "y", "question": "pears", "namespace": "default", "keywords": ["nothing"], "title_part": "b"}]))
    cases = evaluate.golden(spark, str(tmp_path / "g.json"))
    judged = evaluate.sweep(e, cases.withColumn("title_part", F.col("title_part").cast("string")), ALL, {"hybrid": ("none", True, False), "mmr": ("mmr", True, True)})
    rows = {r["config"]: r for r in evaluate.recall(judged, "config").collect()}
    assert {k: (r["n"], r["hits"], r["missed"]) for k, r in rows.items()} == {"hybrid": (2, 1, ["y"]), "mmr": (2, 1, ["y"])}
    assert evaluate.sql_hit([["Q3", 4.5]], "4.5") and not evaluate.sql_hit([], "4.5")


def test_stored_graph_follows_the_articles(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), threshold=100)
    schema = "namespace string, title string, url string, text string"
    e.ingest(spark.createDataFrame([("", "law", "file://law", "금융위원회가 자본시장법을 고쳤다"), ("z", "law", "file://law", "금융위원회와 배당")], schema), ALL)
    derived = sorted(map(tuple, e.graph_hits("금융위원회", "default", e.store.load().where("namespace = 'default'")).select("id", "score").collect()))
    assert e.store_graph() and e.store.index("graph")
    stored = sorted(map(tuple, e.graph_hits("금융위원회", "default", e.store.load().where("namespace = 'default'")).select("id", "score").collect()))
    assert stored == derived and len(derived) == 1
    e.ingest(spark.createDataFrame([("", "new", "file://new", "자본시장법")], schema), ALL)
    assert len(e.store.index("graph").added) == 1 and e.retrieve("금융위원회", None, ALL).count() == 2


def test_many_questions_find_what_each_finds(spark, tmp_path):
    e = Engine(spark, str(tmp_path / "e"), threshold=100)
    schema = "namespace string, title string, url string, text string"
    rows = [("", f"t{i}", f"file://t{i}", f"{w} about 자본시장법 {i}") for i, w in enumerate(["apples", "pears", "금융위원회", "plums and apples"])] + [("z", "t9", "file://t9", "apples of z")]
    e.ingest(spark.createDataFrame(rows, schema), ALL)
    asked = [("a", "apples", None), ("b", "금융위원회 pears", ""), ("c", "apples", "z"), ("d", "", None)]
    cases = spark.createDataFrame(asked, "case_id string, question string, namespace string")
    many = {}
    for r in e.retrieve_all(cases, ALL).collect():
        many.setdefault(r["case_id"], []).append((r["rank0"], r["id"], round(r["score"], 12)))
    for case, question, ns in asked:
        one = [(r["rank0"], r["id"], round(r["score"], 12)) for r in e.retrieve(question, ns, ALL).collect()]
        assert sorted(many[case]) == sorted(one)
    assert {r["case_id"] for r in e.retrieve_all(cases, {"z"}).collect()} == {"c"}


def test_questions_are_rewritten_as_a_column(spark):
    g = Glossary()
    asked = ["ETF란?", "상장지수펀드와 KRX", "nothing", "", " ", None, "ETF 상장지수펀드"]
    df = spark.createDataFrame([(i, q) for i, q in enumerate(asked)], "i int, question string")
    assert [r["asked"] for r in g.rewritten(df).orderBy("i").collect()] == [g.rewrite(q) for q in asked]


def test_ranked_sends_on_the_best_only(spark):
    df = spark.range(1000).selectExpr("id", "id % 3 AS q", "cast(id % 17 AS double) AS score")
    plan = fusion.ranked(df, ["q"], 5)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    texts = arts(spark, [(1, "n", "a b")])
    assert bm25.counted(texts, ["a", "b"])._jdf.queryExecution().optimizedPlan().toString().count("split(") == 1


def test_recall(spark):
    cases = spark.createDataFrame([("a", ["X", "y"], None), ("b", None, "top")], "case_id string, keywords array<string>, title_part string")
    found = spark.createDataFrame([("a", "c1", "t", "x and Y"), ("b", "c1", "Top", ""), ("a", "c2", "t", "x")], "case_id string, config string, title string, summary string")
    rows = {r["config"]: r for r in evaluate.recall(evaluate.hits(cases, found), "config").collect()}
    assert rows["c1"]["recall"] == 1.0 and rows["c2"]["missed"] == ["a", "b"]


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    schema = "namespace string, title string, url string, text string"
    df = spark.createDataFrame([("n", "t", "file://t", "words " * 10), ("n", "t", "file://t", "words " * 10)], schema)
    df.write.parquet(str(src))
    s = store.TieredStore(spark, str(tmp_path / "s"), 100)
    for _ in range(2):
        incremental.ingest(incremental.landing(spark, str(src), df.schema), s, str(tmp_path / "cp")).awaitTermination()
    assert s.load().count() == 1
    log = spark.createDataFrame([("m", 10, "2024-01-01 00:10:00"), ("m", 30, "2024-01-01 00:20:00"), ("m", 5, "2024-01-01 09:00:00")], "model string, latency_ms long, at string").select("model", "latency_ms", F.col("at").cast("timestamp").alias("created_at"))
    log.write.parquet(str(tmp_path / "log"))
    stream = incremental.hourly(incremental.landing(spark, str(tmp_path / "log"), log.schema))
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [(r["calls"], r["avg_latency_ms"]) for r in spark.table("hours").orderBy("hour").collect()] == [(2, 20.0), (1, 5.0)]


def test_a_csv_table_is_many_files(spark, monkeypatch):
    """Values with line ends keep a file from being split, so no file has more than a task's share."""
    from siltstone.plans import stored

    monkeypatch.setattr(stored, "CSV_ROWS", 9)
    sf = "/root/testdata/sf0.001"
    found = stored.csv_load(spark, sf)
    n = spark.read.parquet(f"{sf}/documents.parquet").count()
    assert found.count() == n and len(found.inputFiles()) >= n / 9
    assert found.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] <= 9


def test_odd_texts_come_back_from_csv(spark, tmp_path):
    """Blanks at the ends, empty texts, carriage returns, code 0, what means null in the file, and columns of figures alone."""
    from siltstone.plans import stored

    odd = [" a", "a\t", "\n", "", None, "a\rb", "\r\n", "\0\"a\0#", "\\N", "\\", "\\0b\\b", '"', 'a",\n"b', "plain words", "﻿"]
    tables = {"odd": [(i, t, "en", "s") for i, t in enumerate(odd)], "figures": [(1, "007", "1.50", ""), (2, "1", None, "2024-01-01"), (None, "2", "3", "2024-01-02")]}
    for name, rows in tables.items():
        spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        found = stored.csv_load(spark, f"{tmp_path}/{name}")
        assert found.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang_1", "string"), ("_2_source", "string")]
        assert sorted(map(tuple, found.collect()), key=repr) == sorted(rows, key=repr)
