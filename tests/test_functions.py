import pytest
from pyspark.sql import functions as F

from siltstone.functions import text as X
from siltstone.operators import chunk, rerank, security, services, vector
from siltstone.operators.glossary import Glossary
from siltstone.sources import tabular


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(("text", "masked", "n"), [
    ("write to ann@site.org now", "write to [EMAIL] now", 1),
    ("tel 010-1234-5678 and 123-45-6789", "tel [PHONE] and [SSN]", 2),
    ("card 4785 3805 9139 1637.", "card [CARD].", 1),
    ("nothing here", "nothing here", 0),
    (None, None, 0),
])
def test_private_data(spark, text, masked, n):
    df = spark.createDataFrame([(text,)], "t string").select(X.pii_text(F.col("t")).alias("t"), X.pii_count(F.col("t")).alias("n"))
    assert tuple(df.first()) == (masked, n)


@pytest.mark.parametrize(("ns", "key"), [(None, "default"), ("", "default"), ("  ", "default"), ("a", "a"), (" a\t", "a")])
def test_namespace_key(spark, ns, key):
    assert one(spark, X.ns_key(F.col("n")), n=ns) == key
    assert security.key_of(ns) == key


@pytest.mark.parametrize(("name", "route"), [("a.hwp", "HWP"), ("A.HWPX", "HWPX"), ("x.hwp.pdf", "TIKA"), ("x.pdf.hwp", "HWP"), ("README", "TIKA"), ("", "TIKA"), (None, "TIKA")])
def test_route(spark, name, route):
    assert one(spark, X.extractor(F.col("n")), n=name) == route


@pytest.mark.parametrize(("model", "query", "document"), [
    ("Nomic-embed", "search_query: ", "search_document: "),
    ("mxbai-embed-large", "Represent this sentence for searching relevant passages: ", ""),
    ("granite-embedding:278m", "", ""), ("other", "", ""), (None, "", ""),
])
def test_prefix(spark, model, query, document):
    assert one(spark, X.prefix(F.col("m"), "query"), m=model) == query
    assert one(spark, X.prefix(F.col("m"), "document"), m=model) == document


def test_definitions_and_expansion(spark):
    text = "Under a Data Review Board (DRB) we work. Foo Bar (XYZ). Deep Red Box (DRB)."
    found = one(spark, X.definitions(F.col("t")), t=text)
    assert [(r["acronym"], r["full"]) for r in found] == [("DRB", "Data Review Board")]
    known = F.array(F.struct(F.lit("AI").alias("acronym"), F.lit("Artificial Intelligence").alias("full")))
    assert one(spark, X.expand_acronyms(F.col("t"), known), t="An AI here") == "An AI here\nArtificial Intelligence (AI)"
    assert one(spark, X.expand_acronyms(F.col("t"), known), t="Only RAIL here") == "Only RAIL here"
    assert one(spark, X.expand_acronyms(F.col("t"), known), t="Artificial Intelligence (AI)") == "Artificial Intelligence (AI)"
    assert one(spark, X.expand_acronyms(F.col("t"), X.definitions(F.lit("none"))), t="AI") == "AI"


def test_vector_literals(spark):
    df = spark.createDataFrame([([0.5, -0.25, 3.5],), ([],)], "v array<float>").select(X.vector_literal(F.col("v")).alias("s"))
    assert [r["s"] for r in df.collect()] == ["[0.5,-0.25,3.5]", "[]"]
    assert one(spark, X.parse_vector(F.col("s")), s="[0.5,-0.25,3.5]") == [0.5, -0.25, 3.5]
    assert one(spark, X.parse_vector(F.col("s")), s="") == [] and one(spark, X.parse_vector(F.col("s")), s=None) == []


def test_glossary():
    g = Glossary()
    found = g.extract("금융위원회는 자본시장법 시행령을 고쳐 ETF는 바뀌고 FSS는 본다.")
    assert {"금융위원회", "자본시장법", "상장지수펀드", "금융감독원"} <= found and "자본시장법 시행령" not in found
    assert g.rewrite("금융감독원 보고").endswith("FSS") and "상장지수펀드" in g.rewrite("ETF 규칙")
    assert g.rewrite("weather") == "weather" and g.rewrite(None) is None
    assert g.relation("코스피200", "한국거래소") == "CALCULATES" and g.relation("상법", "배당") is None
    assert len(g.names()) == 54 and g.type_of("코스피") == "INDEX"


def test_fixed_chunks(spark):
    text = "".join(chr(97 + i % 26) for i in range(500))
    rows = chunk.chunked(spark.createDataFrame([(1, text), (2, None), (3, "")], "id int, t string"), "t", 200, "fixed").collect()
    assert [(r["id"], r["pos"], r["chunk"]) for r in rows] == [(1, i, text[i * 50 : i * 50 + 200]) for i in range(7)]


def test_mmr_prefers_other_content():
    same, other = [1.0, 0.0], [0.0, 1.0]
    assert rerank.mmr_order([same, same, other], 2) == [0, 2]
    assert rerank.mmr_order([same, other], 2) == [0, 1]
    assert rerank.mmr_order([None, same, same], 2)[0] == 0


@pytest.mark.parametrize(("reply", "n", "k", "got"), [("2, 0", 3, 2, [2, 0]), ("9 1 1", 3, 2, [1]), ("none", 3, 2, [0, 1]), ("", 1, 2, [0])])
def test_reply_numbers(reply, n, k, got):
    assert rerank.picks(reply, n, k) == got


def test_unknown_strategy_is_mmr():
    assert rerank.strategy("?") is rerank.mmr and rerank.strategy("none") is rerank.none


def test_access():
    for ns, allowed in (("a", {"a", "default"}), ("", {"default"}), ("x", {"*"})):
        security.require_access(ns, allowed)
    for ns, allowed in (("b", {"a"}), ("", {"a"}), ("default", None), ("default", set())):
        with pytest.raises(security.AccessDenied):
            security.require_access(ns, allowed)
    assert security.allowed_for("k", {"k": "a, b,"}) == {"a", "b"} and security.allowed_for("z", {"k": "a"}) == set()


def test_models():
    assert services.models("m", " a, m,b ") == ["m", "a", "b"]
    assert services.checked_model("", "m", None) == "m"
    with pytest.raises(ValueError):
        services.checked_model("x", "m", "a")


@pytest.mark.parametrize("sql", ["SELECT 1", " with x as (select 1) select * from x ", "select * from t"])
def test_read_only_takes(sql):
    tabular.require_read_only(sql)


@pytest.mark.parametrize("sql", ["DROP TABLE t", "delete from t", "UPDATE t SET a=1", "INSERT INTO t VALUES (1)", "SELECT created_at FROM t", "EXPLAIN SELECT 1"])
def test_read_only_refuses(sql):
    with pytest.raises(tabular.NotReadOnly):
        tabular.require_read_only(sql)


def test_strict_read_only(spark):
    tabular.require_read_only("SELECT created_at FROM t", spark)
    with pytest.raises(tabular.NotReadOnly):
        tabular.require_read_only("INSERT INTO t SELECT 1", spark)


@pytest.mark.parametrize(("reply", "sql"), [("```sql\nSELECT 1\n```", "SELECT 1"), ("It is: SELECT a FROM t", "SELECT a FROM t"), ("SELECT 1; x", "SELECT 1"), ("WITH x AS (SELECT 1) SELECT * FROM x", "WITH x AS (SELECT 1) SELECT * FROM x"), (" no ", "no")])
def test_clean_sql(reply, sql):
    assert tabular.clean_sql(reply) == sql


def test_java_random():
    draw = vector.JavaRandom(42)
    assert draw.gaussian() == pytest.approx(1.1419053154730547, abs=1e-12)


def test_term_counts(spark):
    from collections import Counter

    from siltstone.functions.text import term_counts

    rows = [(["b", "a", "b", "c", "b", "a"],), ([],), (None,), (["x"],), (["é", "e", "é"],)]
    for r in spark.createDataFrame(rows, "t array<string>").select("t", term_counts(F.col("t")).alias("c")).collect():
        assert {x["term"]: x["tf"] for x in r["c"] or []} == Counter(r["t"] or [])
