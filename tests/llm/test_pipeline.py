"""The pipeline's stages on their own, and every query against its SQL on the small tables."""

import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from siltstone.llm import queries, simhash

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


def rows(df):
    names = sorted(df.columns)
    return sorted(tuple(str(v) for v in r) for r in df[names].itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, name):
    got = queries.QUERIES[name](spark, SF).toPandas()
    if name in queries.ORACLE:
        con = duckdb.connect()
        for t in ("documents", "conversations"):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
        want = con.execute(queries.ORACLE[name]).df()
        assert sorted(got.columns) == sorted(want.columns) and rows(got) == rows(want)
    elif name != "op9_chat_format":
        docs = spark.read.parquet(f"{SF}/documents.parquet")
        assert got["doc_id"].nunique() == docs.count()


def test_held_out_results(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    found = queries.op7_language_id(spark, SF).toPandas().merge(docs, on="doc_id")
    assert (found.lang == found.lang_pred)[found.held_out].mean() > 0.95
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    scored = queries.op10_quality_classifier(spark, SF).toPandas().merge(labels, on="doc_id")
    assert (scored.predicted == scored.quality)[scored.held_out].mean() > 0.85


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    n = docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / str(i)))
        read = spark.read.parquet(str(tmp_path / str(i)))
        if i < 4:
            assert read.columns == docs.columns and read.count() == read.select("doc_id").distinct().count()
        if name == "line dedup":
            assert read.count() == docs.count()
        if name == "simhash near-dedup":
            groups = simhash.near_duplicates(docs, 5).select("component_id").distinct().count()
            assert read.count() == groups < n
        docs = read
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == docs.count()
    assert set(whole.columns) >= {"doc_id", "piece", "sequence_id", "offset"}


CLASHING = ["bits", "__may", "__score", "__lang", "__sure", "__text", "__id", "__copy", "piece", "a.b"]


def odd_rows(spark):
    long = "the words of a very long text " * 5000
    rows = [(None, "some text of a few words", None, None, None), (1, None, None, None, None), (1, None, None, None, None), (2, "", "en", "s", 0)]
    rows += [(3, "the words the words", "en", "s", 19)] * 2 + [(4, long, "en", "s", len(long)), (5, "first text of its own here", "fr", "s", 26), (5, "quite another text that stands there", "en", "s", 36)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in CLASHING)
    return spark.createDataFrame([(*r, *CLASHING) for r in rows], schema)


def test_stages_on_odd_rows(spark):
    odd = odd_rows(spark)
    for table in (odd, odd.where("false")):
        for _, stage in corpus_pipeline.STAGES[:4]:
            out = stage(spark, table, SF)
            assert out.columns == odd.columns
            assert all(tuple(r)[5:] == tuple(CLASHING) for r in out.collect())
    near = corpus_pipeline.near_stage(spark, odd, SF)
    kept = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in near.collect())
    assert [(n, i) for n, i, _ in kept] == [(False, 1), (False, 3), (False, 4), (False, 5), (False, 5), (True, 0)]
    assert corpus_pipeline.line_stage(spark, odd, SF).where(F.col("text").isNull()).count() == 2
    packed = corpus_pipeline.packing_stage(spark, odd, SF).collect()
    assert len(packed) == odd.count() - 1 + len({r["piece"] for r in packed if r["doc_id"] == 4}) and corpus_pipeline.packing_stage(spark, odd.where("false"), SF).count() == 0


def test_unrelated_texts_of_one_id_stay(spark):
    rows = [(1, "alpha beta gamma delta epsilon zeta eta"), (5, "one two three four five six seven"), (5, "red green blue yellow black white grey"), (5, "red green blue yellow black white grey")]
    near = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF)
    assert sorted(map(tuple, near.collect())) == sorted(set(rows))
