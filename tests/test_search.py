"""Searches for the nearest vectors: blocks of two tables, and an index of rings, against plain products."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.operators import nearest, vector

SCHEMA = "id long, namespace string, embedding array<double>"


def plain(rows, asked, k, within=False):
    ids, m = np.array([r[0] for r in rows]), np.array([r[2] for r in rows], float)
    size = np.linalg.norm(m, axis=1, keepdims=True)
    u = np.divide(m, size, out=np.zeros_like(m), where=size > 0)
    out = {}
    for q in asked:
        at = np.flatnonzero(ids == q)[0]
        s = np.round(u @ u[at], 12)
        use = ~np.isnan(s) & (np.array([r[1] == rows[at][1] for r in rows]) if within else True)
        order = [i for i in np.lexsort((ids, -s)) if use[i]][:k]
        out[q] = [(int(ids[i]), float(s[i])) for i in order]
    return {q: x for q, x in out.items() if x}


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["score"]))
    return out


def same(got, want):
    assert {q: [i for i, _ in x] for q, x in got.items()} == {q: [i for i, _ in x] for q, x in want.items()}
    assert all(a == pytest.approx(b, abs=1e-9) for q in got for (_, a), (_, b) in zip(got[q], want[q], strict=True))


def clusters(n, dim, seed, spread=0.3, groups=7):
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(groups, dim))[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, dim))
    return [(i, "ab"[i % 2], [float(x) for x in r]) for i, r in enumerate(m)]


def ties(n, seed):
    rng = np.random.default_rng(seed)
    return [(i, "ab"[i % 2], [float(x) for x in r]) for i, r in enumerate(rng.integers(-1, 2, (n, 4)))]  # many equal scores, vectors of zeros


def table_of(spark, rows):
    odd = [(5000, "a", None), (5001, "a", [1.0]), (5002, "b", [None] * len(rows[0][2])), (5003, "a", [float("nan")] * len(rows[0][2]))]
    return spark.createDataFrame(rows + odd, SCHEMA).repartition(3)


def asked_of(v, every):
    return v.where(F.col("id") % every == 0).withColumnRenamed("id", "query_id")


@pytest.mark.parametrize("within", [None, "namespace"])
@pytest.mark.parametrize("rows", [clusters(400, 8, 1), ties(300, 2)], ids=["clusters", "ties"])
def test_both_searches_equal_plain_products(spark, monkeypatch, rows, within):
    monkeypatch.setattr(nearest, "ROWS", 37)  # several blocks of each side
    v = table_of(spark, rows)
    want = plain(rows, range(0, len(rows), 20), 7, within is not None)
    same(found(nearest.knn_join(v, asked_of(v, 20), 7, within=within)), want)
    index = nearest.build(v, within=within)
    same(found(nearest.search(index, asked_of(v, 20), 7, within=within)), want)


def test_more_neighbours_than_vectors_and_empty_tables(spark):
    rows = clusters(40, 4, 3)
    v = spark.createDataFrame(rows, SCHEMA)
    want = plain(rows, [0, 20], 100)
    same(found(nearest.knn_join(v, asked_of(v, 20), 100)), want)
    same(found(nearest.search(nearest.build(v), asked_of(v, 20), 100)), want)
    none = v.limit(0)
    assert nearest.knn_join(none, asked_of(v, 20), 3).count() == 0 and nearest.knn_join(v, asked_of(none, 20), 3).count() == 0
    assert nearest.search(nearest.build(none, dim=4), asked_of(v, 20), 3).count() == 0
    assert nearest.search(nearest.build(v), asked_of(none, 20), 3).count() == 0


def test_the_index_reads_few_vectors(spark, tmp_path):
    rows = clusters(3000, 32, 5, spread=0.15, groups=30)
    v = spark.createDataFrame(rows, SCHEMA)
    for name, df in nearest.build(v).tables().items():
        df.write.parquet(f"{tmp_path}/{name}")
    index = nearest.Index.read(spark, str(tmp_path))
    same(found(nearest.search(index, asked_of(v, 100), 10)), plain(rows, range(0, 3000, 100), 10))
    assert nearest.share_read(index, asked_of(v, 100), 10) < 0.2


def test_an_extended_index_equals_plain_products(spark):
    rows = clusters(300, 8, 6)
    v = spark.createDataFrame(rows, SCHEMA)
    index = nearest.build(v.where("id < 200"))
    more = nearest.Index(index.members.unionByName(nearest.extended(index, v.where("id >= 200"))).where("id <> 20"), index.centres)
    kept = [r for r in rows if r[0] != 20]
    same(found(nearest.search(more, asked_of(v.where("id <> 20"), 50), 5)), plain(kept, range(0, 300, 50), 5))


def test_queries_do_not_go_through_the_driver(spark):
    """The plan of a join says nothing of the queries, whatever their number."""
    v = spark.createDataFrame(clusters(200, 8, 7), SCHEMA)
    few, many = (len(nearest.knn_join(v, asked_of(v, n), 3)._jdf.queryExecution().optimizedPlan().toString()) for n in (100, 2))
    assert abs(few - many) < 400
    with pytest.raises(ValueError):
        vector.knn(v, [(i, [0.0] * 8) for i in range(vector.MOST_QUERIES + 1)], 3)
