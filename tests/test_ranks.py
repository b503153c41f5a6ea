"""Neighbours and ranks without windows over whole keys, against plain loops."""

import random

from siltstone.operators import ranks


def rows(seed=1):
    rng = random.Random(seed)
    return [(k, i, rng.choice([rng.uniform(-1, 1), 0.25, 0.5, -1.0, 1.0, None])) for k in ("a", "b", None) for i in rng.sample(range(3000), 200)] + [("c", 5, 0.1)]


def test_next_row(spark):
    data = rows()
    df = spark.createDataFrame(data, "k string, i long, v double").repartition(4)
    for block in (7, 500, 10_000):
        got = {(r["k"], r["i"]): r["n"] for r in ranks.with_next(df, "k", "i", "v", "n", block=block).collect()}
        assert len(got) == len(data)
        for key in {r[0] for r in data}:
            own = sorted((r[1], r[2]) for r in data if r[0] == key)
            assert [got[key, i] for i, _ in own] == [v for _, v in own[1:]] + [None]


def test_nearest_rank(spark):
    data = [r for r in rows(2) if r[0] is not None]
    df = spark.createDataFrame(data, "k string, i long, v double").repartition(4)
    for share in (0.0, 0.25, 0.5, 1.0):
        for bins, few in ((4096, 10_000), (3, 20), (2, 1)):
            got = {r["k"]: r["v"] for r in ranks.nearest_rank(df, "k", "v", share, -1.0, 1.0, bins=bins, few=few).collect()}
            for key in ("a", "b", "c"):
                own = sorted(r[2] for r in data if r[0] == key and r[2] is not None)
                assert got[key] == own[int(share * (len(own) - 1))]


def test_values_that_are_alike_are_ranked_in_no_task(spark):
    """All equal, nearly equal, and one value with most rows: what is ranked in the end is few rows or none."""
    data = [("same", 0.3)] * 500 + [("near", 0.3 + 1e-13 * (i % 7)) for i in range(500)] + [("most", 0.5 if i % 10 else i / 1000) for i in range(500)] + [("one", -1.0), (None, 0.9), (None, 0.1)]
    df = spark.createDataFrame(data, "k string, v double").repartition(4)
    for share in (0.0, 0.25, 0.9):
        got = {r["k"]: r["v"] for r in ranks.nearest_rank(df, "k", "v", share, -1.0, 1.0, bins=4, few=5).collect()}
        for key in {k for k, _ in data}:
            own = sorted(v for k, v in data if k == key)
            assert got[key] == own[int(share * (len(own) - 1))], key


def test_other_columns_stay(spark):
    df = spark.createDataFrame([("a", 1, 0.5, 7, 8), ("a", 2, 0.6, 9, 10)], "k string, i long, v double, block int, `first` int")
    out = ranks.with_next(df, "k", "i", "v", "n")
    assert out.columns == ["k", "i", "v", "block", "first", "n"] and sorted(tuple(r) for r in out.collect()) == [("a", 1, 0.5, 7, 8, 0.6), ("a", 2, 0.6, 9, 10, None)]
