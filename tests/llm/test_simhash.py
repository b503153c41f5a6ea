"""Dense balls of fingerprints: memory of their links, parts of a crowded shard, hot fingerprints."""

import numpy as np

from siltstone.llm import common, simhash

CENTRE = np.uint64(0x0123456789ABCDEF)


def ball(n, bits, seed=1):
    """Distinct fingerprints that differ from a centre in at most ``bits`` of its bits."""
    rng = np.random.default_rng(seed)
    flips = np.uint64(1) << rng.integers(0, 64, (2 * n, bits)).astype(np.uint64)
    return np.unique(CENTRE ^ np.bitwise_or.reduce(flips, axis=1))[:n]


def brute(fps, radius=3):
    a, b = np.nonzero(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= radius)
    return simhash.components(len(fps), a, b)


def test_a_ball_keeps_one_forest():
    fps = ball(100_000, 6)
    assert len(fps) == 100_000
    a, b = simhash.links(fps, np.ones(len(fps), bool), 3)
    assert len(a) < len(fps) and (fps[a] != fps[b]).all()


def test_links_of_balls_equal_brute_force():
    for bits in (3, 5, 8, 12):
        fps = ball(1500, bits, seed=bits)
        old, simhash.BLOCK = simhash.BLOCK, 64
        try:
            a, b = simhash.links(fps, np.ones(len(fps), bool), 3)
        finally:
            simhash.BLOCK = old
        label = np.arange(len(fps))
        label[a] = b
        assert (label == brute(fps)).all()


def test_a_crowded_shard_is_searched_in_parts(spark):
    fps = np.r_[ball(600, 9), np.random.default_rng(3).integers(0, 2**63, 200, dtype=np.uint64)]
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long").repartition(3)
    dealt = df.selectExpr("0 AS shard", "fp", "fp % 7 <> 0 AS resident")
    parts = simhash.spread(dealt, 100).collect()
    assert {r["part"] for r in parts} == set(range(8))
    met = {}
    for r in parts:
        met.setdefault(r["part"], ([], []))[0 if r["resident"] else 1].append(r["fp"])
    home = {x: p for p, (own, _) in met.items() for x in own}
    assert sum(len(own) for own, _ in met.values()) == len(home)
    # every pair with a resident meets where one of the two is at home
    for x in list(home)[::37]:
        for y in fps.view(np.int64).tolist()[::11]:
            assert x == y or any((x in own and (y in own or y in guests)) or (y in own and x in guests) for own, guests in ((set(a), set(b)) for a, b in met.values()))
    edges = simhash.near_edges(df, 3, shard=16)
    roots = {r["node"]: r["root"] for r in simhash.connected(edges).collect()}
    want = brute(fps)
    groups = {}
    for i, x in enumerate(fps.view(np.int64).tolist()):
        groups.setdefault(int(want[i]), set()).add(roots.get(x, x))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_hot_fingerprints_meet_their_component_by_broadcast(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY", 4)
    rows = [(i, "one text that most rows have" if i % 3 else f"text of its own {i} {i * i} {i + 7}") for i in range(90)] + [(None, None), (200, ""), (7, "")]
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), 3).collect()
    assert len(out) == len(rows)
    by = {}
    for r in out:
        by.setdefault(r["fp"], set()).add(r["component_id"])
    assert all(len(c) == 1 for c in by.values()) and by[0] == {7}


def test_a_small_graph_takes_one_round(spark, monkeypatch):
    cuts = []
    monkeypatch.setattr(simhash, "cut", lambda df: cuts.append(df) or common.cut(df))
    for kind, node in (("long", lambda i: i - 300), ("binary", lambda i: i.to_bytes(2, "big"))):
        cuts.clear()
        edges = [(node(i), node(i + 1)) for i in range(600) if i % 200 != 199] + [(node(5), node(5))]
        roots = {r["node"]: r["root"] for r in simhash.connected(spark.createDataFrame(edges, f"a {kind}, b {kind}").repartition(3)).collect()}
        assert {bytes(k) if kind == "binary" else k: bytes(v) if kind == "binary" else v for k, v in roots.items()} == {node(i): node(i - i % 200) for i in range(600) if i % 200}
        assert len(cuts) == 2  # the contracted edges and the round that moves nothing


def test_contraction_in_parts_keeps_components(spark):
    rng = np.random.default_rng(5)
    u, v = rng.integers(0, 400, (2, 300))
    edges = spark.createDataFrame([(int(max(a, b)), int(min(a, b))) for a, b in zip(u, v, strict=True) if a != b], "u long, v long").repartition(4)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        got = simhash.contracted(edges, 20).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert all(r["u"] > r["v"] for r in got)
    small = simhash.components(400, np.array([r["u"] for r in got]), np.array([r["v"] for r in got]))
    assert (small == simhash.components(400, u, v)).all()
    assert simhash.contracted(edges.where("false")).count() == 0
