"""Near-dedup of the pipeline against brute force over shingle sets."""

import random

import corpus_pipeline
import numpy as np
from siltstone.llm import minhash, simhash

DOCS = "doc_id long, text string"


def families(seed=0):
    """Texts of 60 to 200 words, each with versions that swap 1 to 6 words, of themselves or of the version before."""
    rng = random.Random(seed)
    rows = []
    for _ in range(40):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 200))]
        rows.append(" ".join(words))
        for _ in range(rng.randrange(5)):
            new = list(words)
            for _ in range(rng.randrange(1, 7)):
                new[rng.randrange(len(new))] = f"x{rng.randrange(5000)}"
            rows.append(" ".join(new))
            words = new if rng.random() < 0.5 else words
    rng.shuffle(rows)
    return list(enumerate([*rows, rows[0], rows[0].upper(), "", None, "two words"]))


def brute(rows, width=5, percent=80):
    """The least id of each row's component, and the similar pairs of different sets."""
    sets = [frozenset(simhash.shingle_hashes(t, width).tolist()) for _, t in rows]
    label, pairs = list(range(len(rows))), []
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x == y or 100 * len(x & y) >= percent * len(x | y) > 0:
                pairs += [(j, i)] if x != y else []
                a, b = label[i], label[j]
                label = [min(a, b) if v in (a, b) else v for v in label]
    return label, pairs


def test_similar_texts_are_one_component(spark):
    rows = families()
    label, pairs = brute(rows)
    got = {r["id"]: r["component_id"] for r in minhash.similar(spark.createDataFrame(rows, DOCS).repartition(5), 5).collect()}
    assert [got[i] for i, _ in rows] == label
    # the stage finds what three bits of a fingerprint miss
    bits = [int(simhash.fingerprint(simhash.shingle_hashes(rows[i][1], 5)) ^ simhash.fingerprint(simhash.shingle_hashes(rows[j][1], 5))).bit_count() for i, j in pairs]
    assert len(pairs) > 20 and sum(b > 3 for b in bits) > len(pairs) / 2
    kept = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    assert kept == set(label)


def test_exactly_four_fifths_counts(spark):
    # 5 words a shingle: 9 and 9 shingles with 8 in common are 8 of 10, with 7 in common 7 of 11
    a, b, c = ([str(i) for i in range(k, k + 13)] for k in (0, 1, 2))
    rows = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join([*c[:-2], "y", "z"]))]
    sets = spark.createDataFrame([(str(i).encode(), simhash.shingle_hashes(t, 5).view("int64").tolist()) for i, t in rows], "set binary, hashes array<long>")
    pairs = spark.createDataFrame([(b"1", b"2"), (b"2", b"3")], "a binary, b binary")
    assert [bytes(r["a"]) for r in minhash.verified(pairs, sets, 80).collect()] == [b"1"]


def test_a_large_family_costs_a_pair_each(spark):
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join([*words[:i], "new", *words[i + 1 :]])) for i in range(300)]
    assert {r["component_id"] for r in minhash.similar(spark.createDataFrame(rows, DOCS), 5).collect()} == {0}


def test_copies_of_one_text_that_are_not_similar_to_each_other(spark, monkeypatch):
    """All link to the text they were made from and few to each other: no pair by pair comparison is needed for them."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 220):
        new = list(base)
        for k in rng.sample(range(400), 7):
            new[k] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(new)))
    rng.shuffle(rows)
    label, _ = brute(rows)
    asked, real = [], minhash.verified
    monkeypatch.setattr(minhash, "verified", lambda pairs, *a: asked.append(pairs.count()) or real(pairs, *a))
    got = {r["id"]: r["component_id"] for r in minhash.similar(spark.createDataFrame(rows, DOCS).repartition(4), 5).collect()}
    ids = [i for i, _ in rows]
    assert [got[i] for i in ids] == [min(i for i, x in zip(ids, label, strict=True) if x == mine) for mine in label]
    assert sum(asked) < 8 * len(rows) and len(set(got.values())) < 10


def test_parts_of_a_band_miss_no_pair(spark):
    rows = families(3)
    sets = [(str(i).zfill(4).encode(), simhash.shingle_hashes(t, 5)) for i, t in rows]
    kept = [(k, np.unique(h)) for k, h in sets if len(h) > 3]
    left = spark.createDataFrame([(band, k, len(h), k) for band in (1, 2) for k, h in kept], "band long, set binary, n int, root binary").repartition(3)
    stored = spark.createDataFrame([(k, h.view("int64").tolist()) for k, h in kept], "set binary, hashes array<long>")
    label, _ = brute([(i, t) for (i, t), (_, h) in zip(rows, sets, strict=True) if len(h) > 3])
    for part, shingles in ((10**6, 10**9), (17, 10**9), (10**6, 900)):
        links = minhash.block_links(left, stored, 80, part, shingles).collect()
        assert all(r["a"] != r["b"] for r in links)
        place = {k: i for i, (k, _) in enumerate(kept)}
        a, b = (np.array([place[bytes(r[x])] for r in links], int) for x in "ab")
        assert simhash.components(len(kept), a, b).tolist() == label
        # a forest for each part and not all pairs
        assert len(links) < 8 * len(kept)


def test_one_row_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (1, b), (1, b), (2, b), (None, c), (None, c), (None, c + " more"), (3, c + " end"), (None, "alone"), (None, "alone")]
    kept = corpus_pipeline.near_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()
    assert sorted((r["doc_id"] or 0, r["text"]) for r in kept) == [(0, "alone"), (1, a), (1, b), (3, c + " end")]


def test_near_fingerprints_are_candidates(spark, monkeypatch):
    """Where texts share no band of hashes, those with near fingerprints still meet and are checked by their sets; the stage asks for them."""
    words, phrase = [f"w{i}" for i in range(400)], [f"p{i}" for i in range(7)] * 60
    rows = [(i, " ".join([*words[:i], *words[i + 1 :]])) for i in (0, 1, 399)] + [(i, " ".join([*phrase, *(f"t{i}-{k}" for k in range(i))])) for i in (9, 12)] + [(20, "quite another text of some words"), (30, None), (31, "")]
    prints = [simhash.fingerprint(simhash.shingle_hashes(t, 5)) for _, t in rows]
    bits = [int(prints[i] ^ prints[j]).bit_count() for i, j in ((0, 2), (3, 4))]
    assert bits[0] <= 3 and bits[1] == 0
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    own = minhash.sketches(docs, 5, "doc_id", "text", True).cache()
    assert {r["id"]: np.int64(r["fp"]).view(np.uint64) for r in own.collect()} == dict(zip([i for i, _ in rows], prints, strict=True))
    keep = lambda df: df.cache()
    near = minhash.fingerprint_bands(own, 3, keep)
    ids = {bytes(r["set"]): r["id"] for r in own.where("n > 0").collect()}
    bands = {}
    for r in near.collect():
        bands.setdefault(r["band"], set()).add(ids[bytes(r["set"])])
    assert {9, 12} in bands.values() and any({0, 399} <= x for x in bands.values()) and not any({20} & x for x in bands.values())
    nodes = own.selectExpr("set", "copy", "n", "CAST(array() AS array<long>) AS bands")
    links = [{ids[bytes(r["a"])], ids[bytes(r["b"])]} for r in minhash.band_links(docs, nodes, 5, 80, "text", keep, near).collect()]
    assert any(0 in x or 399 in x for x in links) and {9, 12} not in links  # equal fingerprints, but sets of too little in common
    assert minhash.band_links(docs, nodes, 5, 80, "text", keep).count() == 0
    asked, real = [], minhash.near_edges
    monkeypatch.setattr(minhash, "near_edges", lambda fps, radius, *a: asked.append(radius) or real(fps, radius, *a))
    kept = {r["doc_id"] for r in corpus_pipeline.near_stage(spark, docs, "").collect()}
    assert asked == [corpus_pipeline.RADIUS] and kept == {0, 9, 12, 20, 30}
