"""Toxicity: voters, label model and classifier on made texts, and held-out accuracy on the driver's tables."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from siltstone.llm import toxicity as T
from siltstone.llm.language import words_of


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def made(n, seed=1):
    """Clean prose, and toxic texts of which two words in a hundred come from an unknown stem or a stated list; chance words in either."""
    rng = random.Random(seed)
    syllables = ["ka", "lo", "mi", "ter", "sun", "el", "vor", "ang"]

    def word():
        return "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))

    rows = []
    for i in range(n):
        toxic, words = rng.random() < 0.15, [word() for _ in range(rng.randint(40, 300))]
        if toxic:
            for _ in range(max(3, len(words) // 40)):
                words.insert(rng.randrange(len(words)), rng.choice(["scum", "idiot"]) if i % 2 else "quxor" + word())
        elif rng.random() < 0.1 and len(words) > 150:
            words[rng.randrange(len(words))] = "quxor" + word()
        rows.append((i, " ".join(words).capitalize() + ".", int(toxic)))
    return rows


@pytest.fixture(scope="module")
def learned(spark):
    rows = made(900)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string").repartition(3)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    return rows, docs, labels, T.fit(docs, labels)


def test_held_out_texts(learned):
    rows, docs, labels, model = learned
    found = {r["doc_id"]: r for r in T.score_documents(docs, labels).collect()}
    assert all(found[i]["held_out"] == held_out(i) for i, _, _ in rows)
    wrong = [found[i]["predicted"] != y for i, _, y in rows if held_out(i)]
    assert np.mean(wrong) <= 0.02
    assert all(r["predicted"] == (r["score"] >= 0.7) and 0 <= r["score"] <= 1 for r in found.values())
    assert found[0]["score"] == model.score(rows[0][1])


def test_labels_of_held_out_rows_are_not_used(spark, learned):
    rows, docs, labels, _ = learned
    turned = labels.withColumn("toxic", F.when(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = ({r["doc_id"]: r["score"] for r in T.score_documents(docs, x).collect()} for x in (labels, turned))
    assert a == b


def test_the_label_model_finds_accuracies_and_links():
    rng = np.random.default_rng(3)
    y = rng.random(6000) < 0.2
    votes = np.zeros((6000, 7), np.int8)
    right = [0.95, 0.9, 0.8, 0.7]
    for j, p in enumerate(right):
        votes[:, j] = np.where(rng.random(6000) < p, np.where(y, 1, -1), np.where(y, -1, 1))
        votes[rng.random(6000) < 0.2, j] = 0
    votes[:, 4] = votes[:, 3]  # the same voter again, and once more
    votes[:, 5] = votes[:, 3]
    votes[:, 6] = rng.integers(-1, 2, 6000)
    annotated = np.where(rng.random(6000) < 0.97, y, ~y).astype(int)
    model = T.fit_labels(votes, annotated)
    assert np.abs(np.array(model.accuracy[:4]) - right).max() < 0.03
    assert abs(model.prior - 0.2) < 0.02
    linked = {frozenset((j, p)) for j, p in enumerate(model.parent) if p >= 0}
    assert len(linked & {frozenset(x) for x in ((3, 4), (3, 5), (4, 5))}) == 2
    assert not any(6 in x for x in linked)
    q = model.posterior(np.c_[votes, np.where(annotated > 0, 1, -1)])
    assert ((q > 0.5) == y).mean() > 0.985


def test_units_that_begin_one_another_count_once():
    units = [("vequor", 9, 9), ("vequ*", 60, 60), ("veq*", 60, 60), ("vequo*", 20, 20), ("idiot", 30, 30), ("idio*", 30, 30), ("lost*", 90, 40), ("lostra*", 40, 40), ("rare", 2, 2)]
    kept = {u for u, _, _ in T.independent(units)}
    assert kept == {"vequ*", "idiot", "lostra*", "rare"}
    lists = T.lists_of(units)
    assert lists.counted(["vequor", "vequis", "idiots", "rare", "scum"])
    dense = lists.lists + len(lists.full) - 1
    assert lists.counted(words_of("vequor vequis idiots rare scum idiot"))[dense] == 4


def test_the_classifier_minimises_its_loss():
    rng = np.random.default_rng(5)
    x = rng.random((400, 6)).astype(np.float32)
    q = 1 / (1 + np.exp(-(x @ np.array([4, -3, 0, 2, 0, 0]) - 1)))
    w, b = T.fit_weights(x, q)
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - q) + T.RIDGE * w).max() < 1e-2
    assert abs((p - q).sum() + 1e-3 * b) < 1e-2


def test_rows_of_any_kind(spark, learned):
    rows, docs, labels, model = learned
    odd = [(None, "x"), (5, None), (5, ""), (6, " \n"), (7, "SCUM!! " * 4), (7, "SCUM!! " * 4), (8, "scum idiot " * 40_000), (9, "漢字 \x00 😀")]
    many = spark.createDataFrame([(*r, 0.5, "y") for r in odd], "doc_id long, text string, score double, predicted string")
    out = T.score(many, model)
    assert out.columns == ["doc_id", "score"]
    found = [(r["doc_id"], r["score"]) for r in out.collect()]
    by = dict(found)
    assert len(found) == len(odd)
    assert len({s for i, s in found if i == 7}) == 1 and len({s for i, s in found if i == 5}) == 1
    assert by[5] < 0.3 and by[7] > 0.7 and by[8] > 0.7
    assert T.score_documents(docs.limit(0), labels).collect() == []
    none = labels.where(F.lit(False))
    assert {(r["score"], r["predicted"]) for r in T.score_documents(many, none).collect()} == {(0.0, 0)}
    # null labels and ids, several labels and texts of one id
    mixed = labels.unionByName(labels.limit(5)).unionByName(spark.createDataFrame([(None, 1), (3, None)], "doc_id long, toxic int"))
    assert T.fit(docs.unionByName(docs.limit(3)), mixed).score(rows[0][1]) >= 0


@pytest.mark.parametrize(("name", "least", "most"), [("sf0.01", 0.7, 0.02)])
def test_held_out_rows_of_the_tables(spark, name, least, most):
    folder = f"/root/testdata/{name}"
    docs, labels = (spark.read.parquet(f"{folder}/{t}.parquet") for t in ("documents", "labels"))
    y = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    found = [r for r in T.score_documents(docs, labels).collect() if r["held_out"] and r["doc_id"] in y]
    toxic, clean = [r["predicted"] for r in found if y[r["doc_id"]]], [r["predicted"] for r in found if not y[r["doc_id"]]]
    assert np.mean(toxic) >= least and np.mean(clean) <= most
