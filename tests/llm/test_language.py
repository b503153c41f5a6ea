"""Language identification against a plain model made with dictionaries."""

import math
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from siltstone.llm import language

SCHEMA = "doc_id long, text string, lang string"


def corpus(langs, each=30, seed=3):
    rng = random.Random(seed)
    sounds = {lang: ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzéß") for _ in range(rng.randrange(1, 4))) for _ in range(12)] for lang in langs}
    rows = []
    for i in range(each):
        for lang, parts in sounds.items():
            rows.append((len(rows), " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(1, 25))) + rng.choice([".", "! 12", ""]), lang))
    return rows


def plain_model(rows):
    """Counts of words and n-grams by kind, gram and language, of rows whose crc32 isn't 0 mod 5."""
    kinds = [{} for _ in range(5)]
    langs = sorted({lang for i, t, lang in rows if lang is not None and t is not None and zlib.crc32(str(i).encode()) % 5})
    for i, text, lang in rows:
        if lang is None or text is None or zlib.crc32(str(i).encode()) % 5 == 0:
            continue
        for w in re.findall(r"[^\W\d_]+", text.lower()):
            for k in range(5):
                marked = f"<{w}>" if k > 1 else w
                for g in [w] if k == 0 else [marked[j : j + k] for j in range(len(marked) - k + 1)]:
                    kinds[k].setdefault(g, Counter())[lang] += 1
    totals = [{lang: sum(c[lang] + 0.5 for c in kind.values()) for lang in langs} for kind in kinds]

    def logs(k, g):
        return [math.log((kinds[k][g][lang] + 0.5) / totals[k][lang]) for lang in langs]

    def score(w):
        if w in kinds[0]:
            return logs(0, w)
        for k in range(4, 0, -1):
            marked = f"<{w}>" if k > 1 else w
            found = [logs(k, g) for g in (marked[j : j + k] for j in range(len(marked) - k + 1)) if g in kinds[k]]
            if found:
                return [sum(x) / len(found) for x in zip(*found, strict=True)]
        return [0.0] * len(langs)

    def predict(text):
        ws = re.findall(r"[^\W\d_]+", (text or "").lower())
        if not ws or not langs or not any(map(str.isalpha, text)):
            return "und", 0.0
        mean = [sum(x) / len(ws) * math.sqrt(len(ws)) for x in zip(*map(score, ws), strict=True)]
        best = max(range(len(langs)), key=lambda i: (round(mean[i], 4), -i))
        return langs[best], 1 / sum(math.exp(m - mean[best]) for m in mean)

    return predict


ODD = [None, "", " ", "123 !!", "½", "a", "zzzz qqqq", "漢字", "🙂", "İstanbul", "word " * 30_000, "abab cdcd", "abab cdcd"]


def test_every_prediction_equals_the_plain_model(spark):
    rows = corpus(["aa", "bb", "cc"])
    rows += [(1000 + i, t, None) for i, t in enumerate(ODD)] + [(5, "one id again", "bb"), (5, "one id again", "bb")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA + ", score string, held_out string").repartition(3)
    predict = plain_model(rows)
    got = [(r["doc_id"], r["lang_pred"], r["score"], r["held_out"]) for r in language.identify_documents(df).collect()]
    assert len(got) == len(rows)
    by_id = {}
    for i, lang, score, held in got:
        by_id.setdefault(i, []).append((lang, score))
        assert held == (zlib.crc32(str(i).encode()) % 5 == 0)
    for i, text, _ in rows:
        want = predict(text)
        assert any(lang == want[0] and score == pytest.approx(want[1], abs=1e-3) for lang, score in by_id[i]), text


def test_every_language_is_learned(spark, monkeypatch):
    monkeypatch.setattr(language, "WORDS", 40)
    monkeypatch.setattr(language, "GRAMS", 40)
    monkeypatch.setattr(language, "PLACES", 30)
    langs = [f"l{i:03}" for i in range(230)]
    rows = corpus(langs, each=4)
    df = spark.createDataFrame(rows, SCHEMA)
    model = language.fit(df)
    assert model.langs == langs
    # each keeps its own best words, 30 at most (more only where others brought them)
    assert all(0 < len(t.place) <= 30 * len(langs) for t in model.tables[2:])
    out = {r["doc_id"]: r["lang_pred"] for r in language.identify(df, model).collect()}
    assert sum(out[i] == lang for i, _, lang in rows) > 0.8 * len(rows)


def test_full_caches_move_no_score(spark, monkeypatch):
    rows = corpus(["aa", "bb"], each=40)
    model = language.fit(spark.createDataFrame(rows, SCHEMA))
    texts = [t for _, t, _ in rows]
    whole = language.Scorer(model).predict(texts)
    monkeypatch.setattr(language, "KEPT", 5)
    small = language.Scorer(model)
    assert [small.predict([t])[0] for t in texts] == whole


def test_ties_go_to_the_first_language(spark):
    rows = [(i, "same words here", lang) for i, lang in enumerate(["b", "a"] * 10)]
    df = spark.createDataFrame(rows, SCHEMA)
    balanced = df.where(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) != 0).withColumn("lang", F.explode(F.array(F.lit("b"), F.lit("a"))))
    got = language.identify(df, language.fit(balanced)).collect()
    assert {(r["lang_pred"], round(r["score"], 6)) for r in got} == {("a", 0.5)}


@pytest.mark.parametrize("n", [1, 3000, 3001, 10**6, 4 * 10**9, 10**13, 2**60])
def test_a_language_of_any_size_is_read_at_about_the_same_rate(n):
    limit = language.limit_of(3000, n)
    assert 1 <= limit <= 2**62
    assert abs(min(3000, n) - n * limit / 2**62) <= 1


def test_words_of_one_count_have_the_places_that_are_there(spark, monkeypatch):
    """Of a language whose words all occur once as many are learned as it has places for, and of a count that doesn't fit a part."""
    monkeypatch.setattr(language, "PLACES", 1)
    monkeypatch.setattr(language, "WORDS", 600)
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5]
    letters = "abcdefghijklmnopqrstuvwxyz"
    once = [letters[a] + letters[b] + letters[c] for a in range(10) for b in range(10) for c in range(10)]
    rows = [(ids[0], " ".join(once), "xx"), (ids[1], " ".join(f"{w}z" for w in once[:50]) + " " + " ".join(f"{w}y" for w in once[:400]) * 2, "yy")]
    model = language.fit(spark.createDataFrame(rows, SCHEMA))
    known = model.tables[0].place
    xx, yy = [w for w in known if len(w) == 3], [w for w in known if len(w) > 3]
    assert len(xx) == 300 and len(yy) == 300
    again = language.fit(spark.createDataFrame(rows, SCHEMA).repartition(3))
    assert again.tables[0].place == known


def test_a_null_id_is_held_out(spark):
    rows = [(None, "aa bb", "xx"), (1, "cc dd", "yy")]
    found = {r["doc_id"]: r["held_out"] for r in language.identify_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert found[None] is True


def test_fits_gather_columns_and_no_rows(spark, monkeypatch):
    """Rows of Python numbers took the driver ten times the memory of Arrow's columns."""
    import pyarrow as pa

    from siltstone.llm import quality

    df = spark.createDataFrame([(i, f"word{i % 7} some other{i % 3} text", "ab"[i % 2]) for i in range(60)], "doc_id long, text string, lang string")
    gathered, told = [], quality.told
    monkeypatch.setattr(quality, "told", lambda found: gathered.append((found, told(found))) or told(found))
    assert quality.fit(df, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")).labels.sum() > 0
    (found, (rows, marks)), = gathered
    assert isinstance(found, pa.Table) and len(rows) == len(marks) == found.num_rows
    assert not any(a.flags.owndata for row in rows for a in row)
    by_id = {r["i"]: r for r in found.to_pylist()}
    for i, (code, count), y in zip(sorted(by_id), rows, marks, strict=True):
        assert (code.tolist(), count.tolist(), y) == (by_id[i]["code"], by_id[i]["count"], by_id[i]["y"])
    monkeypatch.setattr(type(df), "toLocalIterator", None)
    assert language.fit(df).langs == ["a", "b"]
