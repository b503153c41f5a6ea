"""Chat windows: round trips, and every window against a plain loop over turns."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from siltstone.llm import chat

LONG = "word " * 30_000
HARD = ["\\", "<|", "<\\|", "|>", "<|turn|>", "<|end|>", "<|text|>", "\\\\<|", "<", "<<|end|>", "", None, "é\n", "a " * 30, "a b c"]
SCHEMA = "conv_id long, turn long, role string, text string"


def chats(seed=6, most=40):
    rng = random.Random(seed)
    rows = []
    for c in range(14):
        for t in range(rng.randrange(1, most)):
            role = "system" if t == 0 and c % 2 else ("user", "assistant", "assistant", "odd<|", None)[rng.randrange(5)]
            rows.append((c, t, role, "".join(str(rng.choice(HARD) or "") for _ in range(3)) if rng.random() < 0.8 else rng.choice(HARD)))
    rows += [(50, 1, "assistant", "tie"), (50, 1, "assistant", "tie"), (50, 0, "user", LONG), (50, 3, "assistant", LONG), (50, None, "user", "first"), (None, 0, "assistant", "none")]
    return rows + [(60, None, "user", f"many of no number {i % 7} {i}") for i in range(90)] + [(61, 4, "assistant", "one number")] * 60 + [(70, 0, "system", "long " * 200), (70, 1, "user", "x"), *((70, i, "assistant", "y " * 50) for i in range(2, 9))]


def conversations(rows):
    out = {}
    for c, n, role, text in rows:
        out.setdefault(c, []).append((-1 if n is None else n, role or "", text or ""))
    return {c: [(role, text, len(text.split()) + 1) for _, role, text in sorted(turns)] for c, turns in out.items()}


def plain_windows(turns, budget, history):
    """(shown turns, which of them are the span's own) of each window."""
    system = turns[0][2] if turns[0][0] == "system" else 0
    room = max(budget - history - system, chat.ROOM)
    spans = []
    for i, (_, _, tokens) in enumerate(turns):
        if not spans or sum(turns[j][2] for j in spans[-1]) + tokens > room:
            spans.append([])
        spans[-1].append(i)
    out = []
    for k, span in enumerate(spans):
        before, total = [], 0
        for i in reversed(spans[k - 1] if k else []):
            total += turns[i][2]
            if total > history or (i == 0 and system):
                break
            before.insert(0, i)
        shown = ([0] if system and k else []) + before + span
        out.append((shown, span))
    return out


@pytest.mark.parametrize(("budget", "history", "block", "tables"), [(512, 128, 1024, 256), (160, 30, 1024, 256), (200, 0, 7, 256), (160, 30, 5, 3)])
def test_every_window_equals_the_plain_loop(spark, monkeypatch, budget, history, block, tables):
    monkeypatch.setattr(chat, "BLOCK", block)
    monkeypatch.setattr(chat, "TABLES", tables)
    monkeypatch.setattr(chat, "ROOM", 40)
    rows = chats()
    df = spark.createDataFrame([(*r, "z", "y") for r in rows], SCHEMA + ", window string, formatted string").repartition(4)
    windows = chat.format_windows(df, budget=budget, history=history)
    got = {}
    for r in windows.orderBy("conv_id", "window").collect():
        got.setdefault(r["conv_id"], []).append(r)
    told = conversations(rows)
    assert set(got) == set(told)

    def escaped(x):
        return x.replace("\\", "\\\\").replace("<|", "<\\|")

    for c, turns in told.items():
        want = plain_windows(turns, budget, history)
        assert [r["window"] for r in got[c]] == list(range(1, len(want) + 1))
        system = turns[0][2] if turns[0][0] == "system" else 0
        for r, (shown, span) in zip(got[c], want, strict=True):
            assert r["formatted"] == "".join(f"<|turn|>{escaped(turns[i][0])}<|text|>{escaped(turns[i][1])}<|end|>" for i in shown)
            assert (r["n_turns"], r["n_repeated"], r["tokens"]) == (len(shown), len(shown) - len(span), sum(turns[i][2] for i in shown))
            loss = [r["formatted"][x["from"] : x["from"] + x["length"]] for x in r["loss"]]
            assert loss == [escaped(turns[i][1]) for i in span if turns[i][0] == "assistant"]
            assert r["tokens"] <= budget or len(span) == 1 or system + history + chat.ROOM > budget


def test_digests(spark):
    rows = chats(7)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    windows = chat.format_windows(df, budget=90, history=30)
    out = {r["conv_id"]: r for r in chat.digests(windows).collect()}
    told = conversations(rows)
    assert set(out) == set(told)
    for c, turns in told.items():
        whole = "".join(f"{role}\n{text}\n" for role, text, _ in turns)
        loss = "".join(text for role, text, _ in turns if role == "assistant")
        assert (out[c]["n_turns"], out[c]["turns_sha256"]) == (len(turns), hashlib.sha256(whole.encode()).hexdigest())
        assert (out[c]["loss_chars"], out[c]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert windows.agg(F.sum(F.length("formatted"))).first()[0] == sum(r["formatted_chars"] for r in out.values())
    assert chat.digests(chat.format_windows(df.where("false"))).count() == 0


def test_a_hot_conversation_is_not_one_task(spark):
    """Places come from a sort over all tasks: no window over a conversation's or a turn number's rows."""
    df = spark.range(3000).selectExpr("1L AS conv_id", "CAST(NULL AS BIGINT) AS turn", "'user' AS role", "concat('text ', id) AS text")
    placed = chat._placed(df, "conv_id", "turn", "role", "text")
    assert placed.select("place").distinct().count() == 3000 and placed.agg(F.max("place")).first()[0] == 2999
    in_order = [r["text"] for r in placed.orderBy("place").collect()]
    assert in_order == sorted(in_order)
    assert chat.format_windows(df).agg(F.max("tokens")).first()[0] <= chat.BUDGET


def test_blocks_end_no_span(spark):
    """2,100 turns of two tokens: all windows but the last hold the whole budget, across both blocks' edges."""
    df = spark.range(2100).selectExpr("1L AS conv_id", "id AS turn", "'user' AS role", "'x' AS text")
    found = [r["tokens"] for r in chat.format_windows(df).orderBy("window").collect()]
    assert len(found) == -(-4200 // 384) and set(found[1:-1]) == {512} and found[0] == 384
