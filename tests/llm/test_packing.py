"""The packing program against brute force, a bound and plain best-fit decreasing."""

import itertools

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from siltstone.llm import packing

CAPACITY = 2048


def histogram(lengths, capacity=CAPACITY):
    return np.bincount(lengths, minlength=capacity + 1)[1:].astype(np.int64)


def best_fit_decreasing(lengths, capacity=CAPACITY):
    rooms = np.zeros(capacity + 1, int)  # sequences by the room they have
    n = 0
    for length in sorted(lengths, reverse=True):
        at = np.flatnonzero(rooms[length:])
        if len(at):
            room = length + int(at[0])
            rooms[room] -= 1
        else:
            room, n = capacity, n + 1
        rooms[room - length] += 1
    return n


def least_sequences(lengths, capacity=CAPACITY):
    """A lower bound: pieces over half share with none of their kind, and those over ``capacity - k`` with none of ``k`` or more."""
    x, out = np.asarray(lengths), 0
    for k in range(0, capacity // 2 + 1, 8):
        alone, wide, rest = x > capacity - k, (x <= capacity - k) & (2 * x > capacity), (2 * x <= capacity) & (x >= k)
        room = int(wide.sum()) * capacity - int(x[wide].sum())
        out = max(out, int(alone.sum() + wide.sum()) + max(0, -(-(int(x[rest].sum()) - room) // capacity)))
    return out


def sequences(patterns, counts, capacity=CAPACITY):
    """The number of sequences, once every piece is seen to be placed exactly once."""
    got = np.zeros(capacity, np.int64)
    for held, uses in patterns:
        assert uses > 0 and sum(length * n for length, n in held.items()) <= capacity
        for length, n in held.items():
            got[length - 1] += n * uses
    assert (got == counts).all()
    return sum(uses for _, uses in patterns)


def drawn(kind):
    rng = np.random.default_rng(11)
    return {
        "uniform": lambda: rng.integers(1, 2049, 20_000),
        "multiples of 3": lambda: 3 * rng.integers(1, 683, 20_000),
        "few": lambda: rng.integers(1, 2049, 1500),
        "middle": lambda: rng.integers(600, 1101, 20_000),
        "thirds": lambda: rng.integers(500, 800, 30_000),
        "documents": lambda: np.minimum(2048, np.exp(rng.normal(5.5, 1.0, 30_000)).astype(int) + 1),
        "200 pieces": lambda: rng.integers(300, 900, 200),
    }[kind]()


@pytest.mark.parametrize("kind", ["uniform", "multiples of 3", "few", "middle", "thirds", "documents", "200 pieces"])
def test_no_more_sequences_than_best_fit_decreasing(kind):
    lengths = drawn(kind)
    counts = histogram(lengths)
    n, plain, bound = sequences(packing.plan(counts, CAPACITY), counts), best_fit_decreasing(lengths), least_sequences(lengths)
    assert bound <= n <= plain
    if kind in ("middle", "thirds", "200 pieces"):  # where the program helps
        assert n < plain
    if kind == "uniform":
        assert n <= 1.005 * bound


@pytest.mark.parametrize(("kind", "most"), [("middle", 8905), ("thirds", 9816)])
def test_sequences_meet_the_programs_bound(kind, most):
    counts = histogram(drawn(kind))
    full, counts[-1] = int(counts[-1]), 0
    for (_, bound), _ in zip(packing.solve(counts, CAPACITY), range(5), strict=False):
        pass
    n = sequences(packing.plan(counts, CAPACITY), counts)
    assert bound <= n <= 1.025 * bound
    assert n + full <= most


def test_all_columns_stay(spark):
    rows = [(i, 0, 100 + i % 7, i, "s", "b", "r", 1.5, "dot") for i in range(40)]
    names = ["doc_id", "piece", "length", "__salt", "salt", "before", "rank", "n", "a.b"]
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, length long, __salt long, salt string, before string, rank string, n double, `a.b` string")
    found = packing.pack(pieces)
    assert found.columns == [*names, "sequence_id", "offset"]
    assert sorted(tuple(r)[:9] for r in found.collect()) == rows
    again = packing.pack(found)
    assert again.columns == found.columns and again.count() == 40


def test_the_program_prices_few_pieces_too(monkeypatch):
    calls = []
    real = packing.solve
    monkeypatch.setattr(packing, "solve", lambda *a: calls.append(a) or real(*a))
    counts = histogram(np.random.default_rng(1).integers(1, 2048, 200))
    sequences(packing.plan(counts, CAPACITY), counts)
    assert len(calls) == 1


@settings(max_examples=25, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(1, 300), max_size=12))
def test_plan_takes_every_piece_once(found):
    counts = np.zeros(40, np.int64)
    for length, n in found.items():
        counts[length - 1] = n
    sequences(packing.plan(counts, 40, stage=20), counts, 40)


def test_prices_are_those_of_the_best_pattern():
    rng = np.random.default_rng(1)
    for _ in range(20):
        w = np.where(rng.random(12) < 0.6, rng.random(12), -1)
        best = packing.best_prices(w, 12)
        for room in range(13):
            brute = max(
                sum(c * w[n - 1] for n, c in zip(range(1, 13), x, strict=True))
                for x in itertools.product(*(range(room // n + 1 if w[n - 1] > 0 else 1) for n in range(1, 13)))
                if sum(c * n for n, c in zip(range(1, 13), x, strict=True)) <= room
            ) if room < 7 else None
            assert brute is None or best[room] == pytest.approx(brute)


def test_the_bound_is_one():
    # halves and a bit: two never share a sequence, so as many sequences as pieces are needed
    counts = histogram(np.random.default_rng(2).integers(1025, 2000, 500))
    _, bound = next(packing.solve(counts, CAPACITY))
    assert 0.6 * 500 <= bound <= 500
    # any packing needs at least the bound
    for kind in ("middle", "thirds", "few"):
        counts = histogram(drawn(kind))
        counts[-1] = 0
        assert next(packing.solve(counts, CAPACITY))[1] <= sequences(packing.plan(counts, CAPACITY), counts)
