"""Best-fit packing: a configuration linear program over the length histogram, solved by multiplicative weights, then rounded."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import count as count_from

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import WordCodec
from .common import cut, free, map_texts

#: The program stops once the sequences are within this share of its bound, or after STALE stages that bring less than PROGRESS.
GAP, PROGRESS, STALE = 0.01, 0.001, 3
#: Rounds of a stage, the first step of the weights and the rounds after which it is down to 0.7 of that, and patterns priced in a round.
STAGE, STEP, SLOWER, PRICED = 100, 0.1, 10, 100
#: How far (in sequences) a pattern's price may stay under the best one: in the program, and where the roundings begin.
NEAR, EVEN, MARGINS = 0.01, 0.004, (0.003, 0.01, 0.1)
#: Of a pattern's possible uses the share that the even rounding takes at once, and its rounds.
SHARE, TURNS = 0.1, 150
#: Pieces of one length that are ranked together in one task, about.
RANKED = 100_000

#: A pattern: lengths and how many pieces of each, in order of filling.
Pattern = dict[int, int]


def best_prices(prices: np.ndarray, capacity: int) -> np.ndarray:
    """The knapsack's dynamic program: the greatest price of pieces that fill at most 0, 1, ... ``capacity`` tokens.

    ``prices[i]`` belongs to length i + 1; lengths of a negative price aren't there. A length may be taken any number of times.
    """
    best = np.zeros(capacity + 1)
    for room in range(1, capacity + 1):
        top = (best[:room][::-1] + prices[:room]).max()
        best[room] = max(top, best[room - 1])
    return best


def filled(first: int, best: np.ndarray, prices: np.ndarray, left: np.ndarray, capacity: int, near: float, wanted: np.ndarray | None = None) -> Pattern:
    """A pattern with a piece of length ``first`` whose rest is filled at a price within ``near`` of the best, piece by piece.

    Of the lengths that allow it the longest is taken, or with ``wanted`` the longest of those that are wanted most. No length is
    taken more often than ``left`` says; where none is left that allows such a price, the rest of the sequence stays empty.
    """
    held, room = {first: 1}, capacity - first
    while room:
        fits = (best[:room][::-1] + prices[:room] >= best[room] - near) & (left[:room] > 0)
        for length, n in held.items():
            if length <= room and n >= left[length - 1]:
                fits[length - 1] = False
        if wanted is not None and fits.any():
            fits &= wanted[:room] >= 0.9 * wanted[:room][fits].max()
        place = int(fits[::-1].argmax())
        if not fits[room - 1 - place]:
            break
        length = room - place
        held[length] = held.get(length, 0) + 1
        room -= length
    return held


def _arrays(held: Pattern) -> tuple[np.ndarray, np.ndarray]:
    return np.fromiter(held, np.int64, len(held)), np.fromiter(held.values(), np.int64, len(held))


def solve(counts: np.ndarray, capacity: int, stage: int = STAGE) -> Iterator[tuple[np.ndarray, float]]:
    """Prices of the lengths and the number of sequences that the configuration linear program needs at least, after each stage.

    The program covers each length's pieces by uses of patterns. Multiplicative weights: each round prices patterns under the
    present weights (the knapsack), those near the best price cover what they can of the demand, and a length's weight falls
    by the share of its demand that was covered, so that lengths which are hard to place gain. Steps grow smaller by the root of
    the rounds. Weights scaled so that no pattern costs more than one sequence bound the program from below; the best ones
    become the prices.
    """
    lengths, there = np.arange(1, capacity + 1), counts > 0
    demand = np.maximum(counts, 1).astype(float)
    log = np.log(lengths / capacity)
    bound, prices = 0.0, np.zeros(capacity)
    for turn in count_from(1):
        weights = np.where(there, np.exp(log), -1.0)
        best = best_prices(weights, capacity)
        weights, best = weights / best[capacity], best / best[capacity]
        total = float((weights * counts)[there].sum())
        if total > bound:
            bound, prices = total, weights
        need, start = counts.astype(float), there & (weights + best[:capacity][::-1] >= 1 - NEAR)
        for _ in range(PRICED):
            share = np.where(start, need / demand, 0)
            first = capacity - int(share[::-1].argmax())
            if share[first - 1] <= 1e-9:
                break
            held, copies = _arrays(filled(first, best, weights, need, capacity, NEAR / 8, need))
            need[held - 1] -= (need[held - 1] / copies).min() * copies
        covered = np.where(there, 1 - need / demand, 0)
        log -= STEP / math.sqrt(1 + (turn - 1) / SLOWER) * covered / max(covered.max(), 1e-9)
        log -= log[there].max()
        if turn % stage == 0:
            yield prices, bound


def round_longest(counts: np.ndarray, prices: np.ndarray, capacity: int, near: float = MARGINS[1]) -> list[tuple[Pattern, int]]:
    """Whole uses of patterns that take every piece: the longest piece first, filled at near the best price by the longest that allow it.

    Each pattern is used as often as the counts allow, which uses up a length, so that their number is bounded by the lengths and
    not by the pieces. What finds no pattern near the best price waits for a wider margin.
    """
    left, out = counts.copy(), []
    while left.any():
        now = np.where(left > 0, prices, -1.0)
        best = best_prices(now, capacity)
        start = left > 0
        while (start & (left > 0)).any():
            first = int(np.flatnonzero(start & (left > 0))[-1]) + 1
            held = filled(first, best, now, left, capacity, near)
            lengths, copies = _arrays(held)
            if (now[lengths - 1] * copies).sum() < best[capacity] - near:
                start[first - 1] = False
                continue
            uses = int((left[lengths - 1] // copies).min())
            out.append((held, uses))
            left[lengths - 1] -= uses * copies
        near = min(3 * near, 2.0)
    return out


def round_evenly(counts: np.ndarray, prices: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Whole uses of patterns that lower all lengths alike: a share of the possible uses at once, the least covered lengths first.

    What is left then, a part of each length, is rounded with the longest first.
    """
    left, out, near, demand = counts.copy(), [], EVEN, np.maximum(counts, 1)
    for _ in range(TURNS):
        there = left > 0
        if not there.any() or near > 0.02:
            break
        share = left / demand
        now = np.where(there, prices * np.exp(0.1 * (share - left.sum() / demand[there].sum())), -1.0)
        best = best_prices(now, capacity)
        now, best = now / best[capacity], best / best[capacity]
        start, before = there & (now + best[:capacity][::-1] >= 1 - near), len(out)
        for _ in range(24):
            open_ = np.where(start & (left > 0), share, 0)
            if not open_.any():
                break
            first = capacity - int((open_[::-1] >= 0.9 * open_.max()).argmax())
            start[first - 1] = False
            held = filled(first, best, now, left, capacity, near / 4, share)
            lengths, copies = _arrays(held)
            if (now[lengths - 1] * copies).sum() < 1 - 2 * near:
                continue
            uses = max(1, int((left[lengths - 1] // copies).min() * SHARE))
            out.append((held, uses))
            left[lengths - 1] -= uses * copies
            share[lengths - 1] = left[lengths - 1] / demand[lengths - 1]
        if len(out) == before:
            near *= 2
    return out + round_longest(left, prices, capacity)


def plan(counts: np.ndarray, capacity: int, stage: int = STAGE) -> list[tuple[Pattern, int]]:
    """Patterns and whole numbers of uses that take every piece of the histogram exactly once.

    Full-length pieces fill sequences of their own; the program prices the others, whatever their number. After each of its stages
    the prices are rounded evenly and, with several margins, longest first, and the rounding with the fewest sequences stays. The
    program goes on until these are within GAP of its bound, or neither has come nearer for STALE stages: rounding alone may cost
    more than that, on few pieces.
    """
    left, out = counts.astype(np.int64).copy(), []
    if left[capacity - 1]:
        out.append(({capacity: 1}, int(left[capacity - 1])))
        left[capacity - 1] = 0
    if not left.any():
        return out

    def sequences(patterns: list[tuple[Pattern, int]]) -> int:
        return sum(n for _, n in patterns)

    kept, best_n, best_bound, stale = [], 0, 0.0, 0
    for prices, bound in solve(left, capacity, stage):
        tried = [*(round_longest(left, prices, capacity, near) for near in MARGINS), round_evenly(left, prices, capacity), *([kept] if kept else [])]
        found = min(tried, key=sequences)
        n = sequences(found)
        nearer = not kept or n < best_n or bound > best_bound * (1 + PROGRESS)
        kept, best_n, best_bound, stale = found, n, bound, 0 if nearer else stale + 1
        if n <= math.ceil(bound - 1e-6) or n <= (1 + GAP) * bound or stale == STALE:
            return out + kept
    return out


def places(patterns: list[tuple[Pattern, int]]) -> pd.DataFrame:
    """Runs of ranks of each length: a run's pieces go ``copies`` to a sequence, from sequence ``first`` and place ``base`` on."""
    at, first, rows = {}, 0, []
    for pattern, uses in patterns:
        base = 0
        for length, copies in pattern.items():
            rows.append((length, at.get(length, 0), copies, first, base))
            at[length] = at.get(length, 0) + copies * uses
            base += copies * length
        first += uses
    return pd.DataFrame(rows, columns=["length", "rank", "copies", "first", "base"], dtype="int64").sort_values(["length", "rank"], ignore_index=True)


def tokenized(docs: DataFrame, path: str, capacity: int = 2048, end: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all documents: ids of the text and ``end``; documents over ``capacity`` are cut into pieces of it.

    Null and empty texts are one piece, of ``end`` alone; repeated rows give their pieces each; an empty table gives none. Columns
    other than the two named aren't read.
    """

    def make():
        codec, tail, step = WordCodec(path), int(end).to_bytes(4, "little"), 4 * capacity

        def work(texts):
            ids = [x + tail for x in codec.encode([t or "" for t in texts])]
            return {"__n": [len(x) // 4 for x in ids], "__crc": [[zlib.crc32(x[i : i + step]) for i in range(0, len(x), step)] for x in ids]}

        return work

    made = map_texts(docs, [id_col], text_col, make, "__n long, __crc array<long>")
    start = F.col("piece").cast("long") * capacity
    length = F.least(F.lit(capacity).cast("long"), F.col("__n") - start)
    each = made.select(id_col, "__n", F.posexplode("__crc").alias("piece", "ids_crc32"))
    return each.select(id_col, "piece", start.alias("start"), length.alias("length"), "ids_crc32")


def pack(pieces: DataFrame, capacity: int = 2048, id_col: str = "doc_id", into: tuple[str, str] = ("sequence_id", "offset")) -> DataFrame:
    """Adds the columns ``into`` to pieces (``length`` from 1 to ``capacity``); ``pieces`` should be read from storage.

    Only the histogram (``capacity`` counts) and the runs of ranks made from it are on the driver. Ranks of a length come from
    counts of salted groups, so no task gets all pieces of a frequent length. Pieces that tie are ranked in any order; an empty
    table gives no rows; all other columns stay, whatever their names, and those of ``into`` are replaced.
    """
    counts = np.zeros(capacity, np.int64)
    for length, n in pieces.groupBy("length").count().collect():
        counts[length - 1] = n
    runs = places(plan(counts, capacity))
    salts = max(8, math.ceil(int(counts.sum()) / RANKED))
    kept = pieces.drop(*into)
    salt, before, rank, n = (free(x, kept.columns) for x in ("salt", "before", "rank", "n"))
    name = f"`{id_col}`"
    salted = kept.withColumn(salt, F.pmod(F.xxhash64(name, "piece"), F.lit(salts)))
    earlier = Window.partitionBy("length").orderBy(salt).rowsBetween(Window.unboundedPreceding, -1)
    sums = salted.groupBy("length", salt).agg(F.count("*").alias(n)).select("length", salt, F.coalesce(F.sum(n).over(earlier), F.lit(0)).alias(before))
    own = Window.partitionBy("length", salt).orderBy(name, "piece")
    ranked = salted.withColumn(rank, F.row_number().over(own) - 1).join(sums, ["length", salt])
    ranked = ranked.select(*[F.col(f"`{c}`") for c in kept.columns], (F.col(rank) + F.col(before)).alias(rank))

    wide = int(counts.max(initial=0)) + 1
    keys = runs["length"].to_numpy() * wide + runs["rank"].to_numpy()
    tables = [runs[c].to_numpy() for c in ("rank", "copies", "first", "base")]
    # columns go under plain names, since Python functions take no names with dots in them
    length_at, rank_at = (f"c{ranked.columns.index(c)}" for c in ("length", rank))
    plain = ranked.toDF(*[f"c{i}" for i in range(len(ranked.columns))])
    schema = plain.drop(rank_at).schema.add("s", "long").add("o", "long")

    def place(batches):
        for b in batches:
            lengths, ranks = b[length_at].to_numpy(), b[rank_at].to_numpy()
            k = np.searchsorted(keys, lengths * wide + ranks, "right") - 1
            rank, copies, first, base = (t[k] for t in tables)
            over = ranks - rank
            yield b.drop(columns=rank_at).assign(s=first + over // copies, o=base + over % copies * lengths)

    return plain.mapInPandas(place, schema).toDF(*[c for c in ranked.columns if c != rank], *into)


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every piece of every document, its sequence and its place there; sequences are filled without gaps from 0.

    Null and empty texts are one piece with the closing id alone; repeated rows are packed each; an empty table gives no rows.
    Columns other than the two named aren't read.
    """
    return pack(cut(tokenized(docs, path, capacity, id_col=id_col, text_col=text_col)), capacity, id_col).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
