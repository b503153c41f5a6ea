"""Periodic runs of words, found by Crochemore's partition refinement over many texts at once."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, map_texts
from .rules import whole, words

#: A run holds its period at least so many times, and so many words at least.
EXPONENT, SHORTEST = 4, 6
#: Texts are refined together until they have so many words (a longer text is alone); texts of one slice of an Arrow batch.
TOGETHER, ROWS = 1_000_000, 4096
RUNS = "array<struct<start:bigint,length:bigint,period:bigint>>"
NONE = np.zeros(0, np.int64)


def _heads(*sorted_keys: np.ndarray) -> np.ndarray:
    """Where a new group begins in keys that stand sorted."""
    new = np.zeros(len(sorted_keys[0]), bool)
    new[:1] = True
    for key in sorted_keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """``start[i], start[i] + 1, ...``, ``n[i]`` of them, one after another."""
    return np.repeat(start - np.cumsum(n) + n, n) + np.arange(int(n.sum()))


class Refinement:
    """Classes of positions whose factors of one length are equal, refined length by length.

    ``codes`` holds a class of factors of length one for each position, -1 where no factor may reach (between two texts). A class
    that splits hands on all its parts but the largest, and only what stands before those moves at the next length; so a position
    moves log(n) times at most. A class' members are linked in the order of their places, and links are kept by their distance:
    those as far as the length are read without a look at others.

    In a run of exponent e each position has floor(e) - 1 equal factors as long as the period, itself counted. Classes with fewer
    members are dropped, and so is, one length on, what stands before a dropped position.
    """

    def __init__(self, codes: np.ndarray, longest: int, exponent: int = EXPONENT):
        n = len(codes)
        self.least, self.longest, self.length = max(exponent - 1, 2), longest, 1
        self.by_gap: dict[int, list[np.ndarray]] = {}
        order = np.argsort(codes, kind="stable")
        order = order[np.searchsorted(codes[order], 0) :]
        sizes = np.diff(np.append(_heads(codes[order]), len(order)))
        order, sizes = order[np.repeat(sizes >= self.least, sizes)], sizes[sizes >= self.least]
        #: A class is named by the place where its members begin; ``of`` has the class of a position (-1: dropped), ``at`` its place.
        self.members, self.size = order, np.zeros(len(order), np.int64)
        self.of, self.at, self.next, self.prev = (np.full(n + 1, -1, np.int64) for _ in range(4))
        start = np.cumsum(sizes) - sizes
        self.size[start], self.of[order], self.at[order] = sizes, np.repeat(start, sizes), np.arange(len(order))
        self.alive = len(order)
        self._link(order, self.of[order])
        # nothing has been refined by any class yet, so all are handed on
        self.moved, self.dropped = order.copy(), np.flatnonzero(self.of < 0)

    def _keep(self, place: np.ndarray, gap: np.ndarray) -> None:
        """Links by distance, but for those that no later length asks for."""
        use = (gap >= self.length) & (gap <= self.longest)
        place, gap = place[use], gap[use]
        if len(place) < 8:
            for p, g in zip(place.tolist(), gap.tolist(), strict=True):
                self.by_gap.setdefault(g, []).append(np.array([p]))
            return
        order = np.argsort(gap, kind="stable")
        place, gap = place[order], gap[order]
        cut = _heads(gap)
        for g, part in zip(gap[cut].tolist(), np.split(place, cut[1:]), strict=True):
            self.by_gap.setdefault(g, []).append(part)

    def _link(self, order: np.ndarray, group: np.ndarray) -> None:
        """Links positions that stand sorted by group and place."""
        same = group[1:] == group[:-1]
        self.prev[order], self.next[order] = -1, -1
        a, b = order[:-1][same], order[1:][same]
        self.next[a], self.prev[b] = b, a
        self._keep(a, b - a)

    def _unlink(self, gone: np.ndarray, group: np.ndarray) -> None:
        """Takes positions, sorted by class and place, out of the links of their classes."""
        joined = (self.next[gone[:-1]] == gone[1:]) & (group[:-1] == group[1:])
        left, right = self.prev[gone[np.append(True, ~joined)]], self.next[gone[np.append(~joined, True)]]
        self.next[left[left >= 0]], self.prev[right[right >= 0]] = right[left >= 0], left[right >= 0]
        both = (left >= 0) & (right >= 0)
        self._keep(left[both], right[both] - left[both])

    def _all(self, classes: np.ndarray) -> np.ndarray:
        return self.members[_ranges(classes, self.size[classes])]

    def squares(self) -> np.ndarray:
        """In order, the positions whose next class member is as far away as the length: there the square of a primitive word begins."""
        found = self.by_gap.pop(self.length, None)
        if not found:
            return NONE
        place = np.unique(np.concatenate(found))
        return place[(self.of[place] >= 0) & (self.next[place] - place == self.length)]

    def refine(self) -> None:
        """Goes on to the classes of factors that are one longer."""
        self.length += 1
        after = np.concatenate([self.moved, self.dropped])
        after = after[after > 0]
        after = after[self.of[after - 1] >= 0]
        self.moved = self.dropped = NONE
        if not len(after):
            return
        gone, old, key = after - 1, self.of[after - 1], self.of[after]
        order = np.lexsort((gone, old))
        self._unlink(gone[order], old[order])

        # what moves goes behind what stays of its class: by the class after it, dropped ones last
        key = np.where(key < 0, len(self.members), key)
        order = np.lexsort((gone, key, old))
        gone, old, key = gone[order], old[order], key[order]
        cut = _heads(old)
        touched, n = old[cut], np.diff(np.append(cut, len(old)))
        self.size[touched] -= n
        place = _ranges(touched + self.size[touched], n)
        stay = np.ones(len(place), bool)
        own = self.at[gone]
        behind = own >= np.repeat(touched + self.size[touched], n)
        stay[np.searchsorted(place, own[behind])] = False
        staying, free = self.members[place[stay]], np.sort(own[~behind])
        self.members[free], self.at[staying] = staying, free
        self.members[place], self.at[gone] = gone, place

        # the parts; those that are too small, or before a dropped position, are dropped
        cut = _heads(old, key)
        sizes = np.diff(np.append(cut, len(old)))
        large = (sizes >= self.least) & (key[cut] < len(self.members))
        kept = np.repeat(large, sizes)
        parts, parents = place[cut][large], old[cut][large]
        left, few = touched[self.size[touched] >= self.least], touched[(self.size[touched] > 0) & (self.size[touched] < self.least)]
        self.dropped = np.concatenate([gone[~kept], self._all(few)])
        self.size[few] = 0  # where nothing stays, the first part takes the class' name
        self.size[parts] = sizes[large]
        self.of[gone[kept]] = np.repeat(parts, sizes[large])
        self._link(gone[kept], self.of[gone[kept]])
        self.of[self.dropped] = -1
        self.alive -= len(self.dropped)

        # smaller halves: all parts of a class but the largest are handed on
        part, parent = np.concatenate([parts, left]), np.concatenate([parents, left])
        order = np.lexsort((-self.size[part], parent))
        smaller = np.ones(len(part), bool)
        smaller[_heads(parent[order])] = False
        self.moved = self._all(part[order][smaller])


def runs_of(codes: np.ndarray, longest: int, exponent: int = EXPONENT, shortest: int = SHORTEST) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(starts, lengths, period) of the runs, period by period, over texts that stand one after another with -1 between them.

    Squares of one period that begin at neighbouring places are one run.
    """
    state = Refinement(codes, longest, exponent)
    while state.alive and state.length <= longest:
        q, place = state.length, state.squares()
        if len(place):
            cut = np.flatnonzero(np.diff(place, prepend=-2) != 1)
            length = np.diff(np.append(cut, len(place))) - 1 + 2 * q
            good = length >= max(shortest, exponent * q)
            if good.any():
                yield place[cut][good], length[good], q
        state.refine()


def _groups(told: list[list[bytes]], most: int) -> Iterator[range]:
    first = n = 0
    for i, w in enumerate(told):
        if n and n + len(w) > most:
            yield range(first, i)
            first, n = i, 0
        n += len(w) + 1
    if told:
        yield range(first, len(told))


def find(told: list[list[bytes]], exponent: int = EXPONENT, shortest: int = SHORTEST) -> list[list[tuple[int, int, int]]]:
    """For each list of words its runs as (start, length, period), by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in told]
    for group in _groups(told, TOGETHER):
        number, offsets = count(), np.cumsum([0, *(len(told[i]) + 1 for i in group)])
        codes = np.full(int(offsets[-1]), -1, np.int64)
        for i, at in zip(group, offsets.tolist(), strict=False):
            codes[at : at + len(told[i])] = list(map(defaultdict(number.__next__).__getitem__, told[i]))
        longest = max(len(told[i]) for i in group) // exponent
        for starts, lengths, q in runs_of(codes, longest, exponent, shortest):
            own = np.searchsorted(offsets, starts, "right") - 1
            for doc, start, length in zip(own.tolist(), (starts - offsets[own]).tolist(), lengths.tolist(), strict=True):
                out[group[doc]].append((start, length, q))
    for runs in out:
        runs.sort(key=lambda r: (r[0], r[2]))
    return out


def collapse(told: list[bytes], runs: list[tuple[int, int, int]]) -> str:
    """The words, joined by blanks, without those that a run repeats after its first period."""
    if runs:
        gone = np.zeros(len(told) + 1, np.int64)
        for start, length, q in runs:
            gone[start + q] += 1
            gone[start + length] -= 1
        told = [told[i] for i in np.flatnonzero(np.cumsum(gone[:-1]) == 0).tolist()]
    return b" ".join(told).decode()


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", exponent: int = EXPONENT, shortest: int = SHORTEST) -> DataFrame:
    """One row per row of ``docs``: the id, n_words, runs (start, length, period; in words from 0) and the text without repeated periods.

    A run is maximal and has its smallest period. Null and empty texts have no words, no runs and collapse to the empty text; of
    a text without runs only the white space changes. Texts of any length are refined whole, by themselves from TOGETHER words
    on. Repeated rows give equal rows, an empty table none; other columns aren't read, so their names can't clash.
    """

    def make():
        def work(texts):
            told = [(t or "").encode().split() for t in texts]
            found = find(told, exponent, shortest)
            runs = [[{"start": s, "length": n, "period": q} for s, n, q in x] for x in found]
            return {"n_words": list(map(len, told)), "runs": runs, "collapsed": list(map(collapse, told, found))}

        return work

    return map_texts(docs, [id_col], text_col, make, f"n_words long, runs {RUNS}, collapsed string", ROWS)


def planted(text: Column, id_: Column) -> Column:
    """For ids whose crc32 is divisible by 10 the text's words with a repeated stretch from a place that the crc32 tells; else the text.

    A null id counts as the empty text, whose crc32 is 0. Texts without a word stay as they are.
    """
    h = F.crc32(F.coalesce(id_.cast("string"), F.lit("")).cast("binary"))
    g = F.floor(h / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w)
        a = F.pmod(g, n)
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + F.pmod(g, F.lit(8))))
        told = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(w, F.when(i < a, i).otherwise(a + F.pmod(i - a, p)).cast("int")))
        return F.when(n > 0, F.array_join(told, " ")).otherwise(whole(text))

    return F.when(F.pmod(h, F.lit(10)) == 0, let(words(whole(text)), repeated)).otherwise(whole(text))


def longest_run(runs: Column) -> Column:
    """The run of greatest length, then smallest start, then smallest period; null without runs."""
    return F.array_max(F.transform(runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))


def told_runs(runs: Column) -> Column:
    """``start,length,period`` and a line end for each run, in order."""
    return F.array_join(F.transform(runs, lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
