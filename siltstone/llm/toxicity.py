"""Toxicity by weak supervision: many voters, a generative model of their errors, and a linear classifier of its posterior labels."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SLICE, Scratch, bucket_of, map_texts
from .language import words_of

#: Bounds of what is fitted: labelled documents, and units (words and word beginnings) that voters and the classifier know.
SAMPLE, UNITS = 12_000, 1024
#: Lengths of word beginnings, labelled documents that hold a unit at least, and lists that units of a kind and a tier are dealt to.
BEGINNINGS, SUPPORT, LISTS = (3, 4, 5, 6, 7, 8), 2, 4
#: Share of a text's words from which it holds a unit, not by chance; share of words in lists that is more than chance; shares at
#: which one unit, and all of a group, count in full.
FREQUENT, DENSE, ONE_FULL, ALL_FULL = 0.002, 0.01, 0.01, 0.02
#: Share of toxic documents among those with a unit, at least so, from which a unit is of the first and of the second tier, and by
#: how many deviations it is held to be so (the lower end of Wilson's interval): what only a few documents hold is of no tier.
TIERS, DEVIATIONS = (0.6, 0.3), 3.0
#: Rounds of the label model, weight of its smoothing, and bits that two voters share given the label from which they are linked.
ROUNDS, SMOOTHING, LINKED = 25, 0.5, 0.005
#: Weight of the classifier's squared weights, and the score from which a document counts as toxic.
RIDGE, THRESHOLD = 0.1, 0.7
#: What an annotator is taken to get right before anything is known.
TRUSTED = 0.95

#: Words of the stated lexicons; each is one voter.
LEXICONS = {
    "mind": "idiot moron imbecile stupid dumb fool dimwit halfwit brainless cretin dunce simpleton",
    "worth": "loser worthless pathetic useless failure nobody pitiful hopeless parasite leech",
    "disgust": "scum trash garbage filth disgusting vermin vile repulsive sickening revolting",
    "ridicule": "clown joke ridiculous laughable buffoon jerk creep freak weirdo coward",
}
STATED = {name: frozenset(words.split()) for name, words in LEXICONS.items()}
INSULTS = "|".join(sorted(set().union(*STATED.values())))
#: Signs in a text; each is one voter.
PATTERNS = {
    "addressed": re.compile(rf"\b(?:you|your|he|she|they)\b(?:\W+\w+){{0,3}}\W+(?:{INSULTS})\b", re.I),
    "doubled": re.compile(rf"\b({INSULTS})\b.{{0,80}}\b\1\b", re.I | re.S),
    "masked": re.compile(r"\b[a-z]+[*@$#][a-z*@$#]*[a-z]\b", re.I),
    "shouted": re.compile(r"\b[A-Z]{3,}(?:\W+[A-Z]{3,}){2,}"),
    "exclaimed": re.compile(r"!!"),
    "stretched": re.compile(r"([a-z])\1\1\1", re.I),
}


def units_of(words: list[str]) -> dict[str, int]:
    """Of a text's words, and of the beginnings of longer ones (marked with a star), how many there are."""
    out: Counter = Counter()
    for w, n in Counter(words).items():
        out[w] += n
        for k in BEGINNINGS:
            if len(w) <= k:
                break
            out[f"{w[:k]}*"] += n
    return out


def held(words: list[str]) -> list[str]:
    """The units that a text holds, not by chance."""
    return [u for u, n in units_of(words).items() if n >= FREQUENT * len(words)]


def counted_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches (label, text) of the bounded sample rows (unit, documents that hold it, toxic ones)."""
    every, toxic = Counter(), Counter()
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            part = whole.slice(at, SLICE)
            for label, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                own = held(words_of(text))
                every.update(own)
                if label:
                    toxic.update(own)
    columns = (pa.array(list(every), pa.string()), pa.array(list(every.values()), pa.int64()), pa.array([toxic[u] for u in every], pa.int64()))
    yield pa.RecordBatch.from_arrays(list(columns), names=["unit", "n", "toxic"])


def at_least(toxic: int, n: int) -> float:
    """The lower end of Wilson's interval of a share."""
    z = DEVIATIONS**2
    return (toxic + z / 2 - DEVIATIONS * (toxic * (n - toxic) / n + z / 4) ** 0.5) / (n + z)


@dataclass
class Lists:
    """What voters and the classifier know: of each unit its features, which are itself, its groups, and the list that it votes in."""

    features: dict[str, tuple[int, ...]]
    least: np.ndarray  # of each feature of the classifier the share up to which it doesn't count
    full: np.ndarray  # and the one from which it counts in full
    lists: int  # features behind those, a voter each; the last is of all units that are in a list

    def counted(self, words: list[str]) -> dict[int, int]:
        """Of each feature how many words have it."""
        get, out = self.features.get, {}
        for w, n in Counter(words).items():
            found = get(w, ())
            for k in BEGINNINGS:
                if len(w) <= k:
                    break
                found += get(f"{w[:k]}*", ())
            for i in set(found):
                out[i] = out.get(i, 0) + n
        return out

    def values(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The classifier's features of a text and their values from 0 to 1, by their share of its words."""
        found = sorted((i, n) for i, n in self.counted(words).items() if i < len(self.full))
        at, n = np.array([i for i, _ in found], np.int64), np.array([n for _, n in found], np.float64)
        value = np.clip((n / max(len(words), 1) - self.least[at]) / (self.full[at] - self.least[at]), 0, 1)
        return at, value

    def votes(self, text: str) -> np.ndarray:
        """Of each voter 1 (toxic), -1 (clean) or 0 (no vote)."""
        words = words_of(text)
        counts = self.counted(words)
        shares = [counts.get(len(self.full) + k, 0) / max(len(words), 1) for k in range(self.lists)]
        # a single word may stand there by chance: a list votes where the text holds enough of all lists
        out = [int(s > 0 and shares[-1] >= DENSE) for s in shares]
        out += [1 if shares[-1] >= 2 * DENSE else -1 if shares[-1] < DENSE / 2 else 0, 0 if shares[-1] > 0 else -1]
        return np.array(out + [int(bool(p.search(text))) for p in PATTERNS.values()], np.int8)


def independent(units: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Of units that begin one another the one that is toxic most surely, then the longest: the others would vote on the same words again."""
    kept: dict[str, tuple[str, int, int]] = {}
    begun: set[str] = set()
    for unit, n, toxic in sorted(units, key=lambda x: (-at_least(x[2], x[1]), -len(x[0]) - (not x[0].endswith("*")), x[0])):
        bare = unit.rstrip("*")
        if unit in kept or bare in begun and unit.endswith("*") or any(f"{bare[:k]}*" in kept for k in BEGINNINGS if k <= len(bare)):
            continue
        kept[unit] = (unit, n, toxic)
        begun.update(bare[:k] for k in BEGINNINGS if k <= len(bare))
    return list(kept.values())


def lists_of(units: list[tuple[str, int, int]]) -> Lists:
    """From units with their documents and toxic ones: words' and beginnings' units of each tier are dealt to LISTS voters each."""
    units = independent(units)
    tiers = len(units)
    stated = tiers + 2 * len(TIERS)
    some, dense = stated + len(STATED), stated + len(STATED) + 1
    voters, size = 2 * len(TIERS) * LISTS, dense + 1
    features: dict[str, set[int]] = {}
    for i, (unit, n, toxic) in enumerate(units):
        share, kind = at_least(toxic, n), int(unit.endswith("*"))
        features[unit] = {i}
        for tier, least in enumerate(TIERS):
            if share >= least:
                at = kind * len(TIERS) + tier
                features[unit] |= {tiers + at, some, dense, size + at * LISTS + crc32(unit.encode()) % LISTS, size + voters + len(STATED)}
                break
    for k, words in enumerate(STATED.values()):
        for w in words:
            features.setdefault(w, set()).update({stated + k, some, dense, size + voters + k, size + voters + len(STATED)})
    least = np.array([0.0] * dense + [DENSE])
    full = np.array([ONE_FULL] * tiers + [ALL_FULL] * (some - tiers) + [DENSE, ALL_FULL])
    return Lists({u: tuple(sorted(x)) for u, x in features.items()}, least, full, voters + len(STATED) + 1)


@dataclass
class LabelModel:
    """P(label), and of each voter P(vote | label, vote of the voter that it hangs on)."""

    prior: float
    parent: list[int]  # -1: it hangs on the label alone
    tables: list[np.ndarray]  # label x parent's vote x vote, or label x vote
    accuracy: list[float]  # of each voter's votes, abstentions left out

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of rows of votes (-1, 0, 1)."""
        v = votes.astype(np.int64) + 1
        log = np.tile(np.log([1 - self.prior, self.prior]), (len(v), 1))
        for j, (parent, t) in enumerate(zip(self.parent, self.tables, strict=True)):
            log += np.log(t[:, v[:, j]] if parent < 0 else t[:, v[:, parent], v[:, j]]).T
        return 1 / (1 + np.exp(np.clip(log[:, 0] - log[:, 1], -500, 500)))


def soft_counts(votes: np.ndarray, q: np.ndarray) -> np.ndarray:
    """label x voter x vote x voter x vote: how many rows, each shared out by its posterior."""
    n, k = votes.shape
    hot = np.zeros((n, k, 3), np.float32)
    np.put_along_axis(hot, (votes.astype(np.int64) + 1)[:, :, None], 1, axis=2)
    flat = hot.reshape(n, 3 * k)
    return np.stack([(flat * w[:, None].astype(np.float32)).T @ flat for w in (1 - q, q)]).astype(np.float64).reshape(2, k, 3, k, 3)


def shared_bits(counts: np.ndarray) -> np.ndarray:
    """Voters' mutual information given the label, in bits."""
    joint = counts.transpose(0, 1, 3, 2, 4) + 1e-9  # label, voter, voter, vote, vote
    n = joint.sum((3, 4), keepdims=True)
    p = joint / n
    each = p * np.log2(p / (p.sum(4, keepdims=True) * p.sum(3, keepdims=True)))
    weight = n[..., 0, 0] / n[..., 0, 0].sum(0, keepdims=True)
    return np.maximum((each.sum((3, 4)) * weight).sum(0), 0)


def forest(bits: np.ndarray) -> list[int]:
    """Each voter's parent in the spanning forest that shares most bits; links below LINKED are left out."""
    k = len(bits)
    parent, best = [-1] * k, np.zeros(k)
    free, nearest = set(range(k)), [-1] * k
    while free:
        j = max(sorted(free), key=lambda x: best[x])
        free.discard(j)
        parent[j] = nearest[j] if best[j] >= LINKED else -1
        for x in free:
            if bits[j, x] > best[x]:
                best[x], nearest[x] = bits[j, x], j
    return parent


def fit_labels(votes: np.ndarray, annotated: np.ndarray) -> LabelModel:
    """Expectation maximisation. The annotator's labels are one more voter, whose accuracy is estimated like the others'.

    Voters that share more than LINKED bits given the label are linked in a forest, so that votes which come together count once.
    """
    votes = np.c_[votes, np.where(annotated > 0, 1, -1)].astype(np.int8)
    q = np.where(annotated > 0, TRUSTED, 1 - TRUSTED)
    model = LabelModel(0.5, [], [], [])
    for at in range(ROUNDS):
        counts = soft_counts(votes, q)
        if at % 5 == 0:  # the structure follows the labels, but not at each step
            parent = forest(shared_bits(counts)) if at else [-1] * votes.shape[1]
        tables, right = [], []
        for j, up in enumerate(parent):
            own = np.einsum("ckk->ck", counts[:, j, :, j, :]) + SMOOTHING
            alone = own / own.sum(1, keepdims=True)
            right.append(float((own[0, 0] + own[1, 2]) / (own[:, 0] + own[:, 2]).sum()))
            if up < 0:
                tables.append(alone)
                continue
            t = counts[:, up, :, j, :] + SMOOTHING * 3 * alone[:, None]  # an unseen vote of the parent leaves the voter's own shares
            tables.append(t / t.sum(2, keepdims=True))
        model = LabelModel(float((q.sum() + SMOOTHING) / (len(q) + 2 * SMOOTHING)), parent, tables, right)
        q = model.posterior(votes)
    return model


def fit_weights(x: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on posterior labels, by damped Newton steps; RIDGE holds the weights small."""
    x1 = np.c_[x, np.ones(len(x), np.float32)].astype(np.float32)
    w = np.zeros(x1.shape[1])
    ridge = np.full(len(w), RIDGE)
    ridge[-1] = 1e-3

    def loss(w):
        z = x1 @ w
        return float((np.logaddexp(0, z) - q * z).sum() + 0.5 * (ridge * w * w).sum())

    now = loss(w)
    for _ in range(30):
        p = 1 / (1 + np.exp(-(x1 @ w)))
        slope = x1.T @ (p - q) + ridge * w
        bend = (x1 * (p * (1 - p))[:, None].astype(np.float32)).T @ x1 + np.diag(ridge)
        step, t = np.linalg.solve(bend, slope), 1.0
        while (then := loss(w - t * step)) > now and t > 1e-4:
            t /= 2
        w, gained, now = w - t * step, now - then, then
        if gained < 1e-6 * abs(now):
            break
    return w[:-1], float(w[-1])


@dataclass
class Model:
    lists: Lists
    labels: LabelModel
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        at, value = self.lists.values(words_of(text or ""))
        z = float(self.weights[at] @ value) + self.bias
        return float(1 / (1 + np.exp(-min(max(z, -500.0), 500.0))))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Model | None:
    """From at most ``sample`` labelled rows whose crc32(id) mod 3 isn't 1, the first by a hash of their id.

    Units that tell toxic documents of the sample from others become lists of voters; stated lexicons and patterns vote beside
    them. An id with several labels or texts counts once, with its least label and text. Null ids, labels and texts are left out;
    None if no row is left.
    """
    marked = labels.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{label_col}`").cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isNotNull() & (bucket_of(F.col("i"), 3) != 1))
    some = marked.groupBy("i").agg(F.min("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(sample)
    texts = docs.select(F.col(f"`{id_col}`").alias("i"), F.col(f"`{text_col}`").cast("string").alias("t")).where(F.col("t").isNotNull())
    with Scratch(docs.sparkSession) as keep:
        chosen = keep(texts.join(F.broadcast(some), "i").groupBy("i").agg(F.min("y").alias("y"), F.min("t").alias("t")))
        sums = chosen.agg(F.count("*").alias("n"), F.sum((F.col("y") > 0).cast("long")).alias("toxic")).first()
        if not sums["n"]:
            return None
        toxic, clean = sums["toxic"], sums["n"] - sums["toxic"]
        units = chosen.select((F.col("y") > 0).alias("y"), "t").mapInArrow(counted_units, "unit string, n long, toxic long").groupBy("unit").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
        lift = F.log((F.col("toxic") + 0.5) / (toxic + 1.0)) - F.log((F.col("n") - F.col("toxic") + 0.5) / (clean + 1.0))
        weight = F.round(F.abs(lift) * F.sqrt("n"), 6)  # log odds by their error, about
        found = [tuple(r) for r in units.where(F.col("n") >= SUPPORT).orderBy(weight.desc(), "unit").limit(UNITS).collect()]
        lists = lists_of(found)

        def make():
            def work(texts):
                told = [lists.values(words_of(t)) for t in texts]
                return {"votes": [lists.votes(t).tobytes() for t in texts], "at": [a.tobytes() for a, _ in told], "value": [v.tobytes() for _, v in told]}

            return work

        rows = map_texts(chosen, ["i", "y"], "t", make, "votes binary, at binary, value binary").collect()
    rows.sort(key=lambda r: r["i"])
    votes = np.stack([np.frombuffer(r["votes"], np.int8) for r in rows])
    annotated = np.array([int(r["y"] > 0) for r in rows])
    x = np.zeros((len(rows), len(lists.full)), np.float32)
    for row, r in zip(x, rows, strict=True):
        row[np.frombuffer(r["at"], np.int64)] = np.frombuffer(r["value"], np.float64)
    model = fit_labels(votes, annotated)
    q = model.posterior(np.c_[votes, np.where(annotated > 0, 1, -1)])
    return Model(lists, model, *fit_weights(x, q))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """One row per row of ``docs`` with the columns ``keep`` (the id alone) and ``score`` (or the name ``into``), from whole texts.

    Null texts count as empty; without a model every score is 0. Equal texts get equal scores; an empty table gives no rows. The
    name ``into`` mustn't be among ``keep``; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(texts):
            return {into: [own.score(t) if own else 0.0 for t in texts]}

        return work

    return map_texts(docs, keep or [id_col], text_col, make, f"`{into}` double")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """Learns from labelled rows whose crc32(id) mod 3 isn't 1 and scores every row; ``held_out`` marks the others.

    Null and empty texts are scored as empty ones; a null id counts as the empty text and isn't held out. Repeated rows get equal
    scores; an empty table gives no rows; without labels every score is 0. ``predicted`` is 1 from THRESHOLD on, at it too.
    """
    out = score(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return out.select(id_col, (bucket_of(F.col(f"`{id_col}`"), 3) == 1).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
