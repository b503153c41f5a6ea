"""Quality classifier: similar labelled documents vote, in a latent space of words and character-shape trigrams."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucket_of, map_texts
from .language import words_of

#: Bounds of what is fitted: labelled documents, terms of a kind (shapes, words), latent dimensions. The terms are those that most
#: exemplars hold; rarer ones weigh nothing.
EXEMPLARS, TERMS, DIMENSIONS = 5000, 1024, 48
#: Slots that words are hashed into, and what the words' part of a vector weighs against the shapes'.
SLOTS, WORDS_WEIGH = 2**17, 0.5
#: Neighbours that vote, and the power of their similarity that weighs a vote.
NEIGHBOURS, SHARPNESS = 25, 8
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    """Of each code point its shape: 0 other, 1 letter, 2 upper-case letter, 3 digit, 4 blank, 5 line end, then each ASCII sign.

    All code points from the last one of the table on count as letters.
    """
    out = np.zeros(0x2000, np.int32)
    signs = 6
    for i in range(len(out)):
        c = chr(i)
        if c.isupper():
            out[i] = 2
        elif c.isalpha() or i == len(out) - 1:
            out[i] = 1
        elif c.isdigit():
            out[i] = 3
        elif c in "\n\r\v\f":
            out[i] = 5
        elif c.isspace():
            out[i] = 4
        elif i < 128 and c.isprintable():
            out[i] = signs
            signs += 1
    return out


CLASSES = _classes()
BASE = int(CLASSES.max()) + 1
VOLUME = BASE**3


def terms_of(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the terms of a whole text, in the codes' order: trigrams of its shape, then hashed words."""
    code, count = shapes(text)
    slots: Counter = Counter()
    for word, n in Counter(words_of(text or "")).items():
        slots[VOLUME + zlib.crc32(word.encode()) % SLOTS] += n
    order = sorted(slots)
    return np.r_[code, np.array(order, np.int64)], np.r_[count, np.array([slots[x] for x in order], np.int64)]


def shapes(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Codes and counts of the trigrams of a text's shape; runs of letters, digits and blanks count as one place, signs each."""
    c = CLASSES[np.minimum(np.frombuffer((text or "").encode("utf-32-le"), "<u4"), len(CLASSES) - 1)]
    if len(c):
        c = c[np.r_[True, (c[1:] != c[:-1]) | (c[1:] > 5)]]
        c = np.r_[5, c, 5]
    if len(c) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    code = (c[:-2] * BASE + c[1:-1]) * BASE + c[2:]
    count = np.bincount(code, minlength=VOLUME)
    at = np.flatnonzero(count)
    return at, count[at]


@dataclass
class Model:
    column: np.ndarray  # of each code: its term, or -1; shapes before words
    idf: np.ndarray
    axes: np.ndarray  # terms x dimensions
    vectors: np.ndarray  # dimensions x exemplars, of length one
    labels: np.ndarray
    prior: float


def weigh(rows: list[tuple[np.ndarray, np.ndarray]], column: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows with log counts times inverse document frequency; the part of shapes has length one (or zero), that of words WORDS_WEIGH."""
    out = np.zeros((len(rows), len(idf)), np.float32)
    for row, (code, count) in zip(out, rows, strict=True):
        term = column[code]
        known = term >= 0
        row[term[known]] = (1 + np.log(count[known])) * idf[term[known]]
    first = int((column[:VOLUME] >= 0).sum())
    for part, length in ((out[:, :first], 1.0), (out[:, first:], WORDS_WEIGH)):
        norm = np.sqrt((part * part).sum(1, keepdims=True))
        part *= np.float32(length) / np.where(norm > 0, norm, 1)
    return out


def project(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    out = weigh(rows, model.column, model.idf) @ model.axes
    norm = np.sqrt((out * out).sum(1, keepdims=True))
    return out / np.where(norm > 1e-6, norm, np.inf)


def told(chosen: pa.Table) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Codes and counts of each row, and the labels, in the order of the ids: views into Arrow's columns, since a Python object for each number takes ten times that."""
    chosen = chosen.combine_chunks().sort_by("i")
    columns = []
    for name in ("code", "count"):
        column = chosen.column(name).combine_chunks()
        columns.append(np.split(column.flatten().to_numpy(), column.offsets.to_numpy()[1:-1] - column.offsets[0].as_py()))
    return list(zip(*columns, strict=True)), chosen.column("y").to_numpy()


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", exemplars: int = EXEMPLARS) -> Model | None:
    """From at most ``exemplars`` labelled rows whose crc32(id) mod 5 isn't 0, the first by a hash of their id.

    An id that has several labels or texts counts once, with its least label and text. Null labels and texts are left out; None
    if there is no labelled row.
    """
    marked = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isNotNull() & (bucket_of(F.col("i"), 5) != 0))
    some = marked.groupBy("i").agg(F.min("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(exemplars)
    texts = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).where(F.col("t").isNotNull())
    chosen = texts.join(F.broadcast(some), "i").groupBy("i").agg(F.min("y").alias("y"), F.min("t").alias("t"))

    def make():
        def work(found):
            rows = [terms_of(t) for t in found]
            return {"code": [a.astype(np.int32) for a, _ in rows], "count": [b.astype(np.int32) for _, b in rows]}

        return work

    got = map_texts(chosen, ["i", "y"], "t", make, "code array<int>, count array<int>").toArrow()
    if not got.num_rows:
        return None
    rows, marks = told(got)
    df = np.zeros(VOLUME + SLOTS)
    for code, _ in rows:
        df[code] += 1
    kinds = (slice(0, VOLUME), slice(VOLUME, None))
    best = [k.start + np.argsort(-df[k], kind="stable")[: min(TERMS, int((df[k] > 0).sum()))] for k in kinds]
    terms = np.sort(np.concatenate(best))
    column = np.full(VOLUME + SLOTS, -1, np.int64)
    column[terms] = np.arange(len(terms))
    idf = (np.log((1 + len(rows)) / (1 + df[terms])) + 1).astype(np.float32)
    x = weigh(rows, column, idf)
    products = x.T @ x
    del x  # the largest table on the driver; it is made again when there are axes to project it on
    axes = np.ascontiguousarray(np.linalg.eigh(products)[1][:, ::-1][:, :DIMENSIONS], np.float32)
    del products
    y = marks.clip(0, 1).astype(np.float32)
    model = Model(column, idf, axes, np.zeros((0, 0)), y, float(y.mean()))
    model.vectors = np.ascontiguousarray(project(model, rows).T)
    return model


def vote(model: Model, rows: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Exact cosine products with every exemplar in one block; the nearest vote by a power of their similarity.

    Neighbours that tie with the last one count too, so a score doesn't hang on their order. No similar one: the labels' mean.
    """
    near = np.round(project(model, rows) @ model.vectors, 5)
    k = min(NEIGHBOURS, near.shape[1])
    least = np.partition(near, near.shape[1] - k, axis=1)[:, near.shape[1] - k, None]
    weight = np.where((near >= least) & (near > 0), near, 0).astype(np.float64) ** SHARPNESS
    total = weight.sum(1)
    return np.where(total > 0, weight @ model.labels / np.where(total > 0, total, 1), model.prior)


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, into: str = "score") -> DataFrame:
    """One row per row of ``docs`` with the columns ``keep`` (the id alone) and ``score`` (or the name ``into``), from whole texts.

    Null texts count as empty; without a model every score is 0.5. Equal texts get equal scores, an empty table gives no rows. The
    name ``into`` mustn't be among ``keep``; other columns aren't read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def work(texts):
            rows = [terms_of(t) for t in texts]
            return {into: vote(own, rows).clip(0, 1) if own else np.full(len(rows), 0.5)}

        return work

    return map_texts(docs, keep or [id_col], text_col, make, f"`{into}` double")


def score_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> DataFrame:
    """Learns from labelled rows whose crc32(id) mod 5 isn't 0 and scores every row; ``held_out`` marks the others.

    Null and empty texts are scored as empty ones; null ids and labels aren't learned from. Repeated rows get equal scores; an
    empty table gives no rows; without labels every score is 0.5. ``predicted`` is 1 from THRESHOLD on, at it too.
    """
    out = score(docs, fit(docs, labels, id_col, text_col, label_col), id_col, text_col)
    return out.select(id_col, (bucket_of(F.col(id_col), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
