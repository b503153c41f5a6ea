"""Language identification: known words score by their log frequency, unseen ones by ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE, bucket_of, cut, map_texts

#: Training rows of a language (whole texts, about). Every language of the labelled rows is learned.
ROWS = 3000
#: Words, and n-grams of each length, that the languages share out evenly; each language keeps its most frequent ones.
WORDS, GRAMS, LONGEST = 60_000, 20_000, 4
#: Places that a language has at least, however many languages there are.
PLACES = 200
#: With more languages than this, tables of a row for each are joined by shuffles.
FEW = 20_000
#: Bytes of word scores, and words, that a worker keeps.
KEPT_BYTES, KEPT = 24_000_000, 200_000

LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    return LETTERS.findall(text.lower())


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


@dataclass
class Table:
    """Log frequencies of one kind: languages' floors, and what a gram has beyond them, by the languages that hold it."""

    floor: np.ndarray
    place: dict[str, int]
    start: np.ndarray
    lang: np.ndarray
    above: np.ndarray

    def rows(self, at: np.ndarray) -> np.ndarray:
        """The log frequencies of some grams, a row each."""
        n = self.start[at + 1] - self.start[at]
        out = np.repeat(self.floor[None], len(at), 0)
        row = np.repeat(np.arange(len(at)), n)
        entry = np.arange(len(row)) + np.repeat(self.start[at] - np.cumsum(n) + n, n)
        out[row, self.lang[entry]] += self.above[entry]
        return out


def table_of(found: pa.Table, langs: list[str]) -> Table:
    """From counts (g, l, n) by gram and language, in that order: logs of the count (a half more) over all that the language has in the table.

    Counts stay in Arrow's columns, since a Python object for each takes ten times that; only the grams become Python's.
    """
    grams = found.column("g").combine_chunks().dictionary_encode()
    start = np.searchsorted(grams.indices.to_numpy(), np.arange(len(grams.dictionary) + 1))
    lang = pc.index_in(found.column("l"), pa.array(langs, pa.string())).to_numpy()
    counts = found.column("n").to_numpy().astype(np.float64)
    total = 0.5 * len(grams.dictionary) + np.bincount(lang, counts, len(langs))
    floor = np.log(0.5 / np.maximum(total, 0.5))
    return Table(floor, {g: i for i, g in enumerate(grams.dictionary.to_pylist())}, start, lang, np.log((counts + 0.5) / 0.5))


@dataclass
class Model:
    langs: list[str]
    tables: list[Table] = field(default_factory=list)  # [0] of words, [n] of n-grams

    def known(self, word: str) -> tuple[int, list[int]]:
        """What scores a word: itself (kind 0), else its n-grams of the greatest length that has a known one; else none."""
        at = self.tables[0].place.get(word)
        if at is not None:
            return 0, [at]
        for n in range(LONGEST, 0, -1):
            get = self.tables[n].place.get
            found = [i for g in grams(word, n) if (i := get(g)) is not None]
            if found:
                return n, found
        return 0, []

    def scores(self, words: list[str]) -> np.ndarray:
        """A row for each word: the mean log frequencies of what scores it, zeros if nothing does."""
        out = np.zeros((len(words), len(self.langs)), np.float32)
        found = [self.known(w) for w in words]
        for k, table in enumerate(self.tables):
            rows = [i for i, (kind, at) in enumerate(found) if kind == k and at]
            for i in range(0, len(rows), 4096):
                part = rows[i : i + 4096]
                sizes = np.array([len(found[r][1]) for r in part])
                logs = table.rows(np.array([x for r in part for x in found[r][1]]))
                out[part] = np.add.reduceat(logs, np.cumsum(sizes) - sizes, axis=0) / sizes[:, None]
        return out


def counted_words(batches):
    """Of batches (language, text) rows (language, word, count), summed over as many texts as memory is meant to hold."""

    def told(seen: dict[str, Counter]) -> pa.RecordBatch:
        columns = ([x for x, c in seen.items() for _ in c], [w for c in seen.values() for w in c], [n for c in seen.values() for n in c.values()])
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["l", "g", "n"])

    seen: dict[str, Counter] = {}
    for whole in batches:
        for at in range(0, whole.num_rows, SLICE):
            part = whole.slice(at, SLICE)
            for lang, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                seen.setdefault(lang, Counter()).update(words_of(text))
            if sum(map(len, seen.values())) > KEPT:
                yield told(seen)
                seen = {}
    yield told(seen)


def grams_of(words: DataFrame) -> DataFrame:
    """(k, g, l, n) of the n-grams of counted words (l, g, n): ``grams`` as column functions, since each word is told once."""

    def parts(n: int) -> Column:
        marked = F.concat(F.lit("<"), "g", F.lit(">")) if n > 1 else F.col("g")
        each = F.transform(F.sequence(F.lit(1), F.length(marked) - (n - 1)), lambda i: F.struct(F.lit(n).alias("k"), F.substring(marked, i, F.lit(n)).alias("g")))
        return F.when(F.length(marked) >= n, each).otherwise(F.array().cast("array<struct<k:int,g:string>>"))

    every = words.select("l", "n", F.explode(F.concat(*[parts(n) for n in range(1, LONGEST + 1)])).alias("x"))
    return every.groupBy("x.k", "x.g", "l").agg(F.sum("n").alias("n"))


def limit_of(rows: int, n: int) -> int:
    """Of ``n`` texts at places spread over 2^62 about ``rows`` stand below this."""
    return 2**62 if n <= rows else max(1, 2**62 * rows // n)


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = ROWS) -> Model:
    """Counts words and n-grams of at most about ``rows`` whole texts of each language, chosen by a hash of their id.

    Every language of a labelled text is learned, however many texts it has: a text stands at a place below 2^62 by the hash of its id
    and number, and those below a limit, about ``rows``, are read. The places of the model (WORDS, and GRAMS for each length) are
    shared out evenly, with PLACES for a language at least; its most frequent words have them, by the word's hash among those of
    one count. What the model leaves out is thus a language's rarest words and n-grams, whose texts shorter n-grams still score.
    """
    labelled = docs.select(F.col(id_col).alias("i"), F.col(lang_col).cast("string").alias("l"), F.col(text_col).cast("string").alias("t"))
    labelled = labelled.where(F.col("l").isNotNull() & F.col("t").isNotNull() & (bucket_of(F.col("i"), 5) != 0))
    sizes = dict(labelled.groupBy("l").agg(F.count("*").alias("rows")).collect())
    langs = sorted(sizes)
    if not langs:
        return Model([], [table_of(pa.table({"g": pa.array([], pa.string()), "l": pa.array([], pa.string()), "n": pa.array([], pa.int64())}), []) for _ in range(LONGEST + 1)])

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if len(langs) <= FEW else df

    spark = docs.sparkSession
    limits = small(spark.createDataFrame([(x, limit_of(rows, n)) for x, n in sizes.items()], "l string, limit long"))
    chosen = labelled.join(limits, "l").where(F.shiftrightunsigned(F.xxhash64("i", "t"), 2) < F.col("limit")).select("l", "t")
    words = cut(chosen.mapInArrow(counted_words, "l string, g string, n long").groupBy("l", "g").agg(F.sum("n").alias("n")))
    counted = cut(words.select(F.lit(0).alias("k"), "g", "l", "n").unionByName(grams_of(words)))

    # the least count that a language's places have room for, from how many grams have each count; of those with that count the first
    # by their hash take what is left
    places = F.when(F.col("k") == 0, max(PLACES, WORDS // max(len(langs), 1))).otherwise(max(PLACES, GRAMS // max(len(langs), 1)))
    alike = counted.groupBy("k", "l", "n").agg(F.count("*").alias("grams"))
    upto = F.sum("grams").over(Window.partitionBy("k", "l").orderBy(F.desc("n")))
    told = alike.withColumn("before", upto - F.col("grams")).where(F.col("before") < places)
    least = told.groupBy("k", "l").agg(F.min_by(F.struct("n", F.greatest(places - F.col("before"), F.lit(0)).alias("room"), "grams"), "n").alias("x"))
    held = counted.join(small(least.select("k", "l", "x.*").withColumnRenamed("n", "least")), ["k", "l"]).where(F.col("n") >= F.col("least"))
    # a share of the last class by hash, a little more than its room, so that few are ranked
    cut_off = F.least(F.lit(1.0), F.col("room") / F.col("grams") + 4 * F.sqrt(F.col("room") + 16) / F.col("grams"))
    last = held.where(F.col("n") == F.col("least")).withColumn("h", F.shiftrightunsigned(F.xxhash64("g"), 2)).where(F.col("h") <= cut_off * float(2**62))
    rank = F.row_number().over(Window.partitionBy("k", "l").orderBy("h", "g"))
    last = last.withColumn("rank", rank).where(F.col("rank") <= F.col("room"))
    best = held.where(F.col("n") > F.col("least")).select("k", "g").unionByName(last.select("k", "g")).distinct()
    found = counted.join(best, ["k", "g"], "left_semi").select("k", "g", "l", "n").toArrow().sort_by([(c, "ascending") for c in ("k", "g", "l")])
    return Model(langs, [table_of(found.filter(pc.equal(found.column("k"), k)), langs) for k in range(LONGEST + 1)])


class Scorer:
    """Scores of words by a model, kept in one matrix of bounded size and made anew when it is full."""

    def __init__(self, model: Model):
        self.model, self.place = model, {}
        self.room = max(1, min(KEPT, KEPT_BYTES // max(4 * len(model.langs), 1)))
        self.table = np.zeros((0, len(model.langs)), np.float32)

    def learn(self, words: set[str]) -> None:
        if len(self.place) > self.room:
            self.place.clear()
        new, first = sorted(words.difference(self.place)), len(self.place)
        short = first + len(new) - len(self.table)
        if short > 0:
            self.table = np.concatenate([self.table, np.zeros((max(short, len(self.table) // 2), self.table.shape[1]), np.float32)])
        self.table[first : first + len(new)] = self.model.scores(new)
        self.place.update(zip(new, range(first, first + len(new)), strict=True))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        found = [words_of(t) if t and any(map(str.isalpha, t)) else [] for t in texts] if self.model.langs else [[]] * len(texts)
        self.learn({w for words in found for w in words})
        out = []
        for words in found:
            if not words:
                out.append(("und", 0.0))
                continue
            at = np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))
            mean = self.table[at].mean(0, dtype=np.float64) * len(words) ** 0.5
            best = int(mean.argmax())
            out.append((self.model.langs[best], float(1 / np.exp(mean - mean[best]).sum())))
        return out


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """One row per row of ``docs``: the columns ``keep`` (the id alone) and lang_pred and score (or the names ``into``), from whole texts.

    A null text, one without a letter, and every text when nothing was learned get ``und`` and 0. Equal scores go to the
    language that sorts first. The score is the posterior of the mean word, sharpened by the root of the number of words. Repeated
    rows get equal values; an empty table gives no rows. The names ``into`` mustn't be among ``keep``.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        scorer = Scorer(shared.value)

        def work(texts):
            found = scorer.predict(texts)
            return {into[0]: [x for x, _ in found], into[1]: [x for _, x in found]}

        return work

    return map_texts(docs, keep or [id_col], text_col, make, f"`{into[0]}` string, `{into[1]}` double")


def identify_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from rows whose crc32(id) mod 5 isn't 0 and predicts every row; ``held_out`` marks the others.

    Null and empty texts are ``und``; null languages aren't learned from; a null id counts as the empty text, whose crc32 is 0: its rows
    are held out. Repeated rows count as often as they stand there, and an empty table gives no rows. Other columns aren't read.
    """
    out = identify(docs, fit(docs, id_col, text_col, lang_col), id_col, text_col)
    return out.select(id_col, (bucket_of(F.col(id_col), 5) == 0).alias("held_out"), "lang_pred", "score")
