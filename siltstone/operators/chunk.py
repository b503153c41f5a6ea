"""Chunkers as column functions: fixed windows, recursive packing between ever finer separators, and sentences that are alike."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import let, trim
from .vector import cosine

OVERLAP = 150
SEPARATORS = ("\n\n", "\n", ". ", " ")
LOW_SHARE = 0.25
#: Where sentences end; what is between is left out.
SENTENCE_END = "(?<=[.!?])[ \\t\\n\\x0b\\f\\r]+|\\n{2,}"
#: Sentences that are embedded in one call.
EMBEDDED = 4096
TEXTS = "array<string>"
VECTORS = pa.list_(pa.float64())


def fixed(text: Column, size: int, overlap: int = OVERLAP) -> Column:
    """Windows of ``size`` characters, each ``size - overlap`` on, until one reaches the end; trimmed, blank ones left out."""
    step, n = max(1, size - overlap), F.length(text)
    count = F.when(n <= size, 1).otherwise(F.ceil((n - size) / step).cast("int") + 1)
    parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: trim(F.substring(text, i * step + 1, F.lit(size))))
    return F.filter(F.when(text.isNull(), F.array().cast(TEXTS)).otherwise(parts), lambda x: x != "")


def _parts(text: Column, pattern: str) -> Column:
    """Split at a pattern, without the empty parts at the end."""
    last = lambda parts: F.array_max(F.transform(parts, lambda x, i: F.when(x != "", i + 1).otherwise(0)))
    return let(F.split(text, pattern, -1), lambda parts: F.slice(parts, F.lit(1), last(parts)))


def _packed(text: Column, separator: str, size: int) -> Column:
    """Parts between a separator, each with one after it, joined while the next part's text still fits."""
    start = F.struct(F.array().cast(TEXTS).alias("done"), F.lit("").alias("held"), F.lit(0).alias("n"))

    def step(s: Column, part: Column) -> Column:
        more, n = F.concat(part, F.lit(separator)), F.length(part) + len(separator)
        full = (s["n"] > 0) & (s["n"] + F.length(part) > size)
        done = F.when(full, F.array_append(s["done"], s["held"])).otherwise(s["done"])
        return F.struct(done.alias("done"), F.when(full, more).otherwise(F.concat(s["held"], more)).alias("held"), F.when(full, n).otherwise(s["n"] + n).alias("n"))

    def finish(s: Column) -> Column:
        return F.when(s["n"] > 0, F.array_append(s["done"], s["held"])).otherwise(s["done"])

    return F.aggregate(_parts(text, "\\Q" + separator + "\\E"), start, step, finish)


def _cut(text: Column, size: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.ceil(F.length(text) / size).cast("int") - 1), lambda i: F.substring(text, i * size + 1, F.lit(size)))


def recursive(text: Column, size: int) -> Column:
    """Pieces of ``size`` at most: packed greedily from parts between ever finer separators, at last cut hard; trimmed, blank ones left out.

    A part keeps a separator after it, the last one too. A level for each separator, each over the pieces that are too long still; of a
    hard cut blank pieces stay. Null texts have no pieces.
    """
    short = lambda p: F.length(p) <= size
    marked = F.array(F.struct(text.alias("p"), F.lit(False).alias("hard")))

    def by(separator: str) -> Callable[[Column], Column]:
        def finer(x: Column) -> Column:
            more = F.transform(_packed(x["p"], separator, size), lambda p: F.struct(p.alias("p"), F.lit(False).alias("hard")))
            return F.when(short(x["p"]), F.array(x)).otherwise(more)

        return finer

    for separator in SEPARATORS:
        marked = F.flatten(F.transform(marked, by(separator)))

    def last(x: Column) -> Column:
        return F.when(short(x["p"]), F.array(x)).otherwise(F.transform(_cut(x["p"], size), lambda p: F.struct(p.alias("p"), F.lit(True).alias("hard"))))

    bare = F.transform(F.flatten(F.transform(marked, last)), lambda x: F.struct(trim(x["p"]).alias("p"), x["hard"].alias("hard")))
    kept = F.transform(F.filter(bare, lambda x: x["hard"] | (x["p"] != "")), lambda x: x["p"])
    return F.when(text.isNull(), F.array().cast(TEXTS)).otherwise(kept)


def sentences(text: Column) -> Column:
    """The text's sentences, an empty one at the end left out; a text without an end is one, and so is an empty text."""
    return let(_parts(text, SENTENCE_END), lambda s: F.when(F.size(s) > 0, s).otherwise(F.array(F.lit(""))))


def embed_lists(lists: Column, embed: Callable[[list[str]], list[list[float]]]) -> Column:
    """A vector for each text of each list: the lists of a batch of rows are embedded together, EMBEDDED texts in a call.

    What is Python's at the same time is the texts of a call and their vectors; the rest of a batch stays in Arrow.
    """

    @F.arrow_udf("array<array<double>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for rows in batches:
            ends = np.cumsum(pc.fill_null(pc.list_value_length(rows), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            at = 0
            while at < len(rows):
                before = int(ends[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(ends, before + EMBEDDED, "right")))
                texts = rows.slice(at, to - at).flatten()
                calls = (embed(texts.slice(i, EMBEDDED).to_pylist()) for i in range(0, len(texts), EMBEDDED))
                told = [pa.array([list(map(float, v)) for v in call], VECTORS) for call in calls]
                vectors = pa.concat_arrays(told) if told else pa.array([], VECTORS)
                yield pa.ListArray.from_arrays(pa.array(np.r_[before, ends[at:to]] - before, pa.int32()), vectors)
                at = to

    return run(lists)


def low_quartile(values: Column) -> Column:
    """The nearest rank below a quarter of the way; 0 of none."""
    return let(F.sort_array(values), lambda v: F.when(F.size(v) == 0, 0.0).otherwise(F.get(v, F.floor(LOW_SHARE * (F.size(v) - 1)).cast("int"))))


def semantic(told: Column, near: Column, size: int) -> Column:
    """Sentences joined until the likeness of neighbours falls under the text's lower quartile, or ``size`` would be passed; trimmed.

    ``near`` is the likeness of each sentence but the last with the next one.
    """
    first = F.get(told, 0)
    start = F.struct(F.array().cast(TEXTS).alias("done"), first.alias("held"), F.length(first).alias("n"))
    rest = F.arrays_zip(near.alias("near"), F.slice(told, F.lit(2), F.size(told)).alias("s"))

    def joined(least: Column) -> Column:
        def step(s: Column, x: Column) -> Column:
            ends = (x["near"] < least) | (s["n"] + F.length(x["s"]) > size)
            done = F.when(ends, F.array_append(s["done"], s["held"])).otherwise(s["done"])
            held = F.when(ends, x["s"]).otherwise(F.concat(s["held"], F.lit(" "), x["s"]))
            return F.struct(done.alias("done"), held.alias("held"), F.when(ends, F.length(x["s"])).otherwise(s["n"] + 1 + F.length(x["s"])).alias("n"))

        return F.aggregate(rest, start, step, lambda s: F.array_append(s["done"], s["held"]))

    return F.transform(let(low_quartile(near), joined), trim)


CHUNKERS = {"fixed", "recursive", "semantic"}


def chunked(docs: DataFrame, text: str, size: int = 1000, how: str = "recursive", embed: Callable | None = None) -> DataFrame:
    """``docs`` without ``text``, a row for each chunk: ``pos`` from 0 and ``chunk``. Null texts have no chunks.

    Only the vectors of the semantic chunker come from Python, many sentences in a call; all cutting and joining is column functions.
    """
    if how not in CHUNKERS:
        raise ValueError(f"unknown chunker {how!r}")
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    if how != "semantic":
        parts = (fixed if how == "fixed" else recursive)(F.col(f"`{text}`"), size)
        return docs.select(*others, F.posexplode(parts).alias("pos", "chunk"))
    if embed is None:
        from .services import hashing_embedder

        embed = hashing_embedder()
    row = F.struct(*others) if others else F.struct(F.lit(0).alias("none"))
    found = docs.where(F.col(f"`{text}`").isNotNull()).select(row.alias("row"), sentences(F.col(f"`{text}`")).alias("told"))
    found = found.withColumn("v", embed_lists(F.col("told"), embed))
    pairs = F.arrays_zip(F.slice("v", 1, F.greatest(F.size("v") - 1, F.lit(0))).alias("a"), F.slice("v", F.lit(2), F.size("v")).alias("b"))
    found = found.withColumn("near", F.transform(pairs, lambda x: cosine(x["a"], x["b"])))
    each = found.select("row", F.posexplode(semantic(F.col("told"), F.col("near"), size)).alias("pos", "chunk"))
    return each.select(*([F.col("row.*")] if others else []), "pos", "chunk")
