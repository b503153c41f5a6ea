"""How far each source of a language is from the others: term shares compared in dense tiles of groups by terms."""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

#: A term is kept in a language if so many of its documents hold it; ranks of terms that are told.
LEAST_DOCS, TOP = 3, 200
#: Shares are integers of this unit.
UNIT = 1_000_000_000
#: Terms and groups that a worker counts together before it sends its counts on.
KEPT = 400_000
#: Cells (groups times terms) of a tile, of what is compared at once, and rows that a tile sends on together.
CELLS, AT_ONCE, SENT = 2**20, 2**18, 10_000
#: With more languages than this, tables of a row for each are joined by shuffles.
FEW = 20_000
#: Bytes as terms have them: letters A-Z lowered, and a blank for each that stands between terms.
LOWER = bytes(c if 97 <= c <= 122 or c >= 128 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
COUNTS = "lang string, source string, term string, n long, docs long"
PARTS = "lang string, source string, part string, item string, value long"


def counted_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of batches (language, source, text) rows (language, source, term, occurrences, documents), summed as far as memory is meant to hold."""

    def told() -> pa.RecordBatch:
        rows = [(lang, source, term, n, docs[term]) for (lang, source), (counts, docs) in seen.items() for term, n in counts.items()]
        columns = zip(*rows, strict=True) if rows else ([],) * 5
        kinds = (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64())
        made = [pa.array(list(x), t) for x, t in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*made[:2], made[2].cast(pa.string()), *made[3:]], names=["lang", "source", "term", "n", "docs"])

    seen: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    size = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            counts, docs = seen.setdefault((lang, source), (Counter(), Counter()))
            own = Counter(text.encode().translate(LOWER).split())
            size -= len(counts)
            counts.update(own)
            docs.update(own.keys())
            size += len(counts)
            if size > KEPT:
                yield told()
                seen, size = {}, 0
    yield told()


def shares(n: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * n / total), a long division by thousands, so that counts near 2^53 don't overflow."""
    out, rest = np.zeros(np.broadcast_shapes(n.shape, total.shape), np.int64), n
    for _ in range(3):
        digit, rest = np.divmod(rest * 1000, total)
        out = out * 1000 + digit
    return out + 1


def gain(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // q


def compared(counts: np.ndarray, sums: np.ndarray, kept: int, groups: list[str], terms: list[str], top: int) -> Iterator[tuple[str, str, list[str], list[int]]]:
    """Of a tile (groups by terms) for each group its sums against every other one, and its best terms against all of them.

    ``sums`` are the groups' occurrences in all tiles, ``kept`` is the number of terms of all tiles.
    """
    p = shares(counts + 1, (sums + kept)[:, None])
    all_of = shares(counts.sum(0) + 1, np.array(int(sums.sum()) + kept))
    step = max(1, AT_ONCE // max(len(terms), 1))
    for a, group in enumerate(groups):
        value = np.concatenate([gain(p[a], p[b : b + step]).sum(1) for b in range(0, len(groups), step)])
        yield group, "pair", groups[:a] + groups[a + 1 :], np.delete(value, a).tolist()
        mine = np.flatnonzero((counts[a] > 0) & (p[a] > all_of))
        mine_value = gain(p[a][mine], all_of[mine])
        best = heapq.nsmallest(top, ((-v, terms[i].encode(), i) for v, i in zip(mine_value.tolist(), mine.tolist(), strict=True)))
        yield group, "term", [terms[i] for _, _, i in best], [-v for v, _, _ in best]


def tile_task(top: int) -> Callable:
    """What runs on the rows of one language and block: those without a term are its groups, the others fill the tile."""

    def run(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lang = key[0].as_py()
        rows = pa.Table.from_batches(list(batches)).combine_chunks()
        own = rows.filter(pc.is_null(rows["term"])).sort_by("source")
        rows = rows.filter(pc.is_valid(rows["term"]))
        groups, sums = own["source"].to_pylist(), own["n"].to_numpy()
        kept = own["terms"][0].as_py()
        term, source = (rows[x].combine_chunks().dictionary_encode() for x in ("term", "source"))
        place = {s: i for i, s in enumerate(groups)}
        row = np.array([place[s] for s in source.dictionary.to_pylist()], np.int64)[source.indices.to_numpy()]
        counts = np.zeros((len(groups), len(term.dictionary)), np.int64)
        counts[row, term.indices.to_numpy()] = rows["n"].to_numpy()
        sent: list[tuple[str, str, str, int]] = []
        for group, part, items, values in compared(counts, sums, kept, groups, term.dictionary.to_pylist(), top):
            sent += [(group, part, item, value) for item, value in zip(items, values, strict=True)]
            if len(sent) >= SENT:
                yield batch_of(lang, sent)
                sent = []
        yield batch_of(lang, sent)

    return run


def batch_of(lang: str, sent: list[tuple[str, str, str, int]]) -> pa.RecordBatch:
    columns = list(zip(*sent, strict=True)) if sent else [()] * 4
    made = [pa.array([lang] * len(sent), pa.string()), *[pa.array(columns[i], pa.string()) for i in range(3)], pa.array(columns[3], pa.int64())]
    return pa.RecordBatch.from_arrays(made, names=["lang", "source", "part", "item", "value"])


def divergence(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank): of each group its distance to the language's other sources, and its outstanding terms.

    Null texts, languages and sources count as ''. A group without terms has its pairs too; a language's only source has none. An
    empty table gives no rows. Repeated rows count as often as they stand there; equal values go by the item's bytes. All
    arithmetic is of integers. Other columns aren't read, so their names can't clash.

    A language's terms are dealt by hash into blocks of about CELLS cells, whatever a source's size. A task holds one tile, sums its
    pairs, and keeps ``top`` terms of each group in a heap; sums and heaps are all that meets.
    """
    columns = (("lang", lang_col), ("source", source_col), ("text", text_col))
    own = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(x) for x, c in columns])
    counted = own.mapInArrow(counted_terms, COUNTS).groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    by_term = counted.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.collect_list(F.struct("source", "n")).alias("by"))
    kept = stored(by_term.where(F.col("docs") >= least_docs).select("lang", "term", F.explode("by").alias("x")).select("lang", "term", "x.source", "x.n"))
    sums = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    terms = kept.groupBy("lang").agg(F.countDistinct("term").alias("terms"))
    groups = own.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(terms, "lang", "left")
    groups = stored(groups.select("lang", "source", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.coalesce("terms", F.lit(0).cast("long")).alias("terms")))
    blocks = groups.groupBy("lang").agg(F.greatest(F.ceil(F.max("terms") * F.count("*") / CELLS), F.lit(1).cast("long")).alias("blocks"))
    blocks = F.broadcast(blocks) if blocks.count() <= FEW else blocks

    block = F.pmod(F.xxhash64("term"), F.col("blocks"))
    of_terms = kept.join(blocks, "lang").select("lang", block.alias("block"), "source", "term", "n", F.lit(None).cast("long").alias("terms"))
    of_groups = groups.join(blocks, "lang").select("lang", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "source", F.lit(None).cast("string").alias("term"), "n", "terms")
    parts = stored(of_terms.unionByName(of_groups).groupBy("lang", "block").applyInArrow(tile_task(top), PARTS))

    pairs = parts.where(F.col("part") == "pair").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    found = pairs.unionByName(parts.where(F.col("part") == "term"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item"))
    ranked = found.withColumn("rank", rank).where((F.col("part") == "pair") | (F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")
