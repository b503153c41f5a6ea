"""Near-duplicates by Jaccard similarity of shingle sets: candidates share a MinHash band or near SimHash fingerprints, and each link is verified by the sets themselves."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, join_spread, let, map_texts, stored
from .lines import filter_of, may_hold
from .simhash import SEED, connected, fingerprint, near_edges, shingle_hashes

#: Bands, and least hashes in one: a pair of similarity 0.8 shares none with probability (1 - 0.8 ** 5) ** 25 = 5e-5.
BANDS, ROWS = 25, 5
#: Similarity in percent from which two texts are linked.
LEAST = 80
#: Nodes and shingles, about, that are compared in one task.
PART, PART_SHINGLES = 2000, 1_000_000
BLOCK = 512


def multipliers() -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(SEED)
    a, b = rng.integers(0, 2**64, (2, BANDS * ROWS, 1), np.uint64)
    return a | np.uint64(1), b


def band_keys(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[int]:
    """A signed 64-bit key for each band of a set of hashes; an empty set has none."""
    import xxhash

    if not len(hashes):
        return []
    least = np.full(len(a), 2**64 - 1, np.uint64)
    for i in range(0, len(hashes), BLOCK):
        least = np.minimum(least, (a * hashes[None, i : i + BLOCK] + b).min(1))
    keys = [xxhash.xxh64_intdigest(x.tobytes(), i) for i, x in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def sketches(docs: DataFrame, width: int, id_col: str, text_col: str, prints: bool = False) -> DataFrame:
    """One row per row of ``docs``: id, ``copy`` (hash of the text), ``set`` (128-bit hash of the shingle set), its size ``n`` and ``bands``.

    With ``prints`` also ``fp``, the fingerprint of all shingles, repeats included.

    Null texts, empty ones and those without a word have the empty set, size 0 and no bands; a text of fewer words than ``width`` is one shingle.
    Repeated rows give equal rows, an empty table none; other columns aren't read. Long texts are hashed in blocks of BLOCK shingles.
    """

    def make():
        import xxhash

        a, b = multipliers()

        def work(texts):
            hashes = [shingle_hashes(t, width) for t in texts]
            sets = [np.unique(h) for h in hashes]
            told = {"set": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "n": [len(s) for s in sets], "bands": [band_keys(s, a, b) for s in sets]}
            return told | ({"fp": np.array([fingerprint(h) for h in hashes], np.uint64).view(np.int64)} if prints else {})

        return work

    text = F.col(text_col).cast("string")
    named = docs.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("copy"), text.alias("text"))
    return map_texts(named, ["id", "copy"], "text", make, "set binary, n int, bands array<long>" + (", fp long" if prints else ""))


def shingle_sets(docs: DataFrame, nodes: DataFrame, width: int, text_col: str) -> DataFrame:
    """(set, hashes) of the nodes, whose texts (one ``copy`` each) are read again through a filter of fixed size.

    A text is told once, however many rows have it; null texts have the hash of null as their copy and the empty set. No nodes, no rows.
    """

    def make():
        import xxhash

        def work(texts):
            sets = [np.unique(shingle_hashes(t, width)) for t in texts]
            return {"set": [xxhash.xxh3_128_digest(s.tobytes()) for s in sets], "hashes": [s.view(np.int64).tolist() for s in sets]}

        return work

    texts = docs.select(F.col(text_col).cast("string").alias("text")).withColumn("copy", F.xxhash64("text"))
    few = may_hold(texts, filter_of(nodes.select(F.col("copy").alias("key"))), F.col("copy"), "may").where("may")
    few = few.join(nodes.select("copy").distinct(), "copy", "left_semi")
    once = few.groupBy("copy").agg(F.first("text").alias("text"))
    return map_texts(once, [], "text", make, "set binary, hashes array<long>")


def may_reach(n: Column, m: Column, percent: int) -> Column:
    """Can sets of these sizes be as similar as that?"""
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have at least the similarity; whole numbers, so that exactly 0.8 counts."""
    both = pairs.join(sets.select(F.col("set").alias("a"), F.col("hashes").alias("x")), "a").join(sets.select(F.col("set").alias("b"), F.col("hashes").alias("y")), "b")
    enough = let(F.size(F.array_intersect("x", "y")), lambda i: i * 100 >= (F.size("x") + F.size("y") - i) * percent)
    return both.where(enough).select("a", "b")


def similar(docs: DataFrame, width: int, percent: int = LEAST, id_col: str = "doc_id", text_col: str = "text", bits: int | None = None) -> DataFrame:
    """One row per row of ``docs``: ``id``, ``copy`` (hash of the text), ``root`` (a component's name) and ``component_id``, the least id that links reach.

    Texts of equal sets are one node, texts without a word too. Every pair of nodes that share a band is either verified or already
    linked by others. With ``bits``, a component of fingerprints that differ in at most so many (as ``simhash`` links them)
    is a band as well. Repeated rows give equal rows; null ids are no component's least id unless it has no other; an empty table
    gives no rows. Other columns aren't read.
    """
    with Scratch(docs.sparkSession) as keep:
        own = stored(sketches(docs, width, id_col, text_col, bits is not None))
        grouped = (F.min("id").alias("__first"), F.min("copy").alias("copy"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.count("*").alias("times"))
        nodes = keep(own.groupBy("set").agg(*grouped))
        near = None if bits is None else fingerprint_bands(own, bits, keep)
        roots = connected(band_links(docs, nodes, width, percent, text_col, keep, near))
        rooted = nodes.join(roots, nodes["set"] == roots["node"], "left").select("set", "times", "__first", F.coalesce("root", "set").alias("root"))
        component = rooted.groupBy("root").agg(F.min("__first").alias("component_id"))
        placed = stored(rooted.join(component, "root").select("set", "times", "root", "component_id"))
        total = nodes.agg(F.sum("times")).first()[0] or 0
    return join_spread(own.select("id", "copy", "set"), placed, ["set"], "times", total).select("id", "copy", "root", "component_id")


def band_links(docs: DataFrame, nodes: DataFrame, width: int, percent: int, text_col: str, keep: Callable[[DataFrame], DataFrame], near: DataFrame | None = None) -> DataFrame:
    """Verified links (a, b) between nodes that share a band, one of theirs or of ``near`` (set, band): enough of them to join all that are similar and share one.

    Of each band the node that meets most others over all its bands is held against the rest: a text that many were made from is such a
    one, so that a large family costs a pair for each. What is then in one band and not in one component is compared in blocks, which
    tell links between components and nothing else.
    """
    entries = nodes.select("set", "copy", "n", F.explode("bands").alias("band"))
    if near is not None:
        entries = entries.unionByName(nodes.join(near, "set").select("set", "copy", "n", "band"))
    counts = keep(entries.groupBy("band").agg(F.count("*").alias("times")).where("times > 1"))
    total = counts.agg(F.sum("times")).first()[0] or 0
    met = join_spread(entries, counts.withColumn("others", F.col("times")), ["band"], "times", total)
    met = keep(met.groupBy("set", "copy", "n").agg(F.sum("others").alias("degree"), F.collect_list("band").alias("bands")))
    sets = keep(shingle_sets(docs, met.select("copy").distinct(), width, text_col).dropDuplicates(["set"]))
    met = met.select("set", "n", "degree", F.explode("bands").alias("band"))

    pivots = keep(met.groupBy("band").agg(F.count("*").alias("times"), F.max(F.struct("degree", "set", "n")).alias("b")))
    star = join_spread(met, pivots, ["band"], "times", total).where((F.col("set") != F.col("b.set")) & may_reach(F.col("n"), F.col("b.n"), percent))
    star = star.select(F.greatest("set", "b.set").alias("a"), F.least("set", "b.set").alias("b")).distinct()
    links = keep(verified(star, sets, percent))
    # a band's pivot has met all others of it
    rest = met.join(pivots.select("band", F.col("b.set").alias("set")), ["band", "set"], "left_anti")
    left = keep(apart(rest, connected(links)))
    return links.unionByName(block_links(left, sets, percent))


def fingerprint_bands(own: DataFrame, bits: int, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(set, band): a band for each component of fingerprints (column ``fp``) that is of several sets. The empty set is in none."""
    pairs = keep(own.where("n > 0").select("set", "fp").distinct())
    prints = keep(pairs.groupBy("fp").agg(F.count("*").alias("times")))
    roots = connected(near_edges(prints.select("fp"), bits))
    rooted = keep(prints.join(roots, prints["fp"] == roots["node"], "left").select("fp", "times", F.coalesce("root", "fp").alias("root")))
    several = rooted.groupBy("root").agg(F.sum("times").alias("all")).where("all > 1").select("root", F.xxhash64(F.lit("fingerprint"), "root").alias("band"))
    total = prints.agg(F.sum("times")).first()[0] or 0
    return join_spread(pairs, rooted.join(several, "root").select("fp", "times", "band"), ["fp"], "times", total).select("set", "band").distinct()


def dealt(left: DataFrame, rows: int, shingles: int) -> DataFrame:
    """(band, part, set, n, root, resident): bands in parts of about ``rows`` nodes and ``shingles`` shingles at most.

    A part has its own residents and, as visitors, those of the parts before it, so every pair of a band meets in one part.
    """
    parts = F.greatest(F.ceil(F.count("*") / rows), F.ceil(F.sum("n") / shingles)).cast("int")
    sized = left.groupBy("band").agg(F.count("*").alias("times"), parts.alias("parts"))
    total = sized.agg(F.sum("times")).first()[0] or 0
    own = join_spread(left, sized, ["band"], "times", total).withColumn("home", F.pmod(F.xxhash64("set", F.lit("part")), F.col("parts")).cast("int"))
    each = own.withColumn("part", F.explode(F.sequence("home", F.col("parts") - 1)))
    return each.select("band", "part", "set", "n", "root", (F.col("home") == F.col("part")).alias("resident"))


def block_links(left: DataFrame, sets: DataFrame, percent: int, rows: int = PART, shingles: int = PART_SHINGLES) -> DataFrame:
    """Links (a, b) of different components among nodes (band, set, n, root) of one band, by the whole sets."""

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        names, hashes = pdf["set"].to_numpy(object), pdf["hashes"].tolist()
        i, j = linked(hashes, pd.factorize(pdf["root"])[0], pdf["resident"].to_numpy(bool), percent)
        return pd.DataFrame({"a": names[i], "b": names[j]})

    whole = dealt(left, rows, shingles).join(sets, "set").select("band", "part", "set", "root", "resident", "hashes")
    return whole.groupBy("band", "part").applyInPandas(search, "a binary, b binary").distinct()


def linked(hashes: list[np.ndarray], label: np.ndarray, resident: np.ndarray, percent: int) -> tuple[list[int], list[int]]:
    """Positions of links that join components: of residents with what is similar to them and not of their component yet."""
    sizes = np.array([len(h) for h in hashes])
    starts = np.cumsum(sizes) - sizes
    words, place = np.unique(np.concatenate(hashes), return_inverse=True) if len(hashes) else (np.zeros(0), np.zeros(0, int))
    mine, label, out = np.zeros(len(words), bool), label.copy(), ([], [])
    for i in np.flatnonzero(resident):
        others = label != label[i]
        if not others.any():
            continue
        own = place[starts[i] : starts[i] + sizes[i]]
        mine[own] = True
        shared = np.add.reduceat(mine[place], starts, dtype=np.int64)
        mine[own] = False
        found = others & (shared * 100 >= (sizes[i] + sizes - shared) * percent)
        for j in np.flatnonzero(found):
            if label[j] != label[i]:
                out[0].append(int(i))
                out[1].append(int(j))
                label[label == label[j]] = label[i]
    return out


def apart(met: DataFrame, roots: DataFrame) -> DataFrame:
    """(band, set, n, root) of the nodes in bands whose nodes are in two components or more."""
    placed = met.join(roots, met["set"] == roots["node"], "left").select("band", "set", "n", F.coalesce("root", "set").alias("root"))
    mixed = placed.groupBy("band").agg(F.min("root").alias("r"), F.max("root").alias("s")).where("r <> s").select("band")
    return placed.join(mixed, "band", "left_semi")
