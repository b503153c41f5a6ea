"""SimHash near-duplicates: fingerprints dealt over the shells of vantage-point trees, exact links within a Hamming distance."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, join_spread, map_texts

#: Fingerprints of a shard, about; bounds of the sample that the tree is fitted on and of the tree's shards.
SHARD, SAMPLE, SHARDS = 32_768, 65_536, 16_384
#: A shard with more than so many times SHARD rows is searched in parts.
CROWDED = 4
#: Vantage points tried at a node, and residents that are compared without a further split.
TRIED, BLOCK = 6, 512
#: Edges that a task contracts at a time, about.
HELD = 1_000_000
SEED = 42


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of each run of ``width`` words (fewer words: of them all), joined by single spaces; A-Z count as a-z."""
    import xxhash

    words = (text or "").encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    digest = xxhash.xxh64_intdigest
    if len(words) <= width:
        return np.array([digest(flat, SEED)], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.r_[0, ends[:-1] + 1]
    return np.array([digest(flat[a:b], SEED) for a, b in zip(starts[: 1 - width or None].tolist(), ends[width - 1 :].tolist(), strict=True)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bits set in over half of the hashes; none: 0."""
    votes = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536]
        votes += np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64).sum(0, dtype=np.uint32)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs`` with its fingerprint in ``fp``, a long that holds the 64 bits.

    Null and empty texts and those without a word have fingerprint 0; a text of fewer words than ``width`` is one shingle. Equal texts have
    equal fingerprints, whatever their length; an empty table gives no rows. Columns other than ``keep`` aren't read.
    """

    def make():
        return lambda texts: {"fp": np.array([fingerprint(shingle_hashes(t, width)) for t in texts], np.uint64).view(np.int64)}

    return map_texts(docs, keep or [id_col], text_col, make, "fp long")


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def vantage(points: np.ndarray, radius: int, rng: np.random.Generator) -> tuple[np.uint64, int] | None:
    """A point and a distance that part ``points`` in two, with few of them near the boundary; None if none parts them."""
    best = None
    for v in points[rng.integers(0, len(points), TRIED)]:
        d = distance(points, v)
        at = int(np.median(d))
        for split in (at, at + 1):
            inner = int((d < split).sum())
            if 0 < inner < len(points):
                near = int(((d >= split - radius) & (d < split + radius)).sum())
                cost = near + 2 * abs(len(points) - 2 * inner)
                if best is None or cost < best[0]:
                    best = (cost, v, split)
    return best and best[1:]


@dataclass
class Tree:
    """Nodes in arrays: a node's vantage point and boundary, and its children; a negative child ~s is shard s."""

    points: np.ndarray
    splits: list[int]
    inner: list[int]
    outer: list[int]
    shards: int

    def deal(self, fps: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Positions in ``fps``, shards, and whether resident there. Each is resident in one shard and visits others.

        By the triangle bound a point within ``radius`` of one inside a boundary is less than ``radius`` outside it. So that a pair
        is met once, points outside visit the inside; points inside don't visit the outside. Visitors go wherever the bound allows.
        """
        out: list = []
        stack = [(0 if len(self.splits) else -1, np.arange(len(fps)), np.ones(len(fps), bool))]
        while stack:
            node, at, resident = stack.pop()
            if not len(at):
                continue
            if node < 0:
                out.append((at, np.full(len(at), ~node), resident))
                continue
            d, split = distance(fps[at], self.points[node]), self.splits[node]
            inside = d < split
            into = np.where(resident, inside, d < split + radius)
            beyond = np.where(resident, ~inside, d.astype(int) >= split - radius)
            guests = resident & ~inside & (d < split + radius)
            stack.append((self.inner[node], np.r_[at[into], at[guests]], np.r_[resident[into], np.zeros(int(guests.sum()), bool)]))
            stack.append((self.outer[node], at[beyond], resident[beyond]))
        if not out:
            return np.zeros(0, int), np.zeros(0, int), np.zeros(0, bool)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def plant(sample: np.ndarray, shards: int, radius: int) -> Tree:
    """A tree of about ``shards`` shards over a sample; the largest part is split until there are enough or none can be."""
    import heapq

    rng = np.random.default_rng(SEED)
    tree = Tree(np.zeros(0, np.uint64), [], [], [], 0)
    points: list = []
    heap = [(-len(sample), 0, sample, None)]
    done, serial = [], 0
    while heap and len(heap) + len(done) < shards:
        _, _, part, slot = heapq.heappop(heap)
        found = vantage(part, radius, rng) if len(part) > 1 else None
        if found is None:
            done.append(slot)
            continue
        node = len(points)
        points.append(found[0])
        tree.splits.append(found[1])
        tree.inner.append(-1)
        tree.outer.append(-1)
        if slot:
            getattr(tree, slot[1])[slot[0]] = node
        inside = distance(part, found[0]) < found[1]
        for name, mask in (("inner", inside), ("outer", ~inside)):
            serial += 1
            heapq.heappush(heap, (-int(mask.sum()), serial, part[mask], (node, name)))
    for slot in [*done, *(x[3] for x in heap)]:
        if slot:
            getattr(tree, slot[1])[slot[0]] = ~tree.shards
        tree.shards += 1
    tree.points = np.array(points, np.uint64)
    return tree


def components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of each of n nodes the least node that the edges reach."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        low = np.minimum(x, y)
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        while (new[new] != new).any():
            new = new[new]
        if (new == label).all():
            break
        label = new
    return label


class Forest:
    """Components of positions as links come in: of each the least position that it is linked with so far."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        x, y = self.label[a], self.label[b]
        apart = x != y
        if apart.any():
            nodes, ends = np.unique(np.r_[x[apart], y[apart]], return_inverse=True)
            top = nodes[components(len(nodes), *np.split(ends, 2))]
            moved = np.arange(len(self.label))
            moved[nodes] = top
            self.label = moved[self.label]

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        moved = np.flatnonzero(self.label != np.arange(len(self.label)))
        return moved, self.label[moved]


def links(fps: np.ndarray, resident: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges between positions that join what lies within ``radius``: residents with residents and with visitors.

    Vantage points split the residents further; small blocks are compared outright. One forest takes all their links, and points that
    are in one component already aren't compared again, so a dense ball of fingerprints costs neither its pairs' memory nor, once
    it hangs together, their time.
    """
    rng = np.random.default_rng(SEED)
    forest = Forest(len(fps))
    stack = [(np.flatnonzero(resident), np.flatnonzero(~resident))]
    while stack:
        own, guests = stack.pop()
        if not len(own) or len(own) + len(guests) < 2:
            continue
        found = vantage(fps[own] if len(own) <= 4096 else fps[rng.choice(own, 4096)], radius, rng) if len(own) > BLOCK else None
        if found is not None:
            v, split = found
            d, g = distance(fps[own], v), distance(fps[guests], v)
            inside = d < split
            near, beyond = guests[g < split + radius], guests[g.astype(int) >= split - radius]
            border = own[~inside & (d < split + radius)]
            # a split that sends nearly all to both sides only costs
            if len(near) + len(beyond) + len(border) < 0.75 * (2 * len(guests) + len(own)):
                stack.append((own[inside], np.r_[near, border]))
                stack.append((own[~inside], beyond))
                continue
        every = np.r_[own, guests]
        for i in range(0, len(own), BLOCK):
            for j in range(i, len(every), 4096):
                rows, columns = own[i : i + BLOCK], every[j : j + 4096]
                x, y = forest.label[rows], forest.label[columns]
                if (y == x[0]).all() and (x == x[0]).all():
                    continue
                r, c = np.nonzero(distance(fps[rows][:, None], fps[columns][None, :]) <= radius)
                forest.join(rows[r], columns[c])
    return forest.edges()


def spread(dealt: DataFrame, most: int) -> DataFrame:
    """(shard, part, fp, resident): shards of more than ``most`` rows in parts, so that none is one task's, whatever lies in it.

    A part has its own residents and, as visitors, the shard's visitors and the residents of the parts before it; every pair of the shard
    that has a resident meets in a part.
    """
    sizes = dealt.groupBy("shard").count().where(F.col("count") > most).collect()  # of SHARDS shards at most
    if not sizes:
        return dealt.select("shard", F.lit(0).alias("part"), "fp", "resident")
    parts = F.create_map(*[F.lit(x) for shard, n in sizes for x in (shard, -(-n // most))])
    own = dealt.withColumn("parts", F.coalesce(F.try_element_at(parts, F.col("shard")), F.lit(1)))
    own = own.withColumn("home", F.when(F.col("resident"), F.pmod(F.xxhash64("fp", F.lit("part")), F.col("parts")).cast("int")))
    each = own.withColumn("part", F.explode(F.sequence(F.coalesce("home", F.lit(0)), F.col("parts") - 1)))
    return each.select("shard", "part", "fp", F.coalesce(F.col("home") == F.col("part"), F.lit(False)).alias("resident"))


def near_edges(fps: DataFrame, radius: int, shard: int = SHARD, sample: int = SAMPLE) -> DataFrame:
    """Edges (a, b) over distinct fingerprints (column ``fp``): each shard's forest. Together they link what lies within ``radius``."""
    n = fps.count()
    share = int(min(1.0, sample / max(n, 1)) * 2**20) + 1
    drawn = fps.where(F.pmod(F.xxhash64("fp", F.lit("tree")), F.lit(2**20)) < share).select("fp").limit(2 * sample)
    points = np.unique(drawn.toPandas()["fp"].to_numpy(np.int64).view(np.uint64))
    tree = plant(points, max(1, min(SHARDS, -(-n // shard))), radius)
    shared = fps.sparkSession.sparkContext.broadcast(tree)

    def deal(batches):
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            at, to, resident = shared.value.deal(own, radius)
            columns = [pa.array(to, pa.int32()), pa.array(own[at].view(np.int64)), pa.array(resident)]
            yield pa.RecordBatch.from_arrays(columns, names=["shard", "fp", "resident"])

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf["fp"].to_numpy(np.int64)
        a, b = links(own.view(np.uint64), pdf["resident"].to_numpy(bool), radius)
        return pd.DataFrame({"a": own[a], "b": own[b]})

    dealt = cut(fps.select("fp").mapInArrow(deal, "shard int, fp long, resident boolean"))
    return spread(dealt, CROWDED * shard).groupBy("shard", "part").applyInPandas(search, "a long, b long").where("a <> b")


def contracted(edges: DataFrame, most: int = HELD) -> DataFrame:
    """Edges (u, v) of the same components: of ``most`` edges of a task at a time each node's with the least one that they reach."""

    def told(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        both = pa.Table.from_batches(held).to_pandas()
        nodes, ends = np.unique(np.r_[both["u"].to_numpy(), both["v"].to_numpy()], return_inverse=True)
        label = components(len(nodes), *np.split(ends, 2))
        moved = np.flatnonzero(label != np.arange(len(nodes)))
        return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((nodes[moved], nodes[label[moved]]), held[0].schema, strict=True)], names=["u", "v"])

    def run(batches):
        held = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= most:
                yield told(held)
                held = []
        if held:
            yield told(held)

    return edges.mapInArrow(run, edges.schema)


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of an edge, root the least node of its component: large and small stars in turn until nothing moves.

    Each task contracts its own edges first, so that a small graph needs one round: a thread of the driver lives for a minute after each
    shuffle, and many rounds in a minute cost it more memory than their rows do. Every round is written to the checkpoint folder; only
    counts and sums of hashes reach the driver.
    """
    e = cut(contracted(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()))
    before = None
    while True:
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == before or not now[0]:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = cut(small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct())


def near_duplicates(docs: DataFrame, width: int, radius: int = 3, id_col: str = "doc_id", text_col: str = "text", shard: int = SHARD) -> DataFrame:
    """One row per row of ``docs``: id, ``fp`` and ``component_id``, the least id that links reach.

    Texts without a word (null, empty) have fingerprint 0 and link like any other. Equal fingerprints are one node, so a large group
    of copies is one row before any comparison. Rows of a null id get the least id of their component. An empty table gives no rows.
    """
    own = cut(fingerprints(docs, width, id_col, text_col))
    nodes = cut(own.groupBy("fp").agg(F.min(id_col).alias("__first"), F.count("*").alias("times")))
    roots = connected(near_edges(nodes, radius, shard))
    placed = nodes.join(roots, nodes["fp"] == roots["node"], "left").select("fp", "times", "__first", F.coalesce("root", "fp").alias("__root"))
    least = placed.groupBy("__root").agg(F.min("__first").alias("component_id"))
    total = nodes.agg(F.sum("times")).first()[0] or 0
    return join_spread(own, placed.join(least, "__root").select("fp", "times", "component_id"), ["fp"], "times", total).select(id_col, "fp", "component_id")
