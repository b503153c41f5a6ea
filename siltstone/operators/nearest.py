"""The nearest vectors of a table of queries: a join of blocks, and a stored index of rings around centres that is searched exactly."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..lineage import cut
from .vector import best_of, knn, matrix, unit, usable

#: Rows of either side that meet in one task, about, and queries of one product.
ROWS, ASKED = 20_000, 256
#: Bounds of what an index is fitted on and with: vectors of the sample, centres, turns of their fitting; and a ring's width in radians.
SAMPLE, CENTRES, TURNS, RING = 20_000, 1024, 8, 0.1
#: What angles and scores may be off by rounding.
ANGLE_SLACK, SCORE_SLACK = 1e-6, 1e-9
#: Tables of a row for each key are joined by broadcast up to this number of rows.
FEW = 100_000
KEYS = ["space", "cluster", "ring"]
#: The cluster of vectors without a direction, whose score is 0 for every query.
NOWHERE = -1


def sides(rows: DataFrame, name: str, id_col: str, column: str, within: str | None, dim: int) -> DataFrame:
    """(space, name, v) of the rows that can be compared; without ``within`` all are in one space."""
    space = F.coalesce(F.col(f"`{within}`").cast("string"), F.lit("")) if within else F.lit("")
    return usable(rows, dim, column).select(space.alias("space"), F.col(f"`{id_col}`").cast("long").alias(name), F.col(f"`{column}`").cast("array<double>").alias("v"))


def dimension(rows: DataFrame, column: str) -> int:
    first = rows.where(F.size(column) > 0).select(F.size(column)).first()
    return first[0] if first else 1


def _joined(rows: DataFrame, small: DataFrame, keys: list[str], few: bool) -> DataFrame:
    return rows.join(F.broadcast(small) if few else small, keys)


def block_best(members: DataFrame, asked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """(query_id, id, score): of each pair of blocks of the rows that share the keys the k best members of each query, but none under its ``least``.

    ``members`` (keys, id, v) and ``asked`` (keys, query_id, v, least) are dealt by hash into blocks of about ROWS rows of a key, however many it
    has, and every block of one side meets every one of the other. No row of either side goes through the driver.
    """
    parts = F.ceil(F.count("*") / ROWS).cast("int")
    sizes = cut(members.groupBy(*keys).agg(parts.alias("own")).join(asked.groupBy(*keys).agg(parts.alias("theirs")), keys))
    told = sizes.limit(2).collect()
    few = len(told) < 2 or sizes.count() <= FEW

    def sized(rows: DataFrame) -> DataFrame:
        if len(told) != 1:
            return _joined(rows, sizes, keys, few)
        own = rows
        for key in keys:
            own = own.where(F.col(key) == F.lit(told[0][key]))
        return own.withColumn("own", F.lit(told[0]["own"])).withColumn("theirs", F.lit(told[0]["theirs"]))

    def dealt(rows: DataFrame, name: str, mine: str, other: str) -> DataFrame:
        home = F.pmod(F.xxhash64(name, F.lit(name)), F.col(mine)).cast("int")
        each = sized(rows).withColumn("home", home).withColumn("met", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        a, b = ("home", "met") if mine == "own" else ("met", "home")
        named = [F.col(name) if x == name else F.lit(None).cast("long").alias(x) for x in ("id", "query_id")]
        least = F.col("least") if name == "query_id" else F.lit(None).cast("double").alias("least")
        return each.select(*keys, F.col(a).alias("block_a"), F.col(b).alias("block_b"), *named, "v", least)

    both = dealt(members, "id", "own", "theirs").unionByName(dealt(asked, "query_id", "theirs", "own"))
    return both.groupBy(*keys, "block_a", "block_b").applyInArrow(_product(k), "query_id long, id long, score double")


def _product(k: int) -> Callable[[pa.Table], pa.Table]:
    def search(rows: pa.Table) -> pa.Table:
        sides_ = [rows.filter(pc.is_valid(rows[name])).combine_chunks() for name in ("id", "query_id")]
        (ids, names), (own, theirs) = (np.asarray(t[n]) for t, n in zip(sides_, ("id", "query_id"), strict=True)), (t["v"].combine_chunks() for t in sides_)
        found = [[np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]]
        if len(ids) and len(names):
            dim = len(own[0])
            m, q = unit(matrix(own, dim)), unit(matrix(theirs, dim))
            bar = np.nan_to_num(np.asarray(sides_[1]["least"], np.float64), nan=-2.0) - SCORE_SLACK  # null: NaN
            for at in range(0, len(names), ASKED):
                score = np.round(q[at : at + ASKED] @ m.T, 12)
                score = np.where(np.isnan(score), -np.inf, score)
                score = np.where(score >= bar[at : at + ASKED, None], score, -np.inf)
                least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None] if 0 < k < len(ids) else -np.inf
                j, r = np.nonzero((score >= least) & (score > -np.inf))
                found.append(best_of(names[j + at], ids[r], score[j, r], k))
        columns = [np.concatenate(x) for x in zip(*found, strict=True)]
        return pa.table(dict(zip(("query_id", "id", "score"), columns, strict=True)))

    return search


def ranked(found: DataFrame, k: int) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k)


def knn_join(vectors: DataFrame, queries: DataFrame, k: int, id_col: str = "id", column: str = "embedding", query_id: str = "query_id", query_column: str = "embedding", within: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest vectors of each row of ``queries`` by cosine, ties to the least id.

    Both tables may have any number of rows: the plan doesn't grow with them and no row goes through the driver. With ``within``, a
    column of both, a query sees the rows of its own value alone. Vectors with nulls or of another length than the queries'
    aren't compared; one without a direction has score 0, one with a NaN none. A table without rows gives none.
    """
    dim = dimension(queries, query_column)
    members, asked = sides(vectors, "id", id_col, column, within, dim), sides(queries, "query_id", query_id, query_column, within, dim)
    return ranked(block_best(members, asked.withColumn("least", F.lit(None).cast("double")), ["space"], k), k)


# an index of rings


@dataclass
class Rings:
    """What routes a query: centres, and each ring's cluster, least and greatest angle to its centre, and number of members."""

    centres: np.ndarray  # of length one
    cluster: np.ndarray
    ring: np.ndarray
    least: np.ndarray
    most: np.ndarray
    n: np.ndarray

    def bounds(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of rows of length one (or 0) the least angle that a member of each ring can have, and the angle to its centre.

        The angle is a metric: a member that is ``b`` from its centre is at least ``|a - b|`` from a query that is ``a`` from it.
        """
        known = self.cluster >= 0
        angle = np.full((len(q), len(self.cluster)), np.pi / 2)
        angle[:, known] = np.arccos(np.clip(q @ self.centres.T, -1, 1))[:, self.cluster[known]]
        low = np.maximum(0, np.maximum(angle - self.most, self.least - angle))
        low[:, ~known] = np.pi / 2
        low[~q.any(1)] = np.pi / 2  # a query without a direction has score 0 everywhere
        return low, angle

    def first(self, low: np.ndarray, angle: np.ndarray, k: int) -> np.ndarray:
        """Which rings each query sees first: the nearest ones that have k members together."""
        order = np.lexsort((angle, low), axis=1)
        before = np.cumsum(self.n[order], axis=1) - self.n[order]
        out = np.zeros(low.shape, bool)
        np.put_along_axis(out, order, before < k, axis=1)
        return out


@dataclass
class Index:
    """The tables of an index: ``members`` (space, id, v, cluster, ring, angle) and ``centres`` (cluster, centre)."""

    members: DataFrame
    centres: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return {"members": self.members, "centres": self.centres}

    @staticmethod
    def read(spark: SparkSession, folder: str) -> Index:
        return Index(spark.read.parquet(f"{folder}/members"), spark.read.parquet(f"{folder}/centres"))

    def rings(self) -> Rings:
        """At most CENTRES times pi / RING rows, whatever the number of members."""
        told = self.members.groupBy("cluster", "ring").agg(F.min("angle").alias("least"), F.max("angle").alias("most"), F.count("*").alias("n")).orderBy("cluster", "ring").toPandas()
        centres = np.array([r["centre"] for r in self.centres.orderBy("cluster").collect()], np.float64)
        return Rings(centres, *(told[c].to_numpy() for c in ("cluster", "ring", "least", "most", "n")))


def fitted_centres(sample: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means of rows of length one, from the first ``count`` of them; a centre that loses all its rows stays."""
    centres = sample[:count].copy()
    for _ in range(TURNS):
        nearest = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, sample)
        moved = unit(sums)
        centres = np.where(moved.any(1)[:, None], moved, centres)
    return centres


def placed(members: DataFrame, centres: np.ndarray) -> DataFrame:
    """``members`` (space, id, v) with cluster, ring and angle. Vectors with a NaN have no score, and no place."""
    shared = members.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            v = unit(matrix(b.column("v"), own.shape[1]))
            near = np.clip(v @ own.T, -1, 1)
            cluster = near.argmax(1)
            angle = np.arccos(near[np.arange(len(v)), cluster])
            still = ~v.any(1)
            cluster, angle = np.where(still, NOWHERE, cluster), np.where(still, np.pi / 2, angle)
            ring = np.floor(np.nan_to_num(angle) / RING).astype(np.int32)
            made = [pa.array(cluster.astype(np.int32)), pa.array(np.where(still, 0, ring).astype(np.int32)), pa.array(angle)]
            batch = pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, "cluster", "ring", "angle"])
            yield batch.filter(pa.array(~np.isnan(angle)))

    return members.mapInArrow(run, "space string, id long, v array<double>, cluster int, ring int, angle double")


def build(vectors: DataFrame, id_col: str = "id", column: str = "embedding", within: str | None = None, dim: int | None = None, centres: int | None = None) -> Index:
    """An index of every vector. Centres are fitted on SAMPLE vectors, those of the least hash: half the root of the rows many, CENTRES at most.

    It is meant to be written (``tables``) and read again. An empty table gives an index that finds nothing.
    """
    dim = dim or dimension(vectors, column)
    members = sides(vectors, "id", id_col, column, within, dim)
    n = members.count()
    drawn = members.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toPandas()["v"]
    sample = unit(np.array(drawn.tolist(), np.float64).reshape(-1, dim))
    sample = sample[np.isfinite(sample).all(1) & sample.any(1)]
    sample = sample if len(sample) else np.eye(1, dim)
    own = fitted_centres(sample, min(centres or max(1, round(n**0.5 / 2)), CENTRES, len(sample)))
    table = members.sparkSession.createDataFrame([(i, c.tolist()) for i, c in enumerate(own)], "cluster int, centre array<double>")
    return Index(placed(members, own), table)


def extended(index: Index, vectors: DataFrame, id_col: str = "id", column: str = "embedding", within: str | None = None) -> DataFrame:
    """``members`` of further vectors, by the centres that the index has."""
    centres = np.array([r["centre"] for r in index.centres.orderBy("cluster").collect()], np.float64)
    return placed(sides(vectors, "id", id_col, column, within, centres.shape[1]), centres)


def routed(asked: DataFrame, rings: Rings, k: int) -> DataFrame:
    """(space, query_id, v, least, cluster, ring, place): the rings that queries (space, query_id, v, seen, least) see.

    Where ``seen`` is null these are the nearest ones that have k members. Else they are all others (by their place among the rings) that may
    hold something as good as ``least``, the k-th score so far; all if there is none yet.
    """
    shared = asked.sparkSession.sparkContext.broadcast(rings)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 64):
                b = whole.slice(at, 64)
                q = unit(matrix(b.column("v"), own.centres.shape[1]))
                low, angle = own.bounds(np.nan_to_num(q))
                score = b.column("least").to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
                good = np.cos(np.maximum(0, low - ANGLE_SLACK)) >= np.nan_to_num(score, nan=-2.0)[:, None] - SCORE_SLACK
                see = own.first(low, angle, k)
                for row, before in enumerate(b.column("seen").to_pylist()):
                    if before is not None:
                        see[row] = good[row]
                        see[row, before] = False
                see[np.isnan(q).any(1)] = False
                i, r = np.nonzero(see)
                columns = [b.column(c).take(pa.array(i)) for c in ("space", "query_id", "v", "least")]
                made = [pa.array(x.astype(np.int32)) for x in (own.cluster[r], own.ring[r], r)]
                yield pa.RecordBatch.from_arrays([*columns, *made], names=["space", "query_id", "v", "least", "cluster", "ring", "place"])

    source = asked.select("space", "query_id", "v", "seen", "least")
    return source.mapInArrow(run, "space string, query_id long, v array<double>, least double, cluster int, ring int, place int")


def _rounds(index: Index, queries: DataFrame, k: int, query_id: str, query_column: str, within: str | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What queries are sent to first, the k best of that, and what they are sent to then."""
    rings = index.rings()
    asked = sides(queries, "query_id", query_id, query_column, within, rings.centres.shape[1])
    none = asked.withColumn("seen", F.lit(None).cast("array<int>")).withColumn("least", F.lit(None).cast("double"))
    first = cut(routed(none, rings, k))
    found = cut(ranked(block_best(index.members, first, KEYS, k), k))
    # a query is told which rings it has seen: angles that are reckoned twice may differ in their last bits
    seen = first.groupBy("query_id").agg(F.collect_set("place").alias("seen"))
    least = found.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).where(F.col("n") >= k).drop("n")
    rest = routed(asked.join(seen, "query_id").join(least, "query_id", "left"), rings, k)
    return first, found, rest


def search(index: Index, queries: DataFrame, k: int, query_id: str = "query_id", query_column: str = "embedding", within: str | None = None) -> DataFrame:
    """As ``knn_join`` over the vectors of an index, and as exact: (query_id, id, score, rank).

    A query first sees the nearest rings that have k members; its k-th score there bounds what another ring must be able to reach,
    and a second round sees only those. Rings of any size, and queries of one ring in any number, are dealt into blocks.
    """
    _, found, rest = _rounds(index, queries, k, query_id, query_column, within)
    return ranked(found.select("query_id", "id", "score").unionByName(block_best(index.members, rest, KEYS, k)), k)


def share_read(index: Index, queries: DataFrame, k: int, query_id: str = "query_id", query_column: str = "embedding", within: str | None = None) -> float:
    """Of all pairs of a query and a member of its space the share that ``search`` compares."""
    first, _, rest = _rounds(index, queries, k, query_id, query_column, within)
    counts = index.members.groupBy(*KEYS).agg(F.count("*").alias("n"))
    pairs = first.unionByName(rest).join(counts, KEYS).agg(F.sum("n")).first()[0] or 0
    asked = first.select("space", "query_id").distinct()
    every = asked.join(counts.groupBy("space").agg(F.sum("n").alias("n")), "space").agg(F.sum("n")).first()[0] or 0
    return pairs / every if every else 0.0


class Exact:
    """Every query against every vector."""

    def one(self, vectors: DataFrame, embedding: list[float], k: int) -> DataFrame:
        return knn(vectors, [(0, embedding)], k)

    def many(self, vectors: DataFrame, queries: DataFrame, k: int, within: str | None = None) -> DataFrame:
        return knn_join(vectors, queries, k, within=within)


class Indexed:
    """An index in the place of the vectors: ``members`` may have been read, extended and rid of what is gone by then."""

    def __init__(self, index: Index):
        self.index = index

    def one(self, vectors: DataFrame, embedding: list[float], k: int) -> DataFrame:
        space = vectors.select("namespace").first()
        asked = vectors.sparkSession.createDataFrame([(0, space[0], embedding)] if space else [], "query_id long, namespace string, embedding array<double>")
        return self.many(vectors, asked, k, "namespace")

    def many(self, vectors: DataFrame, queries: DataFrame, k: int, within: str | None = None) -> DataFrame:
        return search(self.index, queries, k, within=within)
