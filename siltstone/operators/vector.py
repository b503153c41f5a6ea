"""Cosine search for the few queries of a question, exact; locality-sensitive signatures. ``nearest`` has searches for tables of queries."""

from __future__ import annotations

import math
from collections.abc import Iterable
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Queries that travel with the tasks of a scan, and those of one product with a batch of vectors.
MOST_QUERIES, ASKED = 10_000, 256
PLANES, MOST_PLANES = 16, 31
SEED = 42


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 where a vector has no length."""
    size = norm(a) * norm(b)
    return F.when(size == 0, 0.0).otherwise(dot(a, b) / F.nullif(size, F.lit(0.0)))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def unit(rows: np.ndarray) -> np.ndarray:
    size = np.sqrt((rows * rows).sum(1, keepdims=True))
    return rows / np.where(size > 0, size, 1)


def usable(vectors: DataFrame, dim: int, column: str = "embedding") -> DataFrame:
    """Rows with a vector of ``dim`` numbers without nulls; others can't be compared."""
    return vectors.where((F.size(column) == dim) & F.forall(column, lambda x: x.isNotNull()))


def knn(vectors: DataFrame, queries: Iterable[tuple[int, Iterable[float]]], k: int, id_col: str = "id", column: str = "embedding", within: str | None = None) -> DataFrame:
    """(query_id, id, score, rank): the k nearest of each of a few queries by cosine, ties to the least id.

    Queries travel with the tasks of one scan, so there are MOST_QUERIES at most; ``nearest`` takes tables of them. A task sends on only its
    own k best for each, which are then ranked. With ``within``, queries are (id, vector, value) and see only the rows whose
    column ``within`` has that value.
    """
    asked = [(q[0], list(q[1]), *q[2:]) for q in queries]
    if len(asked) > MOST_QUERIES:
        raise ValueError(f"{len(asked)} queries; nearest.knn_join takes a table of any size")
    found = _block_knn(vectors, asked, k, id_col, column, within)
    return found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def best_of(q: np.ndarray, i: np.ndarray, s: np.ndarray, k: int) -> list[np.ndarray]:
    """The k best rows of each query, sorted by query, then best first."""
    order = np.lexsort((i, -s, q))
    q, i, s = q[order], i[order], s[order]
    first = np.r_[True, q[1:] != q[:-1]] if len(q) else np.zeros(0, bool)
    place = np.arange(len(q)) - np.maximum.accumulate(np.where(first, np.arange(len(q)), 0))
    return [x[place < k] for x in (q, i, s)]


def _block_knn(vectors: DataFrame, queries: list[tuple], k: int, id_col: str, column: str, within: str | None) -> DataFrame:
    """(query_id, id, score): each task's k best of each query of a block."""
    dim = len(queries[0][1]) if queries else 1
    block = unit(np.array([q[1] for q in queries], np.float64).reshape(-1, dim))
    names = np.array([q[0] for q in queries], np.int64)
    wanted = np.array([q[2] for q in queries], object) if within else None
    source = usable(vectors, dim, column).select(F.col(id_col).cast("long").alias("id"), column, *([F.col(within).alias("in")] if within else []))

    def search(batches):
        # places of queries in the block, ids and scores of the best so far
        best = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        for b in batches:
            ids = b.column(0).to_numpy()
            if not len(ids) or not len(names):
                continue
            rows, own = unit(matrix(b.column(1), dim)), np.array(b.column(2).to_pylist(), object) if within else None
            new = [best]
            for at in range(0, len(names), ASKED):
                score = np.round(block[at : at + ASKED] @ rows.T, 12)
                score = np.where(np.isnan(score), -np.inf, score)
                if within:
                    score = np.where(wanted[at : at + ASKED, None] == own[None, :], score, -np.inf)
                least = np.partition(score, len(ids) - k, axis=1)[:, len(ids) - k, None] if 0 < k < len(ids) else -np.inf
                j, r = np.nonzero((score >= least) & (score > -np.inf))
                new.append(best_of(j + at, ids[r], score[j, r], k))
            best = best_of(*[np.concatenate(x) for x in zip(*new, strict=True)], k)
        if len(best[0]):
            yield pa.RecordBatch.from_arrays([pa.array(names[best[0]]), pa.array(best[1]), pa.array(best[2])], names=["query_id", "id", "score"])

    return source.mapInArrow(search, "query_id long, id long, score double")


class JavaRandom:
    """The linear congruential generator of java.util.Random, and its polar Gaussian."""

    def __init__(self, seed: int):
        self.state, self.spare = (seed ^ 0x5DEECE66D) & ((1 << 48) - 1), None

    def bits(self, n: int) -> int:
        self.state = (self.state * 0x5DEECE66D + 0xB) & ((1 << 48) - 1)
        return self.state >> (48 - n)

    def uniform(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) / (1 << 53)

    def gaussian(self) -> float:
        if self.spare is not None:
            out, self.spare = self.spare, None
            return out
        while True:
            x, y = 2 * self.uniform() - 1, 2 * self.uniform() - 1
            s = x * x + y * y
            if 0 < s < 1:
                scale = math.sqrt(-2 * math.log(s) / s)
                self.spare = y * scale
                return x * scale


def planes(dim: int, count: int = PLANES, seed: int = SEED) -> np.ndarray:
    draw = JavaRandom(seed)
    return np.array([[np.float32(draw.gaussian()) for _ in range(dim)] for _ in range(min(count, MOST_PLANES))], np.float64)


def signatures(vectors: DataFrame, cuts: np.ndarray, column: str = "embedding") -> DataFrame:
    """``vectors`` with ``sig``: bit h is set where the product with plane h isn't negative."""
    dim = cuts.shape[1]
    source = usable(vectors, dim, column)
    powers = 1 << np.arange(len(cuts))
    at = source.columns.index(column)

    def sign(batches):
        for b in batches:
            sig = ((matrix(b.column(at), dim) @ cuts.T >= 0) * powers).sum(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sig)], names=[*b.schema.names, "sig"])

    return source.mapInArrow(sign, T.StructType([*source.schema.fields, T.StructField("sig", T.IntegerType())]))


class VectorSearch(Protocol):
    """What an engine asks of a vector store, over articles of one tenant (``one``) or of many (``many``, with a table of queries)."""

    def one(self, vectors: DataFrame, embedding: list[float], k: int) -> DataFrame: ...

    def many(self, vectors: DataFrame, queries: DataFrame, k: int, within: str | None = None) -> DataFrame: ...


def index_stats(signed: DataFrame) -> DataFrame:
    return signed.groupBy("namespace").agg(F.count("*").alias("vectors"), F.count_distinct("sig").alias("buckets"))
