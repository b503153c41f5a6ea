"""Reciprocal-rank fusion of ranked lists and the hybrid retriever made of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schema import free

RRF_K, GRAPH_WEIGHT = 60, 2.0


def ranked(scored: DataFrame, by: list[str], k: int | None = None) -> DataFrame:
    """Adds rank0 (from 0) within the keys: best score first, ties to the least id.

    The filter is on the row number itself, so that each task sends on its k best only.
    """
    n = free("n", [*scored.columns, "rank0"])
    numbered = scored.withColumn(n, F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")))
    return (numbered.where(F.col(n) <= k) if k else numbered).withColumn("rank0", F.col(n) - 1).drop(n)


def fuse(lists: list[tuple[DataFrame, float]], by: list[str], rrf_k: int = RRF_K) -> DataFrame:
    """(by..., id, score) of lists with rank0: each adds weight / (rrf_k + rank0 + 1); one union and one aggregate, no outer join."""
    of = free("list", [*by, "id", "score"])

    def part(i: int, df: DataFrame, weight: float) -> DataFrame:
        return df.select(*by, "id", (F.lit(float(weight)) / (rrf_k + F.col("rank0") + 1)).alias("score"), F.lit(i).alias(of))

    parts = [part(i, df, w) for i, (df, w) in enumerate(lists)]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    # added in the lists' order, so sums are equal on every run
    in_order = F.array_sort(F.collect_list(F.struct(of, "score")))
    return whole.groupBy(*by, "id").agg(F.aggregate(in_order, F.lit(0.0), lambda a, x: a + x["score"]).alias("score"))


def hybrid(vector: DataFrame, keyword: DataFrame | None, graph: DataFrame | None, n: int, by: list[str], graph_weight: float = GRAPH_WEIGHT) -> DataFrame:
    """The n best by fused score; without keyword and graph lists the vector list as it is. Inputs: (by..., id, score), each cut to n."""
    if keyword is None and graph is None:
        return ranked(vector, by, n).select(*by, "id", "score", "rank0")
    lists = [(ranked(vector, by, n), 1.0)]
    lists += [(ranked(keyword, by, n), 1.0)] if keyword is not None else []
    lists += [(ranked(graph, by, n), graph_weight)] if graph is not None else []
    return ranked(fuse(lists, by), by, n).select(*by, "id", "score", "rank0")
