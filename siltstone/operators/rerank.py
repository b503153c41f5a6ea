"""Rerankers over a query's few candidates: none, mmr, llm and cross. Candidates are (query_id, id, rank0, summary, embedding)."""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LAMBDA = 0.6
LLM_CHARS, CROSS_CHARS = 300, 512


def none(candidates: DataFrame, k: int) -> DataFrame:
    return candidates.where(F.col("rank0") < k)


def _unit(v) -> np.ndarray | None:
    a = np.asarray(v if v is not None else [], np.float64)
    size = np.sqrt((a * a).sum())
    return a / size if size > 0 else None


def mmr_order(vectors: list, k: int, trade: float = LAMBDA) -> list[int]:
    """Positions chosen one by one: relevance falls with the rank, likeness to what is chosen counts against; ties to the better rank."""
    n, units, chosen = len(vectors), [_unit(v) for v in vectors], []
    if n <= k:
        return list(range(n))
    nearest = np.zeros(n)
    while len(chosen) < k:
        value = np.array([trade * (1 - i / n) - (1 - trade) * nearest[i] for i in range(n)])
        value[chosen] = -np.inf
        best = int(value.argmax())
        chosen.append(best)
        for i, u in enumerate(units):
            if u is not None and units[best] is not None and len(u) == len(units[best]):
                nearest[i] = max(nearest[i], float(u @ units[best]))
    return chosen


def _per_query(candidates: DataFrame, order: Callable[[pd.DataFrame], list[int]]) -> DataFrame:
    """Each query's candidates (FETCH at most, so a group is bounded) in the order's sequence; rank0 anew."""

    def pick(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rank0", "id"], ignore_index=True)
        return pdf.iloc[order(pdf)].assign(rank0=lambda d: np.arange(len(d), dtype=np.int32))

    return candidates.groupBy("query_id").applyInPandas(pick, candidates.schema)


def mmr(candidates: DataFrame, k: int, trade: float = LAMBDA) -> DataFrame:
    return _per_query(candidates, lambda pdf: mmr_order(list(pdf["embedding"]), k, trade))


def picks(reply: str, n: int, k: int) -> list[int]:
    """Numbers of a reply in order, those of candidates, each once, k at most; none: the first k."""
    found = [int(x) for x in re.findall(r"[0-9]+", reply or "")]
    return list(dict.fromkeys(i for i in found if i < n))[:k] or list(range(min(k, n)))


def llm_prompt(question: str, summaries: list[str], k: int) -> str:
    listed = "".join(f"[{i}] {(s or '')[:LLM_CHARS]}\n" for i, s in enumerate(summaries))
    return f"Which passages help to answer: {question}\n{listed}Name the best {k} by number, best first, with commas between (such as 3,0), and nothing else."


def llm(candidates: DataFrame, k: int, generate: Callable[[str], str]) -> DataFrame:
    """``candidates`` also has ``question``. A failing model leaves the first k."""

    def order(pdf: pd.DataFrame) -> list[int]:
        if len(pdf) <= k:
            return list(range(len(pdf)))
        try:
            reply = generate(llm_prompt(pdf["question"].iloc[0], list(pdf["summary"]), k))
        except Exception:  # noqa: BLE001  the model is outside; search goes on without it
            reply = ""
        return picks(reply, len(pdf), k)

    return _per_query(candidates, order)


def cross(candidates: DataFrame, k: int, scorer: Callable[[list[tuple[str, str]]], list[float]] | None) -> DataFrame:
    """By the sigmoid of a model's output on (question, passage); no model, or one that fails, leaves the first k."""

    def order(pdf: pd.DataFrame) -> list[int]:
        first = list(range(min(k, len(pdf))))
        if len(pdf) <= k or scorer is None:
            return first if scorer is None else list(range(len(pdf)))
        try:
            raw = np.asarray(scorer([(q, (s or "")[:CROSS_CHARS]) for q, s in zip(pdf["question"], pdf["summary"], strict=True)]), np.float64)
        except Exception:  # noqa: BLE001
            return first
        return list(np.argsort(-1 / (1 + np.exp(-raw)), kind="stable")[:k])

    return _per_query(candidates, order)


def mmr_two(candidates: DataFrame, trade: float = LAMBDA) -> DataFrame:
    """MMR for k = 2 as joins and windows: the first candidate, then the best of the others against it alone."""
    from .vector import cosine

    own = candidates.select("query_id", "id", "rank0", "embedding", F.count("*").over(Window.partitionBy("query_id")).alias("n"))
    first = own.where(F.col("rank0") == 0).select(F.col("query_id").alias("q"), F.col("embedding").alias("e"))
    value = trade * (1 - F.col("rank0") / F.col("n")) - (1 - trade) * F.greatest(F.lit(0.0), cosine(F.col("embedding"), F.col("e")))
    others = own.where(F.col("rank0") > 0).join(first, F.col("query_id") == F.col("q")).withColumn("v", F.round(value, 9))
    second = others.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("v"), "rank0"))).where("r = 1")
    lead = own.where(F.col("rank0") == 0).select("query_id", "id", F.lit(0).alias("rank0"), F.lit(float(trade)).alias("mmr"))
    return lead.unionByName(second.select("query_id", "id", F.lit(1).alias("rank0"), F.col("v").alias("mmr")))


def strategy(name: str | None) -> Callable:
    """By its name; an unknown one is mmr."""
    return {"none": none, "mmr": mmr, "llm": llm, "cross": cross}.get(name or "mmr", mmr)
