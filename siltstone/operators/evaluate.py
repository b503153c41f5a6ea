"""Retrieval evaluation: hit tests, sweeps over configurations, recall and judge averages."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def all_keywords(blob: Column, keywords: Column) -> Column:
    """Does the text hold every keyword, whatever the case? Null and empty lists ask nothing."""
    return F.coalesce(F.forall(keywords, lambda k: F.lower(blob).contains(F.lower(k))), F.lit(True))


def title_hit(titles: Column, stem: Column) -> Column:
    return F.exists(titles, lambda t: F.lower(t).contains(F.lower(stem)))


def hits(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """Cases (case_id, keywords, title_part) against rows (case_id, config, title, summary): one row per case and config with ``hit``."""
    blob = retrieved.groupBy("case_id", "config").agg(F.array_join(F.collect_list(F.concat_ws(" ", "title", "summary")), " ").alias("blob"))
    # every case under every configuration: there are a handful of those
    pairs = cases.crossJoin(F.broadcast(retrieved.select("config").distinct()))
    whole = pairs.join(blob, ["case_id", "config"], "left").withColumn("blob", F.coalesce("blob", F.lit("")))
    fits = all_keywords(F.col("blob"), F.col("keywords")) & F.coalesce(F.lower("blob").contains(F.lower("title_part")), F.lit(True))
    return whole.select(*cases.columns, "config", fits.alias("hit"))


def recall(judged: DataFrame, *by: str) -> DataFrame:
    """Share of hits and the missed cases."""
    missed = F.array_sort(F.collect_list(F.when(~F.col("hit"), F.col("case_id"))))
    share = F.avg(F.col("hit").cast("double"))
    return judged.groupBy(*by).agg(F.count("*").alias("n"), F.count_if("hit").alias("hits"), share.alias("recall"), missed.alias("missed"))


def judge_score(reply: Column) -> Column:
    """The first digit from 1 to 5 in a judge's reply, else null."""
    return F.nullif(F.regexp_extract(reply, "[1-5]", 0), F.lit("")).cast("int")


#: Configurations of a sweep: reranker, keyword list on, graph list on.
CONFIGS = {"vector": ("none", False, False), "hybrid": ("none", True, False), "hybrid_graph": ("none", True, True), "llm": ("llm", True, True), "mmr": ("mmr", True, True)}


def golden(spark: SparkSession, path: str) -> DataFrame:
    """Evaluation cases of a JSON file that holds an array of objects."""
    return spark.read.option("multiLine", True).json(path)


def sweep(engine, cases: DataFrame, allowed: set[str], configs: dict[str, tuple[str, bool, bool]] | None = None) -> DataFrame:
    """Cases (case_id, question, namespace, keywords, title_part) under every configuration, with ``hit``.

    A configuration is one search for all its cases, so plans grow with the configurations and not with the golden set.
    """
    found = None
    asked = cases.select("case_id", "question", "namespace")
    for name, (how, keyword, graphs) in (configs or CONFIGS).items():
        top = engine.rerank_all(asked, engine.retrieve_all(asked, allowed, keyword=keyword, graphs=graphs), how)
        rows = top.select("case_id", F.lit(name).alias("config"), "title", "summary")
        found = rows if found is None else found.unionByName(rows)
    if found is None:
        return cases.select("case_id").withColumn("config", F.lit("")).withColumn("hit", F.lit(False))
    return hits(cases.select("case_id", "keywords", "title_part"), found)


def sql_hit(rows: list, expected: str) -> bool:
    """Does the answer's rows, as JSON, hold the expected literal?"""
    return expected in json.dumps(rows, ensure_ascii=False, default=str)
