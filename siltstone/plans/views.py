"""The driver's tables as the engine's logical tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import let, tokens
from ..lineage import forget_at_exit, shared_folder

GLOSSARY_SIZE, GLOSSARY_LETTERS = 40, 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession) -> str:
    """A folder of one query's own, which goes with the session."""
    folder = f"{shared_folder(spark)}/query-{uuid.uuid4().hex}"
    forget_at_exit(spark, folder)
    return folder


def articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    title = F.concat(F.col("source"), F.lit(" #"), (F.col("doc_id") + 1).cast("string"))
    url = F.concat(F.lit("file://"), F.col("source"), F.lit("#"), (F.col("doc_id") + 1).cast("string"))
    none = F.lit(None).cast("timestamp_ntz")
    named = (F.col("doc_id").alias("id"), F.col("lang").alias("namespace"), title.alias("title"), F.col("text").alias("summary"))
    return docs.select(*named, url.alias("url"), none.alias("ingested_at"), F.col("source").alias("doc"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("namespace"), "embedding")


def query_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    feedback = F.when(k % 5 == 0, "up").when(k % 5 == 1, "down")
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("id"),
        F.concat(F.lit("question "), F.col("user_id").cast("string")).alias("question"),
        F.col("event_type").alias("model"),
        F.floor(F.col("value") * 100).cast("long").alias("latency_ms"),
        F.col("ts").alias("created_at"),
        F.concat(F.lit("#"), k.cast("string"), F.lit(" src")).alias("sources"),
        feedback.alias("feedback"),
        (k % 3).alias("pii_count"),
    )


def glossary(arts: DataFrame) -> list[str]:
    """The GLOSSARY_SIZE long tokens that most articles hold, most frequent first; few enough to be a literal in plans."""
    long = F.filter(tokens(F.col("summary")), lambda x: F.length(x) >= GLOSSARY_LETTERS)
    counted = arts.select(F.explode(F.array_distinct(long)).alias("entity")).groupBy("entity").agg(F.count("*").alias("df"))
    return [r[0] for r in counted.orderBy(F.desc("df"), "entity").limit(GLOSSARY_SIZE).collect()]


def entities(arts: DataFrame, names: list[str]) -> DataFrame:
    """(namespace, id, doc, entity), found in the article's own row: no join and no shuffle."""
    every = F.array(*[F.lit(n) for n in names]).cast("array<string>")
    held = let(F.lower("summary"), lambda low: F.filter(every, lambda e: low.contains(e)))
    return arts.select("namespace", "id", "doc", F.explode(held).alias("entity"))


def relations(spark: SparkSession, names: list[str]) -> DataFrame:
    """Relations by a rule on ordinals: neighbours a, a + 1 are typed, in turn by two types; every third pair isn't."""
    rows = [(a, ("CALCULATES", "REQUIRES")[i % 3], b, i) for i, (a, b) in enumerate(zip(names, names[1:], strict=False)) if i % 3 < 2]
    return spark.createDataFrame(rows, "src string, type string, dst string, ord int")
