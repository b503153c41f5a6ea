"""Audit log and document catalogue: rollups over append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schema import free

from ..functions.text import base_title, pii_count, pii_text, rounded, source_type


def by_model(log: DataFrame) -> DataFrame:
    return log.groupBy("model").agg(F.count("*").alias("calls"), rounded(F.avg("latency_ms")).alias("avg_latency_ms"))


def totals(log: DataFrame) -> DataFrame:
    return log.agg(F.count("*").alias("total_calls"), rounded(F.coalesce(F.avg("latency_ms"), F.lit(0.0))).alias("avg_latency_ms"), F.coalesce(F.sum("pii_count"), F.lit(0)).cast("long").alias("total_pii"))


def feedback(log: DataFrame) -> DataFrame:
    return log.where(F.col("feedback").isNotNull()).groupBy("feedback").agg(F.count("*").alias("n"))


def by_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.to_date("created_at").alias("day")).agg(F.count("*").alias("calls"), rounded(F.avg("latency_ms")).alias("avg_latency_ms"), F.max("latency_ms").alias("max_latency_ms"))


def by_hour(log: DataFrame) -> DataFrame:
    return log.groupBy(F.hour("created_at").alias("hour")).agg(F.count("*").alias("calls"), F.count_distinct("model").alias("models"))


def slowest(log: DataFrame, k: int = 10) -> DataFrame:
    return log.orderBy(F.desc("latency_ms"), "id").limit(k)


def recent(log: DataFrame, k: int = 50) -> DataFrame:
    return log.orderBy(F.desc("created_at"), F.desc("id")).limit(k)


def mentioning(log: DataFrame, word: str | None = None, article: int | None = None, with_pii: bool = False, without_sources: bool = False) -> DataFrame:
    out = log
    if word is not None:
        out = out.where(F.lower("question").contains(word.lower()))
    if article is not None:
        out = out.where(F.concat(F.col("sources"), F.lit(" ")).contains(f"#{article} "))
    if with_pii:
        out = out.where(F.col("pii_count") > 0)
    if without_sources:
        out = out.where(F.col("sources").isNull() | (F.col("sources") == ""))
    return out


def documents(articles: DataFrame) -> DataFrame:
    """Chunks by tenant and base title: their number, the first url and the ids in order."""
    return (
        articles.groupBy("namespace", base_title(F.col("title")).alias("base"))
        .agg(F.count("*").alias("chunks"), F.coalesce(F.min_by("url", "id"), F.lit("")).alias("url"), F.array_sort(F.collect_list("id")).alias("ids"), F.max("ingested_at").alias("ingested_at"))
    )


def catalogue(articles: DataFrame, embed_model: str) -> DataFrame:
    """One row per document, derived: nothing is stored twice, so nothing goes stale."""
    kind = source_type(F.col("url"))
    return articles.groupBy("namespace", base_title(F.col("title")).alias("title")).agg(F.min_by(kind, "id").alias("source_type"), F.count("*").cast("int").alias("chunks"), F.max("ingested_at").alias("ingested_at")).withColumn("embed_model", F.lit(embed_model))


def by_source_type(catalogue: DataFrame) -> DataFrame:
    return catalogue.groupBy(F.coalesce("source_type", F.lit("?")).alias("source_type")).agg(F.count("*").alias("docs"), F.coalesce(F.sum("chunks"), F.lit(0)).cast("long").alias("chunks"))


def missing(catalogue: DataFrame, known: DataFrame) -> DataFrame:
    return catalogue.join(known.select("title", "namespace"), ["title", "namespace"], "left_anti")


def upserted(known: DataFrame, fresh: DataFrame) -> DataFrame:
    """``known`` with the rows of ``fresh`` instead of those of the same title and tenant."""
    return known.join(fresh.select("title", "namespace"), ["title", "namespace"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def stats(log: DataFrame, catalogue: DataFrame) -> dict[str, DataFrame]:
    return {"totals": totals(log), "by_model": by_model(log), "by_source_type": by_source_type(catalogue), "feedback": feedback(log)}


def redacted(df: DataFrame, *columns: str, count: str = "pii_count") -> DataFrame:
    """Private data of the columns masked, the matches of all of them summed."""
    total: Column = sum((pii_count(F.col(c)) for c in columns), F.lit(0))
    return df.withColumn(count, total.cast("int")).withColumns({c: pii_text(F.col(c)) for c in columns})


def with_feedback(log: DataFrame, events: DataFrame) -> DataFrame:
    """``log`` with the latest feedback of an append-only table (id, feedback, at)."""
    told = free("told", log.columns)
    last = events.groupBy("id").agg(F.max_by("feedback", "at").alias(told))
    kept = [F.coalesce(told, "feedback").alias(c) if c == "feedback" else F.col(f"`{c}`") for c in log.columns]
    return log.join(last, "id", "left").select(*kept)


def paired(turns: DataFrame) -> DataFrame:
    """Each user turn with the assistant turn that follows it at once."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    return turns.withColumn("__r", F.lead("role").over(w)).withColumn("answer", F.lead("text").over(w)).where((F.col("role") == "user") & (F.col("__r") == "assistant")).select("conv_id", "turn", F.col("text").alias("question"), "answer")


def document_texts(articles: DataFrame, most: int) -> DataFrame:
    """(namespace, base, text): a document's chunks (namespace, base, id, summary) by id, each after a line end, ``most`` characters in all.

    Chunks that begin beyond ``most`` characters are left out in the plan, so a row holds no more than that and one chunk.
    """
    piece = F.concat(F.lit("\n"), F.coalesce("summary", F.lit("")))
    before = Window.partitionBy("namespace", "base").orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    begun = articles.withColumn("__p", piece).withColumn("__at", F.coalesce(F.sum(F.length("__p")).over(before), F.lit(0))).where(F.col("__at") < most)
    parts = F.array_sort(F.collect_list(F.struct("id", F.col("__p").alias("p"))))
    return begun.groupBy("namespace", "base").agg(F.substring(F.array_join(F.transform(parts, lambda x: x["p"]), ""), 1, most).alias("text"))
