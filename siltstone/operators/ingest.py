"""Ingest: texts to chunks with vectors, as one lazy plan; indexes derived from the stored chunks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import base_title, definitions, expand_acronyms, ns_key
from .chunk import chunked
from .glossary import Glossary, article_entities
from .graph import typed_edges
from .services import embed_column


def new_files(files: DataFrame, articles: DataFrame) -> DataFrame:
    """Files (namespace, title, ...) that their tenant doesn't hold yet."""
    have = articles.select("namespace", base_title(F.col("title")).alias("title")).distinct()
    return files.join(have, ["namespace", "title"], "left_anti")


def chunks(files: DataFrame, size: int = 1000, how: str = "recursive", expand: bool = True, embed: Callable | None = None, at: Column | None = None) -> DataFrame:
    """(namespace, title, url, text) to articles without ids: titles numbered from 1, acronyms told in full, vectors added."""
    named = files.select(ns_key(F.col("namespace")).alias("namespace"), "title", "url", definitions(F.col("text")).alias("__g"), "text")
    cut = chunked(named, "text", size, how, embed)
    summary = F.when(F.size("__g") > 0, expand_acronyms(F.col("chunk"), F.col("__g"))).otherwise(F.col("chunk")) if expand else F.col("chunk")
    told = cut.select("namespace", F.concat("title", F.lit(" #"), (F.col("pos") + 1).cast("string")).alias("title"), summary.alias("summary"), "url", (F.current_timestamp().cast("timestamp_ntz") if at is None else at).alias("ingested_at"))
    return told.withColumn("embedding", embed_column(F.col("summary"), embed))


def indexes(articles: DataFrame, glossary: Glossary | None = None) -> dict[str, DataFrame]:
    """The tables that searches use, all derived from the articles."""
    from .bm25 import postings, term_stats

    own = glossary or Glossary()
    texts = articles.select("namespace", "id", "title", F.concat_ws(" ", "title", "summary").alias("text"))
    entities = article_entities(texts, own).join(articles.select("id", base_title(F.col("title")).alias("doc")), "id")
    return {"postings": postings(articles), "term_stats": term_stats(articles), "entities": entities, "edges": typed_edges(entities, own.relation_table(articles.sparkSession))}
