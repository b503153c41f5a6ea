"""BM25 over tenants: index tables, and scores of queries from one pass over the texts."""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let, term_counts, tokens
from ..lineage import cut

K1, B = 1.2, 0.75


def postings(articles: DataFrame, text: str = "summary") -> DataFrame:
    """(namespace, id, term, tf, dl): the inverted index as a table. Ids are unique, so an article's terms are counted in its own row."""
    own = articles.select("namespace", "id", tokens(F.col(text)).alias("t"))
    each = own.select("namespace", "id", F.size("t").alias("dl"), F.explode(term_counts(F.col("t"))).alias("x"))
    return each.select("namespace", "id", F.col("x.term").alias("term"), F.col("x.tf").alias("tf"), "dl")


def term_stats(articles: DataFrame, text: str = "summary") -> DataFrame:
    """(namespace, term, df, n_docs, avgdl); documents without a token count for n_docs and avgdl."""
    own = articles.select("namespace", tokens(F.col(text)).alias("t"))
    per_ns = own.groupBy("namespace").agg(F.count("*").alias("n_docs"), F.avg(F.size("t")).alias("avgdl"))
    df = own.select("namespace", F.explode(F.array_distinct("t")).alias("term")).groupBy("namespace", "term").agg(F.count("*").alias("df"))
    return df.join(per_ns, "namespace")


def gain(tf: Column, dl: Column, df: Column, n: Column, avgdl: Column) -> Column:
    """What a term adds to a text's score: more with its count there, less with the text's length and with how many texts hold it."""
    idf = F.ln(1 + (n - df + 0.5) / (df + 0.5))
    return F.when((tf > 0) & (df > 0), idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / avgdl))).otherwise(0.0)


def counted(articles: DataFrame, terms: list[str], text: str = "summary") -> DataFrame:
    """(namespace, id, dl, tf): a text's tokens and how often each of the terms is one, told apart once."""

    def count(toks: Column) -> Column:
        own = F.filter(toks, lambda x: x.isin(terms))
        return let(own, lambda found: F.struct(F.size(toks).alias("dl"), F.array(*[F.size(F.filter(found, _equals(t))) for t in terms]).alias("tf")))

    return articles.select("namespace", "id", let(tokens(F.col(text)), count).alias("c")).select("namespace", "id", "c.dl", "c.tf")


def _equals(term: str):
    return lambda x: x == F.lit(term)


def scores(articles: DataFrame, query: str, text: str = "summary") -> DataFrame:
    """(namespace, id, score) of the articles that a query's terms score above 0 within their tenant; a repeated term counts repeatedly.

    Texts are read once: what is kept of them is a few numbers, which the sums per tenant and the scores are made from.
    """
    import re

    counts = Counter(re.findall("[a-z0-9]+", query.lower()))
    if not counts:
        return articles.select("namespace", "id", F.lit(0.0).alias("score")).where(F.lit(False))
    terms = sorted(counts)
    slim = cut(counted(articles, terms, text))
    dfs = [F.count_if(F.col("tf")[i] > 0).alias(f"df{i}") for i in range(len(terms))]
    sums = slim.groupBy("namespace").agg(F.count("*").alias("n"), F.avg("dl").alias("avg"), *dfs)
    gains = (counts[t] * gain(F.col("tf")[i].cast("double"), F.col("dl"), F.col(f"df{i}"), F.col("n"), F.col("avg")) for i, t in enumerate(terms))
    found = slim.where(F.exists("tf", lambda x: x > 0)).join(sums, "namespace")
    return found.select("namespace", "id", sum(gains, F.lit(0.0)).alias("score")).where("score > 0")


def batch_scores(index: DataFrame, stats: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, namespace, id, score) of many queries (query_id, namespace, text) over stored postings and term_stats."""
    asked = queries.select("query_id", "namespace", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "namespace", "term").agg(F.count("*").alias("times"))
    joined = asked.join(stats, ["namespace", "term"]).join(index, ["namespace", "term"])
    own = F.col("times") * gain(F.col("tf"), F.col("dl"), F.col("df"), F.col("n_docs"), F.col("avgdl"))
    return joined.groupBy("query_id", "namespace", "id").agg(F.sum(own).alias("score")).where("score > 0")


def topk(scored: DataFrame, k: int, by: list[str] | None = None) -> DataFrame:
    """The k best rows, ties to the least id: of all, or of each key ``by``. ``rank`` counts from 1 when there is a key."""
    if not by:
        return scored.orderBy(F.desc("score"), "id").limit(k)
    ranked = scored.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k)
