"""The registered queries over the driver's tables and their SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..lineage import cut
from ..operators import bm25, chunk, evaluate, fusion, glossary, governance, graph, ingest, keywords, nearest, ranks, rerank, security, vector
from ..sources import files, store, tabular
from .views import articles, entities, fresh_folder, query_log, relations, table, vectors
from .views import glossary as names_of

QUESTION = "the ndanon of thatre ingersh tion"
SEED_ORDS = (35, 38)
FLAGSHIP = "hybrid_graph_weighted"
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return register


# shared parts of the SQL
ARTICLES = """articles AS (SELECT doc_id AS id, lang AS namespace, source || ' #' || (doc_id + 1) AS title, text AS summary, 'file://' || source || '#' || (doc_id + 1) AS url, source AS doc
 FROM documents)"""
TOKENS = "toks AS (SELECT id, namespace, regexp_extract_all(lower(summary), '[a-z0-9]+') AS t FROM articles)"
LOG = """k AS (SELECT *, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events),
log AS (SELECT event_id AS id, 'question ' || user_id AS question, event_type AS model, CAST(floor(value * 100) AS BIGINT) AS latency_ms, ts AS created_at, '#' || k || ' src' AS sources, CASE
 WHEN k % 5 = 0 THEN 'up' WHEN k % 5 = 1 THEN 'down' END AS feedback, k % 3 AS pii_count FROM k)"""
GLOSSARY = """names AS (SELECT entity, row_number() OVER (ORDER BY df DESC, entity) - 1 AS ord FROM (SELECT w AS entity, count(DISTINCT id) AS df
 FROM (SELECT id, unnest(t) AS w FROM toks) WHERE length(w) >= 8 GROUP BY w ORDER BY df DESC, entity LIMIT 40))"""
ENTITIES = "ents AS (SELECT namespace, id, doc, entity FROM articles JOIN names ON contains(lower(summary), entity))"
RELATIONS = """rels AS (SELECT least(a.entity, b.entity) AS a, greatest(a.entity, b.entity) AS b, CASE WHEN a.ord % 3 = 0 THEN 'CALCULATES' ELSE 'REQUIRES' END AS type
 FROM names a JOIN names b ON b.ord = a.ord + 1 WHERE a.ord % 3 < 2)"""
EDGES = """pairs AS (SELECT x.namespace, x.entity AS a, y.entity AS b FROM ents x JOIN ents y ON x.id = y.id AND x.namespace = y.namespace AND x.entity < y.entity
 UNION ALL SELECT namespace, a, b FROM (SELECT DISTINCT x.namespace, x.doc, x.entity AS a, y.entity AS b FROM (SELECT DISTINCT namespace, doc, entity
 FROM ents) x JOIN (SELECT DISTINCT namespace, doc, entity FROM ents) y ON x.doc = y.doc AND x.namespace = y.namespace AND x.entity < y.entity)),
counted AS (SELECT namespace, p.a, p.b, coalesce(type, 'UNTYPED') AS edge_type, count(*) AS cnt FROM pairs p LEFT JOIN rels r ON p.a = r.a AND p.b = r.b GROUP BY ALL),
edges AS (SELECT namespace, a AS src, b AS dst, edge_type, cnt FROM counted UNION ALL SELECT namespace, b, a, edge_type, cnt FROM counted)"""
STEPS = """steps AS (SELECT namespace, src, dst, edge_type, 0.5::DOUBLE * cnt / max(cnt) OVER (PARTITION BY namespace, src) * CASE WHEN edge_type = 'UNTYPED' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS step
 FROM edges)"""
SEARCH = f"""l0 AS (SELECT DISTINCT e.namespace, e.entity, 1.0::DOUBLE AS w FROM ents e JOIN names n USING (entity) WHERE n.ord IN ({", ".join(map(str, SEED_ORDS))})),
l1 AS (SELECT s.namespace, s.dst AS entity, max(l.w * s.step) AS w FROM l0 l JOIN steps s ON s.namespace = l.namespace AND s.src = l.entity
 WHERE NOT EXISTS (SELECT 1 FROM l0 z WHERE z.namespace = s.namespace AND z.entity = s.dst) GROUP BY 1, 2),
l01 AS (SELECT * FROM l0 UNION ALL SELECT * FROM l1),
l2 AS (SELECT s.namespace, s.dst AS entity, max(l.w * s.step) AS w FROM l1 l JOIN steps s ON s.namespace = l.namespace AND s.src = l.entity
 WHERE NOT EXISTS (SELECT 1 FROM l01 z WHERE z.namespace = s.namespace AND z.entity = s.dst) GROUP BY 1, 2),
reached AS (SELECT *, 0 AS hop FROM l0 UNION ALL SELECT *, 1 FROM l1 UNION ALL SELECT *, 2 FROM l2),
gscore AS (SELECT e.namespace, e.id, sum(r.w) AS score FROM ents e JOIN reached r ON r.namespace = e.namespace AND r.entity = e.entity GROUP BY 1, 2)"""


def _terms() -> str:
    from collections import Counter

    return ", ".join(f"('{t}', {n})" for t, n in sorted(Counter(QUESTION.split()).items()))


BM25 = f"""q(term, times) AS (VALUES {_terms()}),
nsq AS (SELECT namespace, count(*) AS n, avg(len(t)) AS avgdl FROM toks GROUP BY 1),
post AS (SELECT namespace, id, w AS term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT namespace, id, len(t) AS dl, unnest(t) AS w FROM toks)
 WHERE w IN (SELECT term FROM q) GROUP BY 1, 2, 3),
dfs AS (SELECT namespace, term, count(*) AS df FROM post GROUP BY 1, 2),
kscore AS (SELECT p.namespace, p.id, sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))) AS score
 FROM post p JOIN q USING (term) JOIN dfs USING (namespace, term) JOIN nsq USING (namespace) GROUP BY 1, 2)"""
VSCORE = """qv AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0),
 vscore AS (SELECT lang AS namespace, vec_id AS id,
 round(list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(q, lambda x: x::DOUBLE * x))), 9) AS score
 FROM embeddings JOIN documents ON doc_id = vec_id, qv)"""


def _ranked(name: str, source: str, n: int = 20) -> str:
    return f"{name} AS (SELECT * FROM (SELECT namespace, id, row_number() OVER (PARTITION BY namespace ORDER BY round(score, 9) DESC, id) - 1 AS rank0 FROM {source}) WHERE rank0 < {n})"


def _fused(parts: list[tuple[str, float]]) -> str:
    union = " UNION ALL ".join(f"SELECT namespace, id, {w}::DOUBLE / (61 + rank0) AS s FROM {p}" for p, w in parts)
    return f"fused AS (SELECT namespace, id, sum(s) AS score FROM ({union}) GROUP BY 1, 2)"


def keyword_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bm25.scores(articles(spark, sf_dir), QUESTION).select("namespace", "id", F.round("score", 9).alias("score"))


def vector_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cosine of every article that has a vector with vector 0, in the article's tenant."""
    own = vectors(spark, sf_dir).select("id", "embedding").join(articles(spark, sf_dir).select("id", "namespace"), "id")
    return own.select("namespace", "id", F.round(vector.cosine(F.col("embedding"), asked_vector(spark, sf_dir)), 9).alias("score"))


def asked_vector(spark: SparkSession, sf_dir: str) -> Column:
    """Vector 0 as a literal, as a question's vector comes from an embedder; without one nothing is near."""
    row = vectors(spark, sf_dir).where("id = 0").select("embedding").first()
    return F.array(*[F.lit(float(x)) for x in row[0]]) if row else F.array(F.lit(0.0))


def graph_tables(spark: SparkSession, sf_dir: str) -> tuple[list[str], DataFrame, DataFrame]:
    """Glossary, entities and edges; entities are written once, since edges, seeds and scores all read them."""
    arts = articles(spark, sf_dir)
    names = names_of(arts)
    ents = cut(entities(arts, names))
    return names, ents, graph.typed_edges(ents, relations(spark, names))


def graph_found(spark: SparkSession, sf_dir: str, typed: bool = True) -> DataFrame:
    names, ents, edges = graph_tables(spark, sf_dir)
    wanted = [n for i, n in enumerate(names) if i in SEED_ORDS]
    seeds = ents.where(F.col("entity").isin(wanted)).select("namespace", "entity").distinct()
    return graph.search(ents, graph.links(edges, typed=typed), seeds)


@query(f"""WITH {ARTICLES}, {TOKENS}, {BM25} SELECT namespace, id, round(score, 6) AS score, rank
 FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY round(score, 9) DESC, id) AS rank FROM kscore) WHERE rank <= 10""")
def bm25_topk(spark, d):
    return bm25.topk(keyword_scores(spark, d), 10, ["namespace"]).select("namespace", "id", F.round("score", 6).alias("score"), "rank")


def asked_everywhere(rows: DataFrame) -> DataFrame:
    """The question, put to every tenant."""
    return rows.select("namespace").distinct().select(F.lit(0).cast("long").alias("query_id"), "namespace", F.lit(QUESTION).alias("text"))


@query(ORACLE["bm25_topk"])
def keyword_index_topk(spark, d):
    """The same through an index of blocks that is written and read again; only blocks are read that can reach the tenth score."""
    arts, folder = articles(spark, d), fresh_folder(spark)
    for name, df in keywords.build(arts).items():
        df.write.parquet(f"{folder}/{name}")
    index = keywords.Keywords(*(spark.read.parquet(f"{folder}/{name}") for name in ("blocks", "sums")))
    return keywords.search(index, asked_everywhere(index.sums), 10).select("namespace", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {ARTICLES}, {TOKENS}, w AS (SELECT item_id AS query_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM benchmark),
asked AS (SELECT query_id, term, count(*) AS times FROM w GROUP BY 1, 2),
nsq AS (SELECT namespace, count(*) AS n, avg(len(t)) AS avgdl FROM toks GROUP BY 1),
post AS (SELECT namespace, id, w AS term, count(*) AS tf, any_value(dl) AS dl FROM (SELECT namespace, id, len(t) AS dl, unnest(t) AS w FROM toks)
 WHERE w IN (SELECT term FROM asked) GROUP BY 1, 2, 3),
dfs AS (SELECT namespace, term, count(*) AS df FROM post GROUP BY 1, 2),
s AS (SELECT query_id, namespace, id, round(sum(times * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 9) AS score
 FROM post p JOIN asked USING (term) JOIN dfs USING (namespace, term) JOIN nsq USING (namespace) GROUP BY 1, 2, 3)
SELECT query_id, namespace, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id, namespace ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 5""")
def keyword_index_batch(spark, d):
    """Every passage of the benchmark as a question to every tenant, in one plan."""
    arts, folder = articles(spark, d), fresh_folder(spark)
    for name, df in keywords.build(arts).items():
        df.write.parquet(f"{folder}/{name}")
    index = keywords.Keywords(*(spark.read.parquet(f"{folder}/{name}") for name in ("blocks", "sums")))
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return keywords.search(index, asked, 5).select("query_id", "namespace", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {ARTICLES}, {TOKENS}, n AS (SELECT namespace, count(*) AS n_docs, avg(len(t)) AS avgdl FROM toks GROUP BY 1),
 f AS (SELECT namespace, term, count(*) AS df FROM (SELECT DISTINCT namespace, id, unnest(t) AS term FROM toks) GROUP BY 1, 2)
 SELECT namespace, term, df, n_docs, round(avgdl, 6) AS avgdl FROM f JOIN n USING (namespace)""")
def bm25_term_stats(spark, d):
    return bm25.term_stats(articles(spark, d)).select("namespace", "term", "df", "n_docs", F.round("avgdl", 6).alias("avgdl"))


@query(f"""WITH {ARTICLES}, {TOKENS} SELECT namespace, id, term, count(*) AS tf, any_value(dl) AS dl
 FROM (SELECT namespace, id, len(t)::INTEGER AS dl, unnest(t) AS term FROM toks) GROUP BY 1, 2, 3""")
def bm25_postings(spark, d):
    return bm25.postings(articles(spark, d))


@query("""WITH q AS (SELECT embedding AS q FROM embeddings WHERE vec_id = 0)
 SELECT vec_id AS id,
 round(list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(q, lambda x: x::DOUBLE * x))), 6) AS score
 FROM embeddings, q ORDER BY score DESC, id LIMIT 20""")
def vector_topk(spark, d):
    v = vectors(spark, d)
    scored = v.select("id", F.round(vector.cosine(F.col("embedding"), asked_vector(spark, d)), 6).alias("score"))
    return bm25.topk(scored, 20)


COSINE = """round(list_sum(list_transform(list_zip({a}, {b}), lambda x: x[1]::DOUBLE * x[2]::DOUBLE))
 / sqrt(list_sum(list_transform({a}, lambda x: x::DOUBLE * x)) * list_sum(list_transform({b}, lambda x: x::DOUBLE * x))), {n})"""
NEAREST = f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS id, {COSINE.format(a="e.embedding", b="q.embedding", n=12)} AS score
 FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10"""


def asked_vectors(v: DataFrame) -> DataFrame:
    """The stated queries of a search: every vector whose id is divisible by 100."""
    return v.where("id % 100 = 0").withColumnRenamed("id", "query_id")


@query(NEAREST)
def vector_knn_join(spark, d):
    """A stated set of queries against every vector: a join of blocks of both tables."""
    v = vectors(spark, d)
    return nearest.knn_join(v, asked_vectors(v), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT label::VARCHAR AS namespace, count(*) AS vectors FROM embeddings WHERE len(embedding) = 64 GROUP BY 1")
def vector_stats(spark, d):
    return vector.usable(vectors(spark, d), 64).groupBy("namespace").agg(F.count("*").alias("vectors"))


def _signature_sql() -> str:
    """The signature of ``embedding`` in SQL, with the planes as literals."""
    product = "list_sum(list_transform(list_zip(embedding, {0}), lambda x: x[1]::DOUBLE * x[2]))"
    cuts = ([float(x) for x in p] for p in vector.planes(64))
    return " + ".join(f"({product.format(p)} >= 0)::INTEGER * {1 << i}" for i, p in enumerate(cuts))


@query(f"SELECT label::VARCHAR AS namespace, count(*) AS vectors, count(DISTINCT {_signature_sql()}) AS buckets FROM embeddings GROUP BY 1")
def lsh_stats(spark, d):
    return vector.index_stats(vector.signatures(vectors(spark, d), vector.planes(64)))


@query(NEAREST)
def vector_index_topk(spark, d):
    """The same queries through an index of rings that is written and read again; of its members only those are compared that the bounds leave."""
    v, folder = vectors(spark, d), fresh_folder(spark)
    for name, df in nearest.build(v).tables().items():
        df.write.parquet(f"{folder}/{name}")
    return nearest.search(nearest.Index.read(spark, folder), asked_vectors(v), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"""WITH {ARTICLES}, {TOKENS}, {BM25}, {VSCORE}, {_ranked('vr', 'vscore')}, {_ranked('kr', 'kscore')}, {_fused([('vr', 1.0), ('kr', 1.0)])}
 SELECT namespace, id, round(score, 9) AS score FROM fused""")
def rrf_fuse(spark, d):
    by = ["namespace"]
    parts = [(fusion.ranked(x(spark, d), by, 20), 1.0) for x in (vector_scores, keyword_scores)]
    return fusion.fuse(parts, by).select("namespace", "id", F.round("score", 9).alias("score"))


@query(f"""WITH {ARTICLES}, {TOKENS}, {BM25}, {VSCORE}, {_ranked('vr', 'vscore')}, {_ranked('kr', 'kscore')}, {_fused([('vr', 1.0), ('kr', 1.0)])}
 SELECT namespace, id, round(score, 9) AS score, rank0 FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, id) - 1 AS rank0
 FROM fused) WHERE rank0 < 20""")
def hybrid_topk(spark, d):
    return fusion.hybrid(vector_scores(spark, d), keyword_scores(spark, d), None, 20, ["namespace"]).withColumn("score", F.round("score", 9))


@query(f"""WITH {ARTICLES}, {TOKENS}, {BM25}, {VSCORE}, {GLOSSARY}, {ENTITIES}, {RELATIONS}, {EDGES}, {STEPS}, {SEARCH}, {_ranked('vr', 'vscore')},
 {_ranked('kr', 'kscore')}, {_ranked('gr', 'gscore')}, {_fused([('vr', 1.0), ('kr', 1.0), ('gr', 2.0)])}
 SELECT namespace, id, round(score, 9) AS score, rank0 FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY score DESC, id) - 1 AS rank0
 FROM fused) WHERE rank0 < 20""")
def hybrid_graph_weighted(spark, d):
    found = graph_found(spark, d).select("namespace", "id", F.round("score", 9).alias("score"))
    return fusion.hybrid(vector_scores(spark, d), keyword_scores(spark, d), found, 20, ["namespace"]).withColumn("score", F.round("score", 9))


MMR = f"""cand AS (SELECT v.namespace, v.id, rank0, embedding, count(*) OVER (PARTITION BY v.namespace) AS n FROM vr v JOIN embeddings e ON e.vec_id = v.id),
lead AS (SELECT namespace, embedding AS q FROM cand WHERE rank0 = 0),
val AS (SELECT c.namespace, id, rank0, round(0.6::DOUBLE * (1 - rank0 / n) - 0.4::DOUBLE * greatest(0.0,
 list_sum(list_transform(list_zip(embedding, q), lambda x: x[1]::DOUBLE * x[2]::DOUBLE)) / sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x)) * list_sum(list_transform(q, lambda x: x::DOUBLE * x)))), 9) AS mmr
 FROM cand c JOIN lead USING (namespace) WHERE rank0 > 0)
SELECT namespace, id, 0 AS rank0 FROM cand WHERE rank0 = 0 UNION ALL SELECT namespace, id, 1 FROM (SELECT *,
 row_number() OVER (PARTITION BY namespace ORDER BY mmr DESC, rank0) AS r FROM val) WHERE r = 1"""


def candidates(spark, d):
    best = fusion.ranked(vector_scores(spark, d), ["namespace"], 20)
    return best.join(vectors(spark, d).select("id", "embedding"), "id").select(F.col("namespace").alias("query_id"), "id", F.col("rank0").cast("int").alias("rank0"), "embedding")


@query(f"WITH {VSCORE}, {_ranked('vr', 'vscore')}, {MMR}")
def mmr_top2(spark, d):
    return rerank.mmr_two(candidates(spark, d)).select(F.col("query_id").alias("namespace"), "id", "rank0")


@query(f"WITH {VSCORE}, {_ranked('vr', 'vscore')}, {MMR}")
def mmr_general(spark, d):
    return rerank.mmr(candidates(spark, d), 2).select(F.col("query_id").alias("namespace"), "id", "rank0")


@query(f"WITH {VSCORE}, {_ranked('vr', 'vscore')} SELECT namespace, id, rank0 FROM vr WHERE rank0 < 2")
def rerank_none(spark, d):
    return rerank.none(candidates(spark, d), 2).select(F.col("query_id").alias("namespace"), "id", "rank0")


@query(f"WITH {VSCORE}, {_ranked('vr', 'vscore')} SELECT namespace, id, (CASE rank0 WHEN 3 THEN 0 ELSE 1 END)::INTEGER AS rank0 FROM vr WHERE rank0 IN (1, 3)")
def llm_rerank(spark, d):
    """The model's reply names the fourth and the second candidate."""
    asked = candidates(spark, d).join(articles(spark, d).select("id", "summary"), "id").withColumn("question", F.lit(QUESTION))
    return rerank.llm(asked, 2, lambda prompt: "3, 1").select(F.col("query_id").alias("namespace"), "id", "rank0")


@query(rf"""WITH {ARTICLES}, {VSCORE}, {_ranked("vr", "vscore")},
shared AS (SELECT v.namespace, v.id, rank0, len(list_intersect({sorted(set(QUESTION.split()))}, regexp_extract_all(substr(summary, 1, 512), '\S+'))) AS n
 FROM vr v JOIN articles a USING (id))
SELECT namespace, id, (row_number() OVER (PARTITION BY namespace ORDER BY n DESC, rank0) - 1)::INTEGER AS rank0 FROM shared
QUALIFY row_number() OVER (PARTITION BY namespace ORDER BY n DESC, rank0) <= 2""")
def cross_rerank(spark, d):
    """The model counts the words that question and passage share."""
    asked = candidates(spark, d).join(articles(spark, d).select("id", "summary"), "id").withColumn("question", F.lit(QUESTION))
    best = rerank.cross(asked, 2, lambda rows: [len(set(q.split()) & set(p.split())) for q, p in rows])
    return best.select(F.col("query_id").alias("namespace"), "id", "rank0")


@query(f"WITH {ARTICLES}, {TOKENS}, {GLOSSARY}, {ENTITIES} SELECT namespace, id, entity FROM ents")
def graph_entities(spark, d):
    arts = articles(spark, d)
    return entities(arts, names_of(arts)).select("namespace", "id", "entity")


@query(f"WITH {ARTICLES}, {TOKENS}, {GLOSSARY}, {ENTITIES}, {RELATIONS}, {EDGES} SELECT namespace, src, dst, sum(cnt)::BIGINT AS cnt FROM edges GROUP BY 1, 2, 3")
def graph_edges(spark, d):
    return graph_tables(spark, d)[2].groupBy("namespace", "src", "dst").agg(F.sum("cnt").alias("cnt"))


@query(f"WITH {ARTICLES}, {TOKENS}, {GLOSSARY}, {ENTITIES}, {RELATIONS}, {EDGES} SELECT namespace, src, dst, edge_type, cnt FROM edges")
def graph_typed_edges(spark, d):
    return graph_tables(spark, d)[2].select("namespace", "src", "dst", "edge_type", "cnt")


@query(f"WITH {ARTICLES}, {TOKENS}, {GLOSSARY}, {ENTITIES}, {RELATIONS}, {EDGES}, {STEPS}, {SEARCH} SELECT namespace, id, round(score, 9) AS score FROM gscore")
def graph_search(spark, d):
    return graph_found(spark, d).select("namespace", "id", F.round("score", 9).alias("score"))


PATHS = """p0 AS (SELECT namespace, entity, w, '' AS path FROM l0),
p1 AS (SELECT * FROM (SELECT s.namespace, s.dst AS entity, p.w * s.step AS w, s.src || ' -' || s.edge_type || '-> ' || s.dst AS path,
 row_number() OVER (PARTITION BY s.namespace, s.dst ORDER BY p.w * s.step DESC, s.src) AS r
 FROM p0 p JOIN steps s ON s.namespace = p.namespace AND s.src = p.entity WHERE (s.namespace, s.dst) NOT IN (SELECT (namespace, entity) FROM l0)) WHERE r = 1),
p2 AS (SELECT * FROM (SELECT s.namespace, s.dst AS entity, p.w * s.step AS w, p.path || '; ' || s.src || ' -' || s.edge_type || '-> ' || s.dst AS path,
 row_number() OVER (PARTITION BY s.namespace, s.dst ORDER BY p.w * s.step DESC, s.src) AS r
 FROM p1 p JOIN steps s ON s.namespace = p.namespace AND s.src = p.entity WHERE (s.namespace, s.dst) NOT IN (SELECT (namespace, entity) FROM l01)) WHERE r = 1),
told AS (SELECT namespace, entity, w, path, 0 AS hop FROM p0 UNION ALL SELECT namespace, entity, w, path, 1 FROM p1 UNION ALL
 SELECT namespace, entity, w, path, 2 FROM p2)"""


@query(f"""WITH {ARTICLES}, {TOKENS}, {GLOSSARY}, {ENTITIES}, {RELATIONS}, {EDGES}, {STEPS}, {SEARCH}, {PATHS}
SELECT e.namespace, e.id, t.entity AS best_entity, t.path FROM ents e JOIN told t ON t.namespace = e.namespace AND t.entity = e.entity
QUALIFY row_number() OVER (PARTITION BY e.namespace, e.id ORDER BY t.w DESC, t.hop, t.entity) = 1""")
def graph_paths(spark, d):
    return graph_found(spark, d).select("namespace", "id", "best_entity", graph.path_text(F.col("path")).alias("path"))


@query(f"""WITH {ARTICLES}, {TOKENS}, {GLOSSARY}, {ENTITIES}, {RELATIONS}, {EDGES},
 {STEPS.replace('0.5::DOUBLE * cnt / max(cnt) OVER (PARTITION BY namespace, src) * CASE WHEN edge_type = ' + chr(39) + 'UNTYPED' + chr(39) + ' THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END', '0.5::DOUBLE')},
 {SEARCH} SELECT namespace, id, round(score, 9) AS score FROM gscore""")
def graph_search_untyped(spark, d):
    """The older form: a half for each hop, whatever the edge."""
    return graph_found(spark, d, typed=False).select("namespace", "id", F.round("score", 9).alias("score"))


@query(f"""WITH {ARTICLES}, {TOKENS}, {GLOSSARY}, {ENTITIES}, {RELATIONS}, {EDGES}
SELECT n.namespace, n.entities, n.articles, coalesce(e.edges, 0) AS edges, coalesce(e.typed_cnt, 0) AS typed_cnt,
 coalesce(e.total_cnt, 0) AS total_cnt FROM (SELECT namespace, count(DISTINCT entity) AS entities, count(DISTINCT id) AS articles FROM ents
 GROUP BY 1) n
LEFT JOIN (SELECT namespace, count(*) AS edges, sum(CASE WHEN edge_type <> 'UNTYPED' THEN cnt ELSE 0 END)::BIGINT AS typed_cnt,
 sum(cnt)::BIGINT AS total_cnt FROM edges WHERE src < dst GROUP BY 1) e USING (namespace)""")
def graph_stats(spark, d):
    _, ents, edges = graph_tables(spark, d)
    return graph.stats(ents, edges)


@query(f"""WITH {ARTICLES} SELECT namespace, doc AS base, count(*) AS chunks, arg_min(url, id) AS url, array_to_string(list_sort(list(id)), ',') AS ids
 FROM articles GROUP BY 1, 2""")
def doc_rollup(spark, d):
    return governance.documents(articles(spark, d)).select("namespace", "base", "chunks", "url", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"))


@query(f"WITH {ARTICLES} SELECT namespace, count(*) AS n FROM articles GROUP BY 1")
def ns_count(spark, d):
    return articles(spark, d).groupBy("namespace").agg(F.count("*").alias("n"))


@query(f"WITH {LOG} SELECT model, count(*) AS calls, floor(avg(latency_ms) + 0.5)::BIGINT AS avg_latency_ms FROM log GROUP BY 1")
def stats_by_model(spark, d):
    return governance.by_model(query_log(spark, d))


@query(f"""WITH {LOG}
 SELECT count(*) AS total_calls, floor(coalesce(avg(latency_ms), 0) + 0.5)::BIGINT AS avg_latency_ms, coalesce(sum(pii_count), 0)::BIGINT AS total_pii
 FROM log""")
def stats_totals(spark, d):
    return governance.totals(query_log(spark, d))


@query(f"WITH {LOG} SELECT feedback, count(*) AS n FROM log WHERE feedback IS NOT NULL GROUP BY 1")
def feedback_counts(spark, d):
    return governance.feedback(query_log(spark, d))


@query(f"""WITH {ARTICLES}, c AS (SELECT namespace, doc, CASE WHEN arg_min(url, id) LIKE 'image://%' THEN 'image'
 WHEN arg_min(url, id) LIKE 'file://%' THEN 'file' ELSE 'wikipedia' END AS source_type, count(*) AS chunks
 FROM articles GROUP BY 1, 2) SELECT source_type, count(*) AS docs, sum(chunks)::BIGINT AS chunks FROM c GROUP BY 1""")
def stats_by_source_type(spark, d):
    return governance.by_source_type(governance.catalogue(articles(spark, d), "hashing"))


@query(f"""WITH {LOG}
 SELECT strftime(created_at, '%Y-%m-%d') AS day, count(*) AS calls, floor(avg(latency_ms) + 0.5)::BIGINT AS avg_latency_ms, max(latency_ms) AS max_latency_ms
 FROM log GROUP BY 1""")
def audit_by_day(spark, d):
    return governance.by_day(query_log(spark, d)).withColumn("day", F.col("day").cast("string"))


@query(f"WITH {LOG} SELECT hour(created_at)::INTEGER AS hour, count(*) AS calls, count(DISTINCT model) AS models FROM log GROUP BY 1")
def audit_by_hour(spark, d):
    return governance.by_hour(query_log(spark, d))


@query(f"WITH {LOG} SELECT id, model, latency_ms FROM log ORDER BY latency_ms DESC, id LIMIT 10")
def slowest10(spark, d):
    return governance.slowest(query_log(spark, d)).select("id", "model", "latency_ms")


@query(f"WITH {LOG} SELECT id, model, created_at FROM log ORDER BY created_at DESC, id DESC LIMIT 50")
def audit_recent(spark, d):
    return governance.recent(query_log(spark, d)).select("id", "model", "created_at")


@query(f"WITH {LOG} SELECT id, question, sources, pii_count FROM log WHERE lower(question) LIKE '%question 1%' AND sources || ' ' LIKE '%#5 %' AND pii_count > 0")
def audit_search(spark, d):
    return governance.mentioning(query_log(spark, d), "Question 1", 5, with_pii=True).select("id", "question", "sources", "pii_count")


def _pii_sql(column: str) -> tuple[str, str]:
    """Masked text and count in SQL, each pattern over what the ones before have left."""
    text, counts = column, []
    for tag, pattern in X.PII:
        counts.append(f"len(regexp_extract_all({text}, '{pattern}'))")
        text = f"regexp_replace({text}, '{pattern}', '{tag}', 'g')"
    return text, " + ".join(counts)


@query(f"SELECT doc_id, {_pii_sql('text')[0]} AS text FROM documents")
def pii_redact(spark, d):
    return table(spark, d, "documents").select("doc_id", X.pii_text(F.col("text")).alias("text"))


@query(f"SELECT doc_id, ({_pii_sql('text')[1]})::INTEGER AS pii_count FROM documents")
def pii_count(spark, d):
    return table(spark, d, "documents").select("doc_id", X.pii_count(F.col("text")).alias("pii_count"))


@query("""WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents), c AS (SELECT doc_id, unnest(range(0, CASE
 WHEN n <= 1000 THEN 1 ELSE ceil((n - 1000) / 850.0)::BIGINT + 1 END)) AS i, text FROM n)
SELECT doc_id, i::INTEGER AS pos, regexp_replace(substr(text, (i * 850 + 1)::BIGINT, 1000), '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g') AS chunk
 FROM c WHERE regexp_matches(substr(text, (i * 850 + 1)::BIGINT, 1000), '[^\\x00-\\x20]')""")
def chunk_fixed(spark, d):
    return chunk.chunked(table(spark, d, "documents").select("doc_id", "text"), "text", 1000, "fixed")


def recursive_sql(source: str, key: str, size: int = 1000) -> str:
    """CTEs from ``source`` (key, text) to ``chunks`` (key, pos, chunk): a level for each separator, each a fold over the parts of what is too long."""
    blank = "regexp_replace({0}, '^[\\x00-\\x20]+|[\\x00-\\x20]+$', '', 'g')"
    told = [f"l0 AS (SELECT {key}, []::INTEGER[] AS ord, text AS p FROM {source} WHERE text IS NOT NULL)"]
    for k, sep in enumerate(chunk.SEPARATORS):
        lit = " || ".join("chr(10)" if c == "\n" else f"'{c}'" for c in sep)
        parts = f"string_split(p, {lit})"
        told.append(f"""s{k} AS (SELECT {key}, ord, list_filter({parts}, lambda x, i: i <= list_max(list_transform({parts}, lambda y, j: CASE WHEN y <> '' THEN j ELSE 0 END))) AS parts
 FROM l{k} WHERE length(p) > {size}),
f{k} AS (SELECT {key}, ord, 1 AS i, 0 AS g, length(parts[1]) + {len(sep)} AS n, parts FROM s{k} WHERE len(parts) > 0
 UNION ALL SELECT {key}, ord, i + 1, CASE WHEN n + length(parts[i + 1]) > {size} THEN g + 1 ELSE g END,
 CASE WHEN n + length(parts[i + 1]) > {size} THEN 0 ELSE n END + length(parts[i + 1]) + {len(sep)}, parts FROM f{k} WHERE i < len(parts)),
l{k + 1} AS (SELECT {key}, list_append(ord, 0) AS ord, p FROM l{k} WHERE length(p) <= {size}
 UNION ALL SELECT {key}, list_append(ord, g), string_agg(parts[i] || {lit}, '' ORDER BY i) FROM f{k} GROUP BY {key}, ord, g)""")
    told.append(f"""cut AS (SELECT {key}, list_append(ord, 0) AS ord, {blank.format("p")} AS chunk, false AS hard FROM l4 WHERE length(p) <= {size}
 UNION ALL SELECT {key}, list_append(ord, i::INTEGER), {blank.format(f"substr(p, (i * {size} + 1)::BIGINT, {size})")}, true
 FROM (SELECT {key}, ord, p, unnest(range(0, ceil(length(p) / {size}.0)::BIGINT)) AS i FROM l4 WHERE length(p) > {size})),
chunks AS (SELECT {key}, (row_number() OVER (PARTITION BY {key} ORDER BY ord) - 1)::INTEGER AS pos, chunk FROM cut WHERE hard OR chunk <> '')""")
    return ",\n".join(told)


@query(f"WITH RECURSIVE {recursive_sql('documents', 'doc_id')} SELECT doc_id, pos, chunk FROM chunks")
def chunk_recursive(spark, d):
    return chunk.chunked(table(spark, d, "documents").select("doc_id", "text"), "text", 1000, "recursive")


#: Letters whose counts are a sentence's vector where SQL must be able to say it.
LETTERS = "aeinorst"


def letter_counts(texts: list[str]) -> list[list[float]]:
    return [[float(t.count(x)) for x in LETTERS] for t in texts]


_COUNTS = "[" + ", ".join(f"length(s) - length(replace(s, '{x}', ''))" for x in LETTERS) + "]"


@query(rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_replace(regexp_replace(text, '([.!?])[ \t\n\x0b\f\r]+', '\1' || chr(1), 'g'), '\n{{2,}}', chr(1), 'g') AS t FROM documents),
p AS (SELECT doc_id, string_split(t, chr(1)) AS p FROM w),
d AS (SELECT doc_id, list_filter(p, lambda x, i: i <= greatest(1, list_max(list_transform(p, lambda y, j: CASE WHEN y <> '' THEN j ELSE 0 END)))) AS p FROM p),
e AS (SELECT doc_id, i, s, {_COUNTS} AS v FROM (SELECT doc_id, unnest(p) AS s, unnest(range(1, len(p) + 1)) AS i FROM d)),
n AS (SELECT a.doc_id, b.i, CASE WHEN list_sum(a.v) = 0 OR list_sum(b.v) = 0 THEN 0.0 ELSE
 list_sum(list_transform(list_zip(a.v, b.v), lambda x: x[1]::DOUBLE * x[2]))
 / (sqrt(list_sum(list_transform(a.v, lambda x: x::DOUBLE * x))) * sqrt(list_sum(list_transform(b.v, lambda x: x::DOUBLE * x)))) END AS near
 FROM e a JOIN e b ON a.doc_id = b.doc_id AND b.i = a.i + 1),
q AS (SELECT doc_id, list_sort(list(near)) AS l FROM n GROUP BY 1),
t AS (SELECT e.doc_id, e.i, e.s, n.near < q.l[floor(0.25 * (len(q.l) - 1))::INTEGER + 1] AS low FROM e LEFT JOIN n ON n.doc_id = e.doc_id AND n.i = e.i LEFT JOIN q ON q.doc_id = e.doc_id),
f AS (SELECT doc_id, i, s, length(s) AS n, 0 AS g FROM t WHERE i = 1
 UNION ALL SELECT t.doc_id, t.i, t.s, CASE WHEN low OR n + length(t.s) > 1000 THEN 0 ELSE n + 1 END + length(t.s), CASE WHEN low OR n + length(t.s) > 1000 THEN g + 1 ELSE g END
 FROM f JOIN t ON t.doc_id = f.doc_id AND t.i = f.i + 1)
SELECT doc_id, g AS pos, regexp_replace(string_agg(s, ' ' ORDER BY i), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS chunk FROM f GROUP BY 1, 2""")
def chunk_semantic(spark, d):
    return chunk.chunked(table(spark, d, "documents").select("doc_id", "text"), "text", 1000, "semantic", letter_counts)


@query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '\b[A-Z][A-Z0-9-]{1,7}\b'), ',') AS found FROM documents")
def acronym_scan(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(X.acronyms(F.col("text")), ",").alias("found"))


_DEFINED = f"list_zip(regexp_extract_all(t, '{X.DEFINITION}', 2), regexp_extract_all(t, '{X.DEFINITION}', 1))"


@query(f"""WITH d AS (SELECT doc_id, 'AI: ' || text AS t FROM documents)
SELECT doc_id, t || CASE WHEN contains(t, 'Artificial Intelligence') THEN '' ELSE chr(10) || 'Artificial Intelligence (AI)' END AS text,
 len(list_distinct(list_transform(list_filter({_DEFINED}, lambda p: upper(p[1][1]) = upper(p[2][1])), lambda p: p[1])))::INTEGER AS n_defined FROM d""")
def acronym_expand(spark, d):
    defined = F.array(F.struct(F.lit("AI").alias("acronym"), F.lit("Artificial Intelligence").alias("full")))
    docs = table(spark, d, "documents").select("doc_id", F.concat(F.lit("AI: "), "text").alias("text"))
    return docs.select("doc_id", X.expand_acronyms(F.col("text"), defined).alias("text"), F.size(X.definitions(F.col("text"))).alias("n_defined"))


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN 'search_query: '
 WHEN event_type = 'view' THEN 'Represent this sentence for searching relevant passages: ' ELSE '' END AS query_prefix, CASE
 WHEN event_type = 'click' THEN 'search_document: ' ELSE '' END AS document_prefix
 FROM events""")
def embed_prefix(spark, d):
    model = F.when(F.col("event_type") == "click", "NOMIC-embed-text").when(F.col("event_type") == "view", "mxbai-embed-large").when(F.col("event_type") == "error", "granite-embedding:278m")
    return table(spark, d, "events").select("event_id", X.prefix(model, "query").alias("query_prefix"), X.prefix(model, "document").alias("document_prefix"))


@query("""WITH f AS (SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'A.HWP' WHEN 1 THEN 'b.HwpX' WHEN 2 THEN 'c.hwp.pdf' ELSE 'd' END AS name FROM documents)
 SELECT doc_id, CASE WHEN lower(name) LIKE '%.hwpx' THEN 'HWPX' WHEN lower(name) LIKE '%.hwp' THEN 'HWP' ELSE 'TIKA' END AS route FROM f""")
def format_router(spark, d):
    k = F.col("doc_id") % 4
    name = F.when(k == 0, "A.HWP").when(k == 1, "b.HwpX").when(k == 2, "c.hwp.pdf").otherwise("d")
    return table(spark, d, "documents").select("doc_id", X.extractor(name).alias("route"))


@query("SELECT page_id, CASE WHEN url LIKE 'image://%' THEN 'image' WHEN url LIKE 'file://%' THEN 'file' ELSE 'wikipedia' END AS source_type FROM pages")
def source_type(spark, d):
    return table(spark, d, "pages").select("page_id", X.source_type(F.col("url")).alias("source_type"))


#: Web pages as what the tenants hold already: their ids deal them over languages and titles.
KNOWN = "known AS (SELECT DISTINCT ['de', 'en', 'es', 'fr'][page_id % 4 + 1] AS lang, 'src' || (page_id // 4 % 13) AS title FROM pages)"


def known_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    langs = F.get(F.array(*[F.lit(x) for x in ("de", "en", "es", "fr")]), (F.col("page_id") % 4).cast("int"))
    number = (F.floor(F.col("page_id") / 4) % 13).cast("string")
    return table(spark, sf_dir, "pages").select(langs.alias("namespace"), number.alias("number"), F.col("page_id").alias("id"))


@query(f"""WITH {KNOWN} SELECT doc_id, lang, source FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.lang = d.lang AND k.title = lower(d.source))""")
def title_dedupe(spark, d):
    docs = table(spark, d, "documents").select("doc_id", F.col("lang").alias("namespace"), F.upper("source").alias("title"), "source")
    known = known_pages(spark, d).select("namespace", F.concat(F.lit("Src"), "number", F.lit("_")).alias("title"))
    return store.title_clash(docs, known).select("doc_id", F.col("namespace").alias("lang"), "source")


@query(f"""WITH {KNOWN} SELECT DISTINCT lang AS namespace, source AS title FROM documents d
WHERE NOT EXISTS (SELECT 1 FROM known k WHERE k.lang = d.lang AND k.title = d.source)""")
def file_dedupe(spark, d):
    known = known_pages(spark, d).select("namespace", F.concat(F.lit("src"), "number", F.lit(" #"), F.col("id").cast("string")).alias("title"))
    return ingest.new_files(articles(spark, d).select("namespace", F.col("doc").alias("title")).distinct(), known)


@query(f"WITH {ARTICLES} SELECT id, namespace, title FROM articles WHERE id % 2 = 0 UNION ALL SELECT id, namespace, title FROM articles WHERE id % 2 = 1")
def tiered_scan(spark, d):
    arts = articles(spark, d)
    return store.tiered(arts.where("id % 2 = 0"), arts.where("id % 2 = 1").drop("ingested_at")).select("id", "namespace", "title")


@query(f"WITH {ARTICLES} SELECT id, namespace, title FROM articles WHERE NOT (namespace = 'en' AND doc = 'src1')")
def delete_document(spark, d):
    arts = articles(spark, d)
    gone = arts.where((F.col("namespace") == "en") & (X.base_title(F.col("title")) == "src1")).select("id")
    return store.without(arts, gone).select("id", "namespace", "title")


@query("SELECT source AS title, lang AS namespace, count(*)::INTEGER AS chunks FROM documents d WHERE source <> 'src1' GROUP BY 1, 2")
def catalog_hydrate(spark, d):
    whole = governance.catalogue(articles(spark, d), "hashing")
    return governance.missing(whole, whole.where("title = 'src1'")).select("title", "namespace", "chunks")


@query("SELECT coalesce(max(doc_id), 0) + 1 AS next_id FROM documents")
def next_id(spark, d):
    return articles(spark, d).agg((F.coalesce(F.max("id"), F.lit(0)) + 1).alias("next_id"))


@query(f"WITH {ARTICLES} SELECT id, namespace FROM articles WHERE namespace IN ('en', 'fr')")
def tenant_filter(spark, d):
    return security.visible(articles(spark, d), {"en", "fr"}).select("id", "namespace")


TOP2 = f"top2 AS (SELECT namespace, id, rank0 FROM ({_ranked('x', 'kscore', 2).removeprefix('x AS (').removesuffix(')')}))"


@query(f"""WITH {ARTICLES}, {TOKENS}, {BM25}, {TOP2} SELECT t.namespace, string_agg('#' || t.id || ' ' || title, '; ' ORDER BY rank0) AS sources FROM top2 t
 JOIN articles a USING (id) GROUP BY 1""")
def provenance(spark, d):
    top = fusion.ranked(keyword_scores(spark, d), ["namespace"], 2).join(articles(spark, d).select("id", "title"), "id")
    return top.groupBy("namespace").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank0", F.concat(F.lit("#"), F.col("id").cast("string"), F.lit(" "), F.col("title")).alias("s")))), lambda x: x["s"]), "; ").alias("sources"))


@query(f"""WITH {ARTICLES}, {TOKENS}, {BM25}, {TOP2}
 SELECT t.namespace, string_agg('- ' || title || ': ' || substr(summary, 1, 600) || chr(10), '' ORDER BY rank0) AS context FROM top2 t
 JOIN articles a USING (id) GROUP BY 1""")
def context_assembly(spark, d):
    from ..api import context

    top = fusion.ranked(keyword_scores(spark, d), ["namespace"], 2).join(articles(spark, d).select("id", "title", "summary"), "id")
    return context(top, ["namespace"])


@query(f"""WITH s AS (SELECT vec_id, label, embedding AS a, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS b FROM embeddings),
c AS (SELECT label, vec_id, {COSINE.format(a="a", b="b", n=9)} AS sim FROM s WHERE b IS NOT NULL),
p AS (SELECT label, list_sort(list(sim)) AS v FROM c GROUP BY 1)
SELECT c.label, vec_id, round(sim, 6) AS sim, sim < v[(floor(0.25 * (len(v) - 1)) + 1)::INTEGER] AS breaks FROM c JOIN p USING (label)""")
def semantic_breaks(spark, d):
    """Neighbours and the lower quartile without a window over a whole label: blocks of ids hand on their first row, bins their counts."""
    e = ranks.with_next(table(spark, d, "embeddings").select("label", "vec_id", "embedding"), "label", "vec_id", "embedding", into="b").where("b IS NOT NULL")
    sims = cut(e.select("label", "vec_id", F.round(vector.cosine(F.col("embedding"), F.col("b")), 9).alias("sim")))
    low = ranks.nearest_rank(sims, "label", "sim", chunk.LOW_SHARE, -1.0, 1.0).withColumnRenamed("sim", "low")
    return sims.join(low, "label").select("label", "vec_id", F.round("sim", 6).alias("sim"), (F.col("sim") < F.col("low")).alias("breaks"))


@query("""WITH h AS (SELECT d.lang AS category, l.doc_id AS case_id, contains(lower(d.text), 'the ') AND contains(lower(d.text), 'tion') AS hit FROM labels l
 JOIN documents d USING (doc_id))
SELECT category, count(*) AS n, count(*) FILTER (hit) AS hits, round(avg(hit::INTEGER), 6) AS recall FROM h GROUP BY 1""")
def recall_sweep(spark, d):
    cases = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("lang").alias("category"), F.col("doc_id").alias("case_id"), evaluate.all_keywords(F.col("text"), F.array(F.lit("The "), F.lit("TION"))).alias("hit"))
    return evaluate.recall(cases, "category").select("category", "n", "hits", F.round("recall", 6).alias("recall"))


@query("SELECT event_id, coalesce(nullif(regexp_extract(props, '[1-5]'), '')::INTEGER, 0) AS score FROM events")
def judge_scores(spark, d):
    return table(spark, d, "events").select("event_id", F.coalesce(evaluate.judge_score(F.col("props")), F.lit(0)).alias("score"))


@query("""SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer
 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant'""")
def conversation_pairs(spark, d):
    return governance.paired(table(spark, d, "conversations"))


_BARE = r"(?is)<script\b.*?</script\s*>|<style\b.*?</style\s*>|<head\b.*?</head\s*>|<!--.*?-->"
HTML = f"regexp_replace(regexp_replace(html, '{_BARE}', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g')"
for _entity, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    HTML = f"replace({HTML}, '{_entity}', '{_sign}')"


@query(rf"SELECT page_id, trim(regexp_replace({HTML}, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS text FROM pages")
def html_extract(spark, d):
    return table(spark, d, "pages").select("page_id", files.html_text(F.col("html")).alias("text"))


def first_source(prompt: str, model: str | None = None) -> str:
    """A model that answers with the beginning of the best source it was given."""
    return prompt.split("\n")[1][:60]


@query(f"""WITH {ARTICLES}, {TOKENS}, {BM25}, {TOP2} SELECT namespace, substr(split_part('- ' || title || ': ' || substr(summary, 1, 600), chr(10), 1), 1, 60) AS answer, 'ok' AS status
 FROM top2 JOIN articles USING (namespace, id) WHERE rank0 = 0""")
def ask_batch(spark, d):
    """A question to every tenant; the answer is what the model makes of the sources that were found."""
    from ..api import ask_all

    top = fusion.ranked(keyword_scores(spark, d), ["namespace"], 2).join(articles(spark, d).select("id", "title", "summary"), "id")
    return ask_all(top, QUESTION, ["namespace"], first_source)


@query(rf"""WITH RECURSIVE pages_text AS (SELECT page_id, trim(regexp_replace({HTML}, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS text FROM pages),
{recursive_sql('pages_text', 'page_id')}
SELECT 'web' AS namespace, 'page ' || page_id || ' #' || (pos + 1) AS title, chunk AS summary, url, TIMESTAMP '2024-01-01 00:00:00' AS ingested_at FROM chunks JOIN pages USING (page_id)""")
def ingest_pages(spark, d):
    """Chunks of web pages, as ingest stores them. The pages define no acronyms, so the SQL leaves those out."""
    pages = table(spark, d, "pages").select(F.lit("web").alias("namespace"), F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), "url", files.html_text(F.col("html")).alias("text"))
    return ingest.chunks(pages, at=F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")).drop("embedding")


def _domain_sql() -> str:
    """Names, acronyms and laws of the default glossary. RE2 can't look ahead, so the pattern takes the next letter in and what ends with one goes."""
    own = glossary.Glossary()
    acronyms = "MAP {" + ", ".join(f"'{a}': '{f}'" for a, f in own.acronyms.items()) + "}"
    full = f"list_filter(list_transform(regexp_extract_all(t, '{X.ACRONYM}'), lambda a: {acronyms}[a]), lambda x: x IS NOT NULL)"
    laws = "list_filter(regexp_extract_all(t, '[가-힣]{2,}법[인률]?(?:[ \\t\\n]*시행령|[ \\t\\n]*시행규칙)?'), lambda x: NOT regexp_matches(x, '법[인률]$'))"
    bare = f"list_transform({laws}, lambda x: regexp_replace(x, '[ \\t\\n]*(시행령|시행규칙)$', ''))"
    return f"""WITH p AS (SELECT page_id AS id, 'KRX 자본시장법 시행령 ' || html AS t FROM pages)
SELECT DISTINCT 'web' AS namespace, id, unnest(list_concat(list_filter({own.names()}, lambda e: contains(t, e)), {full}, {bare})) AS entity FROM p"""


@query(_domain_sql())
def domain_entities(spark, d):
    """The default glossary against the web pages, with two names put in so that it has something to find."""
    text = F.concat(F.lit("KRX 자본시장법 시행령 "), "html").alias("text")
    return glossary.article_entities(table(spark, d, "pages").select(F.lit("web").alias("namespace"), F.col("page_id").alias("id"), text))


def _sql(name: str, text: str, duck: str | None = None, rows: int | None = None) -> None:
    """A query by the guarded SQL surface (``run_select``, with ``rows`` as its cap) over temporary views of the tables it names."""

    def run(spark, d):
        for t in set(re.findall(r"\b(region|nation|customer|supplier|part|orders|lineitem|events)\b", text)):
            table(spark, d, t).createOrReplaceTempView(t)
        return tabular.run_select(spark, text, strict=True, rows=rows)

    QUERIES[name], ORACLE[name] = run, duck or text


_sql("sql_avg_sum_count", """SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS qty, round(avg(l_discount), 6) AS disc,
 round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02 00:00:00'
 GROUP BY l_returnflag, l_linestatus""")
_sql("sql_join_agg", """SELECT n_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey
 JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY n_name HAVING count(*) > 1""")
_sql("sql_semi_anti", """SELECT c_custkey, c_mktsegment FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')
 AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')""")
_sql("sql_rollup_cube", """SELECT coalesce(c_mktsegment, 'all') AS c_mktsegment, coalesce(c_nationkey, -1) AS c_nationkey, count(*) AS n, grouping(c_mktsegment) AS g
 FROM customer GROUP BY CUBE (customer.c_mktsegment, customer.c_nationkey)""", """SELECT coalesce(c_mktsegment, 'all') AS c_mktsegment, coalesce(c_nationkey, -1) AS c_nationkey, count(*) AS n, grouping(c_mktsegment)::TINYINT AS g
 FROM customer GROUP BY CUBE (customer.c_mktsegment, customer.c_nationkey)""")
_sql("sql_window_rank", """SELECT o_custkey, o_orderkey, rk FROM (SELECT o_custkey, o_orderkey,
 row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rk FROM orders) t WHERE rk <= 3""")
_sql("sql_window_frame", """SELECT o_custkey, o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING
 AND CURRENT ROW), 2) AS moving FROM orders""")
_sql("sql_setops", """SELECT k FROM ((SELECT n_nationkey AS k FROM nation EXCEPT SELECT c_nationkey FROM customer WHERE c_acctbal > 9900) UNION ALL (SELECT s_nationkey AS k
 FROM supplier INTERSECT SELECT c_nationkey FROM customer)) t""")
_sql("sql_cte_subquery", """WITH avgs AS (SELECT p_brand, avg(p_retailprice) AS a FROM part GROUP BY p_brand) SELECT p.p_partkey, p.p_brand,
 round(p.p_retailprice - a, 4) AS over_avg FROM part p JOIN avgs ON p.p_brand = avgs.p_brand WHERE p.p_retailprice > (SELECT avg(p_retailprice)
 FROM part)""")
_sql("sql_json", "SELECT event_type, sum(CAST(get_json_object(props, '$.k') AS INT)) AS k FROM events GROUP BY event_type", "SELECT event_type, sum(CAST(json_extract_string(props, '$.k') AS INTEGER))::BIGINT AS k FROM events GROUP BY event_type")
_sql("sql_recursive", """WITH RECURSIVE r(n, place, steps) AS (SELECT n_nationkey, n_regionkey, 1 FROM nation
 UNION ALL SELECT r.n, nation.n_regionkey, steps + 1 FROM r JOIN nation ON n_nationkey = r.place WHERE nation.n_regionkey <> r.place AND steps < 6)
SELECT n, max(steps) AS steps, count(*) AS visits FROM r GROUP BY n""")
_sql("sql_list_index", "SELECT c_custkey, string_split(c_name, '#')[2] AS number, len(string_split(c_name, '#')) AS parts, c_name[1:4] AS head, c_name[-1] AS tail FROM customer")
_sql("sql_whole_division", "SELECT o_orderkey, o_orderkey // 7 AS weeks, o_totalprice // 7 AS share, (o_orderkey + 1) // 2 AS half FROM orders")
_sql("sql_concat_nulls", "SELECT n_nationkey, concat(n_name, CASE WHEN n_regionkey = 1 THEN NULL ELSE '-' END, n_regionkey) AS told FROM nation")
_sql("sql_list_nulls", "SELECT n_regionkey, len(list(CASE WHEN n_nationkey % 2 = 0 THEN n_name END)) AS n, count(CASE WHEN n_nationkey % 2 = 0 THEN 1 END) AS held FROM nation GROUP BY n_regionkey")
_sql("sql_list_position", "SELECT p_partkey, list_position(string_split(p_type, ' '), 'BRASS') IS NULL AS missing, coalesce(list_position(string_split(p_type, ' '), 'BRASS'), 0) AS place, list_contains(string_split(p_type, ' '), 'STEEL') AS steel FROM part")
_sql("sql_epoch", "SELECT event_id, epoch(ts) AS seconds, dayofweek(ts) AS day, isodow(ts) AS iso FROM events")
_sql("sql_list_sums", "SELECT l_orderkey, l_linenumber, list_sum([l_quantity, l_tax, NULL]) AS s, list_avg([l_quantity, l_tax]) AS a, list_sort([l_quantity, l_tax])[1] AS least FROM lineitem")
_sql("sql_powers", "SELECT p_partkey, round(log(p_retailprice), 6) AS digits, p_size ** 2 AS area FROM part")
_sql("sql_substrings", "SELECT s_suppkey, substr(s_name, -3, 3) AS tail, s_name[3] AS third, strpos(s_name, '#') AS sign FROM supplier")
_sql("sql_split_counts", "SELECT len(string_split(p_name, ' ')) AS words, count(*) AS n, round(avg(p_retailprice), 4) AS price FROM part GROUP BY ALL")
_sql("sql_case_outer", """SELECT r_name, CASE WHEN n_nationkey IS NULL THEN 'none' ELSE n_name END AS nation FROM region LEFT JOIN nation ON n_regionkey = r_regionkey
 AND n_nationkey % 2 = 0""")
_sql("sql_pivot", """SELECT * FROM (SELECT o_orderstatus, o_orderpriority FROM orders) PIVOT (count(1) FOR o_orderstatus IN ('F' AS f, 'O' AS o))""", """SELECT o_orderpriority, nullif(count(*) FILTER (o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (o_orderstatus = 'O'), 0) AS o FROM orders
 GROUP BY 1""")
_FIRST = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"
_sql("sql_qualify", f'SELECT "o_custkey", o_orderkey, o_totalprice::DOUBLE AS total FROM orders QUALIFY {_FIRST}')
_sql("sql_strftime", "SELECT strftime(o_orderdate, '%Y-%m') AS month, count(*) AS n, count(*) // 7 AS weeks FROM orders GROUP BY ALL ORDER BY month")
_sql("sql_exclude", "SELECT * EXCLUDE (n_name) FROM nation JOIN (SELECT r_regionkey FROM region WHERE strpos(r_name, 'A') > 0) r ON n_regionkey = r_regionkey")
_NULLS = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN c_acctbal END AS balance FROM customer ORDER BY balance {0}, c_custkey"
_sql("sql_nulls_asc_capped", _NULLS.format(""), _NULLS.format("") + " LIMIT 100", rows=100)
_sql("sql_nulls_desc_capped", _NULLS.format("DESC"), _NULLS.format("DESC") + " LIMIT 100", rows=100)
_ERRORS = "(SELECT * FROM events WHERE event_type = 'error') b"
_sql("sql_asof_text", f"SELECT a.event_id, b.event_id AS error FROM events a ASOF JOIN {_ERRORS} ON a.user_id = b.user_id AND a.ts >= b.ts")


@query("""SELECT a.c_custkey, coalesce(b.s_suppkey, -1) AS s_suppkey, b.s_name FROM (SELECT c_custkey, row_number() OVER (ORDER BY c_acctbal, c_custkey) AS r FROM customer) a
 FULL JOIN (SELECT s_suppkey, s_name, row_number() OVER (ORDER BY s_name, s_suppkey) AS r FROM supplier) b USING (r)""")
def sql_side_by_side(spark, d):
    """Customers by balance beside suppliers by name: what a positional join says where both have an order."""
    a, b = (table(spark, d, t).select(*c) for t, c in (("customer", ("c_custkey", "c_acctbal")), ("supplier", ("s_suppkey", "s_name"))))
    return tabular.side_by_side(a, b, ["c_acctbal", "c_custkey"], ["s_name", "s_suppkey"]).select("c_custkey", F.coalesce("s_suppkey", F.lit(-1)).alias("s_suppkey"), "s_name")


_PROFILED = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "timestamp_ntz", "o_orderpriority": "string"}


def _profile_sql() -> str:
    def part(c: str, kind: str) -> str:
        number = f"round(avg({c}), 4)" if kind in ("bigint", "double") else "NULL::DOUBLE"
        return f"SELECT '{c}' AS column_name, '{kind}' AS column_type, min({c})::VARCHAR AS min, max({c})::VARCHAR AS max, {number} AS avg, count(*) AS rows, count(*) - count({c}) AS nulls FROM orders"

    return " UNION ALL ".join(part(c, kind) for c, kind in _PROFILED.items())


@query(_profile_sql())
def sql_summarize(spark, d):
    """Least and greatest value, mean, rows and nulls of every column of a table, in one pass."""
    return tabular.summarize(table(spark, d, "orders")).withColumn("avg", F.round("avg", 4))


@query("""SELECT o.o_orderkey, e.event_id, e.ts FROM (SELECT o_orderkey, o_custkey, TIMESTAMP '2024-01-16 00:00:00' + INTERVAL (o_orderkey % 86400) SECOND AS at
 FROM orders) o ASOF JOIN (SELECT user_id, ts, max(event_id) AS event_id FROM events GROUP BY 1, 2) e ON e.user_id = o.o_custkey AND e.ts <= o.at""")
def sql_asof(spark, d):
    """The last event of each order's customer: both sides in one ordered stream per customer, no range join."""
    at = F.expr("TIMESTAMP_NTZ '2024-01-16 00:00:00' + make_dt_interval(0, 0, 0, o_orderkey % 86400)")
    left = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), at.alias("at"), F.lit(1).alias("side"), "o_orderkey", F.lit(None).cast("long").alias("event_id"))
    right = table(spark, d, "events").select(F.col("user_id").cast("long").alias("k"), F.col("ts").alias("at"), F.lit(0).alias("side"), F.lit(None).cast("long").alias("o_orderkey"), "event_id")
    w = Window.partitionBy("k").orderBy("at", "side", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("side") == 0, F.struct("event_id", F.col("at").alias("ts"))), ignorenulls=True).over(w)
    return left.unionByName(right).withColumn("e", last).where("side = 1 AND e IS NOT NULL").select("o_orderkey", "e.event_id", "e.ts")


from . import stored  # noqa: E402, F401  its queries register themselves
