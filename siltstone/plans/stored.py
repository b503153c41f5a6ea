"""Registered queries over tables that are written and read again: tiers, files, catalogues, logs; and batch forms of the facade."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import text as X
from ..operators import governance, graph, ingest, keywords, nearest, vector
from ..operators.glossary import Glossary
from ..schema import ARTICLE
from ..sources import files, store, tabular
from .catalogue import ARTICLES, BM25, COSINE, EDGES, ENTITIES, GLOSSARY, LOG, RELATIONS, TOKENS, _pii_sql, asked_everywhere, asked_vectors, query
from .views import articles, entities, fresh_folder, query_log, relations, table, vectors
from .views import glossary as names_of


#: Rows of a CSV file of texts.
CSV_ROWS = 4096
#: Nulls as something that no escaped text is, so that empty texts are none, and line ends that aren't guessed, so that a carriage return in a text is none.
CSV_EXACT = {"nullValue": r"\N", "lineSep": "\n"}


def stored_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    vector_ = F.array(F.col("id").cast("float"), F.lit(0.5).cast("float"))
    return articles(spark, sf_dir).withColumn("embedding", vector_).drop("doc")


STORED = f"""WITH {ARTICLES}, a AS (SELECT *, [id::FLOAT, 0.5::FLOAT] AS embedding FROM articles)
SELECT id, namespace, title, summary, url, embedding[1]::DOUBLE AS first, len(embedding) AS dims FROM a"""


def _whole(df: DataFrame) -> DataFrame:
    first, dims = F.get("embedding", 0).cast("double"), F.size("embedding").cast("long")
    return df.select("id", "namespace", "title", "summary", "url", first.alias("first"), dims.alias("dims"))


@query(STORED)
def parquet_tier(spark, d):
    path = fresh_folder(spark)
    store.write_parquet(stored_articles(spark, d), path)
    return _whole(store.read_parquet(spark, path))


@query(STORED)
def json_tier(spark, d):
    path = fresh_folder(spark)
    store.write_json(stored_articles(spark, d), path)
    return _whole(store.read_json(spark, path, lines=True))


@query(f"WITH {ARTICLES} SELECT row_number() OVER (ORDER BY namespace, title, url) AS id, namespace, title FROM articles")
def store_append(spark, d):
    """Appended rows get the next ids in order; the store compacts at once, since they are more than its threshold."""
    return store.TieredStore(spark, fresh_folder(spark)).append(stored_articles(spark, d).drop("id")).select("id", "namespace", "title")


@query(f"""WITH {ARTICLES}, n AS (SELECT row_number() OVER (ORDER BY namespace, title, url) AS id, namespace, title, doc FROM articles)
SELECT id, namespace, title FROM n WHERE NOT (namespace = 'en' AND doc = 'src1')""")
def store_delete(spark, d):
    tiers = store.TieredStore(spark, fresh_folder(spark), threshold=10**9, hot_format="json")
    tiers.append(stored_articles(spark, d).drop("id"))
    tiers.delete(tiers.load().where((F.col("namespace") == "en") & (X.base_title(F.col("title")) == "src1")).select("id"))
    return tiers.load().select("id", "namespace", "title")


@query("SELECT doc_id, text, lang AS lang_1, source AS _2_source FROM documents")
def csv_load(spark, d):
    """Texts with quotes and line ends through a CSV file, and column names that need cleaning. Every text comes back as it was, odd ones too."""
    path = fresh_folder(spark)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("Doc Id"), "text", F.col("lang").alias("lang (1)"), F.col("source").alias("2 source"))
    told = docs.select(*[tabular.escaped(F.col(f"`{f.name}`")).alias(f.name) if f.dataType == StringType() else F.col(f"`{f.name}`") for f in docs.schema])
    # a file with line ends inside of its values is read by one task, whose share is a file of so many rows, whatever the table's size
    told.write.options(header=True, quoteAll=True, escape='"', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, maxRecordsPerFile=CSV_ROWS, **CSV_EXACT).csv(path)
    loaded = tabular.load(spark, "loaded_documents", path, schema=docs.schema, **CSV_EXACT)
    return loaded.select(F.col("doc_id").cast("long").alias("doc_id"), *[tabular.unescaped(F.col(c)).alias(c) for c in ("text", "lang_1", "_2_source")])


@query("SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_name LIMIT 100")
def ask_table(spark, d):
    """Text to SQL: the model's reply is cleaned, guarded, rewritten and run."""
    for t in ("customer", "nation"):
        table(spark, d, t).createOrReplaceTempView(t)
    sql = "SELECT n_name, count(*)::BIGINT AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1 ORDER BY n DESC, n_name"
    got = tabular.ask_table(spark, "customer", "Customers of each nation?", lambda prompt: f"Sure:\n```sql\n{sql};\n```")
    return spark.createDataFrame([tuple(r) for r in got["rows"]], "n_name string, n long")


@query("""SELECT source AS title, lang AS namespace, CASE WHEN source = 'src1' THEN 7 ELSE count(*) END::INTEGER AS chunks,
 CASE WHEN source = 'src1' THEN 'new' ELSE 'old' END AS embed_model FROM documents GROUP BY 1, 2 UNION ALL SELECT 'added', 'en', 1, 'new'""")
def catalogue_upsert(spark, d):
    known = governance.catalogue(articles(spark, d), "old")
    changed = known.where("title = 'src1'").withColumn("chunks", F.lit(7)).withColumn("embed_model", F.lit("new"))
    added = spark.createDataFrame([("added", "en", 1, "new")], "title string, namespace string, chunks int, embed_model string")
    return governance.upserted(known, changed.unionByName(added, allowMissingColumns=True)).select("title", "namespace", "chunks", "embed_model")


@query(f"""WITH {LOG}, told AS (SELECT event_id AS id, CASE WHEN user_id % 2 = 0 THEN 'up' ELSE 'down' END AS f FROM events WHERE event_type = 'error')
SELECT id, coalesce(f, feedback) AS feedback FROM log LEFT JOIN told USING (id)""")
def feedback_latest(spark, d):
    """An append-only table of feedback beside the log: the latest counts."""
    path = fresh_folder(spark)
    told = table(spark, d, "events").where("event_type = 'error'")
    value = F.when(F.col("user_id") % 2 == 0, "up").otherwise("down")
    long_ago = F.lit("2000-01-01 00:00:00").cast("timestamp_ntz")
    told.select(F.col("event_id").alias("id"), F.lit("none").alias("feedback"), long_ago.alias("at")).write.parquet(path)
    told.select(F.col("event_id").alias("id"), value.alias("feedback"), F.col("ts").alias("at")).write.mode("append").parquet(path)
    return governance.with_feedback(query_log(spark, d), spark.read.parquet(path)).select("id", "feedback")


@query(f"""WITH {ARTICLES}, c AS (SELECT namespace, doc AS base, id, chr(10) || summary AS p,
 sum(length(summary) + 1) OVER (PARTITION BY namespace, doc ORDER BY id) - length(summary) - 1 AS begun FROM articles)
SELECT namespace, base, substr(string_agg(p, '' ORDER BY id), 1, 8000) AS text FROM c WHERE begun < 8000 GROUP BY 1, 2""")
def summary_texts(spark, d):
    """What a summary of each document is asked over."""
    return governance.document_texts(articles(spark, d).withColumn("base", X.base_title(F.col("title"))), 8000)


ASKED = ("ETF 수수료", "한국거래소 상장", "KRX와 DART", "공시 K-IFRS IFRS", "nothing")


def _rewrite_sql(question: str) -> str:
    parts = []
    for short, full in Glossary().acronyms.items():
        has = f"regexp_matches({question}, '\\b{short}\\b')"
        only = f"WHEN {has} AND NOT contains({question}, '{full}') THEN ' {full}'"
        parts.append(f"CASE {only} WHEN NOT {has} AND contains({question}, '{full}') THEN ' {short}' ELSE '' END")
    return " || ".join([question, *parts])


@query(f"WITH q AS (SELECT event_id, {list(ASKED)}[user_id % 5 + 1] AS q FROM events) SELECT event_id, {_rewrite_sql('q')} AS asked FROM q")
def query_rewrite(spark, d):
    asked = F.array(*[F.lit(x) for x in ASKED])
    questions = table(spark, d, "events").select("event_id", F.get(asked, (F.col("user_id") % 5).cast("int")).alias("question"))
    return Glossary().rewritten(questions).select("event_id", "asked")


@query("SELECT vec_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, len(embedding)::INTEGER AS dims FROM embeddings")
def vector_literals(spark, d):
    """Vectors as literals and back: equal to the last bit."""
    v = table(spark, d, "embeddings").select("vec_id", X.parse_vector(X.vector_literal(F.col("embedding"))).alias("v"))
    ends = (F.get("v", i).cast("double").alias(name) for i, name in ((0, "first"), (63, "last")))
    return v.select("vec_id", *ends, F.size("v").alias("dims"))


@query(r"""WITH n AS (SELECT doc_id, text, length(text) AS n FROM documents),
c AS (SELECT doc_id, unnest(range(0, CASE WHEN n <= 1000 THEN 1 ELSE ceil((n - 1000) / 850.0)::BIGINT + 1 END)) AS i, text FROM n),
p AS (SELECT doc_id, i, regexp_replace(substr(text, (i * 850 + 1)::BIGINT, 1000), '^[\x00-\x20]+|[\x00-\x20]+$', '', 'g') AS summary FROM c)
SELECT 'n' AS namespace, 'doc ' || doc_id || ' #' || row_number() OVER (PARTITION BY doc_id ORDER BY i) AS title, summary,
 'file://' || doc_id AS url, 64::INTEGER AS dims FROM p WHERE summary <> ''""")
def ingest_chunks(spark, d):
    """Numbered chunks with vectors, as ingest stores them."""
    number = F.col("doc_id").cast("string")
    named = (F.lit(" n ").alias("namespace"), F.concat(F.lit("doc "), number).alias("title"), F.concat(F.lit("file://"), number).alias("url"))
    made = ingest.chunks(table(spark, d, "documents").select(*named, "text"), 1000, "fixed", expand=False)
    return made.select("namespace", "title", "summary", "url", F.size("embedding").alias("dims"))


@query(f"WITH {ARTICLES} SELECT id, namespace, title, 6::BIGINT AS n_columns FROM articles WHERE namespace IN ('de', 'es')")
def listed_articles(spark, d):
    """The facade's listing: the caller's tenants alone, and no embeddings."""
    from ..api import Engine

    engine = Engine(spark, fresh_folder(spark))
    engine.store.adopt(stored_articles(spark, d))
    rows = engine.articles({"de", "es"})
    return rows.select("id", "namespace", "title", F.lit(len(rows.columns)).cast("long").alias("n_columns"))


@query("SELECT count(*) AS vectors, count(DISTINCT label) AS namespaces FROM embeddings WHERE len(embedding) = 64")
def vector_count(spark, d):
    return vector.usable(vectors(spark, d), 64).agg(F.count("*").alias("vectors"), F.count_distinct("namespace").alias("namespaces"))


@query(f"""WITH pairs AS (SELECT conv_id, turn, text AS question, answer FROM (SELECT *, lead(role) OVER w AS r, lead(text) OVER w AS answer FROM conversations
 WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND r = 'assistant')
SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, {_pii_sql('question')[0]} AS question, {_pii_sql('answer')[0]} AS answer, 'model' AS model, turn AS latency_ms, '#' || conv_id AS sources,
 CASE WHEN turn % 4 = 0 THEN 'up' END AS feedback, ({_pii_sql('question')[1]} + {_pii_sql('answer')[1]})::INTEGER AS pii_count FROM pairs""")
def audit_written(spark, d):
    """The log's own sink: questions and answers are masked and counted, numbered and appended; feedback to some is joined on when it is read."""
    from ..api import Engine

    engine, pairs = Engine(spark, fresh_folder(spark)), governance.paired(table(spark, d, "conversations"))
    told = (F.lit("model").alias("model"), F.col("turn").alias("latency_ms"), F.concat(F.lit("#"), "conv_id").alias("sources"), F.lit("").alias("augmented_prompt"))
    engine.audit_all(pairs.select("conv_id", "turn", "question", "answer", *told), ["conv_id", "turn"])
    liked = engine.log().where("latency_ms % 4 = 0").select("id", F.lit("up").alias("feedback"), F.current_timestamp().alias("at"))
    liked.write.mode("append").parquet(f"{engine.root}/feedback")
    return engine.log().select("id", "question", "answer", "model", "latency_ms", "sources", "feedback", "pii_count")


@query(f"""WITH {ARTICLES} SELECT id, namespace FROM articles WHERE id <> (SELECT min(id) FROM articles WHERE namespace = 'de')""")
def delete_article(spark, d):
    """One article of the caller's tenant goes; another tenant's stays, whoever asks."""
    from ..api import Engine

    engine = Engine(spark, fresh_folder(spark))
    engine.store.adopt(stored_articles(spark, d))
    first = {r["namespace"]: r["id"] for r in engine.store.load().where("namespace IN ('de', 'fr')").groupBy("namespace").agg(F.min("id").alias("id")).collect()}
    for namespace in ("de", "fr"):
        if namespace in first:
            engine.delete_article(first[namespace], {"de"})
    return engine.store.load().select("id", "namespace")


_FULL = ("Amber Ink", "Art Index", "Aged Iron")


@query(f"""SELECT doc_id, {list(_FULL)}[doc_id % 3 + 1] AS first_full FROM documents""")
def first_definition(spark, d):
    """Of an acronym that a text defines twice the first definition counts, whatever stands between."""
    full = F.get(F.array(*[F.lit(x) for x in _FULL]), (F.col("doc_id") % 3).cast("int"))
    text = F.concat(full, F.lit(" (AI) "), "text", F.lit(" Another Idea (AI)"))
    found = F.filter(X.definitions(text), lambda x: x["acronym"] == "AI")
    return table(spark, d, "documents").select("doc_id", F.get(found, 0)["full"].alias("first_full"))


@query("""SELECT coalesce(nullif(trim(CASE source WHEN 'src1' THEN NULL WHEN 'src2' THEN '  ' ELSE ' ' || lang END), ''), 'default') AS namespace, count(*) AS n FROM documents GROUP BY 1""")
def tenant_default(spark, d):
    """Null and blank tenants are the default one; others lose blanks at their ends."""
    given = F.when(F.col("source") == "src2", "  ").when(F.col("source") != "src1", F.concat(F.lit(" "), "lang"))
    return table(spark, d, "documents").groupBy(X.ns_key(given).alias("namespace")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, to_base64(encode(text)) AS encoded FROM documents")
def image_base64(spark, d):
    """Bytes as they are handed to a model of images."""
    return table(spark, d, "documents").select("doc_id", files.encoded(F.encode(F.col("text"), "UTF-8")).alias("encoded"))


@query("SELECT page_id, CASE WHEN page_id % 5 < 4 THEN 'page ' || page_id END AS title, CASE WHEN page_id % 5 < 4 THEN html END AS extract, CASE WHEN page_id % 5 < 3 THEN url END AS url FROM pages")
def page_json(spark, d):
    """Summaries as a page service tells them: unknown fields, one without an address, one that is no JSON."""
    address = F.when(F.col("page_id") % 5 < 3, F.struct(F.struct(F.col("url").alias("page"), F.lit(1).alias("other")).alias("desktop")))
    whole = F.to_json(F.struct(F.concat(F.lit("page "), "page_id").alias("title"), F.col("html").alias("extract"), address.alias("content_urls"), F.lit("x").alias("lang")))
    body = F.when(F.col("page_id") % 5 < 4, whole).otherwise("no json")
    return table(spark, d, "pages").select("page_id", files.page_fields(body).alias("p")).select("page_id", "p.title", "p.extract", "p.url")


#: What the stores of the next queries hold in the end: French articles came later, with new ids, and one English document went.
CHANGED = """first AS (SELECT doc_id AS id, lang AS namespace, source || ' #' || (doc_id + 1) AS title, text AS summary, 'file://' || source || '#' || (doc_id + 1) AS url, source AS doc
 FROM documents), articles AS (SELECT id, namespace, summary, doc FROM first WHERE namespace <> 'fr' AND NOT (namespace = 'en' AND doc = 'src1')
 UNION ALL SELECT (SELECT max(id) FROM first WHERE namespace <> 'fr') + row_number() OVER (ORDER BY title, url), namespace, summary, doc FROM first WHERE namespace = 'fr')"""


def changed_store(spark: SparkSession, sf_dir: str, name: str, made: Callable, follow: Callable) -> store.TieredStore:
    """A store with an index that is made of its first articles, told of others that come, and of some that go."""
    whole, tiers = stored_articles(spark, sf_dir), store.TieredStore(spark, fresh_folder(spark), threshold=10**12)
    tiers.adopt(whole.where("namespace <> 'fr'"))
    tiers.add_index(name, made(tiers.load()))
    tiers.append(whole.where("namespace = 'fr'").drop("id"), {name: follow})
    going = tiers.load().where((F.col("namespace") == "en") & (X.base_title(F.col("title")) == "src1"))
    tiers.delete(going.select("id"), {name: follow})
    return tiers


@query(f"""WITH {CHANGED}, {TOKENS}, {BM25} SELECT namespace, id, round(score, 6) AS score, rank
 FROM (SELECT *, row_number() OVER (PARTITION BY namespace ORDER BY round(score, 9) DESC, id) AS rank FROM kscore) WHERE rank <= 10""")
def keyword_index_changes(spark, d):
    """Append, delete and search: the index answers as one that is made of what there is now."""
    found = changed_store(spark, d, "keywords", keywords.build, keywords.changes).index("keywords")
    parts = [found.changes(how, part) for how in ("added", "gone") for part in ("postings", "sums")]
    index = keywords.Keywords(found.table("blocks"), found.table("sums"), *parts)
    return keywords.search(index, asked_everywhere(index.tenants()), 10).select("namespace", "id", F.round("score", 6).alias("score"), "rank")


_FIRST_NAMES = GLOSSARY.replace("FROM toks", "FROM all_toks")


@query(f"""WITH {CHANGED}, all_toks AS (SELECT id, regexp_extract_all(lower(summary), '[a-z0-9]+') AS t FROM first), {_FIRST_NAMES}, {ENTITIES}, {RELATIONS}, {EDGES}
SELECT namespace, src, dst, edge_type, cnt FROM edges""")
def graph_index_changes(spark, d):
    """Edges of a stored graph after an append and a delete: only documents that changed are counted again."""
    names = names_of(articles(spark, d))
    known = relations(spark, names)

    def found(rows: DataFrame) -> DataFrame:
        return entities(rows.withColumn("doc", X.base_title(F.col("title"))), names)

    tiers = changed_store(spark, d, "graph", lambda rows: {"entities": found(rows), "edges": graph.typed_edges(found(rows), known)}, lambda rows: {"entities": found(rows)})
    return graph.with_changes(tiers.index("graph"), known)["edges"]


@query(f"""WITH e AS (SELECT vec_id AS id, embedding FROM embeddings WHERE label NOT IN (0, 1)
 UNION ALL SELECT (SELECT max(vec_id) FROM embeddings WHERE label <> 0) + row_number() OVER (ORDER BY vec_id), embedding FROM embeddings WHERE label = 0),
s AS (SELECT q.vec_id AS query_id, e.id, {COSINE.format(a="e.embedding", b="q.embedding", n=12)} AS score FROM e, embeddings q WHERE q.vec_id % 100 = 0)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""")
def vector_index_changes(spark, d):
    """A store of vectors whose index was made before those of label 0 came, with new ids, and those of label 1 went."""
    v, tiers = vectors(spark, d), store.TieredStore(spark, fresh_folder(spark), threshold=10**12)
    named = v.withColumn("title", F.lpad(F.col("id").cast("string"), 12, "0")).withColumn("url", F.lit(""))
    tiers.adopt(named.where("namespace <> '0'").select(*[F.col(f.name) if f.name in named.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in ARTICLE]))
    tiers.add_index("vectors", nearest.build(tiers.load(), dim=64).tables())
    told = tiers.index("vectors")
    follow = {"vectors": lambda rows: {"members": nearest.extended(nearest.Index(told.table("members"), told.table("centres")), rows)}}
    tiers.append(named.where("namespace = '0'").drop("id"), follow)
    tiers.delete(tiers.load().where("namespace = '1'").select("id"), follow)
    found = tiers.index("vectors")
    index = nearest.Index(found.now("members"), found.table("centres"))
    return nearest.search(index, asked_vectors(v), 10).select("query_id", "id", F.round("score", 6).alias("score"), "rank")
