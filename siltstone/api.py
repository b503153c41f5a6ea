"""One facade over the engine: a method for each thing a client may ask."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import base_title, ns_key, pii_count, pii_text
from .operators import bm25, fusion, governance, graph, ingest, keywords, nearest, rerank, security, services, vector
from .lineage import cut
from .operators.glossary import Glossary, article_entities
from .schema import QUERY_LOG
from .sources import files, store, tabular

FETCH, KEEP, SUMMARY_CHARS, DOCUMENT_CHARS = 20, 2, 600, 8000
#: Folders of changes that an index gathers before it is made anew.
CHANGES = 16
GROUND = "Answer from these sources alone; where figures differ, an [OCR] part outranks a [Vision] part.\n"


def context(top: DataFrame, by: list[str]) -> DataFrame:
    """(by..., context): a line for each of the few top rows, best first, summaries cut to SUMMARY_CHARS."""
    line = F.concat(F.lit("- "), "title", F.lit(": "), F.substring("summary", 1, SUMMARY_CHARS), F.lit("\n"))
    return top.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank0", line.alias("s")))), lambda x: x["s"]), "").alias("context"))


def prompt_for(found: str, question: str, persona: str = "") -> str:
    return (f"{persona}\n\n" if persona else "") + f"{GROUND}{found}\nIn a few words: {question}"


def ask_all(top: DataFrame, question: str, by: list[str], generate: Callable[[str], str]) -> DataFrame:
    asked = context(top, by).withColumn("prompt", F.concat(F.lit(GROUND), "context", F.lit(f"\nIn a few words: {question}")))
    return services.answers(asked, generate).select(*by, "answer", "status")


class Engine:
    """State is tables under ``root``; services are functions given to it. ``allowed`` is the caller's set of namespaces."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        glossary: Glossary | None = None,
        embed: Callable | None = None,
        generate: Callable[[str], str] = services.echo_model,
        ocr: Callable = services.fixed_ocr,
        caption: Callable = services.fixed_ocr,
        models: tuple[str, str] = ("default", ""),
        persona: str = "",
        threshold: int = 3,
        embed_model: str = "hashing",
        graph_weight: float = fusion.GRAPH_WEIGHT,
        vectors: vector.VectorSearch | None = None,
        indexed_vectors: bool = True,
        hot_format: str = "parquet",
    ):
        self.spark, self.root, self.store = spark, root, store.TieredStore(spark, f"{root}/articles", threshold, hot_format)
        self.vectors, self.indexed_vectors = vectors or nearest.Exact(), indexed_vectors
        self.glossary, self.embed, self.generate = glossary or Glossary(), embed or services.hashing_embedder(), generate
        self.ocr, self.caption, self.models, self.persona, self.embed_model, self.graph_weight = ocr, caption, models, persona, embed_model, graph_weight

    # articles

    def articles(self, allowed: set[str], namespace: str | None = None) -> DataFrame:
        rows = security.visible(self.store.load(), allowed)
        return (rows if namespace is None else rows.where(F.col("namespace") == security.key_of(namespace))).drop("embedding")

    def count(self, allowed: set[str], namespace: str | None = None) -> int:
        return self.articles(allowed, namespace).count()

    def documents(self, allowed: set[str], namespace: str | None = None) -> DataFrame:
        return governance.documents(self.articles(allowed, namespace))

    def ingest(self, texts: DataFrame, allowed: set[str], size: int = 1000, how: str = "recursive") -> DataFrame:
        """(namespace, title, url, text) rows; those of files that the tenant holds already are left out."""
        named = security.visible(security.normalised(texts), allowed)
        fresh = ingest.new_files(named.dropDuplicates(["namespace", "title"]), self.store.load())
        return self._appended(ingest.chunks(fresh, size, how, embed=self.embed))

    def ingest_files(self, path: str, namespace: str, allowed: set[str], **options) -> tuple[DataFrame, DataFrame]:
        """What was stored, and the status of each file."""
        security.require_access(namespace, allowed)
        found = files.read_files(self.spark, path)
        good = found.where("status = 'ok'").select(F.lit(namespace).alias("namespace"), F.col("name").alias("title"), F.concat(F.lit("file://"), "name").alias("url"), "text")
        return self.ingest(good, allowed, **options), found.select("name", "route", "status")

    def ingest_pages(self, titles: list[str], namespace: str, allowed: set[str], fetch: Callable[[str], dict]) -> tuple[DataFrame, DataFrame]:
        security.require_access(namespace, allowed)
        asked = self.spark.createDataFrame([(t,) for t in titles], "title string").withColumn("namespace", F.lit(security.key_of(namespace)))
        fresh = store.title_clash(asked, self.store.load())
        pages = files.fetch_pages(fresh.select("title"), fetch).cache()
        good = pages.where("status = 'ok'").select(F.lit(security.key_of(namespace)).alias("namespace"), "title", "summary", "url", F.current_timestamp().cast("timestamp_ntz").alias("ingested_at"))
        rows = good.withColumn("embedding", services.embed_column(F.concat("title", F.lit(". "), "summary"), self.embed))
        return self._appended(rows), pages.select("title", "status")

    def ingest_image(self, title: str, content: bytes, namespace: str, allowed: set[str]) -> DataFrame:
        security.require_access(namespace, allowed)
        images = self.spark.createDataFrame([(title, content)], "title string, content binary")
        return self.ingest(files.read_images(images, self.ocr, self.caption).withColumn("namespace", F.lit(namespace)), allowed)

    def delete_document(self, title: str, namespace: str | None, allowed: set[str]) -> bool:
        security.require_access(namespace, allowed)
        rows = self.articles(allowed, namespace).where(base_title(F.col("title")) == title)
        return self.store.delete(rows.select("id"), self._followers())

    def delete_article(self, article: int, allowed: set[str]) -> bool:
        if not self.articles(allowed).where(F.col("id") == article).count():
            return False
        return self.store.delete([article], self._followers())

    # retrieval

    def retrieve(self, question: str, namespace: str | None, allowed: set[str], n: int = FETCH, keyword: bool = True, graphs: bool = True) -> DataFrame:
        """(query_id, id, rank0, score, title, summary, embedding) of the n best, in one plan."""
        security.require_access(namespace, allowed)
        ns, asked = security.key_of(namespace), self.glossary.rewrite(question)
        rows = self.store.load().where(F.col("namespace") == ns)
        found = self._searched().one(rows, self.embed([asked])[0], n).select("query_id", "id", "score")
        words = None
        if keyword and self.store.index("keywords"):
            words = self.keyword_hits(rows, self.spark.createDataFrame([(0, ns, asked)], "query_id long, namespace string, text string"), n)
        elif keyword:  # one question: a pass over the texts is less than their postings
            words = bm25.scores(rows, asked).select(F.lit(0).cast("long").alias("query_id"), "id", "score")
        linked = self.graph_hits(asked, ns, rows).select(F.lit(0).cast("long").alias("query_id"), "id", "score") if graphs else None
        best = fusion.hybrid(found, words, linked, n, ["query_id"], self.graph_weight)
        return best.join(rows.select("id", "title", "summary", "embedding"), "id").select("query_id", "id", F.col("rank0").cast("int").alias("rank0"), "score", "title", "summary", "embedding")

    def retrieve_all(self, cases: DataFrame, allowed: set[str], n: int = FETCH, keyword: bool = True, graphs: bool = True) -> DataFrame:
        """``retrieve`` for many questions (case_id, question, namespace) in one plan, none of which goes through the driver: adds case_id.

        Cases of other tenants find nothing.
        """
        asked = security.visible(cases.withColumn("namespace", ns_key(F.col("namespace"))), allowed).select("case_id", "question", "namespace")
        told = self.glossary.rewritten(asked, into="text").withColumn("text", F.coalesce("text", F.lit("")))
        queries = cut(told.withColumn("embedding", services.embed_column(F.col("text"), self.embed))).withColumn("query_id", F.monotonically_increasing_id())
        rows = security.visible(self.store.load(), allowed)
        found = self._searched().many(rows, queries, n, within="namespace").select("query_id", "id", "score")
        words = self.keyword_hits(rows, queries, n) if keyword else None
        linked = None
        if graphs:
            tables = self.graph_tables(rows)
            named = article_entities(queries.select("namespace", F.col("query_id").alias("id"), "text"), self.glossary).withColumnRenamed("id", "query_id")
            seeds = named.join(tables["entities"].select("namespace", "entity"), ["namespace", "entity"], "left_semi")
            linked = graph.search(tables["entities"], graph.links(tables["edges"]), seeds.select("query_id", "namespace", "entity"), by=("query_id",)).select("query_id", "id", "score")
        best = fusion.hybrid(found, words, linked, n, ["query_id"], self.graph_weight)
        told_rows = best.join(rows.select("id", "title", "summary", "embedding"), "id").join(queries.select("query_id", "case_id"), "query_id")
        return told_rows.select("case_id", "query_id", "id", F.col("rank0").cast("int").alias("rank0"), "score", "title", "summary", "embedding")

    def rerank_all(self, cases: DataFrame, candidates: DataFrame, how: str | None = "mmr", k: int = KEEP, scorer: Callable | None = None) -> DataFrame:
        """``rerank`` for what ``retrieve_all`` found."""
        return self._reranked(candidates.join(cases.select("case_id", "question"), "case_id"), how, k, scorer)

    # indexes

    def _vectors_follow(self, rows: DataFrame) -> dict[str, DataFrame]:
        stored = self.store.index("vectors")
        return {"members": nearest.extended(nearest.Index(stored.table("members"), stored.table("centres")), rows, within="namespace")}

    def _followers(self) -> store.Follow:
        """What each stored index makes of articles that come or go."""
        return {
            "keywords": keywords.changes,
            "vectors": self._vectors_follow,
            "graph": lambda rows: {"entities": ingest.indexes(rows, self.glossary)["entities"]},
        }

    def _appended(self, rows: DataFrame) -> DataFrame:
        stored = self.store.append(rows, self._followers())
        self._settle()
        return stored

    def _settle(self) -> None:
        """Indexes that have gathered more than CHANGES folders are made anew, from their own tables and not from texts."""
        for name in ("keywords", "vectors", "graph"):
            found = self.store.index(name)
            if found and len(found.added) + len(found.gone) > CHANGES:
                self.store.add_index(name, self._rebuilt(name, found))

    def _rebuilt(self, name: str, found: store.Stored) -> dict[str, DataFrame]:
        if name == "keywords":
            return self._keywords(found).rebuilt()
        if name == "vectors":
            return {"members": found.now("members"), "centres": found.table("centres")}
        return graph.with_changes(found, self.glossary.relation_table(self.spark))

    def store_indexes(self) -> bool:
        """Derives postings, vectors and the entity graph of all tenants once and stores them; later changes of the articles change them too."""
        rows = self.store.load()
        dim = len(self.embed([""])[0])
        tables = {"keywords": keywords.build(rows), "vectors": nearest.build(rows, within="namespace", dim=dim).tables()}
        return all([self.store.add_index(name, t) for name, t in tables.items()]) and self.store_graph()

    def store_graph(self) -> bool:
        """The entity graph alone."""
        tables = ingest.indexes(self.store.load(), self.glossary)
        return self.store.add_index("graph", {name: tables[name] for name in ("entities", "edges")})

    def _keywords(self, found: store.Stored) -> keywords.Keywords:
        parts = [found.changes(how, part) for how in ("added", "gone") for part in ("postings", "sums")]
        return keywords.Keywords(found.table("blocks"), found.table("sums"), *parts)

    def keyword_hits(self, rows: DataFrame, queries: DataFrame, n: int) -> DataFrame:
        """(query_id, id, score) of questions (query_id, namespace, text) by BM25: from the stored index, or from the texts where there is none."""
        found = self.store.index("keywords")
        if found:
            return keywords.search(self._keywords(found), queries, n).select("query_id", "id", "score")
        return bm25.batch_scores(bm25.postings(rows), bm25.term_stats(rows), queries).select("query_id", "id", "score")

    def _searched(self) -> vector.VectorSearch:
        found = self.store.index("vectors")
        return nearest.Indexed(nearest.Index(found.now("members"), found.table("centres"))) if found and self.indexed_vectors else self.vectors

    def graph_tables(self, rows: DataFrame) -> dict[str, DataFrame]:
        """Entities and edges of some tenants' articles: the stored ones as they are now, or made from the texts."""
        found = self.store.index("graph")
        if found is None:
            return ingest.indexes(rows, self.glossary)
        spaces = rows.select("namespace").distinct()
        tables = graph.with_changes(found, self.glossary.relation_table(self.spark))
        return {name: df.join(spaces, "namespace", "left_semi") for name, df in tables.items()}

    def graph_hits(self, question: str, namespace: str, rows: DataFrame) -> DataFrame:
        tables = self.graph_tables(rows)
        entities = tables["entities"].where(F.col("namespace") == namespace)
        wanted = sorted(self.glossary.extract(question))
        seeds = entities.where(F.col("entity").isin(wanted) if wanted else F.lit(False)).select("namespace", "entity").distinct()
        return graph.search(entities, graph.links(tables["edges"].where(F.col("namespace") == namespace)), seeds)

    def rerank(self, question: str, candidates: DataFrame, how: str | None = "mmr", k: int = KEEP, scorer: Callable | None = None) -> DataFrame:
        return self._reranked(candidates.withColumn("question", F.lit(question)), how, k, scorer)

    def _reranked(self, candidates: DataFrame, how: str | None, k: int, scorer: Callable | None) -> DataFrame:
        chosen = rerank.strategy(how)
        if chosen is rerank.llm:
            return chosen(candidates, k, self.generate)
        return chosen(candidates, k, scorer) if chosen is rerank.cross else chosen(candidates, k)

    def ask(self, question: str, namespace: str | None, allowed: set[str], model: str | None = None, how: str | None = "mmr", keyword: bool = True, graphs: bool = True) -> dict:
        import time

        name = services.checked_model(model, *self.models)
        top = self.rerank(question, self.retrieve(question, namespace, allowed, keyword=keyword, graphs=graphs), how).orderBy("rank0").collect()
        if not top:
            raise LookupError(f"no articles in namespace {security.key_of(namespace)!r}")
        told = "".join(f"- {r['title']}: {(r['summary'] or '')[:SUMMARY_CHARS]}\n" for r in top)
        prompt, began = prompt_for(told, question, self.persona), time.time()
        answer = self.generate(prompt)
        sources = "; ".join(f"#{r['id']} {r['title']}" for r in top)
        return {"answer": answer, "sources": [(r["id"], r["title"]) for r in top], "log_id": self.audit(question, answer, name, int(1000 * (time.time() - began)), sources, prompt)}

    def ask_image(self, question: str, content: bytes, model: str | None = None) -> str:
        services.checked_model(model, *self.models)
        return self.generate(prompt_for(files.image_text(self.ocr(content), self.caption(content)), question))

    def summarize(self, article: int, allowed: set[str]) -> str:
        """Over the chunks of the article's document, of its own tenant."""
        rows = self.articles(allowed)
        own = rows.where(F.col("id") == article).select("namespace", base_title(F.col("title")).alias("base")).limit(1)
        mine = rows.withColumn("base", base_title(F.col("title"))).join(F.broadcast(own), ["namespace", "base"])
        told = governance.document_texts(mine, DOCUMENT_CHARS).collect()
        if not told:
            raise LookupError(f"no article {article}")
        return self.generate("Summarize:\n" + told[0]["text"])

    # governance

    def log(self) -> DataFrame:
        path = f"{self.root}/log"
        rows = self.spark.read.schema(QUERY_LOG).parquet(path) if store.exists(self.spark, path) else self.spark.createDataFrame([], QUERY_LOG)
        told = f"{self.root}/feedback"
        return governance.with_feedback(rows, self.spark.read.parquet(told)) if store.exists(self.spark, told) else rows

    def audit_all(self, calls: DataFrame, order: list[str]) -> int:
        """Appends calls (question, answer, model, latency_ms, sources, augmented_prompt) to the log, masked, with the next ids by ``order``; the last id."""
        last = self.log().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        found = (pii_count(F.col("question")) + pii_count(F.col("answer"))).cast("int")
        masked = {"question": pii_text(F.col("question")), "answer": pii_text(F.col("answer")), "pii_count": found, "created_at": F.current_timestamp().cast("timestamp_ntz"), "feedback": F.lit(None).cast("string")}
        rows = store.in_order(calls, order, last, "id").withColumns(masked)
        rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in QUERY_LOG]).write.mode("append").parquet(f"{self.root}/log")
        return self.log().agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]

    def audit(self, question: str, answer: str, model: str, latency_ms: int, sources: str, prompt: str) -> int | None:
        """Writes a masked row; a log that can't be written never fails the answer."""
        try:
            call = self.spark.createDataFrame([(question, answer, model, latency_ms, sources, prompt)], "question string, answer string, model string, latency_ms long, sources string, augmented_prompt string")
            return self.audit_all(call, ["question"])
        except Exception:  # noqa: BLE001
            return None

    def feedback(self, log_id: int, value: str) -> None:
        if not self.log().where(F.col("id") == log_id).count():
            raise LookupError(f"no log row {log_id}")
        self.spark.createDataFrame([(log_id, value)], "id long, feedback string").withColumn("at", F.current_timestamp()).write.mode("append").parquet(f"{self.root}/feedback")

    def stats(self, allowed: set[str]) -> dict[str, DataFrame]:
        return governance.stats(self.log(), governance.catalogue(self.articles(allowed), self.embed_model))

    def index_stats(self, allowed: set[str]) -> DataFrame:
        rows = security.visible(self.store.load(), allowed)
        return vector.index_stats(vector.signatures(rows, vector.planes(len(self.embed([""])[0]))))

    def graph_stats(self, allowed: set[str]) -> DataFrame:
        tables = ingest.indexes(security.visible(self.store.load(), allowed), self.glossary)
        return graph.stats(tables["entities"], tables["edges"])

    # tables

    def load_table(self, name: str, path: str, header_row: int = 0) -> str:
        return tabular.schema_text(tabular.load(self.spark, name, path, header_row))

    def ask_table(self, name: str, question: str) -> dict:
        return tabular.ask_table(self.spark, name, question, self.generate)
