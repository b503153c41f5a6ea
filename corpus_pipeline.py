"""Five stages from raw documents to packed sequences; each is written as Parquet and read again as the next one's input.

Every stage but the last keeps the columns of ``docs``, whatever their names, and takes rows of any kind: null ids, null and empty
texts, repeated rows, empty tables. What becomes of them is told at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import language, lines, minhash, packing, quality
from siltstone.llm.common import forget_at_exit, free, shared_folder, table
from siltstone.llm.queries import vocabulary

#: A document goes if its language is undetermined or less sure than this.
LEAST_SURE = 0.3
#: Words of a shingle, and similarity in percent (Jaccard, of the shingle sets) from which documents are linked.
SHINGLE, SIMILAR = 5, 80
#: Bits in which fingerprints of one SimHash component differ at most from the next one.
RADIUS = 3


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold of op10 stay. Null and empty texts are scored as empty ones; without labels all stay."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    score = free("__score", docs.columns)
    return quality.score(docs, model, keep=docs.columns, into=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known and sure enough stay; null texts and those without a letter go, all if none was learned."""
    lang, sure = free("__lang", docs.columns), free("__sure", docs.columns)
    found = language.identify(docs, language.fit(docs), keep=docs.columns, into=(lang, sure))
    return found.where((F.col(lang) != "und") & (F.col(sure) >= LEAST_SURE)).drop(lang, sure)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts lose their superseded lines, repeats of short ones too, and n_chars follows; every document stays, an empty one too."""
    out = lines.dedup_lines(docs, least=1).select(*[F.col(f"`{c}`") for c in docs.columns])
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group one row stays: of the least id (a null one comes last), and of its texts the one of the least hash.

    Candidates are documents of one SimHash component, as in op4 (fingerprints that differ in RADIUS bits at most), and those that share a MinHash
    band, since most similar ones differ in more bits; an exact check of the shingle sets follows, which links those of the similarity SIMILAR.
    Texts without a word, null ones too, are one group. Rows of one id whose texts aren't similar stay both.
    """
    found = minhash.similar(docs, SHINGLE, SIMILAR, bits=RADIUS)
    first = found.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("unnamed"), "id", "copy")).alias("first"))
    its_id, copy, text = (free(name, docs.columns) for name in ("__id", "__copy", "__text"))
    kept = first.select(F.col("first.id").alias(its_id), F.col("first.copy").alias(copy))
    own = docs.withColumn(text, F.xxhash64(F.col("text").cast("string")))
    same = F.col("doc_id").eqNullSafe(F.col(its_id)) & (F.col(text) == F.col(copy))
    return own.join(kept, same, "left_semi").dropDuplicates(["doc_id", text]).drop(text)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of 2048 tokens; null and empty texts are a piece of the closing id alone."""
    return packing.pack_documents(docs, vocabulary("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_stage),
    ("language id", language_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_stage),
    ("best-fit packing", packing_stage),
]

#: Tokenizer, nearest neighbours and fingerprints are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES[:-1]):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        forget_at_exit(spark, f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
    return STAGES[-1][1](spark, docs, sf_dir)
