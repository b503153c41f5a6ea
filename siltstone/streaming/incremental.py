"""Structured Streaming forms: ingest of landing files, and audit figures by hour with a watermark."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..operators.ingest import chunks, new_files
from ..sources.store import TieredStore


def landing(spark: SparkSession, path: str, schema: StructType, files_at_once: int = 64) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(path)


def ingest(stream: DataFrame, store: TieredStore, checkpoint: str, size: int = 1000, how: str = "recursive", embed: Callable | None = None) -> StreamingQuery:
    """Each batch of files (namespace, title, url, text) is chunked and appended once; files that the store holds are left out."""

    def batch(df: DataFrame, _: int) -> None:
        fresh = new_files(df.dropDuplicates(["namespace", "title"]), store.load())
        store.append(chunks(fresh, size, how, embed=embed))

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def hourly(log: DataFrame, late: str = "2 hours") -> DataFrame:
    """Calls and mean latency by hour and model; rows later than ``late`` are left out and finished hours come out once."""
    return log.withWatermark("created_at", late).groupBy(F.window("created_at", "1 hour").alias("w"), "model").agg(F.count("*").alias("calls"), F.avg("latency_ms").alias("avg_latency_ms")).select(F.col("w.start").alias("hour"), "model", "calls", "avg_latency_ms")
