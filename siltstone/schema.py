"""Record types of the stored tables."""

from pyspark.sql import types as T

ARTICLE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("namespace", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("summary", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("ingested_at", T.TimestampNTZType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
    ]
)

QUERY_LOG = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("question", T.StringType()),
        T.StructField("answer", T.StringType()),
        T.StructField("model", T.StringType()),
        T.StructField("latency_ms", T.LongType()),
        T.StructField("created_at", T.TimestampNTZType()),
        T.StructField("sources", T.StringType()),
        T.StructField("feedback", T.StringType()),
        T.StructField("pii_count", T.IntegerType()),
        T.StructField("augmented_prompt", T.StringType()),
    ]
)


def free(name: str, taken: list[str]) -> str:
    """``name``, or with as many ``_`` before it as it takes to be none of ``taken`` (case doesn't count, as in Spark)."""
    low = {x.lower() for x in taken}
    while name.lower() in low:
        name = f"_{name}"
    return name
