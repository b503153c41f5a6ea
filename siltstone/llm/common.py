"""What the operators of this package share: table access, lineage cuts and Arrow batches of whole texts."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import cut, forget, forget_at_exit, shared_folder
from ..schema import free

#: A key with more than this share of all rows is joined by broadcast; there can be no more such keys than this.
HEAVY = 4096
#: Rows of one batch that are Python objects at the same time.
SLICE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame) -> DataFrame:
    """The same rows, written as Parquet in the shared folder and read again: smaller than a checkpoint, and as safe. It goes with the session."""
    return _written(df)[0]


def _written(df: DataFrame) -> tuple[DataFrame, str]:
    path = f"{shared_folder(df.sparkSession)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    forget_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


class Scratch:
    """Tables that an operator stores on its way; at the end of the block, when its result is stored itself, they are deleted."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def __enter__(self) -> Callable[[DataFrame], DataFrame]:
        return self.keep

    def keep(self, df: DataFrame) -> DataFrame:
        out, path = _written(df)
        self.paths.append(path)
        return out

    def __exit__(self, *_) -> None:
        for path in self.paths:
            forget(self.spark, path)


def join_spread(rows: DataFrame, side: DataFrame, by: list[str], times: str, total: int) -> DataFrame:
    """``rows`` joined with ``side``, which has a row for each key and in ``times`` how many of the ``total`` rows have it.

    Keys of more than 1/HEAVY of the rows, HEAVY at most, meet by broadcast, so that no key's rows all land in one task.
    """
    heavy = F.broadcast(side.where(F.col(times) * HEAVY > total).drop(times))
    light = side.where(F.col(times) * HEAVY <= total).drop(times)
    return rows.join(heavy, by).unionByName(rows.join(heavy, by, "left_anti").join(light, by))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row, however often ``use`` names it."""
    return F.transform(F.array(value), use).getItem(0)


def bucket_of(key: Column, n: int) -> Column:
    """crc32 of the key as text, modulo ``n``; a null key counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), F.lit(n))


def map_texts(df: DataFrame, keep: list[str], text: str, make: Callable[[], Callable[[list], dict]], schema: str, rows: int = SLICE) -> DataFrame:
    """One row per row: the columns ``keep`` and those of ``schema``, made from whole texts.

    ``make`` runs once in a task and returns a function from a list of texts (None for null), ``rows`` of them at most, to a dict of columns.
    Other columns of ``df`` aren't read, so their names can't clash.
    """
    from pyspark.sql.types import StructField, StructType
    from pyspark.sql.pandas.types import to_arrow_schema

    made = StructType.fromDDL(schema)
    # columns go under plain names, since Python functions take no names with dots in them
    source = df.select(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("t"))
    plain = [StructField(f"m{i}", f.dataType) for i, f in enumerate(made)]
    out = StructType([*source.schema.fields[:-1], *plain])
    arrow = to_arrow_schema(made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                got = work(batch.column(len(keep)).to_pylist())
                columns = [batch.column(i) for i in range(len(keep))] + [pa.array(got[f.name], f.type) for f in arrow]
                yield pa.RecordBatch.from_arrays(columns, names=out.names)

    return source.mapInArrow(run, out).toDF(*keep, *made.names)
