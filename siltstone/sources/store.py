"""Article tables on disk: a columnar cold tier and a row-wise hot tier, in any file system that Spark reads."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField

from ..functions.text import ns_key
from ..lineage import cut
from ..schema import ARTICLE, free

#: What an index makes of articles that come or go: tables by name.
Follow = dict[str, Callable[[DataFrame], dict[str, DataFrame]]]
#: Manifests whose folders stay for readers that began before the last change.
KEPT = 2


def _path(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, fs = _path(spark, path)
    return fs.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    at, fs = _path(spark, path)
    fs.delete(at, True)


def listed(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no folder."""
    at, fs = _path(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(at)] if fs.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    at, fs = _path(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """A file that is there whole or not at all; false if somebody else has made it first."""
    sc = spark.sparkContext
    jvm, staged = sc._jvm, f"{path}.{uuid.uuid4().hex}"
    at, fs = _path(spark, staged)
    stream = fs.create(at)
    stream.write(bytearray(text.encode()))
    stream.close()
    options = sc._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), sc._jsc.hadoopConfiguration())
    try:
        context.rename(at, _path(spark, path)[0], options)
    except Py4JJavaError as e:
        fs.delete(at, False)
        if "FileAlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def read_parquet(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Articles of Parquet folders; one that is missing or holds no rows yet is empty. Without a namespace: ``default``.

    Numbers that aren't floats are dropped from embeddings.
    """
    there = [p for p in ([path] if isinstance(path, str) else path) if exists(spark, p)]
    try:
        df = spark.read.schema(ARTICLE).parquet(*there) if there else None
    except AnalysisException:
        df = None
    return spark.createDataFrame([], ARTICLE) if df is None else _read(df)


def _read(df: DataFrame) -> DataFrame:
    told = df.withColumn("namespace", ns_key(F.col("namespace")))
    return told.withColumn("embedding", F.filter("embedding", lambda x: x.isNotNull())).select(*ARTICLE.names)


def write_parquet(df: DataFrame, path: str) -> None:
    """A new folder of articles, partitioned by namespace; a tenant's rows go to a few files."""
    named = df.withColumn("namespace", ns_key(F.col("namespace")))
    spread = named.repartition("namespace", F.pmod(F.xxhash64("id"), F.lit(8)))
    spread.write.option("compression", "snappy").partitionBy("namespace").parquet(path)


def read_json(spark: SparkSession, path: str | list[str], lines: bool = False) -> DataFrame:
    """Articles of JSON files that hold an array each, or with ``lines`` an object a line."""
    there = [p for p in ([path] if isinstance(path, str) else path) if exists(spark, p)]
    if not there:
        return spark.createDataFrame([], ARTICLE)
    return _read(spark.read.schema(ARTICLE).option("multiLine", not lines).json(there))


def write_json(df: DataFrame, path: str) -> None:
    """A new folder of articles, an object a line; fields that are null are left out."""
    df.select(*ARTICLE.names).write.json(path)


class TieredStore:
    """Cold Parquet, hot small folders (Parquet or JSON); ``append`` compacts when the hot tier holds ``threshold`` rows.

    What the store holds is told by the newest of its numbered manifests, a small file that names the folders. A change writes
    folders of its own and then the next manifest; where another writer has been first, it begins again. So a reader sees
    all of a change or nothing, a failure leaves what was there, and two appends never give one id. (This needs a file system whose rename
    refuses an existing name, as HDFS and local ones do.)
    """

    def __init__(self, spark: SparkSession, root: str, threshold: int = 3, hot_format: str = "parquet"):
        if hot_format not in ("parquet", "json"):
            raise ValueError(f"unknown format {hot_format!r}")
        self.spark, self.root, self.threshold, self.hot_format = spark, root, threshold, hot_format

    # manifests

    def _numbers(self) -> list[int]:
        names = listed(self.spark, f"{self.root}/manifests")
        return sorted(int(n.removesuffix(".json")) for n in names if n.removesuffix(".json").isdigit())

    def manifest(self, number: int | None = None) -> dict:
        """Of a version, the newest by default: cold and hot folders, the next id, rows of the hot tier, indexes."""
        numbers = self._numbers() if number is None else [number]
        if not numbers:
            return {"version": 0, "cold": None, "hot": [], "next_id": 1, "hot_rows": 0, "indexes": {}}
        return json.loads(read_text(self.spark, f"{self.root}/manifests/{numbers[-1]}.json"))

    def _commit(self, now: dict, **changes) -> bool:
        new = now | {"version": now["version"] + 1, "indexes": {}} | changes
        return write_new(self.spark, f"{self.root}/manifests/{new['version']}.json", json.dumps(new))

    def _folder(self, kind: str) -> str:
        return f"{kind}-{uuid.uuid4().hex}"

    def vacuum(self, keep: int = KEPT) -> None:
        """Deletes old manifests and the folders that only they name."""
        numbers = self._numbers()
        kept = [self.manifest(n) for n in numbers[-keep:]]
        named = {f for m in kept for f in _folders(m)}
        for n in numbers[:-keep]:
            for f in _folders(self.manifest(n)) - named:
                remove(self.spark, f"{self.root}/{f}")
            remove(self.spark, f"{self.root}/manifests/{n}.json")

    # rows

    def _hot(self, folders: list[str]) -> DataFrame:
        paths = [f"{self.root}/{f}" for f in folders]
        return read_json(self.spark, paths, lines=True) if self.hot_format == "json" else read_parquet(self.spark, paths)

    def hot_rows(self) -> DataFrame:
        return self._hot(self.manifest()["hot"])

    def _load(self, now: dict) -> DataFrame:
        cold = read_parquet(self.spark, f"{self.root}/{now['cold']}") if now["cold"] else self.spark.createDataFrame([], ARTICLE)
        return tiered(cold, self._hot(now["hot"])) if now["hot"] else cold

    def load(self) -> DataFrame:
        return self._load(self.manifest())

    def append(self, rows: DataFrame, follow: Follow | None = None) -> DataFrame:
        """Gives the rows the next ids, in their order by namespace, title and url, and stores them; returns what was stored.

        Indexes named in ``follow`` are told of the rows in the same manifest and stay; others are outdated by it.
        """
        while True:
            now, folder = self.manifest(), self._folder("hot")
            path, first = f"{self.root}/{folder}", now["next_id"]
            numbered = numbered_from(rows, first - 1)
            (write_json if self.hot_format == "json" else lambda df, p: df.write.parquet(p))(numbered, path)
            n = self._hot([folder]).count()
            indexes = self._followed(now, self._hot([folder]), follow, "added")
            if self._commit(now, hot=[*now["hot"], folder], next_id=first + n, hot_rows=now["hot_rows"] + n, indexes=indexes):
                break
            remove(self.spark, path)
        if now["hot_rows"] + n >= self.threshold:
            self.compact()
        return self.load().where(F.col("id").between(first, first + n - 1))

    def adopt(self, rows: DataFrame) -> None:
        """Makes rows that have ids already the store's first ones; later ids go on after the greatest."""
        now, folder = self.manifest(), self._folder("cold")
        if now["version"]:
            raise ValueError("the store holds something already")
        write_parquet(rows, f"{self.root}/{folder}")
        last = read_parquet(self.spark, f"{self.root}/{folder}").agg(F.coalesce(F.max("id"), F.lit(0))).first()[0]
        if not self._commit(now, cold=folder, next_id=last + 1):
            raise ValueError("another writer has been first")

    def compact(self) -> bool:
        """Moves the hot tier's rows into the cold one; false if another writer has changed the store meanwhile."""
        now = self.manifest()
        return self._replace(now, self._load(now), now["indexes"])

    def _replace(self, now: dict, rows: DataFrame, indexes: dict) -> bool:
        folder = self._folder("cold")
        write_parquet(rows, f"{self.root}/{folder}")
        done = self._commit(now, cold=folder, hot=[], hot_rows=0, indexes=indexes)
        if done:
            self.vacuum()
        else:
            remove(self.spark, f"{self.root}/{folder}")
        return done

    def delete(self, ids: list[int] | DataFrame, follow: Follow | None = None) -> bool:
        """Takes rows out of both tiers; false if there was none. Indexes named in ``follow`` are told of them and stay."""
        gone = ids if isinstance(ids, DataFrame) else self.spark.createDataFrame([(i,) for i in ids], "id long")
        gone = cut(gone.select("id").distinct())
        while True:
            now = self.manifest()
            rows = self._load(now)
            going = rows.join(gone, "id", "left_semi")
            if going.isEmpty():
                return False
            if self._replace(now, without(rows, gone), self._followed(now, going, follow, "gone")):
                return True

    # derived tables that stand beside the articles

    def _written(self, tables: dict[str, DataFrame]) -> str:
        folder = self._folder("index")
        for part, df in tables.items():
            df.write.parquet(f"{self.root}/{folder}/{part}")
        return folder

    def _followed(self, now: dict, rows: DataFrame, follow: Follow | None, how: str) -> dict:
        """The manifest's indexes, with a folder more of what has come or gone; those that nobody follows are left out."""
        return {name: entry | {how: [*entry[how], self._written(follow[name](rows))]} for name, entry in now["indexes"].items() if name in (follow or {})}

    def add_index(self, name: str, tables: dict[str, DataFrame]) -> bool:
        """Stores tables that were derived from the articles as they are now; false if they have changed meanwhile."""
        now, folder = self.manifest(), self._written(tables)
        done = self._commit(now, indexes=now["indexes"] | {name: {"base": folder, "added": [], "gone": []}})
        if not done:
            remove(self.spark, f"{self.root}/{folder}")
        return done

    def index(self, name: str) -> Stored | None:
        """An index of the articles as they are now, if there is one."""
        found = self.manifest()["indexes"].get(name)
        return found and Stored(self.spark, f"{self.root}/{found['base']}", *([f"{self.root}/{f}" for f in found[how]] for how in ("added", "gone")))


@dataclass(frozen=True)
class Stored:
    """Folders of an index: what it was made with, and what has come and gone since, each with a table for each part."""

    spark: SparkSession
    base: str
    added: list[str]
    gone: list[str]

    def table(self, part: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.base}/{part}")

    def changes(self, how: str, part: str) -> DataFrame | None:
        """A part of all that has come (``added``) or gone; None if nothing has."""
        folders = getattr(self, how)
        return self.spark.read.parquet(*[f"{f}/{part}" for f in folders]) if folders else None

    def now(self, part: str) -> DataFrame:
        """A part whose rows carry the articles' ids, as it is now."""
        rows, added, gone = self.table(part), self.changes("added", part), self.changes("gone", part)
        rows = rows if added is None else rows.unionByName(added, allowMissingColumns=True)
        return rows if gone is None else rows.join(gone.select("id").distinct(), "id", "left_anti")


def _folders(manifest: dict) -> set[str]:
    indexes = [f for x in manifest["indexes"].values() for f in (x["base"], *x["added"], *x["gone"])]
    return {f for f in [manifest["cold"], *manifest["hot"], *indexes] if f}


def tiered(cold: DataFrame, hot: DataFrame) -> DataFrame:
    return cold.unionByName(hot, allowMissingColumns=True)


def without(articles: DataFrame, ids: DataFrame) -> DataFrame:
    return articles.join(ids, "id", "left_anti")


def in_order(rows: DataFrame, order: list[str], last: int, into: str) -> DataFrame:
    """``rows`` with the numbers after ``last`` by an order, in column ``into``: sorted over all tasks, each task's count moves the next one's."""
    spark = rows.sparkSession
    row, number, by = (free(x, [*rows.columns, into]) for x in ("row", "task", "shift"))
    placed = cut(rows.orderBy(*[f"`{c}`" for c in order])).withColumn(row, F.monotonically_increasing_id())
    task = F.shiftright(row, 33)
    shift, at = [], last + 1
    for n, count in sorted(placed.groupBy(task.alias("t")).count().collect()):
        shift.append((n, at - (n << 33)))
        at += count
    shifts = F.broadcast(spark.createDataFrame(shift, f"`{number}` long, `{by}` long"))  # a row for each task
    return placed.withColumn(number, task).join(shifts, number).withColumn(into, F.col(row) + F.col(by)).drop(row, number, by)


def numbered_from(rows: DataFrame, last: int) -> DataFrame:
    """Ids after ``last`` by order of (namespace, title, url)."""
    numbered = in_order(rows, ["namespace", "title", "url"], last, "id")

    def told(f: StructField) -> Column:
        return (F.col(f.name) if f.name in numbered.columns else F.lit(None)).cast(f.dataType).alias(f.name)

    return numbered.select(*[told(f) for f in ARTICLE])


def title_clash(fresh: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of ``fresh`` whose tenant has no article of that title yet; _ counts as a blank and case doesn't count."""
    key = lambda c: F.lower(F.trim(F.translate(c, "_", " ")))
    have = known.select(F.col("namespace").alias("known_namespace"), key(F.col("title")).alias("known_title")).distinct()
    left = fresh.alias("fresh")
    same = (F.col("fresh.namespace") == have["known_namespace"]) & (key(F.col("fresh.title")) == have["known_title"])
    return left.join(have, same, "left_anti")
