"""Entity co-occurrence graph: typed weighted edges and two-hop search with the path that led to each article."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .glossary import EDGE_TYPES

HOP_STEP, UNTYPED_TRUST, LEAST_WEIGHT = 0.5, 0.5, 1


def pairs(entities: DataFrame, keys: list[str]) -> DataFrame:
    """Unordered pairs a < b of the entities that share the keys.

    Of the glossary's own entities a group holds at most all, so their pairs are bounded by the glossary, not by the data. Names that the
    law rule finds by its pattern have no such bound: a group's pairs are quadratic in how many of them it names.
    """
    sets = entities.groupBy("namespace", *keys).agg(F.array_sort(F.collect_set("entity")).alias("e")).where(F.size("e") > 1)
    firsts = sets.select("namespace", *keys, "e", F.posexplode("e").alias("i", "a"))
    return firsts.select("namespace", *keys, "a", F.explode(F.slice("e", F.col("i") + 2, F.size("e"))).alias("b"))


def typed_edges(entities: DataFrame, relations: DataFrame) -> DataFrame:
    """(namespace, src, dst, edge_type, cnt), both directions: one for each article that holds a pair, one more for each document.

    ``entities``: (namespace, id, doc, entity). A pair's type is that of the first relation between the two, whichever way.
    """
    both = pairs(entities.select("namespace", "id", "entity"), ["id"]).select("namespace", "a", "b")
    if "doc" in entities.columns:
        both = both.unionByName(pairs(entities.select("namespace", "doc", "entity"), ["doc"]).select("namespace", "a", "b"))
    counted = both.groupBy("namespace", "a", "b").agg(F.count("*").alias("cnt"))
    known = relations.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b"), "type", "ord").groupBy("a", "b").agg(F.min_by("type", "ord").alias("type"))
    one = counted.join(known, ["a", "b"], "left").select("namespace", "a", "b", F.coalesce("type", F.lit("UNTYPED")).alias("edge_type"), "cnt")
    ends = F.explode(F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst"))))
    return one.select("namespace", ends.alias("x"), "edge_type", "cnt").select("namespace", "x.src", "x.dst", "edge_type", "cnt")


def with_changes(stored, relations: DataFrame) -> dict[str, DataFrame]:
    """Entities and edges of a stored graph as it is now (tables ``entities`` and ``edges``; what has come and gone since: ``entities``).

    Edges count pairs of an article and of a document, and what comes or goes belongs to a few documents: the edges of these, as they
    were, are taken from the stored ones, and as they are now, added.
    """
    entities, edges = stored.now("entities"), stored.table("edges")
    changed = [x for x in (stored.changes("added", "entities"), stored.changes("gone", "entities")) if x is not None]
    if not changed:
        return {"entities": entities, "edges": edges}
    docs = changed[0].select("namespace", "doc")
    for x in changed[1:]:
        docs = docs.unionByName(x.select("namespace", "doc"))
    docs = docs.distinct()
    was, is_ = (typed_edges(x.join(docs, ["namespace", "doc"], "left_semi"), relations) for x in (stored.table("entities"), entities))
    every = edges.unionByName(was.withColumn("cnt", -F.col("cnt"))).unionByName(is_)
    counted = every.groupBy("namespace", "src", "dst", "edge_type").agg(F.sum("cnt").alias("cnt")).where("cnt > 0")
    return {"entities": entities, "edges": counted}


def links(edges: DataFrame, least: int = LEAST_WEIGHT, typed: bool = True) -> DataFrame:
    """(namespace, src, dst, edge_type, step): what a step along an edge keeps of a weight.

    ``typed=False`` is the older form: every step keeps a half, whatever the edge's count and type.
    """
    rank = F.create_map(*[F.lit(x) for i, t in enumerate(EDGE_TYPES) for x in (t, i)])
    by_pair = edges.groupBy("namespace", "src", "dst").agg(F.sum("cnt").alias("w"), F.max_by("edge_type", F.struct(F.col("cnt"), -rank[F.col("edge_type")])).alias("edge_type"))
    most = F.max("w").over(Window.partitionBy("namespace", "src"))
    trust = F.when(F.col("edge_type") == "UNTYPED", UNTYPED_TRUST).otherwise(1.0)
    step = F.lit(HOP_STEP) * F.col("w") / most * trust if typed else F.lit(HOP_STEP)
    return by_pair.withColumn("step", step).where(F.col("w") >= least).select("namespace", "src", "dst", "edge_type", "step")


def reach(seeds: DataFrame, steps: DataFrame, hops: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., namespace, entity, weight, hop, path) of the entities within ``hops`` steps of the seeds (by..., namespace, entity).

    Level by level: an entity's hop is its least distance, its weight the greatest over the level before, ties to the parent that
    sorts first. The path is an array of (from, type, to). With ``by`` many questions are asked at once, each from its own seeds.
    """
    step_type, key = "array<struct<from:string,type:string,to:string>>", [*by, "namespace"]
    start = (F.lit(1.0).alias("weight"), F.lit(0).alias("hop"), F.array().cast(step_type).alias("path"))
    level = seeds.select(*key, "entity", *start).distinct()
    seen = level
    ways = steps.select(F.col("namespace").alias("__ns"), "src", "dst", "edge_type", "step")
    for hop in range(1, hops + 1):
        onward = level.join(ways, (F.col("namespace") == F.col("__ns")) & (F.col("entity") == F.col("src")))
        taken = F.struct(F.col("src").alias("from"), F.col("edge_type").alias("type"), F.col("dst").alias("to"))
        grown = onward.select(*key, F.col("dst").alias("entity"), (F.col("weight") * F.col("step")).alias("weight"), F.concat("path", F.array(taken)).alias("path"), "src")
        fresh = grown.join(seen.select(*key, "entity"), [*key, "entity"], "left_anti")
        best = fresh.groupBy(*key, "entity").agg(F.max("weight").alias("weight"), F.min_by("path", F.struct(-F.col("weight"), F.col("src"))).alias("path"))
        level = best.select(*key, "entity", "weight", F.lit(hop).alias("hop"), "path")
        seen = seen.unionByName(level)
    return seen


def search(entities: DataFrame, steps: DataFrame, seeds: DataFrame, hops: int = 2, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., namespace, id, score, best_entity, path): an article's score is the sum of its reached entities' weights."""
    found = reach(seeds, steps, hops, by)
    held = entities.select("namespace", "id", "entity").distinct().join(found, ["namespace", "entity"])
    order = F.struct(-F.col("weight"), F.col("hop"), F.col("entity"))
    first = (F.min_by("entity", order).alias("best_entity"), F.min_by("path", order).alias("path"))
    return held.groupBy(*by, "namespace", "id").agg(F.sum("weight").alias("score"), *first)


def path_text(path: Column) -> Column:
    return F.array_join(F.transform(path, lambda p: F.concat(p["from"], F.lit(" -"), p["type"], F.lit("-> "), p["to"])), "; ")


def stats(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Per tenant: entities, undirected edges, articles, and typed pair counts of the edge table."""
    nodes = entities.groupBy("namespace").agg(F.count_distinct("entity").alias("entities"), F.count_distinct("id").alias("articles"))
    half = edges.where("src < dst").groupBy("namespace").agg(F.count_distinct("src", "dst").alias("edges"), F.coalesce(F.sum(F.when(F.col("edge_type") != "UNTYPED", F.col("cnt"))), F.lit(0)).alias("typed_cnt"), F.sum("cnt").alias("total_cnt"))
    return nodes.join(half, "namespace", "left").na.fill(0, ["edges", "typed_cnt", "total_cnt"])
