"""Neighbours and ranks within a key, without a window over a whole key's rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..lineage import cut
from ..schema import free

#: Ids of a block; bins of a value's range in one turn, and rows of a bin that one task may rank.
BLOCK, BINS, FEW = 65_536, 4096, 10_000


def with_next(rows: DataFrame, key: str, order: str, value: str, into: str, block: int = BLOCK) -> DataFrame:
    """``rows`` with the ``value`` of the next row of its key by ``order`` (whole numbers, each once in a key); null for the last.

    Rows are ordered within blocks of ids; a block's last row gets the first one of the next block that has rows. Other columns stay,
    whatever their names; ``into`` is replaced.
    """
    taken = [*rows.columns, into]
    place, first, after, k, b, following, last = (free(x, taken) for x in ("block", "first", "after", "k", "b", "following", "last"))
    placed = rows.withColumn(place, F.floor(F.col(order) / block))
    firsts = placed.groupBy(key, place).agg(F.min_by(value, order).alias(first))
    later = firsts.withColumn(after, F.lead(first).over(Window.partitionBy(key).orderBy(place)))
    later = later.select(F.col(key).alias(k), F.col(place).alias(b), after)
    inside = Window.partitionBy(key, place).orderBy(order)
    dealt = placed.withColumn(following, F.lead(value).over(inside)).withColumn(last, F.lead(order).over(inside).isNull())
    met = dealt.join(later, dealt[key].eqNullSafe(later[k]) & (dealt[place] == later[b]))
    kept = [F.col(f"`{c}`") for c in rows.columns if c.lower() != into.lower()]
    return met.select(*kept, F.when(F.col(last), F.col(after)).otherwise(F.col(following)).alias(into))


def nearest_rank(rows: DataFrame, key: str, value: str, share: float, low: float, high: float, bins: int = BINS, few: int = FEW) -> DataFrame:
    """(key, value): of each key the value at place floor(share * (n - 1)) of its rows in order, exact, for any distribution.

    Values (in ``low`` to ``high``) are counted in bins of their key's range, and the range narrows to the bin that holds the place, again
    and again, until it has one value or ``few`` rows; only those are ranked. So values that are all alike, or nearly, land in no task
    together: each turn sends on counts. Null values don't count; NaN and others out of range go to the ends.
    """
    bins = max(bins, 2)  # the least and the greatest value are then in different bins, so each turn narrows
    own = rows.where(F.col(value).isNotNull()).select(F.col(key).alias("k"), F.least(F.greatest(F.col(value).cast("double"), F.lit(float(low))), F.lit(float(high))).alias("v"))
    spans = own.groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
    spans = cut(spans.select("k", "a", "b", "n", F.floor(F.lit(share) * (F.col("n") - 1)).cast("long").alias("place")))
    while True:
        wide = spans.where((F.col("n") > few) & (F.col("a") < F.col("b")))
        if wide.isEmpty():
            break
        inside = own.join(wide, own["k"].eqNullSafe(wide["k"])).select(own["k"], "v", "a", "b", "place")
        inside = inside.where(F.col("v").between(F.col("a"), F.col("b")))
        at = F.least(F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins), F.lit(bins - 1)).cast("int")
        counts = inside.withColumn("bin", at).groupBy("k", "place", "bin").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b"))
        upto = F.sum("n").over(Window.partitionBy("k").orderBy("bin")) - F.col("n")
        held = counts.withColumn("before", upto).where((F.col("place") >= F.col("before")) & (F.col("place") < F.col("before") + F.col("n")))
        narrowed = held.select("k", "a", "b", "n", (F.col("place") - F.col("before")).alias("place"))
        spans = cut(spans.where(~((F.col("n") > few) & (F.col("a") < F.col("b")))).unionByName(narrowed))
    alike = spans.where(F.col("a") == F.col("b")).select("k", F.col("a").alias("v"))
    rest = spans.where(F.col("a") < F.col("b"))
    met = own.join(rest, own["k"].eqNullSafe(rest["k"])).where(F.col("v").between(F.col("a"), F.col("b"))).select(own["k"], "v", "place")
    ranked = met.withColumn("r", F.row_number().over(Window.partitionBy("k").orderBy("v")) - 1).where(F.col("r") == F.col("place")).select("k", "v")
    return alike.unionByName(ranked).select(F.col("k").alias(key), F.col("v").alias(value))
