"""Line dedup by a deletion-neighbourhood join: lines within one word of an earlier line go. Native expressions only."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from .common import Scratch, free, join_spread, let, stored

#: Lines of fewer words aren't held against lines one word apart; their repeats go all the same.
LEAST_WORDS = 6
#: Slots of a filter that is sent to every task: 2048 bitmaps of 4096 bytes, whatever the input.
SLOTS, PAGE = 2**26, 32_768


def filter_of(keys: DataFrame) -> DataFrame:
    """Bitmaps (page, bits) of the slots that the keys (column ``key``, a long) fall into."""
    slots = keys.select(F.pmod("key", F.lit(SLOTS)).alias("slot")).distinct()
    paged = slots.select(F.floor(F.col("slot") / PAGE).cast("int").alias("page"), (F.col("slot") % PAGE).alias("bit")).repartition("page")
    return paged.groupBy("page").agg(F.bitmap_construct_agg("bit").alias("bits"))


def may_hold(df: DataFrame, bitmaps: DataFrame, key: Column, into: str) -> DataFrame:
    """``df`` with the flag ``into``: false only where the filter's keys don't have the row's key. The filter's size has a fixed bound."""
    slot, page, bits = (free(name, [*df.columns, into]) for name in ("__slot", "__page", "__bits"))
    placed = df.withColumn(slot, F.pmod(key, F.lit(SLOTS))).withColumn(page, F.floor(F.col(slot) / PAGE).cast("int"))
    joined = placed.join(F.broadcast(bitmaps.select(F.col("page").alias(page), F.col("bits").alias(bits))), page, "left")
    bit = (F.col(slot) % PAGE).cast("int")
    byte = F.conv(F.hex(F.substring(F.col(bits), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), bit % 8)) != 0
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], F.coalesce(held, F.lit(False)).alias(into))


def one_blank(raw: Column) -> Column:
    """The words of a line with one blank between; most lines are so already, which plain searches tell."""
    odd = raw.startswith(" ") | raw.endswith(" ")
    for blanks in ("  ", "\t", "\r", "\v", "\f"):
        odd = odd | raw.contains(blanks)
    return F.when(odd, F.btrim(F.regexp_replace(raw, "[\\x20\\x09-\\x0D]+", " "))).otherwise(raw)


def numbered_lines(docs: DataFrame, id_col: str, text_col: str, least: int = LEAST_WORDS) -> DataFrame:
    """Every line of ``least`` words or more, with a word at least: id, hash of the text, line number from 0, flat words, their number
    n, 128-bit digest p, q, place.

    ``place`` orders lines by id, then line number; it is a decimal, which aggregates by hash as a pair would not.
    """
    text = F.col(f"`{text_col}`").cast("string")
    # a text is hashed before its lines are dealt out, and a line is made flat before the filter, which would do it again
    flat = F.transform(F.split(text, "\n"), one_blank)
    whole = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(text).alias("copy"), flat.alias("all"))
    own = whole.select("id", "copy", F.posexplode("all").alias("line", "flat"))
    blanks = F.octet_length("flat") - F.octet_length(F.replace(F.col("flat"), F.lit(" "), F.lit("")))
    long_enough = own.withColumn("n", blanks + 1).where((F.col("n") >= least) & (F.col("flat") != ""))
    place = F.col("id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("line").cast("decimal(10,0)")
    digest = (F.xxhash64(F.lit(1), "flat").alias("p"), F.xxhash64("flat", F.lit(2)).alias("q"))
    return long_enough.select("id", "copy", "line", "flat", "n", *digest, place.cast("decimal(32,0)").alias("place"))


def halves(flat: Column, n: Column) -> list[Column]:
    """Keys of which two lines within one edit share one: what an edit in one half leaves of the other, at both lengths that it may have.

    The first two are of beginnings, the last two of ends. Lines of m and m + 1 words meet at floor(m / 2), of m and m words too.
    Where both lengths are one, the second key is null. Lines under LEAST_WORDS have none.
    """
    long, short = F.floor(n / 2).cast("int"), F.floor((n - 1) / 2).cast("int")

    def key(kind: int, size: Column) -> Column:
        return F.xxhash64(F.lit(kind), F.call_function("substring_index", flat, F.lit(" "), size if kind == 3 else -size))

    wide, even = n >= LEAST_WORDS, (n >= LEAST_WORDS) & (long != short)
    return [F.when(wide, key(3, long)), F.when(even, key(3, short)), F.when(wide, key(4, long)), F.when(even, key(4, short))]


def _all_of(values: Column) -> Column:
    return F.aggregate(values, F.lit(0).cast("long"), lambda sofar, x: sofar.bitwiseXOR(x))


def _before(values: Column) -> Column:
    """Of each place the values before it, taken together; in blocks of the root of their number, so that a long array doesn't cost its square."""

    def dealt(span: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / span).cast("int")), lambda b: F.slice(values, b * span + 1, span))
        return let(blocks, lambda each: let(bases(each), lambda base: F.flatten(F.transform(each, lambda block, b: begun(block, F.get(base, b))))))

    def bases(blocks: Column) -> Column:
        return let(F.transform(blocks, _all_of), lambda wholes: F.transform(wholes, lambda _, b: _all_of(F.slice(wholes, F.lit(1), b))))

    def begun(block: Column, base: Column) -> Column:
        return F.transform(block, lambda _, i: base.bitwiseXOR(_all_of(F.slice(block, F.lit(1), i))))

    return let(F.greatest(F.lit(8), F.sqrt(F.size(values)).cast("int")), dealt)


def hashed(*values: Column) -> Column:
    return F.xxhash64(*values)


def variants(w: Column, low: Column, high: Column) -> Column:
    """Hashed keys (k, kind) of a line: itself (0), and for each word from ``low`` to ``high`` the line without it, plain (1) and with the place (2).

    ``w`` holds hashes of the words. A line and one with a word more share the shorter line's plain key; lines that differ in one
    word share the key with its place. A key is made of the hashes of all words with their places, taken together by exclusive or:
    a word that goes takes its own out and moves those of the words after it one place on, so that each variant costs one
    step and not the line's length.
    """

    def key(k: Column, kind: int) -> Column:
        return F.struct(k.alias("k"), F.lit(kind).alias("kind"))

    def keyed(here: Column, moved: Column) -> Column:
        def each(x: Column) -> Column:
            def dropped(i: Column) -> Column:
                plain = x["every"].bitwiseXOR(F.get(moved, i)).bitwiseXOR(F.get(x["before"], i))
                return let(plain, lambda k: F.array(key(k, 1), key(hashed(k, i), 2)))

            return F.flatten(F.transform(F.sequence(low, high), dropped))

        before = _before(F.zip_with(here, moved, lambda x, y: x.bitwiseXOR(y)))
        return F.concat(F.array(key(_all_of(here), 0)), let(F.struct(before.alias("before"), _all_of(moved).alias("every")), each))

    here, moved = F.transform(w, lambda x, j: hashed(x, j)), F.transform(w, lambda x, j: hashed(x, j - 1))
    return let(here, lambda a: let(moved, lambda b: keyed(a, b)))


def within_one(a: Column, b: Column) -> Column:
    """Are two arrays of words at most one insertion, deletion or substitution apart? From the words they begin and end with alike."""

    def alike(x: Column, y: Column) -> Column:
        n = F.least(F.size(x), F.size(y))
        first = F.filter(F.sequence(F.lit(0), n), lambda i: (i == n) | (F.get(x, i) != F.get(y, i)))
        return first[0]

    def tails(x: Column, y: Column, k: Column) -> Column:
        same = F.size(x) == F.size(y)
        rest = F.when(same, F.slice(y, k + 2, F.size(x))).otherwise(F.slice(y, k + 1, F.size(x)))
        return (F.size(x) - F.size(y) <= 1) & (F.slice(x, k + 2, F.size(x)) == rest)

    longer = F.size(a) >= F.size(b)
    long, short = F.when(longer, a).otherwise(b), F.when(longer, b).otherwise(a)
    return let(long, lambda x: let(short, lambda y: let(alike(x, y), lambda k: tails(x, y, k))))


def shared_keys(keys: DataFrame) -> DataFrame:
    """Rows (p, k, ...) whose key stands with two lines or more; keys are counted before rows are picked, so no group is gathered."""
    twice = keys.groupBy("k").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a <> b").select("k")
    return keys.join(twice, "k", "left_semi")


def superseded_classes(own: DataFrame, classes: DataFrame, keep: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(p, q) of the classes of equal lines that have an earlier class within one word.

    Only classes that share a half with another go on to the deletion neighbourhoods (two lines within one edit always share one);
    their words are read again, through a filter that lets few other lines pass. A key's classes aren't paired: each key gives the place
    of its earliest line, and a class is superseded if one of its keys has an earlier one, which is verified by its words.
    """
    # classes that share a beginning or an end, and which
    parts = F.array(*[F.struct(F.col(c).alias("k"), F.lit(int(c[0] == "e")).alias("end")) for c in ("b0", "b1", "e0", "e1")])
    halved = classes.where("b0 is not null").select("p", F.explode(F.filter(parts, lambda x: x["k"].isNotNull())).alias("x")).select("p", "x.k", "x.end")
    suspects = shared_keys(halved).groupBy("p").agg(F.min("end").alias("least"), F.max("end").alias("most"))
    suspects = keep(classes.select("p", "q", "place").join(suspects, "p"))

    near = may_hold(own.select("p", "q", "flat"), filter_of(suspects.select(F.col("p").alias("key"))), F.col("p"), "may").where("may")
    words = near.groupBy("p", "q").agg(F.first("flat").alias("flat"))
    found = keep(words.join(suspects, ["p", "q"]).withColumn("w", F.split("flat", " ")).drop("flat"))

    # what a shared beginning leaves is an edit in the second half, a shared end one in the first
    n = F.size("w")
    half = F.floor((n - 1) / 2).cast("int")
    low, high = F.when(F.col("most") == 1, 0).otherwise(half), F.when(F.col("least") == 0, n - 1).otherwise(n - 1 - half)
    short = found.select("p", low.cast("int").alias("low"), high.cast("int").alias("high"), F.transform("w", lambda x: F.xxhash64(x)).alias("w"))
    keys = keep(short.select("p", F.explode(variants(F.col("w"), F.col("low"), F.col("high"))).alias("x")).select("p", "x.k", "x.kind"))
    met = shared_keys(keys).join(found.select("p", "place"), "p")
    earliest = met.groupBy("k").agg(F.min(F.when(F.col("kind") != 1, F.col("place"))).alias("whole"), F.min("place").alias("any"))
    # a key that lacks a word (kind 1) meets the line itself; the line itself meets either; kind 2 meets its like
    claims = met.join(earliest, "k").withColumn("e", F.when(F.col("kind") == 0, F.col("any")).otherwise(F.col("whole")))
    claims = claims.where(F.col("e") < F.col("place")).select("p", "e", "k").distinct()
    tested = keep(verified(claims, found))
    good = tested.where("good").select("p", "q").distinct()
    # a claim fails only where hashes of different lines meet; then all earlier lines of the key are tried
    failed = tested.where(~F.col("good")).select("p", "k").distinct()
    if failed.isEmpty():
        return good
    mine = failed.join(met.select("p", "k", "place"), ["p", "k"])
    pairs = mine.join(met.select("k", F.col("place").alias("e")), "k").where(F.col("e") < F.col("place")).select("p", "e", "k").distinct()
    return good.unionByName(verified(pairs, found).where("good").select("p", "q")).distinct()


def verified(claims: DataFrame, found: DataFrame) -> DataFrame:
    """Claims (p, e, k) that class p has an earlier line at place e within one word: (p, q, k, good), by the words of both."""
    theirs = found.select(F.col("place").alias("e"), F.col("w").alias("v"))
    both = claims.join(theirs, "e").join(found.select("p", "q", "w", "place"), "p")
    return both.select("p", "q", "k", ((F.col("e") < F.col("place")) & within_one(F.col("w"), F.col("v"))).alias("good"))


def superseded(docs: DataFrame, keep: Callable[[DataFrame], DataFrame], id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """(id, copy, line) of the lines to drop: occurrences that have an earlier line within one word, by id and line number.

    Equal lines are one class, made first, so that a frequent line is one row. The occurrences of the most frequent classes meet
    their class by broadcast, so that none of them lands in one task.
    """
    own = numbered_lines(docs, id_col, text_col, least)
    names = ("b0", "b1", "e0", "e1")
    parts = [h.alias(c) for h, c in zip(halves(F.col("flat"), F.col("n")), names, strict=True)]
    seen = keep(own.select("id", "copy", "line", "p", "q", "place", *parts))
    classes = keep(seen.groupBy("p", "q").agg(F.min("place").alias("place"), F.count("*").alias("times"), *[F.first(c).alias(c) for c in names]))
    gone = superseded_classes(own, classes, keep).withColumn("gone", F.lit(True))

    # only classes that occur twice or are superseded lose a line
    joined = classes.select("p", "q", "place", "times").join(gone, ["p", "q"], "left").where((F.col("times") > 1) | F.col("gone"))
    losing = keep(joined.select("p", "q", F.col("place").alias("first"), F.coalesce("gone", F.lit(False)).alias("gone"), "times"))
    total = classes.agg(F.sum("times")).first()[0] or 0
    met = join_spread(seen.select("id", "copy", "line", "p", "q", "place"), losing, ["p", "q"], "times", total)
    return met.where(F.col("gone") | (F.col("first") < F.col("place"))).select("id", "copy", "line")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the superseded lines taken out of the text, and ``n_lines`` and ``n_dropped`` (after a clash with ``_`` before).

    A line is superseded by an earlier one that equals it or is one word from it (blanks aside); earlier by id, then line number.
    Lines from ``least`` to under LEAST_WORDS words are superseded by equal lines only. Lines under ``least`` words, those without a
    word and rows of a null id are left alone; null texts stay null, texts that lose all lines become empty. Repeated rows (one id
    and text) count as one place and keep the same lines. Other columns stay as they are, whatever their names; an empty table gives
    no rows. Ids are whole numbers; others raise TypeError.
    """
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must hold whole numbers")
    the_id, the_text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    with Scratch(docs.sparkSession) as keep:
        lost = superseded(docs.where(the_id.isNotNull()), keep, id_col, text_col, least)
        lost = stored(lost.distinct().groupBy("id", "copy").agg(F.collect_list("line").alias("gone")))
    may, its_id, copy, gone = (free(name, docs.columns) for name in ("__may", "__id", "__copy", "__gone"))
    lost = lost.select(F.col("id").alias(its_id), F.col("copy").alias(copy), F.col("gone").alias(gone))
    text = the_text.cast("string")
    marked = may_hold(docs, filter_of(lost.select(F.col(copy).alias("key"))), F.xxhash64(text), may)
    # texts that can't have lost a line aren't moved
    touched = marked.where(F.col(may)).drop(may)
    touched = touched.join(lost, (the_id == F.col(its_id)) & (F.xxhash64(text) == F.col(copy)), "left")
    lines = F.split(text, "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), F.col(gone))
    left = let(lines, lambda x: F.array_join(F.transform(stay, lambda i: F.get(x, i)), "\n"))
    kept = F.when(F.col(gone).isNull(), the_text).otherwise(left)

    def counted(dropped: Column) -> list[Column]:
        n = F.when(the_text.isNull(), 0).otherwise(F.size(lines))
        return [n.cast("long").alias(free("n_lines", docs.columns)), dropped.cast("long").alias(free("n_dropped", docs.columns))]

    columns = [F.col(f"`{c}`") for c in docs.columns]
    rebuilt = touched.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in docs.columns], *counted(F.coalesce(F.size(gone), F.lit(0))))
    return marked.where(~F.col(may)).select(*columns, *counted(F.lit(0))).unionByName(rebuilt)
