"""Quality rules as a short-circuit cascade: rules go by rejections for their cost, both estimated on a sample. Native expressions only."""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free, let

BLANKS = " \t\n\v\f\r"
SYMBOLS = "#*$%&|<>"
#: Rows of the sample that orders the rules. It moves no verdict: a document is kept if no rule rejects it.
SAMPLE = 2000
#: Nanoseconds that a rule takes for a row by itself, for a character of a search for a sign, of a pattern's scan, of a scan that
#: looks back at what it found, and of a split into lines, as measured on whole texts.
ROW, FIND, SCAN, LOOK_BACK, SPLIT = 50, 1, 19, 26, 6


def whole(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def words(text: Column) -> Column:
    bare = F.btrim(text, F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, "[\\x20\\x09-\\x0D]+"))


def count_of(text: Column, signs: str) -> Column:
    return F.length(text) - F.length(F.translate(text, signs, ""))


def duplicate_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier one."""
    return let(F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""), lambda x: F.size(x) - F.size(F.array_distinct(x)))


def _twin(items: Column, same: Callable[[Column, Column], Column]) -> Column:
    """Of a sorted array the items that equal a neighbour."""
    return F.filter(items, lambda x, j: F.coalesce(same(x, F.get(items, j - 1)), F.lit(False)) | F.coalesce(same(x, F.get(items, j + 1)), F.lit(False)))


def repeated_words(w: Column, width: int = 3) -> Column:
    """Words in windows of ``width`` words that occur twice or more in the array.

    Windows are first sorted as longs that hold the upper bits of their hash and their place below; only those whose upper bits
    meet are then compared word by word, so the count is exact.
    """

    def window(i: Column) -> list[Column]:
        return [F.get(w, (i + k).cast("int")) for k in range(width)]

    def counted(bits: Column) -> Column:
        starts = F.slice(w, F.lit(1), F.size(w) - (width - 1))
        upper = F.bitwise_not(_shift(F.lit(1).cast("long"), bits, "left") - 1)
        packed = let(upper, lambda u: F.sort_array(F.transform(starts, lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, width)]).bitwiseAND(u).bitwiseOR(i.cast("long")))))
        return let(packed, lambda p: let(F.transform(_twin(p, lambda x, y: _shift(x, bits, "right") == _shift(y, bits, "right")), lambda x: x.bitwiseAND(_shift(F.lit(1).cast("long"), bits, "left") - 1)), exact))

    def exact(at: Column) -> Column:
        spelled = F.sort_array(F.transform(at, lambda i: F.struct(F.concat_ws(" ", *window(i)).alias("g"), i.alias("i"))))
        covered = let(spelled, lambda s: F.size(F.array_distinct(F.flatten(F.transform(_twin(s, lambda x, y: x["g"] == y["g"]), lambda x: F.array(*[x["i"] + k for k in range(width)]))))))
        return F.when(F.size(at) == 0, 0).otherwise(covered)

    return F.when(F.size(w) <= width, 0).otherwise(let((F.ceil(F.log2(F.size(w))) + 1).cast("int"), counted))


def _shift(value: Column, bits: Column, way: str) -> Column:
    return F.call_function(f"shift{way}", value, bits)


def base_columns(text: Column) -> Column:
    """A struct of the counts that the contract names, of whole texts; null counts as empty."""
    t = whole(text)
    return let(
        words(t),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            (F.length(t) - count_of(t, BLANKS)).cast("long").alias("word_chars"),
            count_of(t, SYMBOLS).cast("long").alias("n_symbols"),
            duplicate_lines(t).cast("long").alias("n_dup_lines"),
            repeated_words(w).cast("long").alias("n_repeat_words"),
        ),
    )


@dataclass(frozen=True)
class Facts:
    """What rules ask of a document: its text and the counts that several of them use, as columns."""

    text: Column
    n_words: Column
    word_chars: Column
    n_symbols: Column
    n_dup_lines: Column


def facts(text: Column) -> Facts:
    """From the text alone."""
    return Facts(text, F.regexp_count(text, F.lit("[^\\x20\\x09-\\x0D]++")), F.length(text) - count_of(text, BLANKS), count_of(text, SYMBOLS), duplicate_lines(text))


@dataclass(frozen=True)
class Rule:
    """Rejects a document where ``rejects`` of its facts (never null) is true, which takes about ``cost`` of its facts nanoseconds."""

    name: str
    rejects: Callable[[Facts], Column]
    cost: Callable[[Facts], Column] = lambda _: F.lit(ROW)


def _often(name: str, pattern: str, most: float, sign: str | None = None, scan: int = SCAN) -> Rule:
    """Do places of a pattern come to more than a share of the words? Texts without the ``sign`` that it needs have none."""

    def rejects(f: Facts) -> Column:
        places = F.regexp_count(f.text, F.lit(pattern))
        return F.when(f.text.contains(sign), places).otherwise(0) > most * f.n_words if sign else places > most * f.n_words

    def cost(f: Facts) -> Column:
        scanned = F.when(f.text.contains(sign), FIND + scan).otherwise(FIND) if sign else F.lit(scan)
        return ROW + F.length(f.text) * scanned

    return Rule(name, rejects, cost)


def _lines(f: Facts) -> Column:
    return F.size(F.filter(F.split(f.text, "\n"), lambda x: F.btrim(x, F.lit(BLANKS)) != ""))


RULES = (
    Rule("symbols", lambda f: f.n_symbols > 0.25 * f.n_words),
    _often("shouting", "(?<!\\S)[\\p{Lu}\\p{P}]{2,}+(?!\\S)", 0.4),
    _often("exclaimed", "!!(?!\\S)", 0.2, "!!"),
    _often("tabular", "(?<!\\S)\\|(?!\\S)", 0.2, "|"),
    _often("stuttering", "(?<!\\S)(\\S++)(?=\\s+\\1(?!\\S))", 0.2, scan=LOOK_BACK),
    Rule("long_words", lambda f: f.word_chars > 40 * f.n_words),
    Rule("repeated_lines", lambda f: f.n_dup_lines * 2 > _lines(f), lambda f: ROW + F.length(f.text) * SPLIT),
)


def drawn(docs: DataFrame, by: list[str], sample: int = SAMPLE) -> DataFrame:
    """``sample`` rows at most, those of the least hash of the columns ``by``: rows are drawn one by one, copies of a text too if ids differ.

    Only rows below a threshold, about four times the sample of the whole table, meet in the task that picks the least.
    """
    share = min(1.0, 4 * sample / max(docs.count(), 1))
    place = F.xxhash64(*by)
    return docs.where(F.pmod(place, F.lit(2**40)) <= int(share * 2**40)).orderBy(place).limit(sample)


def measured(sampled: DataFrame, known: Facts, rules: tuple[Rule, ...]) -> list[tuple[tuple[bool, ...], int, list[float]]]:
    """What the sample says of the rules, in one job: for each set of verdicts that occurs, how many rows have it and what each rule costs there."""
    flags = [rule.rejects(known).alias(f"r{i}") for i, rule in enumerate(rules)]
    costs = [rule.cost(known).cast("double").alias(f"c{i}") for i, rule in enumerate(rules)]
    names = [f"r{i}" for i in range(len(rules))]
    groups = sampled.select(*flags, *costs).groupBy(*names).agg(F.count("*").alias("n"), *[F.sum(f"c{i}").alias(f"c{i}") for i in range(len(rules))])
    return [(tuple(g[x] for x in names), g["n"], [g[f"c{i}"] for i in range(len(rules))]) for g in groups.collect()]


def ordered(found: list[tuple[tuple[bool, ...], int, list[float]]], rules: tuple[Rule, ...] = RULES) -> list[Rule]:
    """The rules by rejections for their cost, each among the rows that the rules before it leave; then the cheapest first, then by name."""
    out: list[int] = []
    while len(out) < len(rules):

        def gain(i: int) -> tuple:
            cost = sum(c[i] for _, _, c in found)
            return -sum(n for flags, n, _ in found if flags[i]) / max(cost, 1.0), cost, rules[i].name

        best = min((i for i in range(len(rules)) if i not in out), key=gain)
        out.append(best)
        found = [x for x in found if not x[0][best]]
    return [rules[i] for i in out]


def cascade(known: Facts, rules: list[Rule]) -> Column:
    """The name of the first rule that rejects, null if none does; later rules aren't evaluated then."""
    out = F.lit(None).cast("string")
    for rule in reversed(rules):
        out = F.when(rule.rejects(known), rule.name).otherwise(out)
    return out


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text_col: str = "text", sample: int = SAMPLE, into: str = "failed_rule") -> DataFrame:
    """``docs`` with the rule that rejected each row in column ``into`` (null: kept); which of several is named depends on the order.

    Null and empty texts are rejected by no rule here; equal texts get equal verdicts; an empty table gives no rows. Other columns stay.
    """
    sampled = drawn(docs.select(F.col(f"`{text_col}`").cast("string").alias("t"), F.monotonically_increasing_id().alias("i")), ["i", "t"], sample)
    order = ordered(measured(sampled, facts(whole(F.col("t"))), rules), rules)
    return docs.withColumn(into, cascade(facts(whole(F.col(f"`{text_col}`"))), order))


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 50, most_repeated: int = 50) -> DataFrame:
    """One row per row of ``docs``: the base counts, base_failed, and kept (the cascade's verdict where the base holds).

    The cascade's order comes from sampled rows where the base holds, and from what the rules cost there beside the base counts.
    Null and empty texts count no words, so the base rejects them. Repeated rows give equal rows; an empty table gives none; other
    columns aren't read.
    """
    text = free("__t", [id_col])
    own = docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias(text))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    failed = (F.col("c.n_words") < least_words) | (100 * F.col("c.n_repeat_words") > most_repeated * F.col("c.n_words"))
    known = Facts(whole(F.col(text)), *(F.col(f"c.{x}") for x in names[:4]))
    counted = own.select(F.col(f"`{id_col}`").alias("i"), F.col(text), base_columns(F.col(text)).alias("c"))
    sampled = drawn(own.select(F.col(f"`{id_col}`").alias("i"), text), ["i", text]).select(text, base_columns(F.col(text)).alias("c"))
    order = ordered(measured(sampled.where(~failed), known, RULES))
    kept = F.when(failed, False).otherwise(cascade(known, order).isNull())
    return counted.select(F.col("i").alias(id_col), *[F.col(f"c.{x}").alias(x) for x in names], failed.alias("base_failed"), kept.alias("kept"))
