"""Text expressions: tenant keys, titles, tokens, acronyms, private data, prompts. All are built-in column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: A word boundary that counts ASCII letters, digits and _ alone as word characters, on any JVM.
EDGE = "(?:(?<![A-Za-z0-9_])(?=[A-Za-z0-9_])|(?<=[A-Za-z0-9_])(?![A-Za-z0-9_]))"

#: Fixed patterns and tags of private data, in the order in which they are masked.
PII = (
    ("[CARD]", r"\b(?:[0-9][ -]?){13,16}\b"),
    ("[SSN]", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("[EMAIL]", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}"),
    ("[PHONE]", r"\b[0-9]{2,4}[ -][0-9]{3,4}[ -][0-9]{4}\b"),
)

#: Fixed pattern of an acronym, and of its definition: a name of one to five capitalised words, the acronym in brackets. White space is
#: spelled out since DuckDB's short form for it, which the SQL of this pattern runs on, has no vertical tab.
ACRONYM = r"\b[A-Z][A-Z0-9-]{1,7}\b"
DEFINITION = r"([A-Z][A-Za-z0-9]*(?:[ \t\n\x0B\f\r]+[A-Z][A-Za-z0-9]*){0,4})[ \t\n\x0B\f\r]*\(([A-Z]{2,6})\)"

#: Fixed prefixes of embedding models: beginning of the name, of a query, of a document.
PREFIXES = (
    ("nomic", "search_query: ", "search_document: "),
    ("mxbai", "Represent this sentence for searching relevant passages: ", ""),
)


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once for a row, however often ``use`` names it."""
    return F.transform(F.array(value), use).getItem(0)


def bounded(pattern: str) -> str:
    """A pattern with EDGE for its word boundaries; one before a class of word characters looks for the class first, which most places lack."""
    import re

    first = re.match(r"\\b(?:\(\?:)?(\[(?:0-9|A-Z)\])", pattern)
    if first:
        pattern = f"(?={first[1]})(?<![A-Za-z0-9_])" + pattern[2:]
    return pattern.replace(r"\b", EDGE)


def ns_key(ns: Column) -> Column:
    """Null and blank tenants are ``default``; others lose blanks at their ends."""
    bare = trim(ns)
    return F.when(ns.isNull() | (bare == ""), F.lit("default")).otherwise(bare)


def trim(text: Column) -> Column:
    """Takes code points up to U+0020 off both ends."""
    return F.regexp_replace(text, r"^[\x00-\x20]+|[\x00-\x20]+$", "")


def base_title(title: Column) -> Column:
    return F.regexp_replace(title, r" #[0-9]+$", "")


def source_type(url: Column) -> Column:
    return F.when(url.startswith("image://"), "image").when(url.startswith("file://"), "file").otherwise("wikipedia")


def extractor(name: Column) -> Column:
    low = F.lower(name)
    return F.when(low.endswith(".hwpx"), "HWPX").when(low.endswith(".hwp"), "HWP").otherwise("TIKA")


def prefix(model: Column, kind: str) -> Column:
    out = F.lit("")
    for name, query, document in reversed(PREFIXES):
        out = F.when(F.lower(model).startswith(name), query if kind == "query" else document).otherwise(out)
    return out


def tokens(text: Column) -> Column:
    """Runs of a-z and 0-9 of the lower-cased text, in order; null has none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]+"), lambda x: x != "")


def acronyms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(bounded(ACRONYM)), F.lit(0))


def definitions(text: Column) -> Column:
    """(acronym, full) in order of definition; the first of an acronym counts, if both begin with one letter."""
    names, short = (F.regexp_extract_all(text, F.lit(DEFINITION), F.lit(i)) for i in (1, 2))
    pairs = F.filter(F.arrays_zip(short.alias("acronym"), names.alias("full")), lambda p: F.upper(F.substring(p["acronym"], 1, 1)) == F.upper(F.substring(p["full"], 1, 1)))
    firsts = F.transform(F.array_distinct(F.transform(pairs, lambda p: p["acronym"])), lambda a: F.element_at(F.filter(pairs, lambda p: p["acronym"] == a), 1))
    return F.coalesce(firsts, F.array().cast("array<struct<acronym:string,full:string>>"))


def has_word(text: Column, word: Column) -> Column:
    """Does ``word`` stand in ``text`` with an ASCII word boundary at both ends?"""
    quoted = F.regexp_replace(word, r"([^A-Za-z0-9_])", r"\\$1")
    return F.regexp_like(text, F.concat(F.lit(EDGE), quoted, F.lit(EDGE)))


def expand_acronyms(chunk: Column, glossary: Column) -> Column:
    """Adds a line with the full names that the chunk has only the acronyms of, in the glossary's order."""
    due = F.filter(glossary, lambda g: has_word(chunk, g["acronym"]) & ~chunk.contains(g["full"]))
    line = F.array_join(F.transform(due, lambda g: F.concat(g["full"], F.lit(" ("), g["acronym"], F.lit(")"))), "; ")
    return F.when(F.size(due) > 0, F.concat(chunk, F.lit("\n"), line)).otherwise(chunk)


def _masked(tag: str, pattern: str) -> Callable[[Column], Column]:
    """Only texts with an @ are searched for addresses."""

    def mask(text: Column) -> Column:
        found = F.regexp_replace(text, bounded(pattern), tag)
        return F.when(text.contains("@"), found).otherwise(text) if "@" in pattern else found

    return mask


def pii_text(text: Column) -> Column:
    for tag, pattern in PII:
        text = let(text, _masked(tag, pattern))
    return text


def pii_count(text: Column) -> Column:
    """Matches of the four patterns, each counted in what the ones before have left; null has none."""

    def counted(left: Column, i: int) -> Column:
        if i == len(PII):
            return F.lit(0)
        tag, pattern = PII[i]
        found = F.regexp_count(left, F.lit(bounded(pattern)))
        own = F.when(left.contains("@"), found).otherwise(0) if "@" in pattern else found
        return own + let(_masked(tag, pattern)(left), lambda t: counted(t, i + 1))

    return let(F.coalesce(text, F.lit("")), lambda t: counted(t, 0)).cast("int")


def vector_literal(vector: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(vector.cast("array<string>"), ","), F.lit("]"))


def parse_vector(literal: Column) -> Column:
    """Null and texts shorter than ``[]`` give the empty vector."""
    empty = F.array().cast("array<float>")
    return F.coalesce(F.when(F.length(literal) > 2, F.from_json(literal, "array<float>")), empty)


def rounded(x: Column) -> Column:
    """To the nearest whole number, halves up."""
    return F.floor(x + F.lit(0.5)).cast("long")


def safe_column(name: str) -> str:
    """Lower case, other characters than letters and digits to _, as few _ as can be; a leading digit gets one before."""
    import re

    bare = re.sub(r"[^a-z0-9]+", "_", name.lower()).strip("_")
    return f"_{bare}" if not bare or bare[0].isdigit() else bare


def term_counts(toks: Column) -> Column:
    """An array's distinct items and how often each is there (struct of term, tf), in order: told from its sorted form, in one row."""

    def runs(s: Column) -> Column:
        heads = F.filter(F.sequence(F.lit(1), F.size(s)), lambda i: (i == 1) | (F.get(s, i - 1) != F.get(s, i - 2)))
        ends = lambda h, j: F.coalesce(F.get(h, j + 1), F.size(s) + 1)
        return let(heads, lambda h: F.transform(h, lambda at, j: F.struct(F.get(s, at - 1).alias("term"), (ends(h, j) - at).cast("long").alias("tf"))))

    none = F.array().cast("array<struct<term:string,tf:bigint>>")
    return F.when(F.size(toks) > 0, let(F.array_sort(toks), runs)).otherwise(none)
