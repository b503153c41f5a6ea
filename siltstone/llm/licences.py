"""Licence scans: Aho-Corasick finds notice phrases and identifier tags, a shunting-yard parser evaluates tag expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame

from .common import map_texts

#: Fixed phrases of the contract and their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: Further notice phrases: label and how sure a place of it makes one.
NOTICES = {
    "apache license version 2 0": ("apache-2.0", 0.9),
    "gnu general public license version 2": ("gpl-2.0", 0.9),
    "gnu general public license version 3": ("gpl-3.0", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "bsd license": ("bsd", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.95),
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.95),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.95),
    "creative commons attribution": ("cc-by", 0.9),
    "cc by sa": ("cc-by-sa", 0.8),
    "cc by nc": ("cc-by-nc", 0.8),
    "cc by nd": ("cc-by-nd", 0.8),
    "cc0 1 0": ("cc0", 0.8),
    "released into the public domain": ("public-domain", 0.9),
    "all rights reserved": ("reserved", 0.5),
}
TAG = "spdx license identifier"
TAG_BYTES = re.compile(rb"spdx[- ]license[- ]identifier[ \t]*:", re.IGNORECASE)
#: Brackets, and names that end with a letter, a digit or a plus; so comment marks and full stops after them belong to none.
TOKEN = re.compile(r"[ \t]*([()]|[A-Za-z0-9]+(?:[.:_-]+[A-Za-z0-9]+)*\+?)")
LINE = re.compile(rb"[^\r\n]*")
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Fixed values of a tag that tell of no licence.
UNTOLD = ("none", "noassertion")
#: How sure a base phrase and a tag with an expression make a label, and the doubt that a tag without one leaves.
BASE_SURE, TAG_SURE, TAG_DOUBT = 0.8, 0.99, 0.5

#: How much a licence family asks of one who reuses a text: 0 nothing, 1 notice, 2 share alike in part, 3 share alike, 4 no reuse.
BURDEN = {
    "cc0": 0, "unlicense": 0, "0bsd": 0, "mit": 1, "apache": 1, "bsd": 1, "isc": 1, "zlib": 1, "cc-by": 1, "mpl": 2, "lgpl": 2, "epl": 2,
    "cc-by-sa": 3, "gpl": 3, "agpl": 3, "cc-by-nd": 4, "cc-by-nc": 4,
}
#: Identifiers of the public licence list that tags use most, and of its exceptions. A caller may give others.
IDENTIFIERS = """
0BSD AFL-2.1 AFL-3.0 AGPL-1.0 AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.0 Apache-1.1 Apache-2.0 APSL-2.0 Artistic-1.0 Artistic-2.0
BlueOak-1.0.0 BSD-1-Clause BSD-2-Clause BSD-2-Clause-Patent BSD-3-Clause BSD-3-Clause-Clear BSD-3-Clause-LBNL BSD-4-Clause BSL-1.0 BUSL-1.1
CC-BY-1.0 CC-BY-2.0 CC-BY-2.5 CC-BY-3.0 CC-BY-4.0 CC-BY-NC-2.0 CC-BY-NC-3.0 CC-BY-NC-4.0 CC-BY-NC-ND-3.0 CC-BY-NC-ND-4.0 CC-BY-NC-SA-3.0
CC-BY-NC-SA-4.0 CC-BY-ND-3.0 CC-BY-ND-4.0 CC-BY-SA-2.0 CC-BY-SA-2.5 CC-BY-SA-3.0 CC-BY-SA-4.0 CC-PDDC CC0-1.0 CDDL-1.0 CDDL-1.1 CECILL-2.0
CECILL-2.1 CECILL-B CECILL-C CPAL-1.0 CPL-1.0 curl ECL-2.0 EPL-1.0 EPL-2.0 EUPL-1.1 EUPL-1.2 FSFAP FTL GFDL-1.2-only GFDL-1.2-or-later
GFDL-1.3-only GFDL-1.3-or-later GPL-1.0 GPL-1.0-only GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only GPL-3.0-or-later
HPND ICU IJG ISC JSON LGPL-2.0 LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only
LGPL-3.0-or-later Libpng LPL-1.02 LPPL-1.3c MIT MIT-0 MIT-CMU MPL-1.0 MPL-1.1 MPL-2.0 MS-PL MS-RL MulanPSL-2.0 NCSA NPL-1.1 ODbL-1.0
OFL-1.0 OFL-1.1 OLDAP-2.8 OpenSSL OSL-2.1 OSL-3.0 PHP-3.01 PostgreSQL PSF-2.0 Python-2.0 QPL-1.0 Ruby SISSL Sleepycat SSPL-1.0 TCL Unicode-3.0
Unicode-DFS-2016 Unlicense UPL-1.0 Vim W3C WTFPL X11 Zend-2.0 Zlib zlib-acknowledgement ZPL-2.1
""".split()
EXCEPTIONS = """
Autoconf-exception-2.0 Autoconf-exception-3.0 Bison-exception-2.2 Bootloader-exception Classpath-exception-2.0 eCos-exception-2.0 FLTK-exception
Font-exception-2.0 GCC-exception-2.0 GCC-exception-3.1 Libtool-exception Linux-syscall-note LLVM-exception OCaml-LGPL-linking-exception
OpenJDK-assembly-exception-1.0 Qt-GPL-exception-1.0 Qt-LGPL-exception-1.1 u-boot-exception-2.0 WxWindows-exception-3.1
""".split()
#: Fixed beginnings of names that a document gives itself.
OWN_NAMES = ("licenseref-", "documentref-", "additionref-")
OPERATORS = {"or": 1, "and": 2, "with": 3}
UNKNOWN_BURDEN = 4


def burden(identifier: str) -> int:
    """Of the longest known family that the identifier begins with."""
    low = identifier.lower()
    known = [f for f in BURDEN if low == f or low.startswith((f"{f}-", f"{f}+"))]
    return BURDEN[max(known, key=len)] if known else UNKNOWN_BURDEN


def names_of(identifiers: list[str], exceptions: list[str]) -> tuple[frozenset[str], frozenset[str]]:
    return frozenset(x.lower() for x in [*identifiers, *UNTOLD]), frozenset(x.lower() for x in exceptions)


NAMES = names_of(IDENTIFIERS, EXCEPTIONS)


def is_name(token: str, names: frozenset[str]) -> bool:
    """Is the token in the table of names, with a plus or without, or one that a document gives itself?"""
    low = token.lower()
    return low.removesuffix("+") in names or low.startswith(OWN_NAMES) and not low.endswith("-")


def tokens_at(text: str, at: int = 0, names: tuple[frozenset[str], frozenset[str]] = NAMES) -> tuple[list[str], int, bool]:
    """The longest whole expression that stands at a place of the text, as tokens, where it ends, and whether that is in doubt.

    It ends where the grammar does: at a name that is in no table, a comment's end, a bracket that was never opened, an operator without
    an operand. It is in doubt where an operand was awaited and an unknown name stood there.
    """
    found: list[str] = []
    whole, end, depth, operand, simple, with_, doubt = 0, at, 0, True, False, False, False
    while m := TOKEN.match(text, at):
        token, at = m[1], m.end()
        low = token.lower()
        if token == "(":
            if not operand or with_:
                break
            depth += 1
        elif token == ")":
            if operand or not depth:
                break
            depth, simple = depth - 1, False
        elif low in OPERATORS:
            if operand or low == "with" and not simple:
                break
            operand, with_ = True, low == "with"
        else:
            if not operand:
                break
            if not is_name(token, names[with_]):
                # after an operator a word in small letters is prose, and the operator a plain word
                doubt = not (found and token.isalpha() and token.islower())
                break
            operand, simple, with_ = False, not with_, False
        found.append(token)
        if not depth and not operand:
            whole, end = len(found), at
    return found[:whole], end, doubt


def reckon(tokens: list[str]) -> tuple[list[str], int]:
    """The names in a whole expression, in order, and its burden, by a shunting yard.

    ``or`` takes the lesser burden, ``and`` the greater, and ``with`` (an exception, which is a label too) lowers its licence's by one;
    ``with`` binds closest, then ``and``.
    """
    burdens: list[int] = []
    stack: list[str] = []

    def reduce() -> None:
        op, y, x = stack.pop(), burdens.pop(), burdens.pop()
        burdens.append(max(x - 1, 0) if op == "with" else min(x, y) if op == "or" else max(x, y))

    for token in (t.lower() for t in tokens):
        if token in OPERATORS:
            while stack and stack[-1] != "(" and OPERATORS[stack[-1]] >= OPERATORS[token]:
                reduce()
            stack.append(token)
        elif token == "(":
            stack.append(token)
        elif token == ")":
            while stack[-1] != "(":
                reduce()
            stack.pop()
        else:
            burdens.append(0 if token in UNTOLD else burden(token))
    while stack:
        reduce()
    return [t.lower() for t in tokens if t not in "()" and t.lower() not in OPERATORS and t.lower() not in UNTOLD], burdens[0]


def evaluate(expression: str, names: tuple[frozenset[str], frozenset[str]] = NAMES) -> tuple[list[str], int] | None:
    """The names of a licence expression and its burden; None if it is not well formed, of known names, from end to end."""
    tokens, end, _ = tokens_at(expression, 0, names)
    return reckon(tokens) if tokens and not expression[end:].strip() else None


def tags(raw: bytes, places: list[int], names: tuple[frozenset[str], frozenset[str]] = NAMES) -> list[tuple[str | None, bool]]:
    """The expressions of the tags whose first words the automaton found, None for one without a whole expression; and whether it is in doubt."""
    words = [m.span() for m in WORD.finditer(raw)]
    out = []
    for place in places:
        tag = TAG_BYTES.match(raw, words[place][0])
        if tag:
            line = LINE.match(raw, tag.end())[0].decode("utf-8", "replace")
            tokens, end, doubt = tokens_at(line, 0, names)
            out.append((line[:end].strip() if tokens else None, doubt or not tokens))
    return out


_OTHER = bytes(i if chr(i).isalnum() or i > 127 else 32 for i in range(256))


def scanner(notices: dict = NOTICES, names: tuple[frozenset[str], frozenset[str]] = NAMES):
    import ahocorasick

    machine = ahocorasick.Automaton()
    entries: dict[str, list] = {}
    for phrase, label in BASE.items():
        entries.setdefault(phrase, []).append((label, BASE_SURE, True))
    for phrase, (label, sure) in notices.items():
        entries.setdefault(phrase, []).append((label, sure, False))
    entries.setdefault(TAG, []).append((None, 0.0, False))
    for phrase, found in entries.items():
        machine.add_word(f" {phrase} ", (len(phrase) + 2, found))
    machine.make_automaton()

    def scan(text: str | None) -> tuple:
        raw = (text or "").encode()
        words = raw.lower().translate(_OTHER).split()
        flat = f" {b' '.join(words).decode('latin-1')} "
        n_base, first, last, base, labels, doubt, tagged = 0, None, None, set(), set(), {}, []
        at = seen = 0  # a place in the flat text and the number of its word
        for end, (length, found) in machine.iter(flat):
            start = end - length + 1
            seen += flat.count(" ", at, start) if start >= at else -flat.count(" ", start, at)
            at = start
            for label, sure, is_base in found:
                if label is None:
                    tagged.append(seen)
                    continue
                labels.add(label)
                doubt[label] = min(doubt.get(label, 1.0), 1 - sure)
                if is_base:
                    n_base += 1
                    first, last = (seen if first is None else min(first, seen)), (seen if last is None else max(last, seen))
                    base.add(label)
        expression = restriction = None
        for told, unsure in tags(raw, tagged, names):
            if told is None:
                doubt["?"] = TAG_DOUBT
                continue
            known, weight = evaluate(told, names)
            labels.update(known)
            if known:
                doubt["tag"] = min(doubt.get("tag", 1.0), TAG_DOUBT if unsure else 1 - TAG_SURE)
                restriction = weight if restriction is None else max(restriction, weight)
                expression = told if expression is None else expression
        score = 1.0
        for key in sorted(doubt):
            score *= doubt[key]
        return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(labels)), 1 - score if doubt else 0.0, expression, restriction

    return scan


COLUMNS = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "expression", "burden")
SCHEMA = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expression string, burden int"


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", notices: dict | None = None, identifiers: list[str] | None = None, exceptions: list[str] | None = None) -> DataFrame:
    """One row per row of ``docs``: base phrase places, all labels, score, the first tag expression and its burden.

    Null and empty texts give no words and no labels; repeated rows give equal rows; an empty table gives none. Columns
    other than the two named aren't read. The automaton finds the tags too; a tag's expression goes as far as the grammar does, its
    exceptions are labels as its licences are, and a tag without an expression adds no label and scores 0.5. Names are those of
    ``identifiers`` and ``exceptions`` (IDENTIFIERS, EXCEPTIONS) and those that a document gives itself (``LicenseRef-``); another one
    ends an expression, which scores 0.5 then.
    """
    own = NOTICES if notices is None else notices
    names = names_of(IDENTIFIERS if identifiers is None else identifiers, EXCEPTIONS if exceptions is None else exceptions)

    def make():
        scan = scanner(own, names)
        return lambda texts: dict(zip(COLUMNS, map(list, zip(*map(scan, texts), strict=True)), strict=True))

    return map_texts(docs, [id_col], text_col, make, SCHEMA)
