"""Licence scan: Aho-Corasick over each text's words, shunting-yard over the expressions after identifier tags.

A text becomes its words, joined by single spaces; one automaton then finds all places of all notice phrases and identifier
tags in one pass, so that time follows the text and not the number of phrases. After a tag the licence expression on the
rest of its line is put into postfix order and evaluated. Nothing is shuffled: each row is scanned where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.sources import table

#: The phrases that the query's contract names, with their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Further notice phrases: label, and how sure a notice is by this phrase alone. Words of the public licence texts.
NOTICES = {
    "permission is hereby granted free of charge to any person obtaining a copy": ("mit", 0.9),
    "mit license": ("mit", 0.7),
    "permission to use copy modify and or distribute this software for any purpose": ("isc", 0.9),
    "isc license": ("isc", 0.7),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "bsd 2 clause": ("bsd", 0.7),
    "bsd 3 clause": ("bsd", 0.7),
    "bsd license": ("bsd", 0.7),
    "licensed under the apache license": ("apache", 0.9),
    "apache software license": ("apache", 0.7),
    "gnu general public license": ("gpl", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu library general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "gnu gpl": ("gpl", 0.7),
    "gpl v2": ("gpl", 0.7),
    "gpl v3": ("gpl", 0.7),
    "gplv2": ("gpl", 0.7),
    "gplv3": ("gpl", 0.7),
    "gpl version 2": ("gpl", 0.7),
    "gpl version 3": ("gpl", 0.7),
    "gnu lgpl": ("lgpl", 0.7),
    "lgpl v2": ("lgpl", 0.7),
    "lgpl v3": ("lgpl", 0.7),
    "lgplv2": ("lgpl", 0.7),
    "lgplv3": ("lgpl", 0.7),
    "gnu agpl": ("agpl", 0.7),
    "agpl v3": ("agpl", 0.7),
    "agplv3": ("agpl", 0.7),
    "gnu free documentation license": ("gfdl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "eclipse distribution license": ("edl", 0.9),
    "common development and distribution license": ("cddl", 0.9),
    "common public license": ("cpl", 0.9),
    "european union public licence": ("eupl", 0.9),
    "artistic license": ("artistic", 0.7),
    "boost software license": ("bsl", 0.9),
    "zlib license": ("zlib", 0.7),
    "this software is provided as is without any express or implied warranty": ("zlib", 0.7),
    "python software foundation license": ("python", 0.9),
    "php license": ("php", 0.7),
    "open software license": ("osl", 0.9),
    "academic free license": ("afl", 0.9),
    "microsoft public license": ("ms-pl", 0.9),
    "sil open font license": ("ofl", 0.9),
    "server side public license": ("sspl", 0.9),
    "business source license": ("busl", 0.9),
    "universal permissive license": ("upl", 0.9),
    "this is free and unencumbered software released into the public domain": ("unlicense", 0.9),
    "do what the fuck you want to public license": ("wtfpl", 0.9),
    "open database license": ("odbl", 0.9),
    "open data commons attribution license": ("odc-by", 0.9),
    "public domain dedication and license": ("pddl", 0.9),
    "cc by 1 0": ("cc-by", 0.9),
    "cc by 2 0": ("cc-by", 0.9),
    "cc by 2 5": ("cc-by", 0.9),
    "cc by 3 0": ("cc-by", 0.9),
    "cc by 4 0": ("cc-by", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc by nc sa": ("cc-by-nc-sa", 0.9),
    "cc by nc nd": ("cc-by-nc-nd", 0.9),
    "cc0": ("cc0", 0.7),
    "creative commons zero": ("cc0", 0.9),
    "creative commons attribution": ("cc-by", 0.7),
    "creative commons attribution sharealike": ("cc-by-sa", 0.9),
    "creative commons attribution share alike": ("cc-by-sa", 0.9),
    "creative commons attribution noncommercial": ("cc-by-nc", 0.9),
    "creative commons attribution non commercial": ("cc-by-nc", 0.9),
    "creative commons attribution noderivatives": ("cc-by-nd", 0.9),
    "creative commons attribution no derivatives": ("cc-by-nd", 0.9),
    "public domain": ("public-domain", 0.5),
    "all rights reserved": ("all-rights-reserved", 0.5),
}
#: Words of identifiers that stand without a tag, with their labels; within an expression after a tag the expression speaks. Fixed values.
SHORT_SURE = 0.6
SHORT = {"gpl 2 0": "gpl", "gpl 3 0": "gpl", "lgpl 2 0": "lgpl", "lgpl 2 1": "lgpl", "lgpl 3 0": "lgpl", "agpl 3 0": "agpl"}
#: Identifiers of public licences, or the first parts of theirs ("bsd" of "BSD-3-Clause").
FAMILIES = {
    "0bsd", "aal", "afl", "agpl", "apache", "apsl", "artistic", "beerware", "blueoak", "bsd", "bsl", "busl", "cc", "cc0", "cddl", "cdla", "cecill", "cern", "cpal", "cpl",
    "curl", "ecl", "edl", "efl", "elastic", "epl", "etalab", "eupl", "fsfap", "ftl", "gfdl", "gpl", "hpnd", "icu", "ijg", "imagemagick", "ipl", "isc", "lgpl", "libpng",
    "lppl", "mit", "mpl", "ms", "mulanpsl", "ncsa", "ntp", "oasis", "odbl", "odc", "ofl", "ogl", "oldap", "openssl", "osl", "parity", "pddl", "php", "postgresql", "psf",
    "python", "qpl", "ruby", "sissl", "sleepycat", "sspl", "tcl", "ubuntu", "unicode", "unlicense", "upl", "vim", "w3c", "wtfpl", "x11", "xnet", "zlib", "zpl",
}
TAG = "spdx license identifier"
#: Labels, or identifiers by their first part, that allow use without sharing alike.
PERMISSIVE = {"mit", "apache", "bsd", "isc", "cc0", "unlicense", "zlib", "public-domain", "bsl", "python", "php", "upl", "wtfpl", "pddl", "edl", "afl"}
RESTRICTED = {"cc-by-nc", "cc-by-nd", "cc-by-nc-sa", "cc-by-nc-nd", "all-rights-reserved"}
SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, expressions string, permissive boolean"

_WORD_BYTES = bytes(b + 32 if 0x41 <= b <= 0x5A else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))
#: The tag may stand in quotes, as may what follows it.
_TAGGED = re.compile(r"spdx-license-identifier[\"'`]?\s*:[ \t]*[\"'`]?([^\r\n]*)", re.IGNORECASE)
#: Names of its user's own, and names that end with a version, are identifiers of whatever family.
_OWN_NAME = re.compile(r"(?:documentref-[a-z0-9.\-]+:)?(?:licenseref|additionref)-.+|[a-z][a-z0-9.\-]*-\d+(?:\.\d+)+(?:-only|-or-later|\+)?|none|noassertion")
#: An identifier ends with a letter, a digit or a plus; a stop, hyphen or colon after it belongs to the text.
_TOKEN = re.compile(r"[()]|[A-Za-z0-9](?:[A-Za-z0-9.+\-:]*[A-Za-z0-9+])?")
_BINDS = {"or": 1, "and": 2, "with": 3}


def known(identifier: str) -> bool:
    """Whether a word (in lower case) names a licence or, as what `with` adds may, an exception."""
    return identifier.rstrip("+").split("-")[0] in FAMILIES or "-exception" in identifier or _OWN_NAME.fullmatch(identifier) is not None


def expression_tokens(line: str, named: Callable[[str], bool]) -> list[str]:
    """Tokens in lower case of the expression at the start of a line; it ends before the first word that is not ``named``, and
    operators and opening brackets that lead up to such a word belong to the text with it."""
    out: list[str] = []
    at = 0
    while m := _TOKEN.match(line, at):
        token = m[0].lower()
        if token not in _BINDS and token not in "()" and not named(token):
            while out and (out[-1] in _BINDS or out[-1] == "("):
                out.pop()
            break
        out.append(token)
        at = m.end()
        while line[at : at + 1] in (" ", "\t"):
            at += 1
    return out


def postfix(expression: str, named: Callable[[str], bool] = lambda word: True) -> list[str] | None:
    """Tokens of the longest licence expression of ``named`` words at the start, in postfix order; None if it is malformed."""
    out: list[str] = []
    held: list[str] = []
    operand_next = True
    for token in expression_tokens(expression, named):
        if token == "(" and operand_next:
            held.append(token)
        elif token == ")" and not operand_next:
            while held and held[-1] != "(":
                out.append(held.pop())
            if not held:
                break  # the text goes on with a bracket of its own
            held.pop()
        elif token in _BINDS and not operand_next:
            while held and held[-1] != "(" and _BINDS[held[-1]] >= _BINDS[token]:
                out.append(held.pop())
            held.append(token)
            operand_next = True
        elif token not in "()" and token not in _BINDS and operand_next:
            out.append(token)
            operand_next = False
        else:
            break  # what follows is no part of the expression
    if operand_next or "(" in held:
        return None
    return out + held[::-1]


def _is_permissive(identifier: str) -> bool:
    return identifier in PERMISSIVE or identifier.split("-")[0] in PERMISSIVE


def evaluate(tokens: list[str]) -> tuple[set[str], bool]:
    """Labels of a postfix expression, and whether it can be met by permissive terms alone: `or` needs one side, `and` both.

    `with` joins an exception to a licence; that can widen what is allowed but never makes sharing alike go away here.
    """
    stack: list[tuple[set[str], bool]] = []
    for token in tokens:
        if token not in _BINDS:
            name = {"apache-2.0": "apache-2"}.get(token, token.removesuffix("-only").removesuffix("-or-later"))
            stack.append(({name}, _is_permissive(name)))
            continue
        (right, r), (left, l) = stack.pop(), stack.pop()
        if token == "with":
            stack.append(({f"{a}-with-{b}" for a in left for b in right}, l))
        else:
            stack.append((left | right, l or r if token == "or" else l and r))
    return stack.pop()


def _automaton():
    import ahocorasick

    found = ahocorasick.Automaton()
    own = {p: (label, sure, False) for p, (label, sure) in (NOTICES | {p: (label, SHORT_SURE) for p, label in SHORT.items()}).items()} | {TAG: ("", 0.0, False)}
    for phrase, (label, sure, base) in (own | {p: (label, 1.0, True) for p, label in BASE.items()}).items():
        found.add_word(f" {phrase} ", (phrase.count(" ") + 1, label, sure, base))
    found.make_automaton()
    return found


def scan(text: str, automaton) -> tuple:
    """What one text holds; the columns of SCHEMA after doc_id."""
    words = text.encode("utf-8", "surrogatepass").translate(_WORD_BYTES).split()
    line = f" {b' '.join(words).decode('utf-8', 'replace')} "
    n_base, first, last, seen, at, score, tagged = 0, None, None, 0, 0, 0.0, False
    base, longest = set(), {}
    for end, (length, label, sure, is_base) in automaton.iter(line):
        seen += line.count(" ", at, end)
        at = end
        if not label:
            tagged = True
            continue
        start = seen - length
        if not is_base:
            longest[start] = (label, sure)  # of phrases that start at one place, the longest ends last
            continue
        score = 1.0
        base.add(label)
        n_base, first, last = n_base + 1, start if first is None else min(first, start), start if last is None else max(last, start)
    own = {label for label, sure in longest.values() if sure != SHORT_SURE}
    short = {label for label, sure in longest.values() if sure == SHORT_SURE} - own
    score = max([score, *(sure for _, sure in longest.values())])
    allowed = [label not in RESTRICTED and _is_permissive(label) for label in base | own]
    expressions = []
    if tagged:
        for m in _TAGGED.finditer(text):
            tokens = postfix(m[1], known)
            if tokens is None:
                own.add("unparsed-expression")
                continue
            labels, ok = evaluate(tokens)
            own |= labels
            short -= {label.split("-")[0] for name in labels for label in name.split("-with-")}
            allowed.append(ok)
            expressions.append(" ".join(tokens))
            score = 1.0
    own |= short
    allowed += [False] * len(short)  # all of them ask for sharing alike
    return len(words), n_base, first, last, ",".join(sorted(base)), ",".join(sorted(base | own)), score, ";".join(expressions), all(allowed) if allowed else None


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``, see SCHEMA.

    Words are runs of ASCII letters (lower-cased) and digits and of any other characters beyond ASCII. n_base counts every
    place of a base phrase, also where two overlap; first_word and last_word are the smallest and largest word number (from 0)
    at which one starts, else null. labels also hold the other notices' labels (of phrases that start at the same word, the longest one's) and those of the expressions after identifier
    tags (a malformed one, or one that begins with a word that names no licence: ``unparsed-expression``; quotes around it are skipped). score: how sure the surest notice is. permissive: all licences found
    are permissive, null if none is. Null text counts as empty: no words, empty labels, score 0.
    Very long texts are scanned whole. Null ids stay null;
    repeated rows are scanned each; empty table: no rows; other columns are ignored, whatever their names.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        automaton = _automaton()
        names = [c.split()[0] for c in SCHEMA.split(", ")][1:]
        for frame in frames:
            found = pd.DataFrame([scan(t, automaton) for t in frame["text"]], columns=names)
            for c in ("first_word", "last_word"):
                found[c] = found[c].astype("Int64")
            found.insert(0, "doc_id", frame["doc_id"].astype("Int64").to_numpy())
            yield found

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInPandas(batches, SCHEMA)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents``."""
    return license_scan(table(spark, sf_dir, "documents"))
