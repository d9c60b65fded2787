"""Licence scans: an Aho-Corasick automaton finds notice phrases and identifier tags; a shunting-yard parser reads
the expressions that tags carry, and what it leaves on the stack is evaluated.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

# Phrases of the base rule and their labels.
BASE_PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
# Further notices, whose labels are the method's own.
MORE_PHRASES = {
    "creative commons attribution": "cc-by",
    "cc by nc": "cc-by-nc",
    "cc by sa": "cc-by-sa",
    "cc by nd": "cc-by-nd",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "redistribution and use in source and binary forms": "bsd",
    "bsd license": "bsd",
    "permission is hereby granted free of charge": "mit",
    "all rights reserved": "all-rights-reserved",
    "public domain": "public-domain",
}
# Beginnings of licence identifiers in tags, lower case, and their labels; the longest that fits counts.
IDENTIFIERS = {
    "gpl": "gpl", "lgpl": "lgpl", "agpl": "agpl", "apache": "apache", "mit": "mit", "bsd": "bsd", "0bsd": "bsd", "mpl": "mpl", "epl": "epl", "isc": "isc", "zlib": "zlib", "licenseref": "licenseref",
    "cc-by": "cc-by", "cc-by-nc": "cc-by-nc", "cc-by-sa": "cc-by-sa", "cc-by-nd": "cc-by-nd", "cc0": "public-domain", "unlicense": "public-domain",
}
# How freely a text under each label may be used, from 0 to 1. Labels that are not here leave it at 0.
OPENNESS = {
    "public-domain": 1.0, "mit": 0.9, "bsd": 0.9, "isc": 0.9, "zlib": 0.9, "apache": 0.9, "cc-by": 0.8, "mpl": 0.6, "epl": 0.6, "lgpl": 0.5, "cc-by-sa": 0.5, "gpl": 0.3, "agpl": 0.2, "cc-by-nc": 0.1, "cc-by-nd": 0.1,
}
#: What an exception raises the openness of its licence to, if that is less.
EXCEPTED = 0.5
#: Words that open a tag's expression, which ends with its line at the latest.
TAG = "spdx license identifier"
_TAG = re.compile(r"spdx-license-identifier[ \t]*:[ \t\"'`]*")
_SYMBOL = re.compile(r"[ \t]*([()]|[a-z0-9][a-z0-9.+\-:]*)")
_BINDS = {"or": 1, "and": 2, "with": 3}
_BREAKS = bytes(c if chr(c).isascii() and chr(c).isalnum() or c > 127 else 32 for c in range(256)).lower()

SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, terms string, openness double"


def postfix(symbols: list[str]) -> list[str] | None:
    """The operands and operators of a licence expression in postfix order; None if it is malformed."""
    out: list[str] = []
    waiting: list[str] = []
    operand = False  # whether the symbol before completes an operand
    for s in symbols:
        if s in _BINDS:
            if not operand:
                return None
            while waiting and _BINDS.get(waiting[-1], 0) >= _BINDS[s]:
                out.append(waiting.pop())
            waiting.append(s)
            operand = False
        elif s == "(":
            if operand:
                return None
            waiting.append(s)
        elif s == ")":
            while waiting and waiting[-1] != "(":
                out.append(waiting.pop())
            if not waiting or not operand:
                return None
            waiting.pop()
        else:
            if operand:
                return None
            out.append(s)
            operand = True
    while waiting:
        if waiting[-1] == "(":
            return None
        out.append(waiting.pop())
    return out if operand else None


def identified(name: str) -> str | None:
    """The label of a licence identifier; None if it is not known."""
    fits = [k for k in IDENTIFIERS if name == k or name.startswith((k + "-", k + "+"))]
    return IDENTIFIERS[max(fits, key=len)] if fits else None


def symbols(text: str, at: int = 0) -> list[str]:
    """The symbols of the licence expression that begins at a place of a lower-case text.

    It goes on as far as it can be read: up to the end of its line, or to what no expression holds there (a comment's
    end, a word that names no licence), and back to where it was last complete. Where an operator or a closing
    parenthesis stands for an operand, there is no expression. Unknown names count if they look like identifiers,
    with a hyphen and a digit. An exception is what ``with`` is followed by, whatever its name.
    """
    out: list[str] = []
    complete = depth = 0
    operand = False
    while m := _SYMBOL.match(text, at):
        at, s = m.end(), m[1]
        if s not in "()":
            s = s.rstrip(".-:")
        if s in _BINDS or s == ")":
            if not operand:
                return []
            if s == ")" and not depth:
                break
            depth, operand = (depth - 1, True) if s == ")" else (depth, False)
        elif operand:
            break
        elif s == "(":
            depth += 1
        elif out and out[-1] == "with" or identified(s) or "-" in s and any(c.isdigit() for c in s):
            operand = True
        else:
            break
        out.append(s)
        if operand and not depth:
            complete = len(out)
    return out[:complete]


@dataclass(frozen=True)
class Reading:
    """What an expression comes to: the labels that it names, whether they bind without a choice, and how freely it lets
    the text be used: a choice as the freest of its parts, parts that all bind as the least free, and an exception
    raises its licence."""

    labels: frozenset[str]
    sure: bool
    openness: float


def evaluated(expression: list[str]) -> Reading | None:
    """An expression in postfix order, worked out on a stack; None if it names no known licence."""
    stack: list[Reading] = []
    for s in expression:
        if s not in _BINDS:
            label = identified(s)
            stack.append(Reading(frozenset({label} - {None}), True, OPENNESS.get(label, 0.0)))
            continue
        b, a = stack.pop(), stack.pop()
        if s == "with":
            stack.append(Reading(a.labels, a.sure, max(a.openness, EXCEPTED)))
        elif s == "and":
            stack.append(Reading(a.labels | b.labels, a.sure and b.sure, min(a.openness, b.openness)))
        else:
            stack.append(Reading(a.labels | b.labels, False, max(a.openness, b.openness)))
    return stack[0] if stack and stack[0].labels else None


class Scanner:
    """One automaton over all phrases, each with a space before and after so that whole words match."""

    def __init__(self):
        import ahocorasick

        self.found = ahocorasick.Automaton()
        for phrase in {*BASE_PHRASES, *MORE_PHRASES, TAG}:
            self.found.add_word(f" {phrase} ", phrase)
        self.found.make_automaton()

    def scan(self, text: str | None) -> tuple:
        data = (text or "").encode("utf-8", "surrogatepass").lower()  # bytes.lower changes A-Z alone
        words = data.translate(_BREAKS).split()
        line = (b" " + b" ".join(words) + b" ").decode("latin-1")
        starts: list[int] = []
        base: set[str] = set()
        labels: set[str] = set()
        terms: list[str] = []
        open_to: list[float] = []
        firm = weight = at = seen = 0
        tagged = False
        for end, phrase in self.found.iter(line):
            begin = end - len(phrase) - 1
            if phrase == TAG:
                tagged = True
                continue
            weight += 1
            if phrase in MORE_PHRASES:
                labels.add(MORE_PHRASES[phrase])
                continue
            base.add(BASE_PHRASES[phrase])
            # counted on from the last place if that lies before, else anew
            seen, at = (seen + line.count(" ", at, begin), begin) if begin >= at else (line.count(" ", 0, begin), begin)
            starts.append(seen)
        open_to += [OPENNESS.get(x, 0.0) for x in base | labels]
        if tagged:
            lower = data.decode("latin-1")
            for m in _TAG.finditer(lower):
                expression = postfix(symbols(lower, m.end())) or []
                if read := evaluated(expression):
                    labels |= read.labels
                    open_to.append(read.openness)
                    terms.append(" ".join(s if s in _BINDS else identified(s) or s for s in expression))
                    weight += 4 if read.sure else 3
                    firm += read.sure
        score = 1.0 if firm else 1.0 - 0.5**weight
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), score, "; ".join(terms), min(open_to, default=None)


def reports(docs: DataFrame) -> DataFrame:
    """What each whole text says of its licence; a row for each row of docs.

    Null text counts as empty: no words, no labels (empty strings), score 0, openness null. Long texts are scanned
    whole. Repeated rows return as often as they came, an empty table gives none, and columns of docs other than doc_id
    and text are not read. A tag whose expression is malformed or names no known licence adds nothing. The score, how
    sure it is that the text states a licence, is 1 for a readable tag that leaves no choice, else 1 - 2^-n, where a
    notice adds 1 to n and a choice 3. terms: the tags' expressions in postfix order. openness: the least of what the
    notices and tags allow, from 0 to 1; see Reading.
    """
    schema = docs.select("doc_id").schema.fields[0].dataType
    fields = SCHEMA.replace("doc_id long", f"doc_id {schema.simpleString()}")

    def run(batches):
        scanner = Scanner()
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.string(), pa.float64()]
        for b in batches:
            rows = [scanner.scan(x.as_py()) for x in b.column(1)]
            columns = list(zip(*rows)) or [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "terms", "openness"])

    return docs.select("doc_id", "text").mapInArrow(run, fields)
