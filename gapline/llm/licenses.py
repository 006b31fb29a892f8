"""License scans: an Aho-Corasick automaton and a shunting-yard parser.

The automaton looks for notice phrases and identifier tags among the words of
a text.  What follows a tag, up to the next one or the end of its line, is a
licence expression; a shunting-yard parser puts it into postfix order and evaluates it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import alnum_words, utf8

#: Phrases and labels that are always looked for.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}
#: Notice phrases of our own, with labels and how far each one tells the licence.
NOTICES = {
    "all rights reserved": ("proprietary", 0.5),
    "permission is hereby granted free of charge": ("mit", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 0.9),
    "gnu lesser general public license": ("lgpl", 0.9),
    "gnu affero general public license": ("agpl", 0.9),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "boost software license": ("bsl", 0.9),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "public domain": ("public-domain", 0.4),
    "the unlicense": ("unlicense", 0.6),
}
TAG = "spdx license identifier"
_TAG = rb"(?<![a-z0-9\x80-\xff])spdx[^a-z0-9\x80-\xff]+license[^a-z0-9\x80-\xff]+identifier(?![a-z0-9\x80-\xff])"
_TAG_LINE = re.compile(_TAG + rb"[^\S\n]*:?[^\S\n]*((?:(?!" + _TAG + rb")[^\n])*)")
_TOKEN = re.compile(r"\(|\)|[a-z0-9][a-z0-9.+:-]*")
PRECEDENCE = {"or": 1, "and": 2, "with": 3}
BASE_SCORE, EXPRESSION_SCORE = 0.8, 1.0
#: What an expression's score loses if the choice it leaves has licences of unknown terms.
UNKNOWN_LOSS = 0.1
#: Terms of a licence, the better the higher, and the label that an expression gets for its best choice.
STRONG, UNKNOWN, WEAK, PERMISSIVE = 0, 1, 2, 3
TERMS = {STRONG: "strong-copyleft", UNKNOWN: "unknown-terms", WEAK: "weak-copyleft", PERMISSIVE: "permissive"}
KINDS = [
    (re.compile(r"(mit|isc|zlib|0bsd|unlicense|bsd-|apache-|cc0-|cc-by-\d|bsl-|python-|psf-|ncsa|wtfpl|x11|postgresql|artistic-2)"), PERMISSIVE),
    (re.compile(r"(lgpl-|mpl-|epl-|cddl-|eupl-|cc-by-sa-|osl-|ms-rl)"), WEAK),
    (re.compile(r"(gpl-|agpl-|sspl-|cc-by-n|busl-)"), STRONG),
]


def to_postfix(expression: str) -> list[str]:
    """Shunting yard: ``a or b and c with d`` to ``a b c d with and or``.

    The longest well-formed beginning counts, so that a comment end or a
    sentence after the expression does no harm; [] if there is none.
    """
    out: list[str] = []
    best: list[str] = []
    stack: list[str] = []
    operand_next = True
    for token in _TOKEN.findall(expression.lower()):
        if token == "(":
            if not operand_next:
                break
            stack.append(token)
        elif token == ")":
            if operand_next or "(" not in stack:
                break
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
        elif token in PRECEDENCE:
            if operand_next:
                break
            while stack and stack[-1] != "(" and PRECEDENCE[stack[-1]] >= PRECEDENCE[token]:
                out.append(stack.pop())
            stack.append(token)
            operand_next = True
        else:
            if not operand_next:
                break
            out.append(token)
            operand_next = False
        if not operand_next and "(" not in stack:
            best = [*out, *reversed(stack)]
    return best


def terms_of(licence: str) -> int:
    """How few obligations a licence has: PERMISSIVE, WEAK, UNKNOWN or STRONG; an exception lightens what it is added to."""
    name, _, exception = licence.partition(" with ")
    found = next((terms for pattern, terms in KINDS if pattern.match(name)), UNKNOWN)
    return WEAK if exception and found == STRONG else found


def evaluate(postfix: list[str]) -> tuple[int, set[str]]:
    """The choice with the fewest obligations that a licence expression leaves: its terms, and its licences.

    ``or`` takes the side with the better terms, then the one with fewer
    licences, then the one that sorts first; under ``and`` both sides hold, and
    the worse terms count.  So an expression of any size is evaluated without
    its choices, which multiply: each licence is held once.
    """
    stack: list[tuple[int, set[str]]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append((terms_of(token), {token}))
            continue
        (t, b), (s, a) = stack.pop(), stack.pop()
        if token == "with" and min(len(a), len(b)) == 1:
            joined = {f"{x} with {y}" for x in a for y in b}
            stack.append((min(map(terms_of, joined)), joined))
        elif token == "or":
            first = s > t if s != t else len(a) < len(b) if len(a) != len(b) else sorted(a) <= sorted(b)
            stack.append((s, a) if first else (t, b))
        else:
            small, large = sorted((a, b), key=len)
            large |= small
            stack.append((min(s, t), large))
    return stack[0] if stack else (UNKNOWN, set())


def labels_of(postfix: list[str]) -> set[str]:
    """The licences in the choices of an expression of any size, without its choices, which multiply under and.

    ``with`` joins the licences and exceptions at its sides, one of which is
    single in any licence expression; of two that aren't, all stand alone.
    """
    stack: list[set[str]] = []
    for token in postfix:
        if token not in PRECEDENCE:
            stack.append({token})
            continue
        b, a = stack.pop(), stack.pop()
        if token == "with" and min(len(a), len(b)) == 1:
            stack.append({f"{x} with {y}" for x in a for y in b})
        else:
            small, large = sorted((a, b), key=len)
            large |= small
            stack.append(large)
    return stack[0] if stack else set()


def automaton() -> ahocorasick.Automaton:
    """Phrases between spaces, over words joined by spaces; a word's neighbours share its space."""
    found = ahocorasick.Automaton()
    for phrase in {*BASE, *NOTICES, TAG}:
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan(raw: bytes, finder: ahocorasick.Automaton) -> dict:
    """One text's places, labels, expressions and score."""
    words = alnum_words(raw)
    line = (b" " + b" ".join(words) + b" ").decode("latin-1")
    places: list[tuple[int, str]] = []
    count, upto = 0, 0
    for end, phrase in finder.iter(line):
        begin = end - len(phrase) - 1
        if begin >= upto:
            count, upto = count + line.count(" ", upto, begin), begin
            start = count
        else:  # phrases of several lengths end in no order of their beginnings
            start = count - line.count(" ", begin, upto)
        places.append((start, phrase))
    base = [(at, p) for at, p in places if p in BASE]
    labels = {BASE[p] for _, p in base} | {NOTICES[p][0] for _, p in places if p in NOTICES}
    scores = [BASE_SCORE for _ in base[:1]] + [NOTICES[p][1] for _, p in places if p in NOTICES]
    expressions, choices = [], []
    if any(p == TAG for _, p in places):
        for m in _TAG_LINE.finditer(raw.lower()):
            postfix = to_postfix(m[1].decode("utf-8", "replace"))
            if postfix:
                terms, choice = evaluate(postfix)
                expressions.append(" ".join(postfix))
                choices.append(" and ".join(sorted(choice)))
                labels |= labels_of(postfix) | {TERMS[terms]}
                scores.append(EXPRESSION_SCORE - UNKNOWN_LOSS * any(terms_of(x) == UNKNOWN for x in choice))
    return {
        "n_words": len(words), "n_base": len(base), "first_word": min((at for at, _ in base), default=None), "last_word": max((at for at, _ in base), default=None),
        "base_labels": sorted({BASE[p] for _, p in base}), "labels": sorted(labels), "expressions": expressions, "choices": choices, "score": max(scores, default=0.0),
    }


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row of ``docs``: key, n_words long, n_base long, first_word, last_word long, base_labels, labels, expressions, choices array<string>, score double.

    ``n_base`` counts the places of the base phrases, overlapping ones too;
    first_word and last_word are their smallest and largest start.  ``labels``
    also has those of the notices and expressions found; ``expressions`` are
    in postfix order, and ``choices`` what each leaves with the fewest
    obligations, whose terms are a label, too.  The score is the strongest
    evidence's, 0 without any; an expression's is less if the terms of its
    choice are unknown.
    A null text is empty.  Rows stay where they are: nothing is shuffled.
    """
    narrow = docs.select(key, F.col(text).alias("_text"))
    listed = pa.list_(pa.string())
    found_schema = pa.schema([*((c, pa.int64()) for c in ("n_words", "n_base", "first_word", "last_word")), ("base_labels", listed), ("labels", listed), ("expressions", listed), ("choices", listed), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = automaton()
        for batch in batches:
            found = pa.RecordBatch.from_pylist([scan(raw, finder) for raw in utf8(batch.column(1))], schema=found_schema)
            yield pa.RecordBatch.from_arrays([batch.column(0), *found.columns], names=[key, *found_schema.names])

    kind = docs.schema[key].dataType.simpleString()
    return narrow.mapInArrow(run, f"`{key}` {kind}, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, expressions array<string>, choices array<string>, score double")
