"""Licence scans: Aho-Corasick over a text's words, a shunting-yard parser over licence expressions."""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import prepare

# The base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
# Further notice phrases (words), their labels and how surely they tell of a licence.
PHRASES = {
    "mit license": ("mit", 0.9),
    "permission is hereby granted free of charge": ("mit", 1.0),
    "apache license": ("apache", 0.9),
    "apache software license": ("apache", 0.9),
    "bsd license": ("bsd", 0.9),
    "redistribution and use in source and binary forms": ("bsd", 1.0),
    "mozilla public license": ("mpl", 0.9),
    "eclipse public license": ("epl", 0.9),
    "lesser general public license": ("lgpl", 0.9),
    "affero general public license": ("agpl", 0.9),
    "gnu general public license": ("gpl", 1.0),
    "gnu free documentation license": ("gfdl", 0.9),
    "creative commons": ("creative-commons", 0.7),
    "cc by sa": ("cc-by-sa", 0.9),
    "cc by nc": ("cc-by-nc", 0.9),
    "cc by nd": ("cc-by-nd", 0.9),
    "cc0": ("cc0", 0.8),
    "public domain": ("public-domain", 0.6),
    "boost software license": ("bsl", 0.9),
    "isc license": ("isc", 0.9),
    "unlicense": ("unlicense", 0.8),
    "licensed under": ("notice", 0.5),
    "copyright notice": ("notice", 0.5),
}
BASE_SURE = {"cc by": 0.8, "general public license": 0.9, "all rights reserved": 0.6}
TAG = "spdx license identifier"
# Identifiers (lower case) whose terms let a text be trained on.
OPEN = {"mit", "isc", "apache-2.0", "bsd-2-clause", "bsd-3-clause", "bsl-1.0", "cc0-1.0", "cc-by-4.0", "cc-by-3.0", "unlicense", "zlib", "0bsd", "psf-2.0"}

#: The tag as a text must write it, and what ends its expression besides the next tag.
WRITTEN, LINE_END = b"spdx-license-identifier", re.compile(rb"[\r\n]")
WORD = re.compile(rb"[^ ]+")
TOKEN = re.compile(r"[()]|[a-z0-9][a-z0-9.+:-]*")
RANK = {"or": 1, "and": 2, "with": 3}

#: A-Z to a-z; what separates words to a space; digits, letters and all beyond ASCII stay.
WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def postfix(expression: str) -> list[str] | None:
    """The expression's tokens with operators after their operands, by shunting-yard; None if it isn't well formed."""
    return parsed(expression)[0]


def parsed(expression: str) -> tuple[list[str] | None, str]:
    """postfix() and what wasn't read: the whole of a malformed expression, else what follows from where reading stopped.

    with binds tightest, then and, then or; all associate to the left. Reading stops where an
    operator or the end should come and something else does (such as a comment, or the second name in MIT/Apache-2.0).
    Characters that stand in no token (such as the end of a comment) are passed over.
    """
    out: list[str] = []
    stack: list[str] = []
    operand, depth, rest, expression = True, 0, "", expression.lower().strip()
    for m in TOKEN.finditer(expression):
        t = m[0]
        if operand and t == "(":
            stack.append(t)
            depth += 1
        elif operand and t not in RANK and t != ")":
            out.append(t)
            operand = False
        elif not operand and t == ")" and depth:
            while stack[-1] != "(":
                out.append(stack.pop())
            stack.pop()
            depth -= 1
        elif not operand and t in RANK:
            while stack and stack[-1] != "(" and RANK[stack[-1]] >= RANK[t]:
                out.append(stack.pop())
            stack.append(t)
            operand = True
        elif operand:
            return None, expression
        else:
            rest = expression[m.start() :]
            break
    return (None, expression) if operand or depth or not out else (out + stack[::-1], rest)


def evaluated(tokens: list[str], allowed: set[str]) -> tuple[bool, set[str]]:
    """Whether the terms may be met with allowed licences only, and the licences named.

    or: either side; and: both; with: the licence as it stands (an exception only adds permissions).
    """
    stack: list[tuple[bool, set[str]]] = []
    for t in tokens:
        if t not in RANK:
            stack.append((t.removesuffix("+") in allowed, {t}))
            continue
        (b, nb), (a, na) = stack.pop(), stack.pop()
        if t == "with" and len(na) == len(nb) == 1:
            names = {f"{min(na)} with {min(nb)}"}
        else:
            names, few = (na, nb) if len(na) >= len(nb) else (nb, na)
            names |= few  # the smaller set into the larger: long expressions stay linear
        stack.append((a or b if t == "or" else a and b if t == "and" else a, names))
    return stack[0]


def automaton() -> ahocorasick.Automaton:
    """Values: (phrase's length with its two spaces, kind, label, sureness); one automaton holds tags and all phrases."""
    found: dict[str, list[tuple[str, str, float]]] = {}
    for p, label in BASE.items():
        found.setdefault(p, []).append(("base", label, BASE_SURE[p]))
    for p, (label, sure) in PHRASES.items():
        found.setdefault(p, []).append(("more", label, sure))
    found.setdefault(TAG, []).append(("tag", "", 0.0))
    a = ahocorasick.Automaton()
    for p, what in found.items():
        a.add_word(f" {p} ", (len(p) + 2, what))
    a.make_automaton()
    return a


def tag_expressions(raw: bytes, spaced: bytes, first_words: list[int]) -> Iterator[str]:
    """What follows each tag up to the end of its line or the next tag, given the numbers of tags' first words, ascending.

    spaced is raw with WORDS: its words stand where raw's do, so numbers become offsets by walking along to the last tag. What has the
    tag's words without being written as one isn't a tag.
    """
    wanted, at = set(first_words), []
    for no, m in zip(range(first_words[-1] + 1), WORD.finditer(spaced)):
        end = m.start() + len(WRITTEN)
        if no in wanted and raw[m.start() : end].lower() == WRITTEN and raw[end : end + 1] == b":":
            at.append((m.start(), end + 1))
    for (_, start), (after, _) in zip(at, [*at[1:], (len(raw), 0)]):
        line = LINE_END.search(raw, start, after)
        yield raw[start : line.start() if line else after].decode()


def scan(text: str, a: ahocorasick.Automaton, allowed: set[str]) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions, permitted, unread."""
    raw = text.encode()
    spaced = raw.translate(WORDS)
    words = spaced.split(b" ")
    words = [w for w in words if w] if b"" in words else words
    line = f" {b' '.join(words).decode()} "
    n, base, more, places, score, tags = 0, set(), set(), [], 0.0, []
    for end, (length, what) in a.iter(line):
        for kind, label, sure in what:
            score = max(score, sure)
            if kind == "base":
                n += 1
                base.add(label)
                places.append(end - length + 1)
            elif kind == "more":
                more.add(label)
            else:
                tags.append(end - length + 1)
    expressions, unread, permitted = [], [], None
    if tags:
        numbers, upto, no = [], 0, -1
        for p in tags:  # counted from tag to tag, so that many tags in a long text stay linear
            no += line.count(" ", upto, p + 1)
            upto = p + 1
            numbers.append(no)
        for expression in tag_expressions(raw, spaced, numbers):
            tokens, rest = parsed(expression)
            if rest:
                unread.append(rest)
            if tokens is not None:
                fine, names = evaluated(tokens, allowed)
                permitted = fine if permitted is None else permitted and fine
                expressions.append(" ".join(tokens))
                more |= {f"spdx:{x}" for x in names}
                score = 1.0
    first, last = (line.count(" ", 0, p + 1) - 1 for p in (min(places), max(places))) if places else (None, None)
    return len(words), n, first, last, ",".join(sorted(base)), ",".join(sorted(base | more)), score, expressions, permitted, unread


SCAN = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, expressions array<string>, permitted boolean, unread array<string>"


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allowed: set[str] = OPEN) -> DataFrame:
    """doc_id and SCAN's columns of each row's whole text.

    score: how surely the text tells of a licence (1: a well-formed identifier tag; 0: nothing
    found). expressions: those of the identifier tags, in postfix order; permitted: whether all of
    them can be met with allowed licences, null without any; unread: what of the tags' expressions wasn't
    understood (malformed ones whole, such as "(MIT"; of "MIT/Apache-2.0" the second name) and has no part in permitted. Null or empty text: no words, labels
    empty, score 0. Rows are independent: repeated rows repeat, null ids stay, columns other than
    id and text are left out.
    """
    prepare(docs.sparkSession)
    allowed = frozenset(allowed)
    fields = [("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("expressions", pa.list_(pa.string())), ("permitted", pa.bool_()), ("unread", pa.list_(pa.string()))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = automaton()
        for b in batches:
            rows = [scan(t.as_py() or "", a, allowed) for t in b.column(1)]
            cols = list(zip(*rows)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(list(c), kind) for c, (_, kind) in zip(cols, fields))], names=[b.schema.names[0], *(n for n, _ in fields)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"doc_id long, {SCAN}")
