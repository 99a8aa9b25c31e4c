"""Secret scans by a trigram inverted index, in DataFrame operations only.

Each rule's regular expression is turned into a Boolean query over trigrams that every match must
contain: a disjunction of conjunctions. Postings (trigram, doc_id) are built for the trigrams that
rules ask for; intersecting them per document gives each rule's candidates, and only those are
scanned with the rule's expression. Rules without mandatory trigrams scan every text.

Only postings, candidates and the texts that may be candidates (told by a bitmap of their ids, tested where
texts are read) are shuffled; all other texts are scanned where they are read.

A posting list of a frequent trigram is never gathered: postings are intersected by document, with
the bits of a conjunction's trigrams joined by OR, which Spark does in part before the shuffle.
"""

from __future__ import annotations

import re._constants as ops
import re._parser as parser
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import kept, with_maybe


@dataclass(frozen=True)
class Rule:
    """kind, a pattern that Java and Python read alike, the group whose length counts and its least length."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0


def either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


_NAMES = "|".join([*map(either_case, ("password", "passwd", "secret", "token")), f"{either_case('api')}_?{either_case('key')}"])
# What follows a private key's BEGIN line: all up to its END line or, where that is missing, headers (lines of their own, or
# in text without line ends single words) and key lines as far as they go. Key lines are runs of 20 or more base64
# characters, shorter ones that no word looks like, and whole lines; they may be quoted or indented, their ends written as
# backslash and n. Loops over groups are possessive: Java runs them without recursion, and no length is bounded.
_TO_END = r"[^-]*+(?:-(?!----(?:BEGIN|END)\x20)[^-]*+)*+-----END [A-Z ]*PRIVATE KEY-----"
_SKIP, _PAD, _EOL = r"""(?:[\x20\t\r\n"'`,;>#*|]|\\++[nrt])*+""", r"""[\x20\t"'`,;>#*|+]*+""", r"(?:\r?\n|\r|\\++n)"
_PIECE = r"""(?:[A-Za-z0-9+/=]{20,}+|(?=[A-Za-z/]*+[0-9+=]|[A-Z]*+[a-z]++[A-Z/])[A-Za-z0-9+/=]++(?![^\x20\t\r\n"'`,;\\]))"""
_LINES = rf"(?:{_SKIP}{_PIECE}|{_PAD}{_EOL}{_PAD}[A-Za-z0-9+/=]++(?={_PAD}(?:{_EOL}|(?![\s\S]))))++"
_HEADED = [rf"(?:{_SKIP}[A-Z][A-Za-z0-9-]*+:\x20{value})*+{_LINES}" for value in (r"[^\r\n\\]*+", r"[^\x20\t\r\n\\]*+")]
_AFTER_BEGIN = rf"(?:{_TO_END}|{'|'.join(_HEADED)})?+"
# The base kinds, in the order in which they are listed.
BASE = (
    Rule("assign", rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
# Further kinds.
MORE = (
    Rule("private", rf"-----BEGIN [A-Z ]*PRIVATE KEY-----{_AFTER_BEGIN}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[sr]k_(?:live|test)_[0-9a-zA-Z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}"),
    Rule("login", r"://[^\s:/@]++:[^\s:/@]++@"),
    Rule("bearer", r"[Bb]earer [A-Za-z0-9._~+/-]{20,}"),
)
RULES = BASE + MORE

#: Trigrams that a conjunction keeps: any of the mandatory ones are mandatory, and a text is searched for each.
TERMS = 3
#: A class or alternation that stands for more strings than this ends a literal run.
MOST_STRINGS = 64


def _strings(node) -> set[str] | None:
    """All strings (lower case) that a node of the parsed expression matches, if they are few; else None."""
    op, arg = node
    if op is ops.LITERAL:
        return {chr(arg).lower()}
    if op is ops.IN:
        out: set[str] = set()
        for kind, x in arg:
            if kind is ops.LITERAL:
                out.add(chr(x).lower())
            elif kind is ops.RANGE and x[1] - x[0] < MOST_STRINGS:
                out |= {chr(c).lower() for c in range(x[0], x[1] + 1)}
            else:
                return None
        return out if len(out) <= 8 else None
    if op is ops.SUBPATTERN:
        return _product(arg[3])
    if op is ops.BRANCH:
        parts = [_product(x) for x in arg[1]]
        return None if None in parts else set().union(*parts)
    if op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[1] == 1:
        inner = _product(arg[2])
        return inner and inner | ({""} if arg[0] == 0 else set())
    return None


def _product(nodes) -> set[str] | None:
    out = {""}
    for n in nodes:
        more = _strings(n)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


Query = frozenset  # of frozensets of trigrams: an OR of ANDs; {frozenset()} holds for every text


def _both(a: Query, b: Query) -> Query:
    got = frozenset(x | y for x in a for y in b)
    return frozenset(x for x in got if not any(y < x for y in got))


def _of_strings(strings: set[str]) -> Query:
    return _both(frozenset({frozenset()}), frozenset(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings))


def _query(nodes) -> Query:
    """Of a sequence: the AND of its literal runs' queries and of those of groups that aren't literal."""
    out: Query = frozenset({frozenset()})
    run = {""}
    for n in nodes:
        more = _strings(n)
        if more is not None and len(run) * len(more) <= MOST_STRINGS:
            run = {a + b for a in run for b in more}
            continue
        out = _both(out, _of_strings(run))
        run = more if more is not None else {""}
        op, arg = n
        if more is not None:
            continue
        if op is ops.SUBPATTERN:
            out = _both(out, _query(arg[3]))
        elif op is ops.BRANCH:
            out = _both(out, frozenset().union(*(_query(x) for x in arg[1])))
        elif op in (ops.MAX_REPEAT, ops.MIN_REPEAT) and arg[0] >= 1:
            out = _both(out, _query(arg[2]))
    return _both(out, _of_strings(run))


def trigram_query(pattern: str) -> list[list[str]]:
    """The trigrams (lower case) that a match of pattern contains, as an OR of ANDs; [[]] if none are mandatory."""
    return sorted(sorted(x) for x in _query(parser.parse(pattern)))


def shortened(queries: dict[str, list[list[str]]]) -> dict[str, list[list[str]]]:
    """The queries with TERMS trigrams a conjunction, those that most conjunctions have, so that few are asked for in all."""
    often = Counter(g for q in queries.values() for part in q for g in part)
    return {k: [sorted(sorted(part, key=lambda g: (-often[g], g))[:TERMS]) for part in q] for k, q in queries.items()}


def postings(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """trigram, doc_id of each text (doc_id, text) that contains a trigram; texts and trigrams in lower case."""
    low = docs.select("doc_id", F.lower("text").alias("low"))
    return low.select("doc_id", F.explode(F.array_compact(F.array(*[F.when(F.contains("low", F.lit(g)), F.lit(g)) for g in trigrams]))).alias("trigram"))


def candidates(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame | None:
    """doc_id, kinds: the rules with mandatory trigrams whose query holds for the document; None if there are no such rules."""
    terms, full = [], {}
    for kind, q in shortened({r.kind: trigram_query(r.pattern) for r in rules}).items():
        for k, part in enumerate(q):
            if q != [[]]:
                full[f"{kind}/{k}"] = (1 << len(part)) - 1
                terms += [(g, kind, f"{kind}/{k}", 1 << i) for i, g in enumerate(part)]
    if not terms:
        return None
    spark = docs.sparkSession
    rows = [F.struct(F.lit(g).alias("trigram"), F.lit(k).alias("kind"), F.lit(p).alias("part"), F.lit(b).cast("long").alias("bit")) for g, k, p, b in terms]
    asked = spark.range(1).select(F.inline(F.array(*rows)))  # as many rows as the rules have trigrams
    need = F.create_map(*[F.lit(x) for kv in full.items() for x in kv])
    met = postings(docs, sorted({t[0] for t in terms})).join(F.broadcast(asked), "trigram").groupBy("doc_id", "kind", "part").agg(F.bit_or("bit").alias("bits"))
    return met.filter(F.col("bits") == F.element_at(need, F.col("part"))).groupBy("doc_id").agg(F.collect_set("kind").alias("kinds"))


#: Matches whose starts are summed in one go; arrays that grow by one entry a step stay this short.
RUN = 256


def spans_of(text: Column, rule: Rule, order: int) -> Column:
    """array<struct<start, kind_no, end>> of the rule's leftmost non-overlapping matches that are long enough, in code points.

    split() gives what stands between matches and regexp_extract_all() the matches; their lengths
    add up to the starts.
    """
    pattern = F.lit(rule.pattern)
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    counted = found if rule.group == 0 else F.regexp_extract_all(text, pattern, F.lit(rule.group))
    long = lambda c: F.char_length(c).cast("long")
    rows = F.transform(F.arrays_zip(F.split(text, rule.pattern, -1).alias("gap"), found.alias("hit"), counted.alias("part")), lambda x: F.struct(long(x["gap"]).alias("gap"), long(x["hit"]).alias("n"), long(x["part"]).alias("part")))
    rows = F.filter(rows, lambda x: x["n"].isNotNull())  # there is a gap more than matches
    empty = F.array().cast("array<struct<start:long,kind_no:int,end:long>>")

    def step(acc, x):
        start = acc["at"] + x["gap"]
        one = F.struct(start.alias("start"), F.lit(order).alias("kind_no"), (start + x["n"]).alias("end"))
        return F.struct((start + x["n"]).alias("at"), F.when(x["part"] >= rule.least, F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    def run(acc, part):
        return F.aggregate(part, F.struct(acc["at"].alias("at"), empty.alias("out")), step, lambda a: F.struct(a["at"].alias("at"), F.concat(acc["out"], a["out"]).alias("out")))

    got = F.aggregate(_runs(rows), F.struct(F.lit(0).cast("long").alias("at"), empty.alias("out")), run, lambda a: a["out"])
    return F.when(F.rlike(text, pattern), got).otherwise(empty)


def _runs(rows: Column) -> Column:
    """rows cut into arrays of RUN entries."""
    return F.transform(F.array(rows), lambda r: F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(r), F.lit(1)) - 1) / RUN).cast("int")), lambda i: F.slice(r, i * RUN + 1, RUN)))[0]


def secret_spans(docs: DataFrame, rules: tuple[Rule, ...] = RULES, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, text, the columns in keep, spans: array<struct<start long, kind_no int, end long>> by start, then rule.

    kind_no is the rule's place in rules; start and end count code points, end exclusive. Matches
    of one rule don't overlap, those of different rules may. Null text: empty, no spans. Null ids
    and repeated ids or rows: each row is scanned by itself (rows with the same id share
    candidates, which only adds scans). Columns that are neither id,
    text nor in keep are left out.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"), *(F.col(c).alias(f"__keep{i}") for i, c in enumerate(keep)))
    empty = F.array().cast("array<struct<start:long,kind_no:int,end:long>>")
    every = [spans_of(F.col("text"), r, i) for i, r in enumerate(rules) if trigram_query(r.pattern) == [[]]]
    asked = [F.when(F.array_contains("__kinds", r.kind), spans_of(F.col("text"), r, i)) for i, r in enumerate(rules) if trigram_query(r.pattern) != [[]]]
    out = lambda x, parts: x.select("doc_id", "text", *(F.col(f"__keep{i}").alias(c) for i, c in enumerate(keep)), F.array_sort(F.concat(empty, *[F.coalesce(p, empty) for p in parts])).alias("spans"))
    found = candidates(rows.select("doc_id", "text"), rules)
    if found is None:
        return out(rows, every)
    found = kept(found.withColumnRenamed("kinds", "__kinds"), "secrets-candidates")
    rows = with_maybe(rows, found)
    some = rows.filter("maybe").alias("d").join(found.hint("shuffle_hash").alias("c"), F.expr("d.doc_id <=> c.doc_id"), "left").select("d.*", "__kinds")
    return out(some, every + asked).unionByName(out(rows.filter("NOT maybe"), every))


def joined(spans: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind_no"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans of secret_spans' rows; rules begins with BASE."""
    kept = found.withColumn("base", F.filter("spans", lambda s: s["kind_no"] < len(BASE)))
    number = lambda i: F.size(F.filter("base", lambda s: s["kind_no"] == i)).cast("long")
    counts = [number(i).alias(f"n_{r.kind}") for i, r in enumerate(BASE)]
    return kept.select("doc_id", *counts, F.sha2(joined(F.col("base"), rules), 256).alias("base_sha256"), joined(F.col("spans"), rules).alias("spans"))


def redacted(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """secret_spans' rows with each stretch that spans cover replaced by mark; overlapping spans give one mark."""
    def step(acc, s):
        apart = s["start"] >= acc["at"]
        text = F.when(apart, F.concat(acc["out"], F.substring(F.col("text"), (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int")), F.lit(mark))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), text.alias("out"))

    rest = F.lit((1 << 31) - 1)
    clean = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")), step, lambda a: F.concat(a["out"], F.substring(F.col("text"), (a["at"] + 1).cast("int"), rest)))
    return found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text")))

