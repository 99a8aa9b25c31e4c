"""Document fingerprints: Merkle trees over sections, paragraphs and phrases, in DataFrame operations only.

Sections are what blank lines part, paragraphs are lines, phrases end at sentence ends or after
PHRASE code points, counted afresh from each sentence's start, so an edit moves no later phrase's
bounds beyond its sentence. Splitting is exact (joining gives the text back), so equal roots mean
equal texts; where roots differ, comparing children from the top down locates the edit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.functions.ranges import place

PHRASE = 48
#: Hexadecimal digits kept of a phrase's hash and of a paragraph's or section's; roots keep all.
SHORT, NODE = 12, 16
PHRASES = rf"[^.!?]{{1,{PHRASE}}}[.!?]*|[.!?]+"

#: Coarse ranges of doc_id, whose bounds are all that the driver sees, and rows of a fine one, which a task orders at a time.
COARSE, RANGE_ROWS = 1024, 1024
#: Fine ranges' first rows are looked up by a broadcast of 16 bytes each up to so many, by a join beyond.
MOST_HEADS = 500_000


def let(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once."""
    return F.transform(F.array(x), f)[0]


def node(kind: str, children: Column) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(kind), children), 256), 1, NODE)


def sections(text: Column) -> Column:
    """array<string>: the tree below the root, a string for each section: its hash, '=' and its paragraphs, parted by '/'.

    A paragraph is its hash and its phrases' hashes, parted by blanks. A section's hash is that of its paragraphs' hashes, a
    paragraph's that of its phrases' hashes.
    """
    short = lambda p: F.substring(F.sha2(p, 256), 1, SHORT)
    phrases = lambda p: F.array_join(F.transform(F.regexp_extract_all(p, F.lit(PHRASES), F.lit(0)), short), " ")
    paragraph = lambda p: F.when(p == "", node("p", p)).otherwise(F.concat_ws(" ", node("p", p), p))
    tree = F.transform(F.split(text, "\n\n", -1), lambda s: F.transform(F.transform(F.split(s, "\n", -1), phrases), paragraph))
    return F.transform(tree, lambda ps: F.concat(node("s", F.array_join(F.transform(ps, lambda p: F.substring_index(p, " ", 1)), ",")), F.lit("="), F.array_join(ps, "/")))


def fingerprint(text: Column, tree: Column) -> Column:
    """The root's hash, ':' and sections() parted by '|'.

    The root's hash is that of the sections' hashes and of the text's own, which makes it exact: what is below it is kept short.
    """
    hashes = F.array_join(F.transform(tree, lambda s: F.substring_index(s, "=", 1)), ",")
    return F.concat(F.sha2(F.concat_ws(",", F.lit("d"), F.sha2(text, 256), hashes), 256), F.lit(":"), F.array_join(tree, "|"))


def same_root(a: Column, b: Column) -> Column:
    return F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)


def phrases_in(paragraph: Column) -> Column:
    return F.slice(F.split(paragraph, " ", -1), 2, 1 << 30)


def phrases_of(paragraphs: Column) -> Column:
    """The phrases' hashes in some paragraphs of fingerprints, each once."""
    return F.array_distinct(F.flatten(F.transform(paragraphs, phrases_in)))


def likeness(a: Column, b: Column) -> Column:
    """Of two fingerprints: 1 if the roots are equal, else what they share of the larger one's phrases, below 1.

    Trees are compared from above: a paragraph that both have counts with all its phrases; phrases are compared only
    between the paragraphs that differ, each once.
    """
    part = lambda f: F.array_distinct(F.transform(F.split(F.translate(F.substring_index(f, ":", -1), "|", "/"), "/", -1), lambda p: F.substring_index(p, "=", -1)))
    numbers = F.struct(part(a).alias("a"), part(b).alias("b"))
    numbers = F.transform(F.array(numbers), lambda t: F.struct(F.array_intersect(t["a"], t["b"]).alias("both"), phrases_of(F.array_except(t["a"], t["b"])).alias("x"), phrases_of(F.array_except(t["b"], t["a"])).alias("y")))
    same = lambda t: F.aggregate(t["both"], F.lit(0), lambda n, p: n + F.size(F.split(p, " ", -1)) - 1)
    share = F.transform(numbers, lambda t: (same(t) + F.size(F.array_intersect(t["x"], t["y"]))).cast("double") / F.greatest(same(t) + F.greatest(F.size(t["x"]), F.size(t["y"])), F.lit(1)))[0]
    return F.when(same_root(a, b), F.lit(1.0)).otherwise(F.least(share, F.lit(0.999999)))


def paired(a: Column, b: Column) -> Column:
    """array<struct<a, b>> of two array<struct<key, i>>: the k-th i of a key on one side with its k-th on the other, null where there is none.

    Both are sorted together and cut where the key changes, so work grows as a sort does.
    """
    marked = lambda x, side: F.transform(x, lambda e: F.struct(e["key"].alias("key"), F.lit(side).alias("side"), e["i"].alias("i")))
    both = F.sort_array(F.concat(marked(a, 0), marked(b, 1)))
    heads = lambda s: F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["key"] != F.get(s, i - 1)["key"]))
    sides = lambda run: F.struct(F.filter(run, lambda e: e["side"] == 0).alias("a"), F.filter(run, lambda e: e["side"] == 1).alias("b"))
    pairs = lambda r: F.transform(F.sequence(F.lit(0), F.greatest(F.size(r["a"]), F.size(r["b"])) - 1), lambda k: F.struct(F.get(r["a"], k)["i"].alias("a"), F.get(r["b"], k)["i"].alias("b")))
    runs = lambda t: F.transform(t["heads"], lambda h, n: let(sides(F.slice(t["s"], h + 1, F.coalesce(F.get(t["heads"], n + 1), F.size(t["s"])) - h)), pairs))
    some = lambda s: let(F.struct(s.alias("s"), heads(s).alias("heads")), lambda t: F.flatten(runs(t)))
    return let(both, lambda s: F.when(F.size(s) > 0, some(s)).otherwise(F.array().cast("array<struct<a:int,b:int>>")))


def aligned(a: Column, b: Column) -> Column:
    """struct<differing, moved>, each array<struct<a, b>> of places in two arrays of hashes.

    Equal hashes are anchors, the k-th of a hash with the other side's k-th. What has no anchor is paired in order with what stands after
    as many anchors on the other side (differing; null: there is none). moved: anchors that stand before their predecessor on the
    other side, which is where the order breaks.
    """
    keyed = lambda x: F.transform(x, lambda h, i: F.struct(h.alias("key"), i.alias("i")))
    alone = lambda found, one, other: F.sort_array(F.transform(F.filter(found, lambda p: p[other].isNull()), lambda p: p[one]))
    after = lambda places: F.transform(places, lambda i, k: F.struct((i - k).alias("key"), i.alias("i")))
    breaks = lambda m: F.array_compact(F.transform(m, lambda p, n: F.when(F.get(m, n - 1)["b"] > p["b"], p)))

    def split(found: Column) -> Column:
        anchors = F.sort_array(F.filter(found, lambda p: p["a"].isNotNull() & p["b"].isNotNull()))
        return F.struct(paired(after(alone(found, "a", "b")), after(alone(found, "b", "a"))).alias("differing"), let(anchors, breaks).alias("moved"))

    return let(paired(keyed(a), keyed(b)), split)


CHANGES = "array<struct<kind:string,section:int,paragraph:int,to_section:int,to_paragraph:int>>"


def changes(a: Column, b: Column) -> Column:
    """CHANGES between two fingerprints, compared from the root down: nodes of equal hashes aren't entered.

    kind: changed, removed (to_ is null), added (section and paragraph are null) or moved. Places count from 0; a paragraph of -1 is
    the whole section. A changed section is entered, and its paragraphs are told. Equal roots: none.
    """
    none = F.lit(None).cast("int")
    one = lambda kind, *at: F.struct(kind.alias("kind"), *(x.cast("int").alias(n) for x, n in zip(at, ("section", "paragraph", "to_section", "to_paragraph"))))
    kind = lambda d: F.when(d["b"].isNull(), F.lit("removed")).when(d["a"].isNull(), F.lit("added")).otherwise(F.lit("changed"))
    hashes = lambda nodes, end: F.transform(nodes, lambda x: F.substring_index(x, end, 1))
    lists = lambda x, y: F.struct(x.alias("a"), y.alias("b"))

    def within(x: Column, y: Column, d: Column) -> Column:
        paragraphs = lambda s: F.split(F.substring_index(s, "=", -1), "/", -1)
        told = lambda p, k: one(k, F.when(p["a"].isNotNull(), d["a"]), p["a"], F.when(p["b"].isNotNull(), d["b"]), p["b"])
        found = lambda al: F.concat(F.transform(al["differing"], lambda p: told(p, kind(p))), F.transform(al["moved"], lambda p: told(p, F.lit("moved"))))
        return let(aligned(hashes(paragraphs(x), " "), hashes(paragraphs(y), " ")), found)

    def entered(t: Column, d: Column) -> Column:
        whole = lambda i: F.when(i.isNotNull(), F.lit(-1)).otherwise(none)
        alone = F.array(one(kind(d), d["a"], whole(d["a"]), d["b"], whole(d["b"])))
        return F.when(d["a"].isNull() | d["b"].isNull(), alone).otherwise(within(F.get(t["a"], d["a"]), F.get(t["b"], d["b"]), d))

    def found(t: Column) -> Column:
        moved = lambda p: one(F.lit("moved"), p["a"], F.lit(-1), p["b"], F.lit(-1))
        return let(aligned(hashes(t["a"], "="), hashes(t["b"], "=")), lambda al: F.concat(F.flatten(F.transform(al["differing"], lambda d: entered(t, d))), F.transform(al["moved"], moved)))

    parts = lambda f: F.split(F.substring_index(f, ":", -1), r"\|", -1)
    return F.when(same_root(a, b), F.array().cast(CHANGES)).otherwise(let(lists(parts(a), parts(b)), found))


def edits(a: Column, b: Column) -> Column:
    """array<struct<section, paragraph>>: the places of changes(), in order; those of what was added are places in the second text."""
    at = lambda c: F.struct(F.coalesce(c["section"], c["to_section"]).alias("section"), F.coalesce(c["paragraph"], c["to_paragraph"]).alias("paragraph"))
    return F.sort_array(F.transform(changes(a, b), at))


def told(found: Column) -> Column:
    """changes() as one string: =, -, + or ~ (changed, removed, added, moved) and section:paragraph, comma-joined; places as in edits()."""
    sign = lambda c: F.when(c["kind"] == "changed", "=").when(c["kind"] == "removed", "-").when(c["kind"] == "added", "+").otherwise("~")
    at = lambda c: F.concat(sign(c), F.coalesce(c["section"], c["to_section"]).cast("string"), F.lit(":"), F.coalesce(c["paragraph"], c["to_paragraph"]).cast("string"))
    return F.array_join(F.transform(found, at), ",")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_chars, fingerprint of each row's whole text; null text counts as empty."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return printed(rows, "text", "fingerprint").select("doc_id", F.char_length("text").cast("long").alias("n_chars"), "fingerprint")


def printed(rows: DataFrame, text: str, name: str) -> DataFrame:
    """rows with the fingerprint of a text column; the tree is a column of its own first, so that it is made once."""
    return rows.withColumn("tree", sections(F.col(text))).withColumn(name, fingerprint(F.col(text), F.col("tree"))).drop("tree")


def in_ranges(rows: DataFrame) -> DataFrame:
    """rows with coarse and fine, ints that rise with doc_id; ids that are null come first.

    coarse: among quantiles of doc_id, COARSE at most. fine: the id's place between its quantiles, in as many equal steps as
    make a range of about RANGE_ROWS rows, however many rows there are. Equal ids share a range.
    """
    count = rows.select("doc_id").agg(F.count("*")).first()[0]
    n = max(1, min(COARSE, count // RANGE_ROWS))
    got = rows.select("doc_id").agg(F.percentile_approx("doc_id", [i / n for i in range(n + 1)], 10 * COARSE)).first()[0]
    bounds = sorted(set(got or []))
    if not bounds:
        return rows.withColumn("coarse", F.lit(0)).withColumn("fine", F.lit(0).cast("long"))
    known, steps = F.array(*[F.lit(b).cast("long") for b in bounds]), -(-count // (n * RANGE_ROWS))
    rows = rows.withColumn("coarse", F.coalesce(place(bounds, F.col("doc_id")), F.lit(-1)))
    if steps == 1:
        return rows.withColumn("fine", F.lit(0).cast("long"))
    lo, hi = (F.get(known, F.col("coarse") - i).cast("double") for i in (1, 0))
    step = F.floor((F.col("doc_id").cast("double") - lo) / F.greatest(hi - lo, F.lit(1.0)) * steps)
    return rows.withColumn("fine", F.coalesce(F.least(F.greatest(step, F.lit(0)), F.lit(steps - 1)), F.lit(0)).cast("long"))


def with_next(rows: DataFrame, make: Callable[[DataFrame], DataFrame], made: list[str]) -> DataFrame:
    """rows (doc_id, text) with the columns made, which make() adds, and next: a struct of text and those of the next row by doc_id, then
    text; after the last comes the first.

    Rows are ordered within ranges, and make() is called once for them, where they were ordered. Only a range's last row looks
    up the first row of the range after it.
    """
    spark = rows.sparkSession
    rows = in_ranges(rows)
    heads = rows.groupBy("coarse", "fine").agg(F.min("doc_id").alias("head"))
    ends = heads.groupBy("coarse").agg(F.min_by("head", "fine").alias("head")).collect()  # two numbers for each coarse range
    ends = sorted(ends, key=lambda r: r["coarse"])
    if not ends:
        return make(rows.select("doc_id", "text")).withColumn("next", F.struct("text", *made))
    over = spark.range(1).select(F.inline(F.array(*[F.struct(F.lit(a["coarse"]).alias("coarse"), F.lit(b["head"]).cast("long").alias("over")) for a, b in zip(ends, ends[1:] + ends[:1])])))
    inner = F.lead(F.struct("head")).over(Window.partitionBy("coarse").orderBy("fine"))
    links = heads.withColumn("after", inner).join(F.broadcast(over), "coarse").select(F.col("coarse").alias("to_coarse"), F.col("fine").alias("to_fine"), F.when(F.col("after").isNull(), F.col("over")).otherwise(F.col("after.head")).alias("head"))
    links = F.broadcast(links) if rows.count() <= MOST_HEADS * RANGE_ROWS else links
    first = rows.select("doc_id", "text").join(links, F.expr("doc_id <=> head")).groupBy("to_coarse", "to_fine").agg(F.min("text").alias("text"))
    first = make(first).select("to_coarse", "to_fine", F.struct("text", *made).alias("over"))
    keys, order = ["coarse", "fine"], ["doc_id", "text"]
    led = make(rows.repartition(*keys).sortWithinPartitions(*keys, *order))
    led = led.withColumn("next", F.lead(F.struct("text", *made)).over(Window.partitionBy(*keys).orderBy(*order)))
    led = led.join(first, (led["coarse"] == first["to_coarse"]) & (led["fine"] == first["to_fine"]), "left")
    return led.withColumn("next", F.coalesce("next", "over")).drop("over", "to_coarse", "to_fine", *keys)


def edited_pairs(docs: DataFrame) -> DataFrame:
    """Fingerprints of each document, of its edited text and how near they and the next document's are.

    edited: the last quarter (rounded down) of the code points gives way to as many (or all) of the
    first of the next document by doc_id. Null text: empty. Null ids come first; equal ids go by
    text, and rows that are equal follow each other. One row is its own next. No rows: none. Other
    columns are left out. near values are likeness() of fingerprints. edits: how the edited text's tree
    differs, as told() says it.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = with_next(rows, lambda x: printed(x, "text", "fingerprint"), ["fingerprint"]).withColumn("n_chars", F.char_length("text").cast("long"))
    cut = F.floor(F.col("n_chars") / 4).cast("int")
    rows = rows.select("doc_id", "n_chars", "fingerprint", F.col("next.fingerprint").alias("next_fingerprint"), F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - cut), F.substring(F.col("next.text"), F.lit(1), cut)).alias("edited"))
    rows = printed(rows, "edited", "edited_fingerprint")
    return rows.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"),
        told(changes(F.col("fingerprint"), F.col("edited_fingerprint"))).alias("edits"),
    )
