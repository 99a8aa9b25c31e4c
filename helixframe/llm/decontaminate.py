"""Benchmark decontamination by a prefix-filtered set join, in DataFrame operations only.

1. Items become windows of WINDOW words (an item of fewer words is one window). Items with the same words form a class, and
   equal windows are one.
2. A window's tokens are its shingles of SHINGLE words, or its whole words if it has fewer. Documents' shingles that are
   some window's token are the postings, each with the words around it.
3. Tokens are ordered by rarity in the documents. All of a window's tokens must occur where the window does, so its
   necessary prefix is one token, the rarest: only that one is joined with the postings.
4. The token's place in the window gives where the window starts in the document; the document's bounds and its length in
   words decide whether it has room there. What is left is verified word by word.
5. Places are merged into spans, spans summed per document.

Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` after A-Z to a-z. Null and empty texts, and items without words, have no
words and are in no way contaminated. A null item_id is an item of its own, written as an empty text among the ids. Rows
with equal (doc_id, text) get equal results, each its own row; a null doc_id counts as an id. Other columns don't matter.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from helixframe.llm.common import dropped, kept, shared_dir, with_maybe

WINDOW, SHINGLE = 10, 5
#: Tokens that stand in the plan itself; more are tested by a bitmap of bounded size. Windows that are broadcast at most.
LITERALS, BROADCAST_ROWS = 1 << 15, 1 << 17
#: Keys that the postings of a frequent token are dealt over where windows are too many to broadcast.
SALTS = 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """The words; split at what stands between them, which takes a ninth of the time of matching words."""
    return F.array_remove(F.split(F.translate(F.coalesce(text.cast("string"), F.lit("")), _UPPER, _LOWER), _BETWEEN), "")


def hash_at(words: Column, i: Column, length: int) -> Column:
    return F.xxhash64(*[F.try_element_at(words, i + j) for j in range(length)])


def shingle_places(words: Column, length: int) -> Column:
    """1-based places where length words stand."""
    last = F.size(words) - (length - 1)
    return F.when(last > 0, F.sequence(F.lit(1), last)).otherwise(F.array().cast("array<int>"))


def item_windows(items: DataFrame, window: int) -> tuple[DataFrame, DataFrame]:
    """(cls, item) of items with words, and (cls, words) of their windows."""
    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), words_of(F.col("text")).alias("words")).filter(F.size("words") > 0)
    rows = rows.withColumn("cls", F.sha2(F.array_join("words", " "), 256))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - window + 1, F.lit(1)))
    windows = rows.groupBy("cls").agg(F.first("words").alias("words")).select("cls", F.explode(F.transform(starts, lambda i: F.slice("words", i, window))).alias("words"))
    return rows.select("cls", "item").distinct(), windows


def shingle_hashes(words: Column, length: int) -> Column:
    return F.transform(shingle_places(words, length), lambda i: hash_at(words, i, length))


def posting(words: Column, i: Column, token: Column, k: int | Column, window: int) -> Column:
    """at, length, token, before, around: around are the words of all windows that can hold place i, before of them stand before it."""
    k = F.lit(k)
    before = F.least(i - 1, F.lit(window) - k)
    return F.struct((i - 1).alias("at"), k.alias("length"), token.alias("token"), before.alias("before"), F.slice(words, i - before, before + window).alias("around"))


def places_of(words: Column, k: int, tokens: list[int], window: int) -> Column:
    """posting() of each place where one of the tokens stands; only such places leave the filter."""
    hit = F.filter(shingle_places(words, k), lambda i: hash_at(words, i, k).isin(tokens))
    return F.transform(hit, lambda i: posting(words, i, hash_at(words, i, k), k, window))


def scanned(docs: DataFrame, asked: DataFrame, window: int, literals: int) -> tuple[DataFrame, DataFrame | None]:
    """(key, n_words) of each row of docs (key, words), and (key, n_words and posting()) of each place of an asked token.

    With few tokens one pass finds both: the first has the places as an array then, and the second is None.
    """
    words, n = F.col("words"), asked.count()
    if n <= literals:
        known: dict[int, list[int]] = {}
        for r in asked.collect():  # literals at most
            known.setdefault(r["length"], []).append(r["token"])
        found = F.array().cast("array<struct<at:int,length:int,token:bigint,before:int,around:array<string>>>")
        for k, tokens in sorted(known.items()):
            found = F.concat(found, places_of(words, k, tokens, window))
        return docs.select("key", F.size(words).alias("n_words"), found.alias("places")), None
    # The outer explode: Spark would test a plain one's array for being empty below it, working out words at each place.
    parts = []
    for k in [r[0] for r in asked.select("length").distinct().orderBy("length").collect()]:  # as many as a shingle has words, at most
        rows = docs.select("key", shingle_hashes(words, k).alias("tokens")).select("key", F.posexplode_outer("tokens").alias("place", "token")).filter("token IS NOT NULL")
        hit = with_maybe(rows, asked.filter(F.col("length") == k).select("token"), "token").filter("maybe")
        parts.append(hit.select(F.col("key").alias("k"), F.struct("place", "token", F.lit(k).alias("length")).alias("hit")))
    # Words don't travel with their places: those of documents with a place come back by their key.
    hits = reduce(DataFrame.unionByName, parts).groupBy("k").agg(F.collect_set("hit").alias("hits"))
    both = docs.join(hits, F.expr("key.text = k.text AND key.doc_id <=> k.doc_id"))
    around = F.transform("hits", lambda h: posting(words, h["place"] + 1, h["token"], h["length"], window))
    return docs.select("key", F.size(words).alias("n_words")), both.select("key", F.size(words).alias("n_words"), F.inline(around))


def occurrences(found: DataFrame, tokens: DataFrame, windows: DataFrame, under: str, most: int) -> DataFrame:
    """key, win, start, n of every place where a window's words stand, by postings, windows' tokens (win, length, offset, token) and words."""
    rarity = found.groupBy("length", "token").agg(F.count("*").alias("df"))
    # The rarest token of each window; a token that no document has rules its windows out.
    prefix = tokens.join(rarity, ["length", "token"], "left").groupBy("win").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "token", "offset", "length")).alias("p"))
    prefix = kept(prefix.filter("p.df > 0").select("win", "p.*").join(windows, "win"), "prefix", under)
    n, on = prefix.count(), ["length", "token"]
    if n > most:
        salts = F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))
        found, prefix, on = found.withColumn("salt", F.pmod(F.xxhash64("key", "at"), F.lit(SALTS))), prefix.withColumn("salt", F.explode(salts)), [*on, "salt"]
    pairs = found.join(F.broadcast(prefix) if n <= most else prefix, on)
    start, size = F.col("at") - F.col("offset"), F.size("words")
    room = (start >= 0) & (start + size <= F.col("n_words"))
    same = F.slice("around", F.col("before") - F.col("offset") + 1, size) == F.col("words")
    return pairs.filter(F.when(room, same)).select("key", "win", start.alias("start"), size.alias("n"))


def window_tokens(windows: DataFrame, shingle: int) -> DataFrame:
    """win, length, offset, token of windows (win, words): their shingles, all their words where they have fewer."""
    words = F.col("words")
    length = F.least(F.size(words), F.lit(shingle))
    of = [F.when(length == k, F.transform(shingle_hashes(words, k), lambda t, i: F.struct(i.alias("offset"), t.alias("token")))) for k in range(1, shingle + 1)]
    return windows.select("win", length.alias("length"), F.inline(F.coalesce(*of)))


def spans_hit(found: DataFrame) -> DataFrame:
    """key, n_hit: words of a document in any of its places (key, start, n), those in several once."""
    w = Window.partitionBy("key").orderBy("start", "n").rowsBetween(Window.unboundedPreceding, -1)
    end = F.col("start") + F.col("n")
    rows = found.select("key", "start", "n").distinct().withColumn("__to", F.max(end).over(w))
    new = F.greatest(end - F.greatest(F.col("start"), F.coalesce("__to", F.lit(0))), F.lit(0))
    return rows.select("key", new.cast("long").alias("h")).groupBy("key").agg(F.sum("h").alias("n_hit"))


def contamination(docs: DataFrame, items: DataFrame, window: int = WINDOW, shingle: int = SHINGLE, literals: int = LITERALS, most: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of docs (doc_id, text), by items (item_id, text)."""
    spark = docs.sparkSession
    under = shared_dir(spark, "decontaminate")
    classes, windows = item_windows(items, window)
    classes, windows = kept(classes, "classes", under), kept(windows.withColumn("win", F.sha2(F.array_join("words", " "), 256)), "windows", under)
    unique = windows.groupBy("win").agg(F.first("words").alias("words"))
    tokens = kept(window_tokens(unique, shingle), "tokens", under)
    asked = kept(tokens.select("length", "token").distinct(), "asked", under)
    key = F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text"))
    rows, found = scanned(docs.select(key.alias("key"), words_of(F.col("text")).alias("words")), asked, window, literals)
    if found is None:
        rows = kept(rows, "scanned", under)
        found = rows.filter(F.size("places") > 0).select("key", "n_words", F.inline("places"))
    places = kept(occurrences(kept(found, "postings", under), tokens, unique, under, most), "places", under)
    hit = places.select("key", "win").distinct().join(windows.select("win", "cls"), "win").select("key", "cls").distinct().join(classes, "cls")
    ids = hit.groupBy("key").agg(F.array_sort(F.collect_set("item")).alias("ids"))
    of_doc = spans_hit(places).join(ids, "key").select("key", "n_hit", F.size("ids").cast("long").alias("n_items"), F.sha2(F.array_join("ids", ","), 256).alias("items_sha256"))
    zero = F.lit(0).cast("long")
    rows = rows.alias("d").join(of_doc.alias("h"), F.expr("d.key.text = h.key.text AND d.key.doc_id <=> h.key.doc_id"), "left")
    rows = rows.select("d.key.doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", zero).alias("n_hit"), F.coalesce("n_items", zero).alias("n_items"), F.coalesce("items_sha256", F.sha2(F.lit(""), 256)).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))
    out = kept(rows, "contamination")
    dropped(spark, under)
    return out
