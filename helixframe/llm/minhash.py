"""Near-duplicate groups: SuperMinHash signatures, banding, verification on full sets, union-find.

1. signed(): a task turns each text into the set of its word shingles (64-bit hashes), a key of the
   set, a SuperMinHash signature (one byte a slot is kept) and band keys.
2. Equal sets form a class; its smallest doc_id stands for it from here on.
3. In each bucket (equal band key) every class is paired with the smallest: a star, not all pairs.
   Pairs whose signatures may reach the threshold are verified on full sets of whole texts.
4. Links are merged into components. Where buckets still hold several, components with classes whose
   signatures may reach the threshold form a cluster (again by union-find; only a spanning forest
   of each group of signatures leaves its task). All pairs of classes across the components of a
   cluster are then compared on full sets, and the new links, a spanning forest too, merged.
   Buckets and clusters are cut into blocks, each two of which meet in a group of bounded size; the
   blocks of a group's largest component don't meet each other, so what moves grows with that
   component times the rest.
Every pair that shares a bucket and agrees in LEAST_SLOTS of the SLOTS slots thus ends in one component or is compared
on full sets. With BANDS bands of ROWS slots a pair at similarity 0.8 shares none with probability (1 - 0.8**4)**26,
about 1 in 900,000; it agrees in fewer than LEAST_SLOTS slots with one of about 1 in 10,000,000 (five to six standard
deviations, 0.031 each). Together: about 1 in 800,000, and less above 0.8. A test counts misses on pairs at 0.8.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from helixframe.llm.common import dropped, kept, prepare, scratch, with_maybe

SLOTS, BANDS, ROWS = 128, 26, 4
#: Signatures that agree in fewer slots aren't verified: five standard deviations below what 0.8 gives.
LEAST_SLOTS = 80
#: Classes of a block where signatures meet, and where texts meet; shingles that the texts of a block may have in all.
SIGNATURES, TEXTS, TEXT_SHINGLES = 512, 128, 200_000
#: Rows of a class are dealt over so many keys where they learn their component.
SALTS = 64
#: Words hashed at once; what a task holds of one text beyond the text itself is bounded by it and the set.
WORDS_AT_ONCE = 100_000

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_INVERSE = _U(pow(0x9E3779B97F4A7C15 | 1, -1, 1 << 64))
_BYTE = np.array([int.from_bytes(hashlib.blake2b(bytes([i]), digest_size=8, key=b"shingle").digest(), "little") for i in range(256)], _U)
_POWERS = [np.ones(1, _U), np.ones(1, _U)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse (modulo 2**64), n of each."""
    if len(_POWERS[0]) < n:
        for i, b in enumerate((_BASE, _INVERSE)):
            x = np.full(max(n, 1 << 16), b, _U)
            x[0] = 1
            _POWERS[i] = np.cumprod(x)
    return _POWERS[0][:n], _POWERS[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit (splitmix64's finisher)."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def shingles(text: str | None, k: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's k-word shingles; with fewer words, of all of them as one.

    Words are parted by ASCII white space, A-Z in lower case. No words: empty.
    """
    words = text.encode().lower().split() if text else []
    if not words:
        return np.empty(0, _U)
    k = min(k, len(words))
    parts = []
    for at in range(0, len(words) - k + 1, WORDS_AT_ONCE):
        some = words[at : at + WORDS_AT_ONCE + k - 1]
        line = np.frombuffer(b" ".join(some), np.uint8)
        power, inverse = _powers(len(line) + 1)
        sums = np.zeros(len(line) + 1, _U)
        np.cumsum(_BYTE[line] * power[1:], out=sums[1:])
        ends = np.append(np.flatnonzero(line == 32), len(line))
        starts = np.insert(ends[:-1] + 1, 0, 0)
        first, last = starts[: len(starts) - k + 1], ends[k - 1 :]
        parts.append(mixed((sums[last] - sums[first]) * inverse[first]))
    return np.unique(np.concatenate(parts))


def super_minhash(x: np.ndarray) -> np.ndarray:
    """SLOTS values (round << 32 | rank) of a set of hashes.

    In round j each element visits one slot, by a permutation of its own (b + a * j, a odd), with
    rank j and a random fraction; a slot keeps its least. Rounds end once no slot can still fall.
    """
    sig = np.full(SLOTS, np.iinfo(np.uint64).max, _U)
    if not len(x):
        return sig
    y = mixed(x ^ _U(0xA0761D6478BD642F))
    a, b = (y >> _U(20)) | _U(1), y
    j, at_once = 0, max(1, 512 // len(x))
    while j < SLOTS:
        js = np.arange(j, min(SLOTS, j + at_once), dtype=_U)[:, None]
        slot = ((b + a * js) & _U(SLOTS - 1)).ravel().astype(np.int64)
        rank = (js << _U(32) | mixed(x + (js + _U(1)) * _BASE) >> _U(32)).ravel()
        np.minimum.at(sig, slot, rank)
        j += len(js)
        if int(sig.max()) >> 32 < j:
            break
    return sig


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A 64-bit key of each band's slots and number."""
    s = mixed(sig[: BANDS * ROWS].reshape(BANDS, ROWS) + np.arange(1, ROWS + 1, dtype=_U) * _BASE)
    return mixed(s.sum(1, dtype=_U) + np.arange(BANDS, dtype=_U)).view(np.int64)


SIGNED = "doc_id long, n_shingles long, set_key binary, slots binary, bands array<long>"


def signed(docs: DataFrame, k: int) -> DataFrame:
    """SIGNED of each row (doc_id, text); slots and bands are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ns, keys, slots, bands = [], [], [], []
            for t in b.column(1):
                x = shingles(t.as_py(), k)
                ns.append(len(x))
                keys.append(hashlib.blake2b(x.tobytes(), digest_size=16).digest())
                sig = super_minhash(x) if len(x) else None
                slots.append(None if sig is None else (sig & _U(255)).astype(np.uint8).tobytes())
                bands.append(None if sig is None else band_keys(sig))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ns, pa.int64()), pa.array(keys, pa.binary()), pa.array(slots, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "set_key", "slots", "bands"])

    return docs.mapInArrow(run, SIGNED)


def alike(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * intersection >= percent * union, neither set empty."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both > 0 and 100 * both >= percent * (len(a) + len(b) - both)


def texts_of(docs: DataFrame, ids: DataFrame, under: str) -> DataFrame:
    """doc_id, text of the documents in ids (doc_id), as a table; few other texts are shuffled."""
    ids = kept(ids, "ids", under)
    return kept(with_maybe(docs, ids).filter("maybe").select("doc_id", "text").join(ids, "doc_id", "left_semi"), "texts", under)


def verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int, under: str) -> DataFrame:
    """The pairs (a, b) whose whole texts' sets are alike; docs: doc_id, text."""
    texts = texts_of(docs, pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), under)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory: OrderedDict[tuple[int, str], np.ndarray] = OrderedDict()

        def of(i: int, t: str) -> np.ndarray:
            x = memory.pop((i, t), None)
            memory[i, t] = x = shingles(t, k) if x is None else x
            if len(memory) > 64:
                memory.popitem(last=False)
            return x

        for b in batches:
            rows = zip(*(c.to_pylist() for c in b.columns))
            good = [(p, q) for p, q, s, t in rows if alike(of(p, s), of(q, t), percent)]
            yield pa.RecordBatch.from_pydict({"a": [p for p, _ in good], "b": [q for _, q in good]}, _PAIRS)

    side = lambda c, t: texts.select(F.col("doc_id").alias(c), F.col("text").alias(t))
    both = pairs.join(side("b", "text_b"), "b").join(side("a", "text_a"), "a").select("a", "b", "text_a", "text_b")
    return kept(both.mapInArrow(run, "a long, b long"), "links", under)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def components(links: DataFrame, under: str) -> DataFrame:
    """node, component (the smallest node it reaches) of every node of links (a, b), as a table.

    Union-find on tables: alternately every node hands its larger neighbours, then its smaller
    ones, to the smallest of all, until nothing moves. Each round is written, and takes two passes
    over as many links as there were at most; the round before is deleted then.
    """
    spark, at = links.sparkSession, f"{under}/rounds-{uuid.uuid4().hex}"
    measure = lambda x: x.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    edges = kept(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges", f"{at}/0")
    state, turn = measure(edges), 0
    while state[0]:
        two = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = two.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = two.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.filter("u > v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        edges = kept(small.filter("u > v").distinct(), "edges", f"{at}/{turn + 1}")
        dropped(spark, f"{at}/{turn}")
        turn, (state, before) = turn + 1, (measure(edges), state)
        if state == before:
            break
    ends = edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out = kept(ends, "components", under)
    dropped(spark, at)
    return out


def star_pairs(buckets: DataFrame) -> DataFrame:
    """a, b: the smallest class of each bucket (key, rep) with each other one."""
    lead = buckets.groupBy("key").agg(F.min("rep").alias("a"), F.max("rep").alias("z")).filter("a < z").drop("z")
    return buckets.join(lead, "key").filter("rep > a").select("a", F.col("rep").alias("b")).distinct()


def near(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Slots that agree, for each row of a and each of b."""
    return (a[:, None, :] == b[None, :, :]).sum(2, dtype=np.int16)


def promising(pairs: DataFrame, classes: DataFrame, percent: int, under: str) -> DataFrame:
    """The pairs whose sizes allow the threshold and whose signatures agree in LEAST_SLOTS slots."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y = (np.frombuffer(b"".join(b.column(c).to_pylist()), np.uint8).reshape(-1, SLOTS) for c in (2, 3))
            ok = pa.array((x == y).sum(1) >= LEAST_SLOTS, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(ok)

    side = lambda c: classes.select(F.col("rep").alias(c), F.col("slots").alias(f"s{c}"), F.col("n_shingles").alias(f"n{c}"))
    rows = pairs.join(side("b"), "b").join(side("a"), "a").filter(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * percent)
    return kept(rows.select("a", "b", "sa", "sb").mapInArrow(run, "a long, b long").distinct(), "pairs", under)


class Forest:
    """Union-find within a task; links() are the unions that joined something."""

    def __init__(self):
        self.up: dict[int, int] = {}
        self.made: list[tuple[int, int]] = []

    def root(self, x: int) -> int:
        up = self.up
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    def join(self, x: int, y: int, link: tuple[int, int]) -> None:
        p, q = self.root(x), self.root(y)
        if p != q:
            self.up[max(p, q)] = min(p, q)
            self.made.append((min(link), max(link)))


def in_blocks(rows: DataFrame, group: str, most: int, most_shingles: int | None = None) -> DataFrame:
    """rows (group, rep, component, n_shingles, ...) of groups with several components, once for each pair of blocks i <= j
    of their group that they belong to, dealt out and sorted by (group, i, j).

    A block has about most rows and most_shingles shingles. The largest component's blocks come last and meet only the
    others: its rows need no links among themselves.
    """
    sizes = rows.groupBy(group, "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    sizes = sizes.groupBy(group).agg(F.max(F.struct("n", "s", "component")).alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.count("*").alias("parts")).filter("parts > 1")
    count = lambda n, s: F.greatest(F.ceil(n / most), F.ceil(s / most_shingles) if most_shingles else F.lit(1)).cast("int")
    blocks = sizes.select(group, F.col("main.component").alias("main"), count(F.col("main.n"), F.col("main.s")).alias("large"), count(F.col("n") - F.col("main.n"), F.col("s") - F.col("main.s")).alias("rest"))
    rows = rows.join(blocks, group).withColumn("inside", F.col("component") == F.col("main"))
    place = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    rows = rows.withColumn("own", F.when(F.col("inside"), F.col("rest") + place("large")).otherwise(place("rest")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.when(F.col("inside"), F.col("rest")).otherwise(F.col("rest") + F.col("large")) - 1)))
    rows = rows.withColumn("i", F.least("own", "other")).withColumn("j", F.greatest("own", "other")).drop("other", "main", "large", "rest", "inside")
    return rows.repartition(group, "i", "j").sortWithinPartitions(group, "i", "j")


def by_group(batches: Iterator[pa.RecordBatch], keys: int, links) -> Iterator[pa.RecordBatch]:
    """links(rows) of each run of rows that agree in their first columns, as pairs."""
    group: list[tuple] = []
    made: list[tuple[int, int]] = []
    for b in batches:
        for r in zip(*(c.to_pylist() for c in b.columns)):
            if group and group[0][:keys] != r[:keys]:
                made += links(group)
                group = []
                if len(made) > 20_000:
                    yield pa.RecordBatch.from_pydict({"a": [p for p, _ in made], "b": [q for _, q in made]}, _PAIRS)
                    made = []
            group.append(r)
    if group:
        made += links(group)
    yield pa.RecordBatch.from_pydict({"a": [p for p, _ in made], "b": [q for _, q in made]}, _PAIRS)


def sides(g: list[tuple]) -> tuple[list[tuple], list[tuple]]:
    """A group's rows (key, i, j, own, ...) of block i and of block j."""
    i, j = g[0][1], g[0][2]
    one = [r for r in g if r[3] == i]
    return one, one if i == j else [r for r in g if r[3] == j]


def may_link(one: list[tuple], two: list[tuple], percent: int) -> np.ndarray:
    """Which pairs of rows (.., component, n_shingles, slots) of two components may reach the threshold."""
    s, t = (np.frombuffer(b"".join(r[7] for r in x), np.uint8).reshape(-1, SLOTS) for x in (one, two))
    c, d = (np.array([r[5] for r in x]) for x in (one, two))
    m, n = (np.array([r[6] for r in x]) for x in (one, two))
    fits = (np.minimum(m[:, None], n) * 100 >= np.maximum(m[:, None], n) * percent) & (c[:, None] != d)
    same = np.concatenate([near(s[i : i + 32], t) for i in range(0, len(s), 32)]) if fits.any() else 0
    return fits & (same >= LEAST_SLOTS)


def clusters(buckets: DataFrame, classes: DataFrame, found: DataFrame, percent: int, under: str) -> DataFrame:
    """cluster, rep, component, n_shingles, slots of the classes in clusters of several components."""
    one = classes.select("rep", "n_shingles", "slots").join(found, F.col("rep") == F.col("node"), "left").select("rep", F.coalesce("component", "rep").alias("component"), "n_shingles", "slots")
    one = kept(one, "members", under)
    rows = buckets.join(one.select("rep", "component"), "rep")
    open_ = kept(rows.groupBy("key").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).filter("lo < hi").select("key"), "open", under)
    rows = kept(buckets.join(open_, "key", "left_semi").join(one, "rep"), "meeting", under)
    rows = in_blocks(rows, "key", SIGNATURES)

    def links(g: list[tuple]) -> list[tuple[int, int]]:
        one, two = sides(g)
        f = Forest()
        if one and two:
            for p, q in zip(*np.nonzero(may_link(one, two, percent))):
                a, b = one[p][5], two[q][5]
                f.join(a, b, (a, b))
        return f.made

    cols = rows.select("key", "i", "j", "own", "rep", "component", "n_shingles", "slots")
    touching = cols.mapInArrow(lambda batches: by_group(batches, 3, links), "a long, b long").distinct()
    joined = components(touching, under).select("node", F.col("component").alias("cluster"))
    return one.join(joined, F.col("component") == F.col("node")).select("cluster", "rep", "component", "n_shingles", "slots")


def overlaps(x: list[np.ndarray], y: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of x with each of y, by products of slices of their incidence matrices."""
    out = np.zeros((len(x), len(y)), np.int64)
    values, column = np.unique(np.concatenate([*x, *y]), return_inverse=True)
    row = np.repeat(np.arange(len(x) + len(y)), [len(s) for s in (*x, *y)])
    left = row < len(x)
    both = np.zeros(len(values), np.int8)
    both[column[left]] |= 1
    both[column[~left]] |= 2
    shared = both == 3
    place = np.cumsum(shared) - 1
    keep = shared[column]
    row, column = row[keep], place[column[keep]]
    for at in range(0, int(shared.sum()), 8192):
        inside = (column >= at) & (column < at + 8192)
        m = np.zeros((len(x) + len(y), 8192), np.float32)
        m[row[inside], column[inside] - at] = 1
        out += (m[: len(x)] @ m[len(x) :].T).astype(np.int64)
    return out


def cross_links(members: DataFrame, docs: DataFrame, k: int, percent: int, under: str) -> DataFrame:
    """Links between components of one cluster, on full sets of whole texts: of each group a spanning forest."""
    members = kept(members, "clusters", under)
    texts = texts_of(docs, members.select(F.col("rep").alias("doc_id")).distinct(), under)
    rows = in_blocks(members.join(texts, F.col("rep") == F.col("doc_id")).drop("doc_id"), "cluster", TEXTS, TEXT_SHINGLES)

    def links(g: list[tuple]) -> list[tuple[int, int]]:
        one, two = sides(g)
        f = Forest()
        if not one or not two or not (may := may_link(one, two, percent)).any():
            return f.made
        left, right = np.flatnonzero(may.any(1)), np.flatnonzero(may.any(0))
        x, y = [shingles(one[p][8], k) for p in left], [shingles(two[q][8], k) for q in right]
        both = overlaps(x, y)
        m, n = np.array([len(s) for s in x]), np.array([len(s) for s in y])
        good = may[np.ix_(left, right)] & (100 * both >= percent * (m[:, None] + n - both)) & (both > 0)
        for p, q in zip(*np.nonzero(good)):
            r, s = one[left[p]], two[right[q]]
            f.join(r[5], s[5], (r[4], s[4]))
        return f.made

    cols = rows.select("cluster", "i", "j", "own", "rep", "component", "n_shingles", "slots", "text")
    return kept(cols.mapInArrow(lambda batches: by_group(batches, 3, links), "a long, b long"), "more", under)


def groups(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row.

    Texts without words, null or empty ones, link with nothing. Rows with a null doc_id link with
    nothing: component_id null, kept. Rows that repeat a doc_id are one document with each of their
    texts; all of them are kept if it is. kept: doc_id is the smallest of its component. Other
    columns are left out.
    """
    spark = docs.sparkSession
    prepare(spark)
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    with scratch(spark, "dedup") as under:
        rows = kept(signed(docs, k), "signed", under)
        links_some = F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0)
        full = rows.filter(links_some)
        first = full.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "slots", "bands")).alias("r"))
        classes = kept(first.select(F.col("r.doc_id").alias("rep"), "set_key", "r.n_shingles", "r.slots", "r.bands"), "classes", under)
        buckets = classes.select("rep", F.explode("bands").alias("key"))
        tried = promising(star_pairs(buckets), classes, percent, under)
        links = verified(tried, docs, k, percent, under)
        found = components(links, under)
        more = cross_links(clusters(buckets, classes, found, percent, under), docs, k, percent, under)
        if more.limit(1).count():
            found = components(links.unionByName(more), under)
        by_set = classes.select("set_key", "rep").join(found, F.col("rep") == F.col("node"), "left").select("set_key", F.coalesce("component", "rep").alias("component_id"))
        full = full.select("doc_id", "n_shingles", "set_key", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
        places = full.select("set_key", "salt").distinct().join(by_set, "set_key")  # SALTS rows of a set at most, so no set fills a task
        joined = full.join(places, ["set_key", "salt"]).select("doc_id", "n_shingles", "component_id")
        alone = rows.filter(~links_some).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
        return kept(joined.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))), "dedup-groups")


def one_of_each(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """docs (all columns) without near copies: of each group of alike texts the row with the smallest doc_id.

    Where rows repeat a doc_id, each row is compared by itself, so a text stays unless a row with one alike does; a doc_id's
    texts without words (null, empty) are alike, and null goes first. Rows with a null doc_id stay.
    """
    named, rest = docs.filter("doc_id IS NOT NULL"), docs.filter("doc_id IS NULL")
    if not named.groupBy("doc_id").count().filter("count > 1").limit(1).count():
        stay = groups(named, k, percent).filter("kept").select(F.col("doc_id").alias("__stay"))
        return named.join(stay, F.col("doc_id") == F.col("__stay"), "left_semi").unionByName(rest)
    rows = kept(named.withColumn("__row", F.monotonically_increasing_id()), "dedup-rows")
    found = groups(rows, k, percent, "__row").select(F.col("doc_id").alias("__of"), "n_shingles", "component_id")
    order = F.struct("doc_id", F.col("text").isNull().alias("none"), F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")), 256).alias("text"), F.sha2(F.to_json(F.struct(*docs.columns)), 256).alias("all"), "__row")
    some = F.col("n_shingles") > 0
    one = rows.select(F.col("doc_id").alias("__id"), "__row", order.alias("order")).join(found, F.col("__row") == F.col("__of"))
    stay = one.groupBy(F.when(some, F.col("component_id")).alias("group"), F.when(~some, F.col("__id")).alias("own")).agg(F.min("order").alias("first"))
    return rows.join(stay.select(F.col("first")["__row"].alias("__stay")), F.col("__row") == F.col("__stay"), "left_semi").drop("__row").unionByName(rest)
