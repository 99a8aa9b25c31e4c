"""Conversation repair, whitening and decontamination against plain versions, and odd inputs."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from helixframe.llm import bpe, decontaminate, html_extract, repair, toxicity, whitening
from tests.llm.pages import OPEN, PAGES
from tests.llm.test_edges import small_corpus, tokenizer
from tests.llm.test_llm import path

TALK = "conv_id long, turn long, role string, text string"


def plain_damage(rows):
    out = []
    for c, t, role, text in rows:
        s = [" " if x is None else str(x) for x in (c, t, role, text)]
        kind = zlib.crc32(f"{s[0]}:{s[1]}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", s[3]) if kind == 2 else s[3]
        row = (c, t, "user" if kind == 4 else s[2], text)
        out += [] if kind == 0 else [row, row] if kind == 3 else [row]
    return out


def plain_repair(rows):
    """By a search over (row, state) for the cheapest edits, then the least: costs first, then initials."""
    turns = {t for _, t, _, _ in rows if t is not None}
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.sha256(r[3].encode()).digest()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    pairs = [(a[2][:1], b[2][:1]) for a, b in zip(rows, rows[1:])]
    best, heap = None, [(0, "", 0, "", ())]
    done = set()
    while heap:
        cost, audit, i, state, lines = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == len(rows) and state in ("", "a"):
            best = (cost, audit, lines)
            break
        want = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[want]
        heapq.heappush(heap, (cost + 2, audit + "I", i, want, (*lines, name + ":")))
        if i < len(rows):
            _, _, role, text = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, state, lines))
            if faults[i] in (None, "truncated"):
                more = faults[i] is not None
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, want, (*lines, f"{name}:{text}")))
                if role[:1] == want or role[:1] == "s" and state == "":
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[:1], (*lines, f"{role}:{text}")))
    return {
        "gaps": max(turns) - min(turns) + 1 - len(turns) if turns else 0, **{f: faults.count(f) for f in ("blank", "duplicate", "truncated")},
        "illegal": sum(p not in {("s", "u"), ("u", "a"), ("a", "u")} for p in pairs), "cost": best[0], "audit": best[1], "repaired_sha256": hashlib.sha256("\n".join(best[2]).encode()).hexdigest(),
    }


def talks(r, n, longest=12):
    rows = []
    for c in range(n):
        for t in range(r.randint(1, longest)):
            role = r.choices(["user", "assistant", "system", "tool", "", None, "u2"], [8, 8, 3, 1, 1, 1, 1])[0]
            rows.append((c if r.random() < 0.98 else None, t + r.randint(0, 2) if r.random() < 0.95 else None, role, r.choice(["Yes.", "No!", "Why", "so? \n", "", None, " \t", "é.", "a. b"])))
    return rows


def expected(rows):
    out, left = {}, {}
    for row in plain_damage(rows):
        left.setdefault(row[0], []).append(row)
    for c in {r[0] for r in rows}:
        out[c] = plain_repair(left.get(c, []))
    return out


@pytest.mark.parametrize("block", [1 << 16, 4, 8])
def test_repair_equals_a_search(spark, block):
    """Small blocks cut conversations into many pieces; the result is the same."""
    rows = talks(random.Random(block), 150)
    got = repair.repaired(spark.createDataFrame(rows, TALK), block).collect()
    want = expected(rows)
    assert len(got) == len(want)
    for row in got:
        assert {k: v for k, v in row.asDict().items() if k != "conv_id"} == want[row.conv_id], row.conv_id


def test_one_long_conversation_and_odd_tables(spark):
    r = random.Random(3)
    rows = [(7, t, r.choice(["user", "assistant"]), r.choice(["Yes.", f"No {t}.", "cut"])) for t in range(2000)] + [(8, 1, "user", "x" * 200_000)] + [(9, 0, "user", "Same.")] * 50
    df = spark.createDataFrame(rows, TALK).withColumn("c", F.lit(1)).withColumn("cost", F.lit("x")).withColumn("audit", F.lit(None))
    want = expected(rows)
    for block in (256, repair.BLOCK):  # several blocks; one block of several chunks
        got = {x.conv_id: x.asDict() for x in repair.repaired(df, block).collect()}
        for c, w in want.items():
            assert got[c] == {"conv_id": c, **w}
    assert repair.repaired(df.limit(0)).count() == 0


def test_conversations_that_damage_empties(spark):
    c = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    got = repair.repaired(spark.createDataFrame([(c, 0, "user", "Hi.")], TALK)).first()
    assert got.asDict() == {"conv_id": c, **dict.fromkeys(("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), 0), "audit": "", "repaired_sha256": hashlib.sha256(b"").hexdigest()}


VECTORS = "vec_id long, embedding array<double>"


def embeddings(n=300, d=20, seed=1):
    r = np.random.default_rng(seed)
    return r.normal(size=(n, d)) @ np.diag(np.linspace(0.2, 3, d)) @ np.linalg.qr(r.normal(size=(d, d)))[0]


@pytest.mark.parametrize("tile", [16, 7, 64])
def test_whitening_equals_a_plain_eigendecomposition(spark, tile):
    e = embeddings()
    bad = [(900, None), (901, [float("nan")] + [0.0] * 19), (902, [float("inf")] * 20), (903, [None] + [0.0] * 19)]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(e)] + bad, VECTORS).withColumn("n", F.lit("x")).withColumn("w", F.lit(None)).repartition(5)
    got = whitening.whitened(df, tile=tile).collect()
    x = np.floor(1024 * e).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    y = n * x - s
    cov = (y / n).T @ (y / n) / n
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1], vecs[:, ::-1]
    assert len(got) == n * 8 and {r.n for r in got} == {n} and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    w = np.zeros((n, 8))
    for r in got:
        assert r.deviation == int((y[r.vec_id] ** 2).sum()) and abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9
        w[r.vec_id, r.component - 1] = r.whitened
    plain = (y / n) @ vecs[:, :8] / np.sqrt(values[:8])
    assert np.abs(w - plain * np.sign((w * plain).sum(0))).max() < 1e-8


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 9, [(1, [])]])
def test_vectors_without_variance(spark, rows):
    assert whitening.whitened(spark.createDataFrame(rows, VECTORS)).count() == 0


def test_fewer_dimensions_than_components_and_repeats(spark):
    rows = [(None, [0.0, 1.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.25])]
    got = whitening.whitened(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted((str(r.vec_id), r.component) for r in got) == sorted((str(i), c) for i, _ in rows for c in (1, 2)) and got[0].identity_error < 1e-4
    with pytest.raises(Exception, match="length"):
        whitening.whitened(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], VECTORS)).count()


ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return ITEM.findall((text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def plain_contamination(docs, items):
    windows = {}
    for i, text in items:
        w = plain_words(text)
        for k in range(max(len(w) - 9, 1) if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add("" if i is None else str(i))
    out = []
    for d, text in docs:
        w, hit, found = plain_words(text), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if ids := windows.get(tuple(w[i : i + n])):
                    hit.update(range(i, i + n))
                    found |= ids
        out.append((d, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def leaks(r):
    say = lambda n: " ".join(r.choice(["the", "of", "Ünd", "ab", "cd", "e1", "x"]) for _ in range(n))
    items = [(i, say(r.choice([1, 2, 4, 5, 9, 10, 11, 30]))) for i in range(3, 25)]
    items += [(30, items[0][1].upper()), (30, "other words, that's all"), (None, say(12)), (31, None), (32, ""), (33, "!?"), (34, items[5][1])]
    docs = []
    for i in range(60):
        t = say(r.randint(0, 60))
        for _ in range(r.randint(0, 3)):
            w = (r.choice(items)[1] or "").split()
            t += " -- " + " ".join(w[r.randint(0, 2) :]) + ", " + say(r.randint(0, 3))
        docs.append((i, t))
    return docs + [(1, docs[0][1]), docs[3], docs[3], (None, docs[5][1]), (70, None), (71, ""), (72, "word " * 100_000 + (items[4][1] or ""))], items


@pytest.mark.parametrize("literals, most", [(1 << 15, 1 << 17), (2, 2), (1 << 15, 2), (2, 1 << 17)])
def test_contamination_equals_brute_force(spark, literals, most):
    """Tokens in the plan or in a bitmap, windows broadcast or shuffled: the rows are the same."""
    docs, items = leaks(random.Random(5))
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("key", F.lit(1)).withColumn("words", F.lit("x")).withColumn("n_words", F.lit(None))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("win", F.lit(1)).withColumn("cls", F.lit(2))
    got = decontaminate.contamination(d, b, literals=literals, most=most).collect()
    assert sorted(map(tuple, got), key=str) == plain_contamination(docs, items)


def test_contamination_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "some words here")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "some")], "item_id long, text string")
    assert [tuple(r)[1:4] for r in decontaminate.contamination(d, b.limit(0)).collect()] == [(3, 0, 0)]
    assert decontaminate.contamination(d.limit(0), b).count() == 0


# mended in this round ------------------------------------------------------------------------


def test_rows_that_repeat_leave_the_model_as_it_is(spark):
    r = random.Random(2)
    say = lambda n: " ".join(r.choice(["plain", "text", "word", "some", "other"]) for _ in range(n))
    rows = [(i, say(20) + (" snarvo grukle" if i % 2 else "")) for i in range(80)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(80)], "doc_id long, toxic int")
    one, five = (spark.createDataFrame(rows * k, "doc_id long, text string") for k in (1, 5))
    models = [toxicity.train(d, labels, 20) for d in (one, five)]
    assert models[0] == models[1]
    assert toxicity.score(five, models[1]).filter("toxic").count() == 200


def test_clashing_columns_come_through_the_pipeline(spark, tmp_path):
    rows, labels = small_corpus()
    extra = ("toxic", "grade", "spans", "maybe", "key", "size", "p_toxic", "copies", "component_id", "kept")
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    df = df.select(*(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in extra[:5]), "*", *(F.concat(F.lit(c), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))).alias(c) for c in extra[5:]))
    df.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == df.columns and out.dtypes == df.dtypes
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() > 0 and all(r[c] == c + ("?" if r.doc_id is None else str(r.doc_id)) for r in docs.collect() for c in extra)
    assert {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(corpus_pipeline.encode(spark, docs, str(tmp_path)).columns)


def test_letters_with_marks_are_encoded_as_by_the_library(spark):
    r = random.Random(9)
    marks = "̸゙̧̣̀́̇̈⃐᪰ٓͅ"
    letters = "IiJAaSsKLWßÉéÅΑаИІ가.!'1 \n-"
    texts = ["İ̸", "xİ", "İ.x"] + ["".join(r.choice(letters if r.random() < 0.6 else marks) for _ in range(r.randint(1, 14))) for _ in range(20_000)]
    got = {x.doc_id: x.ids for x in bpe.encode(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), path()).collect()}
    for i, e in enumerate(tokenizer().encode_batch(texts, add_special_tokens=False)):
        assert got[i] == e.ids, texts[i]


def test_pages_written_by_hand():
    got = [t for t, _ in html_extract.extract([h for h, _ in PAGES])]
    for i, (text, (_, blocks)) in enumerate(zip(got, PAGES)):
        assert i in OPEN or text == "\n\n".join(blocks), i
    assert len(PAGES) == 30
