import math
import os

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helixframe.functions import scores
from helixframe.operators import corpus, evaluation, order, sampling, vq
from helixframe.plans import builds
from helixframe.sources import archives
from helixframe.streaming import chunks as streaming


def test_chunks_put_together_give_the_record(spark):
    rows = spark.createDataFrame([("a", "ACGTNACG"), ("b", ""), ("c", "NNN"), ("d", "acgtacgta"), ("e", None)], "id string, sequence string")
    got = corpus.chunks(rows, 3).orderBy("id", "chunk_start").collect()
    assert [(r.id, r.chunk_start, r.chunk_end, r.sequence) for r in got] == [("a", 0, 3, "ACG"), ("a", 3, 4, "T"), ("a", 5, 8, "ACG"), ("d", 0, 3, "ACG"), ("d", 3, 6, "TAC"), ("d", 6, 9, "GTA")]
    s = corpus.corpus_stats(rows, "id", 3).first()
    assert (s.genomes_processed, s.fasta_records_processed, s.input_bases, s.ambiguous_bases, s.retained_bases) == (5, 5, 20, 4, 16)
    assert (s.chunks, s.full_length_chunks, s.short_chunks, s.short_chunk_bases) == (6, 5, 1, 1)


def test_windows_tokens_and_ranks(spark):
    rows = spark.createDataFrame([(0, "AAAACCCC"), (1, "GGGGTTTT")], "id int, sequence string")
    w = corpus.sequence_windows(rows, 4).orderBy("id", "window_no")
    assert [r.window for r in w.collect()] == ["AAAA", "CCCC", "GGGG", "TTTT"]
    parts = [{(r.id, r.window_no) for r in corpus.rank_split(w, 2, k, "id", "window_no").collect()} for k in (0, 1)]
    assert not parts[0] & parts[1] and len(parts[0] | parts[1]) == 4
    b = corpus.token_batches(spark.createDataFrame([(0, "ACGT"), (1, "TGCA")], "p int, window string"), 2, "p").first()
    assert b.input_ids == [[0, 1, 2, 3], [3, 2, 1, 0]]
    with pytest.raises(Exception):
        corpus.token_batches(spark.createDataFrame([(0, "ACGT"), (1, "T")], "p int, window string"), 2, "p").collect()


def dealt(capacities, target, order):
    got, left = dict.fromkeys(capacities, 0), target
    while left:
        for k in order:
            if left and got[k] < capacities[k]:
                got[k] += 1
                left -= 1
    return got


def test_waterfill_equals_dealing_in_rounds(spark):
    import hashlib
    import random

    r = random.Random(1)
    for case in range(6):
        caps = {g: {f"k{i}": r.randint(0, 9) for i in range(r.randint(1, 12))} for g in ("x", "y")}
        goal = {g: r.randint(0, sum(c.values())) for g, c in caps.items()}
        rows = spark.createDataFrame([(g, k, n, goal[g]) for g, c in caps.items() for k, n in c.items()], "g string, k string, cap long, goal long")
        got = {(x.g, x.k): x.quota for x in sampling.waterfill(rows, "g", "k", "cap", F.col("goal"), 3).collect()}
        for g, c in caps.items():
            order = sorted(c, key=lambda k: hashlib.sha256(f"3:quota:{g}_{k}".encode()).hexdigest())
            assert {k: got[g, k] for k in c} == dealt(c, goal[g], order)


def test_waterfill_is_level_and_refuses_too_much(spark):
    rows = spark.createDataFrame([("s", "limited", 1), ("s", "large-a", 5), ("s", "large-b", 5)], "g string, k string, cap long")
    q = {r.k: r.quota for r in sampling.waterfill(rows, "g", "k", "cap", F.lit(7), 1).collect()}
    assert q["limited"] == 1 and sum(q.values()) == 7 and abs(q["large-a"] - q["large-b"]) <= 1
    with pytest.raises(Exception):
        sampling.waterfill(rows, "g", "k", "cap", F.lit(12), 1).collect()


@pytest.mark.parametrize("band_rows", [1, 16, 1 << 16])
def test_order_statistics_of_large_groups(spark, band_rows):
    import hashlib

    rows = spark.range(3000).select(F.when(F.col("id") % 10 == 0, F.lit(None)).when(F.col("id") % 10 == 1, "y").otherwise("x").alias("g"), F.col("id").alias("k"), F.sha2(F.col("id").cast("string"), 256).alias("h"))
    wanted = spark.createDataFrame([("x", 1000), ("y", 300), (None, 1), ("z", 1)], "g string, n long")
    got = {r.g: (r.score_at, r.key_at) for r in order.nth_scores(rows, "g", "h", "k", wanted, 3000, True, band_rows).collect()}
    of = {g: sorted((hashlib.sha256(str(i).encode()).hexdigest(), i) for i in range(3000) if (None if i % 10 == 0 else "y" if i % 10 == 1 else "x") == g) for g in ("x", "y", None)}
    assert got == {"x": of["x"][999], "y": of["y"][299], None: of[None][0]}
    assert order.nth_scores(rows, "g", "h", "k", spark.createDataFrame([("x", 0), ("y", 301)], "g string, n long"), 3000, True, band_rows).count() == 0


def test_no_task_orders_a_whole_split(spark, monkeypatch):
    """One group holds all rows: windows over rows are partitioned by bands, those over groups see a row per band or range."""
    monkeypatch.setattr(order.ranges, "RANGES", 16)
    rows = spark.range(20_000).select(F.lit("train").alias("g"), F.col("id").cast("string").alias("k"), (F.col("id") * 7919 % 5003).alias("cap"))
    seen = []
    plain = order.Window.partitionBy

    def noted(*columns):
        seen.append(columns)
        return plain(*columns)

    monkeypatch.setattr(order.Window, "partitionBy", noted)
    out = sampling.waterfill(rows, "g", "k", "cap", F.lit(9_000_000), 3, 64)
    assert out.agg(F.sum("quota")).first()[0] == 9_000_000
    over_rows = [c for c in seen if c not in (("g",),)]
    assert all(c in (("g", "__band"), ("g", "__range")) for c in over_rows) and over_rows
    scores_ = rows.withColumn("h", scores.stable_score(3, "quota", F.concat_ws("_", "g", "k"))).withColumn("__band", order.hash_band(F.col("h"), order.digits_for(20_000, 64)))
    bands = scores_.groupBy("g", "__band").count().agg(F.max("count"), F.count("*")).first()
    assert bands[0] <= 2 * 64 and bands[1] > 200


def test_samples_are_nested(spark):
    g = lambda q: spark.createDataFrame([("RS_1", 20, q)], "a string, n long, q long")
    numpy_ = {q: {r.ordinal for r in sampling.permuted_ordinals(g(q), "a", "n", "q", 17).collect()} for q in (3, 8, 20)}
    assert len(numpy_[3]) == 3 and numpy_[3] < numpy_[8] < numpy_[20] == set(range(20))
    import hashlib

    seed = int.from_bytes(hashlib.sha256(b"17:chunk_selection:RS_1").digest()[:8], "big")
    assert numpy_[8] == set(np.random.default_rng(seed).permutation(20)[:8].tolist())
    rows = spark.range(20).select(F.lit("RS_1").alias("a"), F.col("id").alias("ordinal"))
    hashed = {q: {r.ordinal for r in sampling.hash_selected(rows.withColumn("q", F.lit(q)), "a", "q", 17).collect()} for q in (3, 8)}
    assert hashed[3] < hashed[8]


L = 32
#: Accession, genus and full chunks: two genera of the held-out kind, six others, one genome too small for a chunk.
GENOMES = [(f"GB_GCA_9{i:05d}.2", g, n) for i, (g, n) in enumerate([("Escherichia", 5), ("Escherichia_C", 2), ("Alphagenus", 2), ("Betagenus", 9), ("Gammagenus", 3), ("Deltagenus", 7), ("Omegagenus", 6), ("Kappagenus", 4), ("Smallgenus", 0)])]


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    import gzip

    folder = tmp_path_factory.mktemp("processed")
    rows = [(f"{a}|record|{L * i}-{L * i + n}", a, L * i, L * i + n, n, "A" * n) for a, _, k in GENOMES for i, n in enumerate([L] * k + [10])]
    df = pd.DataFrame(rows, columns=["chunk_id", "gtdb_accession", "chunk_start", "chunk_end", "chunk_length", "sequence"])
    for i, part in enumerate((df[:18], df[18:])):
        part.to_parquet(folder / f"chunks-{i:05d}.parquet", index=False)
    tax = folder / "bac.tsv.gz"
    with gzip.open(tax, "wt") as f:
        for a, genus, _ in GENOMES:
            f.write(f"{a}\td__Bacteria;p__P;c__C;o__O;f__F;g__{genus};s__{genus} species\n")
    (folder / "ar.tsv.gz").write_bytes(gzip.compress(b""))
    return folder


def build(spark, stored, out, seed=17, **more):
    tax = archives.taxonomy(spark, [str(stored / "bac.tsv.gz"), str(stored / "ar.tsv.gz")])
    args = {"train_bases": 8 * L, "fraction": 0.25, "seed": seed, "length": L} | more
    return builds.build_subset(spark, archives.chunk_shards(spark, str(stored)), tax, str(out), **args)


@pytest.mark.parametrize("exact", [True, False])
def test_subset(spark, stored, tmp_path, exact):
    import json

    build(spark, stored, tmp_path / "a", exact=exact)
    m = spark.read.parquet(str(tmp_path / "a" / "genome_manifest.parquet")).toPandas()
    assert list(m.gtdb_accession) == sorted(a for a, _, _ in GENOMES)
    assert m.split.value_counts().to_dict() == {"train": 4, "validation": 2, "escherichia_holdout": 2}
    assert m[m.genus == "Smallgenus"].split.isna().all()
    got = {s: spark.read.parquet(str(tmp_path / "a" / s)).toPandas() for s in sampling.SPLITS}
    assert {s: len(x) for s, x in got.items()} == {"train": 8, "validation": 4, "escherichia_holdout": 4}
    for s, x in got.items():
        assert set(x.gtdb_accession) <= set(m[m.split == s].gtdb_accession) and (x.chunk_length == L).all()
        assert x.groupby("gtdb_accession").size().to_dict() == {a: n for a, n in zip(m[m.split == s].gtdb_accession, m[m.split == s].selected_chunks) if n}
    stats = json.loads((tmp_path / "a" / "subset_stats.json").read_text())
    assert stats["splits"]["train"] == {"genomes": 4, "chunks": 8, "bases": 8 * L} and stats["genomes_without_full_chunks"] == 1
    assert stats["selection"]["holdout_genera"] == ["Escherichia", "Escherichia_C"]
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    build(spark, stored, tmp_path / "b", exact=exact)
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    again = {s: set(spark.read.parquet(str(tmp_path / "b" / s)).toPandas().chunk_id) for s in sampling.SPLITS}
    assert again == {s: set(x.chunk_id) for s, x in got.items()}
    with pytest.raises(FileExistsError):
        build(spark, stored, tmp_path / "a")
    assert archives.training_sequences(spark, str(tmp_path / "a"), "train").columns == ["sequence"]


def test_subset_fails_before_it_writes(spark, stored, tmp_path):
    tax = archives.taxonomy(spark, [str(stored / "bac.tsv.gz")]).filter("genus <> 'Omegagenus'")
    with pytest.raises(ValueError, match="900006"):
        builds.build_subset(spark, archives.chunk_shards(spark, str(stored)), tax, str(tmp_path / "x"), 8 * L, 0.25, length=L)
    with pytest.raises(ValueError, match="contain only .* full chunks"):
        build(spark, stored, tmp_path / "x", train_bases=1000 * L)
    with pytest.raises(ValueError):
        build(spark, stored, tmp_path / "x", fraction=0.0)
    assert not list(tmp_path.iterdir())


def test_spearman(spark):
    r = np.random.default_rng(0)
    df = pd.DataFrame({"g": ["a"] * 50 + ["b"] * 40 + ["c"] * 5 + ["d"], "x": np.r_[r.integers(0, 9, 90), [1.0] * 5, 2].astype(float), "y": r.normal(size=96)})
    got = {x.g: x.spearman for x in evaluation.spearman(spark.createDataFrame(df), "g", "x", "y").collect()}
    for g in "ab":
        d = df[df.g == g]
        assert math.isclose(got[g], np.corrcoef(d.x.rank(), d.y.rank())[0, 1], abs_tol=1e-12)
    assert got["c"] is None and got["d"] is None


def test_spearman_ranks_by_group_and_by_range_alike(spark):
    r = np.random.default_rng(5)
    df = pd.DataFrame({"g": r.choice(["a", "b", None], 3000, p=[0.7, 0.2, 0.1]), "x": r.integers(0, 40, 3000).astype(float), "y": r.integers(0, 300, 3000) / 7.0})
    rows = spark.createDataFrame(list(df.itertuples(index=False, name=None)), "g string, x double, y double")
    by_group, by_range = ({x.g: (x.num_variants, round(x.spearman, 12)) for x in evaluation.spearman(rows, "g", "x", "y", few).collect()} for few in (1 << 20, 0))
    assert by_group == by_range and len(by_group) == 3
    plan = evaluation.spearman(rows, "g", "x", "y")._jdf.queryExecution().toString()
    assert plan.split("Physical Plan")[1].count("Exchange hashpartitioning") == 1


def test_comparison_adds_the_mean_only_when_all_are_there(spark):
    rows = spark.createDataFrame([(s, 10, 0.5) for s in evaluation.REPORTED], "study_id string, num_variants long, spearman double")
    out = {r.study_id: r for r in evaluation.compared(rows).collect()}
    assert len(out) == 10 and out["macro_average"].num_variants == 90 and math.isclose(out["macro_average"].difference, 0.04)
    assert evaluation.compared(rows.limit(3)).count() == 3
    with pytest.raises(Exception):
        evaluation.compared(spark.createDataFrame([("new", 1, 0.1)], rows.schema)).collect()


def test_evaluation_resumes(spark, tmp_path):
    rows = [("s1", f"a{i % 2}", "ACGTAC"[: 2 + i % 5] + "G" * i, "M*" if i == 3 else "MA", "c.=", str(i * 1.5), "1") for i in range(20)]
    pd.DataFrame(rows, columns=["study_id", "assay_id", "mutant_nt", "mutant_aa", "nt_edit", "experimental_score", "directionality"]).to_csv(tmp_path / "in.csv", index=False)
    (tmp_path / "in").mkdir()
    (tmp_path / "in.csv").rename(tmp_path / "in" / "x.csv")
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), evaluation.base_frequency_scorer)
    a = builds.evaluate(*args, reported={"s1": 0.1}).collect()
    files = sorted(p.name for p in (tmp_path / "out" / "predictions").glob("*.parquet"))
    assert builds.evaluate(*args, reported={"s1": 0.1}).collect() == a and sorted(p.name for p in (tmp_path / "out" / "predictions").glob("*.parquet")) == files
    import json

    meta = json.loads((tmp_path / "out" / "run_metadata.json").read_text())
    assert meta["versions"]["spark"] == spark.version
    assert meta["input_rows"] == meta["prediction_rows"] == 20 and meta["input_files"][0]["stop_variants"] == 1


def test_code_vectors_and_errors(spark):
    book = spark.createDataFrame([(0, [1.0, 2.0]), (1, [3.0, 4.0])], "code int, vector array<double>")
    got = vq.code_vectors(spark.createDataFrame([(7, 1), (8, 0)], "id int, code int"), book).orderBy("id").collect()
    assert [r.vector for r in got] == [[3.0, 4.0], [1.0, 2.0]]
    with pytest.raises(Exception, match="no such code: 5"):
        vq.code_vectors(spark.createDataFrame([(7, 5)], "id int, code int"), book).collect()
    parts = spark.createDataFrame([(0, s, 8.0, p) for s, p in enumerate((4.0, 2.0, 2.0))], "id int, scale int, t double, p double")
    assert [r.mse for r in vq.cumulative_errors(parts, ["id"], "scale", "t", "p").orderBy("scale").collect()] == [16.0, 4.0, 0.0]
    rows = spark.createDataFrame([(i, float(i)) for i in range(5)], "i long, x double")
    assert tuple(vq.batch_means(rows, "i", 2, {"x": F.col("x")}).first()) == (3, (0.5 + 2.5 + 4) / 3)
    assert tuple(vq.batch_means(rows, "i", 2, {"x": F.col("x")}, first=2).first()) == (2, 1.5)
    acc = evaluation.accuracy(spark.createDataFrame([(1, 1), (1, 0), (0, None), (None, 1)], "t int, g int"), "t", "g").first()
    assert acc.n == 3 and math.isclose(acc.accuracy, 1 / 3)


def test_large_codebooks_are_multiplied(spark, monkeypatch):
    r = np.random.default_rng(2)
    x, book = r.normal(size=(30, 8)), r.normal(size=(12, 8))
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id int, v array<double>")
    b = spark.createDataFrame([(10 * i, a.tolist()) for i, a in enumerate(book)], "code int, vector array<double>")
    small = vq.nearest_code(v, b, "id", "v").orderBy("id").collect()
    monkeypatch.setattr(vq, "MOST_LITERALS", 4)
    large = vq.nearest_code(v, b, "id", "v").orderBy("id").collect()
    assert [(r.id, r.code) for r in large] == [(r.id, r.code) for r in small] and np.allclose([r.distance for r in large], [r.distance for r in small])


def test_training_batches_and_places(spark):
    rows = spark.createDataFrame([("ACGTACGTAC",), ("ACGT" * 9,), ("TTTT",), ("GG",)], "sequence string")
    got = [corpus.training_batches(rows, 4, 2, 17, 2, k).collect() for k in (0, 1)]
    flat = ["".join("ACGT"[t] for t in w) for part in got for b in part for w in b.input_ids]
    assert all(len(b.input_ids) == 2 for part in got for b in part) and set(flat) <= {"ACGT", "TTTT"} and 10 <= len(flat) <= 12
    again = [corpus.training_batches(rows.repartition(3), 4, 2, 17, 2, k).collect() for k in (0, 1)]
    assert sorted(map(str, got[0] + got[1])) == sorted(map(str, again[0] + again[1]))
    b = spark.createDataFrame([(i, [[0]]) for i in range(4)], "batch_no long, input_ids array<array<long>>")
    assert [r.batch_no for r in corpus.first_batches(b, 2).orderBy("batch_no").collect()] == [0, 1]
    x = spark.createDataFrame([(v,) for v in (5, None, 3, 3, 90)], "v long")
    assert [(r.v, r.place) for r in corpus.with_place(x, "v").orderBy("place").collect()] == [(3, 0), (3, 1), (5, 2), (90, 3), (None, 4)]


def test_replicates_must_both_be_there(spark):
    one, two = (spark.createDataFrame(r, "k string, v double") for r in ([("a", 1.0), ("b", 2.0)], [("a", 3.0), ("b", 6.0)]))
    assert [tuple(r) for r in corpus.replicate_mean(one, two, "k", "v").orderBy("k").collect()] == [("a", 2.0), ("b", 4.0)]
    for x, y in ((one, two.limit(1)), (one.limit(1), two)):
        with pytest.raises(Exception, match="a replicate lacks"):
            corpus.replicate_mean(x, y, "k", "v").collect()


def test_late_events_are_left_out(spark, tmp_path):
    src, at = tmp_path / "src", "t timestamp, k string"
    out, cp = str(tmp_path / "out"), str(tmp_path / "cp")

    def send(*rows):
        spark.createDataFrame(rows, "t string, k string").select(F.to_timestamp("t").alias("t"), "k").coalesce(1).write.mode("append").parquet(str(src))
        df = streaming.windowed_counts(spark.readStream.schema(at).parquet(str(src)), "t", "k")
        streaming.append_to(df, out, cp).awaitTermination()

    send(("2026-01-01 00:10:00", "a"), ("2026-01-01 00:20:00", "a"), ("2026-01-01 02:30:00", "b"))
    send(("2026-01-01 00:30:00", "a"), ("2026-01-01 05:00:00", "c"))  # the first is later than the watermark
    send(("2026-01-01 09:00:00", "c"))
    got = {(str(r.window_start), r.k, r.n) for r in spark.read.parquet(out).collect()}
    assert {("2026-01-01 00:00:00", "a", 2), ("2026-01-01 02:00:00", "b", 1)} <= got and not any(k == "a" and n > 2 for _, k, n in got)


def test_codes(spark):
    r = np.random.default_rng(1)
    x, book = r.normal(size=(40, 6)), r.normal(size=(5, 6))
    book[3] = book[1]
    v = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(x)], "id int, v array<double>")
    b = spark.createDataFrame([(i, a.tolist()) for i, a in enumerate(book)], "code int, vector array<double>")
    code = ((x[:, None] - book) ** 2).sum(2).argmin(1)
    a = vq.nearest_code(v, b, "id", "v")
    assert [r.code for r in a.orderBy("id").collect()] == code.tolist()
    assert [r.code for r in vq.nearest_code_blocks(v, book, "id", "v").orderBy("id").collect()] == code.tolist()
    h = vq.code_histogram(a, 5)
    n = np.bincount(code, minlength=5)
    assert [r.n for r in h.orderBy("code").collect()] == n.tolist() and n.sum() == 40
    p = n[n > 0] / n.sum()
    assert math.isclose(vq.perplexity(h).first()[0], math.exp(-(p * np.log(p)).sum()), rel_tol=1e-9)
    assert vq.utilization(h).first().codes_used == (n > 0).sum()
    state = spark.createDataFrame([(c, d, 1.0, float(book[c, d]), False) for c in range(5) for d in range(6)], "code int, dim int, ema_count double, ema_sum double, hit boolean")
    out = vq.ema_update(state, h, vq.vector_sums(v.join(a, "id"), "v"), 0.9).collect()
    count = 0.9 + 0.1 * n
    sums = 0.9 * book + 0.1 * np.array([x[code == c].sum(0) for c in range(5)])
    smooth = (count + 1e-5) / (count.sum() + 5e-5) * count.sum()
    assert all(math.isclose(r.value, sums[r.code, r.dim] / smooth[r.code], rel_tol=1e-9) and r.hit == (n[r.code] > 0) for r in out)
    assert vq.world_decay(0.99, 2) == 1 - 0.01 / 2


def test_schedule(spark):
    got = [r[0] for r in spark.range(0, 40).select(vq.learning_rate(F.col("id"), 5, 30, 1.0, 0.1)).collect()]

    def want(s):
        return (s + 1) / 6 if s < 5 else 0.1 if s >= 30 else 0.1 + 0.5 * (1 + math.cos(math.pi * (s - 5) / 25)) * 0.9

    assert np.allclose(got, [want(s) for s in range(40)])


def test_stream(spark, tmp_path):
    src = tmp_path / "src"
    spark.createDataFrame([("a", "ACGTNACG")], "id string, sequence string").write.parquet(str(src))
    for _ in range(2):  # the second run finds nothing new
        df = streaming.chunk_stream(spark.readStream.schema("id string, sequence string").parquet(str(src)), 3)
        streaming.append_to(df, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_dna_queries_read_whole_texts(spark, tmp_path):
    import random

    import duckdb

    from helixframe.functions.dna import CODONS
    from helixframe.plans.queries import ORACLE, QUERIES

    r = random.Random(3)
    texts = ["", "a", "é b", "short text", *(" ".join(f"w{r.randint(0, 999)}" for _ in range(n)) for n in (200, 1000, 3000, 9000, 20_000))]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = lambda name: {x[0]: x for x in QUERIES[name](spark, str(tmp_path)).collect()}
    h = [t.encode().hex().upper() for t in texts]
    h = [x[: len(x) - len(x) % 3] for x in h]
    a, b = ([x.translate(str.maketrans("0123456789ABCDEF", bases)) for x in h] for bases in ("ACGT" * 4, "ACGTACGAACGTACGT"))
    aa = lambda s: "".join(CODONS[s[i : i + 3]] for i in range(0, len(s), 3))
    got = {n: out(n) for n in ("dna_translate_text", "coding_edit_text", "aa_changes_text", "revcomp_text", "replace_codon_text", "apply_substitutions_text", "hgvs_apply_text", "designed_codon_text", "tokenize_text", "model_scores_text")}
    assert len(a[-1]) == 2 * len(texts[-1]) - 2 * len(texts[-1]) % 3
    for i, (w, m) in enumerate(zip(a, b)):
        n = len(w)
        assert got["dna_translate_text"][i][1:] == (aa(w), aa(m)) and got["revcomp_text"][i].rc == w.translate(str.maketrans("ACGT", "TGCA"))[::-1]
        d = [f"{k + 1}{x}>{y}" for k, (x, y) in enumerate(zip(w, m)) if x != y]
        assert got["coding_edit_text"][i].nt_edit == ("c.=" if not d else f"c.{d[0]}" if len(d) == 1 else f"c.[{';'.join(d)}]")
        d = [f"{x}{k + 1}{y}" for k, (x, y) in enumerate(zip(aa(w), aa(m))) if x != y]
        assert got["aa_changes_text"][i].aa_change == (":".join(d) or "p.=")
        assert got["tokenize_text"][i].input_ids == ["ACGT".index(x) for x in w]
        p = [w.count(x) / n for x in "ACGT" if x in w]
        assert abs(got["model_scores_text"][i][1] - sum(x * np.log(x) for x in p)) < 1e-8
        if not n:
            continue
        k = 3 * (i % (n // 3))
        assert got["replace_codon_text"][i].edited == w[:k] + "TAG" + w[k + 3 :]
        k = n // 2
        assert got["apply_substitutions_text"][i].edited == (w[: k - 1] + "A" + w[k:])[:-1] + "T"
        assert got["hgvs_apply_text"][i].mutant_nt == [w, w[:-1] + "T", w[:-3], w + "AAA", "G" + w[1:-2] + "TAA"][i % 5]
        k = 3 * (n // 6)
        assert got["designed_codon_text"][i][1:] == (w[k : k + 3], "TTT" if w[k : k + 3] == "TTC" else "TTC")
    want = [(i, k // 8192, w[k : k + 8192]) for i, w in enumerate(a) for k in range(0, len(w), 8192)]
    assert sorted(map(tuple, QUERIES["window_split_text"](spark, str(tmp_path)).collect())) == want
    batches = [x.input_ids for x in QUERIES["token_batches_text"](spark, str(tmp_path)).orderBy("batch_no").collect()]
    assert all(len(x) <= 8 and len(set(map(len, x))) == 1 for x in batches)
    assert [["ACGT"[t] for t in x] for y in batches for x in y] == [list(w) for _, _, w in want]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("dna_translate_text", "revcomp_text", "window_split_text", "tokenize_text", "model_scores_text"):
        rows = lambda x: sorted(map(str, (tuple(y) for y in x)))
        assert rows(db.execute(ORACLE[name]).fetchall()) == rows(QUERIES[name](spark, str(tmp_path)).collect()), name


def test_equal_rows_are_each_scored(spark, tmp_path):
    """Rows that were added since, equal ones too, are the only ones that a second run scores."""
    row = ("s1", "a", "ACGT", "MA", "c.=", "1.5", "1")
    (tmp_path / "in").mkdir()

    def run(rows):
        pd.DataFrame(rows, columns=["study_id", "assay_id", "mutant_nt", "mutant_aa", "nt_edit", "experimental_score", "directionality"]).to_csv(tmp_path / "in" / "x.csv", index=False)
        return builds.evaluate(spark, str(tmp_path / "in"), str(tmp_path / "out"), evaluation.base_frequency_scorer, reported={"s1": 0.1}).filter("study_id = 's1'").first().num_variants

    assert run([row, row]) == 2 and run([row, row, row]) == 3
    assert spark.read.parquet(str(tmp_path / "out" / "predictions")).count() == 3


def test_evaluate_on_the_command_line(spark, tmp_path, monkeypatch):
    import helixframe.__main__ as cli

    (tmp_path / "in").mkdir()
    names = ["study_id", "assay_id", "mutant_nt", "mutant_aa", "nt_edit", "experimental_score", "directionality"]
    pd.DataFrame([("weeks_2023", "a", "ACGT"[: i + 1], "M", "c.=", str(i), "1") for i in range(4)], columns=names).to_csv(tmp_path / "in" / "x.csv", index=False)
    cli.main(["evaluate", str(tmp_path / "in"), "--output", str(tmp_path / "out"), "--scorer", "helixframe.operators.evaluation:base_frequency_scorer"])
    assert '"weeks_2023"' not in (tmp_path / "out" / "run_metadata.json").read_text() and "base_frequency_scorer" in (tmp_path / "out" / "run_metadata.json").read_text()


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 1000, 4097])
def test_permutations_are_bijections(spark, n):
    got = [spark.range(n).select(corpus.permuted(F.col("id"), n, seed).alias("p")).toPandas().p.tolist() for seed in (1, 2)]
    assert sorted(got[0]) == sorted(got[1]) == list(range(n))
    if n > 50:
        assert got[0] != got[1] and abs(np.corrcoef(got[0], range(n))[0, 1]) < 0.3


def test_batches_of_equal_windows(spark, tmp_path):
    """Nine of ten windows are the same text: ranks are disjoint, exhaustive and equally large, and no window is by text."""
    texts = ["A" * 4 * 9 + "".join("ACGT"[(i >> k) & 3] for k in (0, 2, 4, 6)) for i in range(100)] + ["ACG", None, ""]
    spark.createDataFrame([(t,) for t in texts], "sequence string").repartition(5).write.parquet(str(tmp_path / "s"))
    df = spark.read.parquet(str(tmp_path / "s"))
    ranks = [corpus.training_batches(df, 4, 10, 7, 3, r).collect() for r in range(3)]
    assert [sorted(b.batch_no for b in rank) for rank in ranks] == [list(range(33))] * 3
    assert all(len(b.input_ids) == 10 for rank in ranks for b in rank)
    seen = sorted("".join("ACGT"[i] for i in w) for rank in ranks for b in rank for w in b.input_ids)
    every = sorted(t[i : i + 4] for t in texts if t for i in range(0, len(t) - 3, 4))
    assert len(seen) == 990 and len(every) == 1000
    from collections import Counter

    assert not Counter(seen) - Counter(every)
    again = corpus.training_batches(df, 4, 10, 7, 3, 1).collect()
    assert sorted(map(str, again)) == sorted(map(str, ranks[1]))


def test_places_of_a_frequent_value(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 2 == 0, 5).when(F.col("id") % 101 == 1, F.lit(None)).otherwise(F.col("id")).alias("v"), "id")
    got = corpus.with_place(df, "v").collect()
    assert sorted(r.place for r in got) == list(range(10_000))
    values = [r.v for r in sorted(got, key=lambda r: r.place)]
    assert [v for v in values if v is not None] == sorted(v for v in values if v is not None) and values[-99:] == [None] * 99 if values.count(None) == 99 else values[-1] is None


def test_residuals_fall(spark):
    r = np.random.default_rng(1)
    x = r.normal(size=(40, 8, 3))
    books = []
    left = x.copy()
    for bins in (1, 2, 8):
        pool = left.reshape(40, bins, 8 // bins, 3).mean(2).reshape(-1, 3)
        centres = pool[:6]
        for _ in range(5):
            near = ((pool[:, None] - centres[None]) ** 2).sum(2).argmin(1)
            centres = np.array([pool[near == k].mean(0) if (near == k).any() else centres[k] for k in range(6)])
        books.append((bins, centres.tolist()))
        left = left if bins == 8 else left - np.repeat(centres[near].reshape(40, bins, 3), 8 // bins, 1)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, v array<array<double>>")
    codes = vq.residual_codes(df, "id", "v", 8, books)
    mse = {q.scale: q.m for q in codes.groupBy("scale").agg(F.avg("mse").alias("m")).collect()}
    assert (x**2).mean() > mse[0] > mse[1] > mse[2] and mse[2] < 0.7 * mse[0]
    last = {q.id: np.array(q.values_) for q in vq.decoded(codes, "id", 8, books).filter("scale = 2").withColumnRenamed("values", "values_").collect()}
    error = {q.id: q.mse for q in codes.filter("scale = 2").collect()}
    assert all(abs(((x[i] - last[i]) ** 2).mean() - error[i]) < 1e-9 for i in range(40))


def test_a_stream_that_is_killed_ends_in_the_same_codebook(spark, tmp_path):
    from helixframe.sources import sinks
    from helixframe.streaming import codebooks

    r = np.random.default_rng(4)
    batches = [r.normal(size=(12, 3)) for _ in range(4)]
    first = spark.createDataFrame([(c, d, 1.0, float(v), float(v), False) for c, vec in enumerate(batches[0][:3]) for d, v in enumerate(vec)], "code int, dim int, ema_count double, ema_sum double, value double, hit boolean")
    state = first
    for k, b in enumerate(batches):
        one = spark.createDataFrame([(100 * k + i, v.tolist()) for i, v in enumerate(b)], "id long, v array<double>")
        one.coalesce(1).write.parquet(str(tmp_path / f"part{k}"))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / f"part{k}").glob("*.parquet")).rename(tmp_path / "in" / f"{k}.parquet")
        sinks.write_state(codebooks.stepped(state, one, "id", "v", 0.9), str(tmp_path / "plain"), k)
        state = sinks.read_step(spark, str(tmp_path / "plain"), k)
        os.utime(tmp_path / "in" / f"{k}.parquet", (1_700_000_000 + k, 1_700_000_000 + k))
    stream = lambda: spark.readStream.schema("id long, v array<double>").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))

    def killed(batch_id):
        if batch_id == 1:
            raise RuntimeError("killed")

    run = lambda after=None: codebooks.follow(stream(), first, str(tmp_path / "state"), str(tmp_path / "check"), "id", "v", 0.9, after)
    with pytest.raises(Exception, match="killed"):
        run(killed).awaitTermination()
    assert sinks.last_step(spark, str(tmp_path / "state")) == 2  # the state stands, the batch doesn't count as done
    (tmp_path / "state" / ".step-000000003.incomplete").mkdir()
    run().awaitTermination()
    step, got = sinks.read_state(spark, str(tmp_path / "state"))
    assert step == 4
    key = lambda df: sorted((x.code, x.dim, round(x.ema_count, 9), round(x.ema_sum, 9), round(x.value, 9), x.hit) for x in df.collect())
    assert key(got) == key(state)


def test_archives_that_arrive(spark, tmp_path):
    import gzip

    from helixframe.streaming import folders
    from tests.test_sources import tar

    (tmp_path / "in").mkdir()
    def arrive(i, mode="w:gz"):
        tar(tmp_path / f"x{i}", {f"d/GCA_00{i}{k}.1_genomic.fna.gz": gzip.compress(f">r\n{'ACGTN' * (i + k + 1)}\n".encode()) for k in range(3)}, mode)
        (tmp_path / f"x{i}").rename(tmp_path / "in" / f"a{9 - i}.tar{'.gz' if mode == 'w:gz' else ''}")

    def run(most=None):
        members = folders.arriving(spark, str(tmp_path / "in"), str(tmp_path / "log" / "archives.json"), "*.fna.gz", most)
        streaming.append_to(corpus.member_chunks(members, 3), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    arrive(1)
    arrive(2, "w")
    (tmp_path / "in" / ".hidden.tar").write_bytes(b"x")
    run()
    once = spark.read.parquet(str(tmp_path / "out")).count()
    run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == once > 0
    arrive(3)
    arrive(4)
    run(1)  # one batch of one archive; the other comes with the next run
    run()
    batch = corpus.member_chunks(archives.load(spark, "member_bytes", sorted(str(p) for p in (tmp_path / "in").glob("a*")), member="*.fna.gz"), 3)
    rows = lambda df: sorted(map(str, df.select("archive_path", "record_id", "chunk_start", "sequence").collect()))
    assert rows(spark.read.parquet(str(tmp_path / "out"))) == rows(batch)
