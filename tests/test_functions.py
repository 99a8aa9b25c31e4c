import random

import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from helixframe.functions import dna, hgvs, scores


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def lit(*xs):
    return [F.lit(x) for x in xs]


@pytest.mark.parametrize(
    "column, expected",
    [
        (lambda: dna.replace_codon(*lit("ATGGCT"), F.lit(2), F.lit("taa")), "ATGTAA"),
        (lambda: dna.translate_dna(F.lit("ATGTAA")), "M*"),
        (lambda: dna.translate_dna(F.lit("")), ""),
        (lambda: dna.describe_coding_edit(*lit("ATGGCT", "ATGGCC")), "c.6T>C"),
        (lambda: dna.describe_coding_edit(*lit("ATGGCT", "ATGTCG")), "c.[4G>T;6T>G]"),
        (lambda: dna.describe_coding_edit(*lit("ATGGCT", "CAAATAGTTAAA")), "insertion"),
        (lambda: dna.describe_coding_edit(*lit("ATGGCT", "ATG")), "deletion"),
        (lambda: dna.describe_coding_edit(*lit("ATGGCT", "atggct")), "c.="),
        (lambda: dna.describe_residue_changes(*lit("MA", "IV")), "M1I:A2V"),
        (lambda: dna.describe_residue_changes(*lit("MA", "MA")), "p.="),
        (lambda: dna.describe_residue_changes(*lit("MA", "QIVK")), "insertion"),
        (lambda: dna.apply_substitutions(*lit("ATGGCT", "A1G_T6C")), "GTGGCC"),
        (lambda: hgvs.apply_edit(*lit("ATGGCT", "c.=")), "ATGGCT"),
        (lambda: hgvs.apply_edit(*lit("ATGGCT", "c.4G>T")), "ATGTCT"),
        (lambda: hgvs.apply_edit(*lit("ATGGCT", "c.[4G>T;6T>C]")), "ATGTCC"),
        (lambda: hgvs.apply_edit(*lit("ATGGCT", "c.3_4insAAA")), "ATGAAAGCT"),
        (lambda: hgvs.apply_edit(*lit("ATGAAAGCT", "c.4_6del")), "ATGGCT"),
        (lambda: hgvs.apply_edit(*lit("ATGGCT", "c.4_6delinsTAA")), "ATGTAA"),
        (lambda: hgvs.mutant_codon(*lit("AAAATTCCC", "AAATATCCC", "ATT", "Y")), "TAT"),
        (lambda: hgvs.mutant_codon(dna.reverse_complement(F.lit("AAACTGCCC")), dna.reverse_complement(F.lit("AAATTCCCC")), *lit("CTG", "F")), "TTC"),
        (lambda: dna.tokens(F.lit("ACGT")), [0, 1, 2, 3]),
        (lambda: dna.ascii_upper(F.lit("aßé")), "Aßé"),
        (lambda: scores.seed_from_hash(F.lit("f" * 64)).cast("string"), str(2**64 - 1)),
        (lambda: scores.gtdb_accession(scores.ncbi_accession(F.lit("x/GCF_1.1_genomic.fna.gz"))), "RS_GCF_1.1"),
        (lambda: scores.gtdb_accession(scores.ncbi_accession(F.lit("GCA_1.1_genomic.fna.gz"))), "GB_GCA_1.1"),
    ],
)
def test_value(spark, column, expected):
    assert one(spark, column()) == expected


@pytest.mark.parametrize(
    "column",
    [
        lambda: dna.translate_dna(F.lit("ATGA")),
        lambda: dna.translate_dna(F.lit("ATGNNN")),
        lambda: dna.replace_codon(F.lit("ATG"), F.lit(2), F.lit("AAA")),
        lambda: dna.tokens(F.lit("acgt")),
        lambda: dna.apply_substitutions(*lit("ATGGCT", "C1G")),
        lambda: hgvs.apply_edit(*lit("ATGGCT", "c.4dup")),
        lambda: hgvs.mutant_codon(*lit("AAAATTCCC", "AAAATTCCC", "ATT", "I")),
        lambda: scores.ncbi_accession(F.lit("x.fa")),
        lambda: scores.gtdb_accession(F.lit("XYZ_1")),
    ],
)
def test_failure(spark, column):
    with pytest.raises(Exception):
        one(spark, column())


def test_nulls(spark):
    n = F.lit(None).cast("string")
    for c in (dna.translate_dna(n), dna.describe_coding_edit(n, F.lit("A")), dna.tokens(n), dna.reverse_complement(n), hgvs.apply_edit(F.lit("ATG"), n), dna.segments(n)):
        assert one(spark, c) is None


def test_describe_and_apply_agree(spark):
    r = random.Random(2)
    rows = []
    for _ in range(200):
        wt = [r.choice("ACGT") for _ in range(30)]
        mutant = [r.choice("ACGT") if r.random() < 0.2 else b for b in wt]
        rows.append(("".join(wt), "".join(mutant)))
    df = spark.createDataFrame(rows, "wt string, mutant string")
    back = df.select("mutant", hgvs.apply_edit(F.col("wt"), dna.describe_coding_edit(F.col("wt"), F.col("mutant"))).alias("got"), dna.reverse_complement(dna.reverse_complement(F.col("wt"))).alias("same"), "wt").collect()
    assert all(x.mutant == x.got and x.wt == x.same for x in back)


def test_long_tiles(spark):
    """Differences of long tiles are found without an array of their characters, in both orientations."""
    n = 3_000_000
    wt = F.concat(F.repeat(F.lit("ACG"), n), F.lit("CTG"), F.repeat(F.lit("CAT"), n))
    mutant = F.concat(F.repeat(F.lit("ACG"), n), F.lit("TTC"), F.repeat(F.lit("CAT"), n))
    rows = spark.range(2).select(F.when(F.col("id") == 1, dna.reverse_complement(wt)).otherwise(wt).alias("w"), F.when(F.col("id") == 1, dna.reverse_complement(mutant)).otherwise(mutant).alias("m"))
    out = rows.select(hgvs.mutant_codon(F.col("w"), F.col("m"), *lit("CTG", "F")).alias("c"))
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.c for r in out.collect()] == ["TTC", "TTC"]


@pytest.mark.parametrize("query, value", [("area_pool", "pooled"), ("layer_norm", "norm")])
def test_rounding_equals_sqls(spark, tmp_path, query, value):
    """Bit by bit: halves, numbers that are rounded to zero from below, zeros."""
    import duckdb

    from helixframe.plans.queries import ORACLE, QUERIES

    r = random.Random(9)
    rows = [(i, [r.choice([-1e-7, 1e-7, -0.0, 0.5, -0.5, 2.5e-6, -2.5e-6, 1.5e-6, r.gauss(0, 1), r.gauss(0, 1e-6)]) if i % 2 else r.gauss(0, 0.1) for _ in range(64)]) for i in range(2000)]
    rows += [(2000 + i, [x] * 64) for i, x in enumerate([-1e-7, -0.0, 0.0, 5e-7, -5e-7])]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
    bits = lambda v: [float(x).hex() for x in v]
    want = {i: bits(v) for i, v in db.execute(ORACLE[query]).fetchall()}
    got = {x.vec_id: bits(x[value]) for x in QUERIES[query](spark, str(tmp_path)).collect()}
    assert got.keys() == want.keys() and not [(i, got[i], want[i]) for i in want if got[i] != want[i]][:1]


def test_variance_equals_sqls(spark):
    """Bit by bit; deviations from the mean, squared, give other last bits."""
    import duckdb

    from helixframe.operators import vq

    r = random.Random(4)
    rows = [[r.gauss(0.3, 0.1) for _ in range(64)] for _ in range(300)]
    got = [x.v for x in spark.createDataFrame([(x,) for x in rows], "x array<double>").select(vq.variance(F.col("x")).alias("v")).collect()]
    assert got == [duckdb.execute("SELECT list_var_pop($1::DOUBLE[])", [x]).fetchone()[0] for x in rows]


def test_long_sequences_are_translated_without_arrays(spark):
    """Codons of long sequences don't become an array each; rows of all kinds may share a batch."""
    rows = [(i, s) for i, s in enumerate(["", None, "atgTAA", "GGG" * 100_000, "TTT", "ACG" * 7])]
    out = spark.createDataFrame(rows, "i int, s string").select("i", dna.translate_dna(F.col("s")).alias("aa"))
    assert "regexp_extract_all" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert {x.i: x.aa for x in out.coalesce(1).collect()} == {0: "", 1: None, 2: "M*", 3: "G" * 100_000, 4: "F", 5: "T" * 7}
    for bad in ("ATGé", "ATGAN", "ATNATG"):
        with pytest.raises(Exception):
            spark.createDataFrame([("ATG",), (bad,), ("TTT",)], "s string").coalesce(1).select(dna.translate_dna(F.col("s")).alias("aa")).collect()


def test_long_differences_without_arrays(spark):
    """Texts of all kinds in one batch; no array of their characters is made."""
    r = random.Random(8)
    pairs = [("", ""), (None, "A"), ("A", None), ("ACG", "AC"), ("é", "AC"), ("aéc", "aéG"), ("日本T", "日T本"), ("acgt", "ACGT"), ("A" * 200_000, "A" * 199_999 + "C")]
    pairs += [("".join(r.choices("ACGTacgt", k=50)), "".join(r.choices("ACGT", k=50))) for _ in range(50)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").coalesce(1)
    out = df.select("i", dna.describe_coding_edit(F.col("a"), F.col("b")).alias("nt"), dna.describe_residue_changes(F.col("a"), F.col("b")).alias("aa"))
    assert "split(" not in out._jdf.queryExecution().optimizedPlan().toString()
    upper = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    for x in out.collect():
        a, b = pairs[x.i]
        if a is None or b is None:
            assert x.nt is None and x.aa is None
        elif len(a) != len(b):
            assert x.nt == x.aa == ("insertion" if len(b) > len(a) else "deletion")
        else:
            d = [f"{k}{u}>{v}" for k, (u, v) in enumerate(zip(a.translate(upper), b.translate(upper)), 1) if u != v]
            assert x.nt == ("c.=" if not d else f"c.{d[0]}" if len(d) == 1 else f"c.[{';'.join(d)}]")
            assert x.aa == (":".join(f"{u}{k}{v}" for k, (u, v) in enumerate(zip(a, b), 1) if u != v) or "p.=")


def test_scorers_see_bounded_batches(spark):
    """A batch holds about 4 MB, however many rows a task has and whatever else ran before in the session."""
    from helixframe.functions.batches import BATCH
    from helixframe.operators import evaluation

    before = {k: spark.conf.get(k) for k in BATCH if k in spark.conf.getAll}
    for k in BATCH:
        spark.conf.unset(k)
    try:
        rows = spark.range(4000, numPartitions=1).select("id", F.repeat(F.lit("ACGT"), 2500).alias("s"))
        rows = evaluation.scored(rows, "s", lambda: lambda sequences: [float(len(sequences))] * len(sequences), batch=1 << 20, name="n")
        assert max(x.n for x in rows.select("n").collect()) <= 500
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_batches_shuffle_text(spark):
    """Ids, eight bytes a base, are made behind the shuffle."""
    from helixframe.operators import corpus

    rows = spark.createDataFrame([(i, "ACGT"[i % 4] * 3) for i in range(20)], "place long, window string")
    out = corpus.token_batches(rows, 8, "place")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.rindex("regexp_extract_all") < plan.index("Aggregate")
    assert [x.input_ids for x in out.orderBy("batch_no").collect()] == [[[i % 4] * 3 for i in range(k, min(k + 8, 20))] for k in (0, 8, 16)]
    for bad in (["ACG", "AC"], ["ACG", "acg"]):
        with pytest.raises(Exception):
            corpus.token_batches(spark.createDataFrame(list(enumerate(bad)), "place long, window string"), 8, "place").collect()


@settings(max_examples=15, deadline=None)
@given(st.lists(st.text("ACGTNacgtnß", max_size=60), min_size=1, max_size=20))
def test_segments(spark, texts):
    import re

    table = str.maketrans("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r["i"]: [(x["start"], x["sequence"]) for x in r["s"]] for r in df.select("i", dna.segments(dna.ascii_upper(F.col("t"))).alias("s")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == [(m.start(), m[0]) for m in re.finditer("[ACGT]+", t.translate(table))]


def test_long_sequence_starts(spark):
    got = one(spark, dna.running_starts(F.sequence(F.lit(1).cast("long"), F.lit(1000).cast("long"))))
    assert got == [i * (i + 1) // 2 for i in range(1000)]


def test_python_numbers(spark):
    x = [1.00005, 2.675, 0.00005, 1e7, None]
    rows = spark.createDataFrame([(v,) for v in x], "v double").select(scores.python_round(F.col("v"), 4).alias("r"), scores.python_text(F.col("v")).alias("t")).collect()
    assert [r["r"] for r in rows] == [None if v is None else round(v, 4) for v in x]
    assert [r["t"] for r in rows] == [None if v is None else str(v) for v in x]


@pytest.mark.parametrize("digits", [0, 1, 3, 6, 12])
def test_rounding_equals_pythons(spark, digits):
    """A million doubles of all sizes, halves and what is next to them: equal to round(), bit by bit, without Python in the plan."""
    import numpy as np

    r = np.random.default_rng(digits)
    near = r.integers(-(10**6), 10**6, 20_000) / 10**digits + r.choice([0.5, -0.5], 20_000) / 10**digits
    some = [r.integers(0, 1 << 63, 100_000, dtype=np.uint64).view("float64") * r.choice([1, -1], 100_000), r.normal(size=50_000) * 10.0 ** r.integers(-8, 20, 50_000), near, np.nextafter(near, 0), np.nextafter(near, np.inf), np.arange(-4000, 4000) / 8]
    x = np.concatenate([*some, [0.0, -0.0, np.inf, -np.inf, 2.675, 0.5, 1.5, 2.5, 2.0**52 + 1, 2.0**51 + 0.5, 5e-324]])
    x = x[~np.isnan(x)]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(8)
    out = df.select("x", scores.python_round(F.col("x"), digits).alias("y"))
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString().replace("LocalTableScan", "")
    got = out.toPandas()
    want = np.array([round(float(v), digits) if np.isfinite(v) else v for v in got.x])
    bad = np.flatnonzero(got.y.to_numpy().view("int64") != want.view("int64"))
    assert not len(bad), [(got.x[i], got.y[i], want[i]) for i in bad[:5]]
    assert out.limit(0).count() == 0 and spark.range(1).select(scores.python_round(F.lit(None).cast("double"), digits).alias("y")).first().y is None
