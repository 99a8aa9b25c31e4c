import gzip
import io
import json
import tarfile
import zipfile

import pytest
from pyspark.sql import functions as F
from tests import xlsx

from helixframe.plans import builds, studies
from helixframe.sources import archives, sinks


def tar(path, members, mode="w:gz"):
    with tarfile.open(path, mode) as t:
        for name, data in members.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def test_fasta_records():
    lines = ["junk", ">a first", "AC", "", " gt ", ">b", ">c x", "T"]
    assert list(archives.fasta_records(lines)) == [("a", "ACgt"), ("b", ""), ("c", "T")]
    with pytest.raises(ValueError):
        list(archives.fasta_records([">"]))


def test_corpus_build(spark, tmp_path):
    g = {f"db/GC{k}_00000{i}.1_genomic.fna.gz": gzip.compress(f">r1 x\nACGTN{'ACGT' * i}\n>r2\nnnn\n".encode()) for i, k in enumerate("FAF", 1)}
    tar(tmp_path / "g.tar.gz", {"readme.txt": b"x", **g})
    stats = builds.build_corpus(spark, [str(tmp_path / "g.tar.gz")], str(tmp_path / "out"), length=3)
    assert (stats["genomes_processed"], stats["fasta_records_processed"], stats["input_bases"], stats["retained_bases"]) == (3, 6, 15 + 24 + 9, 12 + 24)
    rows = archives.chunk_shards(spark, str(tmp_path / "out")).orderBy("chunk_id").collect()
    assert len(rows) == stats["chunks"] and rows[0].chunk_id.startswith("GB_GCA_000002.1|r1|") and {r.gtdb_accession[:3] for r in rows} == {"RS_", "GB_"}
    assert json.loads((tmp_path / "out" / "processing_stats.json").read_text()) == stats
    few = archives.first_genomes(archives.load(spark, "fasta_tar", str(tmp_path / "g.tar.gz")), 2)
    assert few.select("archive_path").distinct().count() == 2
    with pytest.raises(FileExistsError):
        builds.build_corpus(spark, [str(tmp_path / "g.tar.gz")], str(tmp_path / "out"))


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    def write(folder):
        spark.range(3).write.parquet(f"{folder}/x")
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        sinks.publish(spark, str(tmp_path / "out"), write)
    assert not [p for p in tmp_path.iterdir() if not p.name.endswith(".crc")]


def test_worksheet(spark, tmp_path):
    xlsx.write(tmp_path / "b.xlsx", {"One": [["h1", "h2"], ["x", 1], [None, 2.5], [None, None, "far"]], "Two": [["in & line", 3]]})
    rows = archives.load(spark, "worksheet", str(tmp_path / "b.xlsx"), sheet="One", min_row=2).orderBy("row_no").collect()
    assert [(r.row_no, r.cells, r.is_number) for r in rows] == [(0, ["x", "1"], [False, True]), (1, [None, "2.5"], [False, True]), (2, [None, None, "far"], [False, False, False])]
    assert archives.load(spark, "worksheet", str(tmp_path / "b.xlsx"), sheet="Two", max_col=1).first().cells == ["in & line"]
    assert archives.named(archives.load(spark, "worksheet", str(tmp_path / "b.xlsx"), sheet="One")).orderBy("row_no").first().h2 == "1"
    with pytest.raises(Exception):
        archives.load(spark, "worksheet", str(tmp_path / "b.xlsx"), sheet="Three").count()


def test_reference_fasta(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">target one\nATG\ngct\n>b\nAA\n>b\nCC\n")
    got = {r.record_id: r.sequence for r in archives.reference_fasta(spark, str(tmp_path / "x.fa")).collect()}
    assert got == {"target one": "ATGGCT", "b": "CC"}


def test_taxonomy(spark, tmp_path):
    line = lambda a, g: f"{a}\td__B;p__P;c__C;o__O;f__F;g__{g};s__S s\n"
    for i, text in enumerate((line("A", "old") + line("A", "mid") + line("B", "b"), line("A", "new"))):
        (tmp_path / f"{i}.gz").write_bytes(gzip.compress(text.encode()))
    got = archives.taxonomy(spark, [str(tmp_path / "0.gz"), str(tmp_path / "1.gz")])
    assert {r.gtdb_accession: r.genus for r in got.collect()} == {"A": "new", "B": "b"}
    (tmp_path / "2.gz").write_bytes(gzip.compress(b"C\td__B;x__P\n"))
    with pytest.raises(Exception):
        archives.taxonomy(spark, [str(tmp_path / "2.gz")]).collect()


def rows(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


WT = "ATGGCTTGGTAA"  # MAW*
MAIN = ("mutant_nt", "nt_edit", "aa_change", "experimental_score")


def test_adkar_and_jacquier(spark, tmp_path):
    (tmp_path / "evo1_adkar_wt.fasta").write_text(f">x\n{WT}\n>y\nAAA\n")
    sheet = [["title"], ["Mutant", "RankScore"], ["A002K=AAA", 3], ["W003*=TGA", 2.5]]
    xlsx.write(tmp_path / "Adkar_2012_CcdB_original_results_mmc2.xlsx", {"bh01_with_RankScore": sheet})
    df = studies.adkar(spark, str(tmp_path))
    assert rows(df, *MAIN, "directionality") == sorted([("ATGAAATGGTAA", "c.[4G>A;5C>A;6T>A]", "A2K", "3", -1), ("ATGGCTTGATAA", "c.9G>A", "W3*", "2.5", -1)])
    assert df.columns == sinks.VARIANT_COLUMNS
    xlsx.write(tmp_path / "Adkar_2012_CcdB_original_results_mmc2.xlsx", {"bh01_with_RankScore": [*sheet, ["G002K=AAA", 3]]})
    with pytest.raises(Exception, match="G002K"):
        studies.adkar(spark, str(tmp_path)).collect()
    (tmp_path / "J01749.1_TEM-1_CDS.fasta").write_text(f">x\n{WT}\n")
    xlsx.write(tmp_path / "1215206110_sd01.xlsx", {"TEM-1 DB": [["Mutant_nt", "Residue", "Mutant_AA", "Mutation", "MIC_Score"], ["G4T_T6A", 2, "S", "A2S", 12.5]]})
    assert rows(studies.jacquier(spark, str(tmp_path)), *MAIN) == [("ATGTCATGGTAA", "c.[4G>T;6T>A]", "A2S", "12.5")]


def test_chen_and_firnberg(spark, tmp_path):
    head = ["codon position (G2 stands for Glycine 2 from the inhouse sequence)", "wt codon", "variant codon", "fitness score"]
    xlsx.write(tmp_path / "elife-56707-supp2-v2.xlsx", {"SF2D Codon Fitness scores": [["t"], head, [1, "atg", "AAA", 0.5], ["G2", "GGT", "ggc", -1], [2, "TGG", "TGG", 0], [2, "TGG", "TGA", None], [None, None, None, 4]]})
    assert rows(studies.chen(spark, str(tmp_path)), *MAIN) == sorted([("AAAGGTTGG", "c.[1A>T;2T>A]".replace("1A>T;2T>A", "2T>A;3G>A"), "M1K", "0.5"), ("ATGGGCTGG", "c.6T>C", "G2G", "-1"), ("ATGGGTTGG", "c.=", "W3W", "0")])
    pad = [None] * 17
    sheet = [["a"], ["b"], ["M1", "ATG", "AAA", *pad, 0.123456], ["M1", "ATG", "ATG", *pad, 1], ["A2", "GCT", "gcc", *pad, 2.00005], ["A2", "GCT", "TTT", *pad, None]]
    xlsx.write(tmp_path / "supp_msu081_Data_S1-S4.xlsx", {"S1 Codon fitnesses": sheet})
    assert rows(studies.firnberg(spark, str(tmp_path)), *MAIN) == sorted([("AAAGCT", "c.[2T>A;3G>A]", "M1K", "0.1235"), ("ATGGCC", "c.6T>C", "A2A", str(round(2.00005, 4)))])
    xlsx.write(tmp_path / "supp_msu081_Data_S1-S4.xlsx", {"S1 Codon fitnesses": [*sheet, ["A2", "GCA", "TTT", *pad, 1]]})
    with pytest.raises(Exception, match="Inconsistent"):
        studies.firnberg(spark, str(tmp_path)).collect()


def test_kelsic(spark, tmp_path):
    (tmp_path / "NIHMS836960-supplement-1.csv").write_text("pos, codon, is_wt, fitness_rich\n1, AAA, 0, 9\n1, ATG, 1, 1\n2, GCT, 1, 1\n2, gcc, 0, 0.00005\n")
    (tmp_path / "NIHMS836960-supplement-2.csv").write_text("pos1, codon1, pos2, codon2, fitness_rich\n1, TTT, 2, TTT, 5\n1, ATG, 2, GCC, 7\n1, TTT, 2, GCC, 1e7\n")
    assert rows(studies.kelsic(spark, str(tmp_path)), *MAIN) == sorted([("ATGGCC", "c.6T>C", "p.=", "5e-05"), ("TTTGCC", "c.[1A>T;3G>T;6T>C]", "M1F", "10000000.0")])


def test_melnikov(spark, tmp_path):
    book = {"Primers_etc": [["x"], ["KKA2_KLEPN_opt", None, WT]], "OLS_A": [[None]] * 5 + [["KKA2_KLEPN_A1_1_wt", "CCATGGCTTGG"], ["KKA2_KLEPN_A1_2_F", "CCATGTTCTGG"], ["other", "A"]], "OLS_B": [[None]] * 5 + [["KKA2_KLEPN_B1_1_wt", "CCAAGCCAT"], ["KKA2_KLEPN_B1_2_K", "CCATTTCAT"]]}
    xlsx.write(tmp_path / "supp_gku511_nar-01049-met-h-2014-File006.xlsx", book)

    def matrix(a, b):
        return f"title\npos\t1\t2\nwt\tM\tA\nDelta-F\t0\t{a}\nDelta-K\t1\t{b}\nMean\t0\t0\n"

    with zipfile.ZipFile(tmp_path / "supp_gku511_nar-01049-met-h-2014-File007.zip", "w") as z:
        for s, m in (("S1", matrix(1, 2)), ("S3", matrix(2, 4)), ("S2", matrix(90, 90))):
            z.writestr(f"Supplementary Data 2 - Unpacked/KKA2_{s}_Kan18_L1.aadiff.txt", m)
    assert rows(studies.melnikov(spark, str(tmp_path)), "mutant_nt", "aa_change", "experimental_score") == sorted([("ATGTTCTGGTAA", "A2F", "1.5"), ("ATGAAATGGTAA", "A2K", "3.0")])


def test_rockah_shmuel(spark, tmp_path):
    wt = ["ATG", "GCT"] + ["AAA"] * 329 + ["TAG"]
    xlsx.write(tmp_path / "pcbi.1004421.s002.xlsx", {"raw G0": [["a"], ["b"], [-1, "x", "CCC"], *([i, "x", c.lower()] for i, c in enumerate(wt)), ["end", None, "GGG"], [332, "x", "GGG"]]})
    codons = ["ATA", "GCC", "GCA", "GAT"]
    book = {"# of nt exchanges": [["pos", "aa", "wt", *codons], ["note"], [0, "M", "ATG", 1, 3, 3, 3], [1, "A", "GCT", 3, 1, 1, 1], [None, "x"]]}
    for s, x in (("Single nt nonSyn", [["M0I", 0.5], ["A1D", 0.25]]), ("Syn", [["A1", 1.5], [None, 3]]), ("nonSense", [["A1*", None]])):
        book[s] = [["Mutation", "Wrel G17"], *x]
    xlsx.write(tmp_path / "pcbi.1004421.s003.xlsx", book)
    got = rows(studies.rockah_shmuel(spark, str(tmp_path)), "nt_edit", "aa_change", "experimental_score")
    assert got == sorted([("c.3G>A", "M1I", "0.5"), ("c.5C>A", "A2D", "0.25"), ("c.6T>C", "A2A", "1.5"), ("c.6T>A", "A2A", "1.5")])


def test_tsuboyama_and_weeks(spark, tmp_path):
    (tmp_path / "evo1_tsuboyama_wt.fasta").write_text(f">1AOY.pdb\n{WT}\n>2LCL.pdb\n{WT}\n")
    with zipfile.ZipFile(tmp_path / "Processed_K50_dG_datasets.zip", "w") as z:
        z.writestr("Processed_K50_dG_datasets/Tsuboyama2023_Dataset1_20230416.csv", f"name,dna_seq,deltaG\n1AOY.pdb,{WT},1\n1AOY.pdb_M1K,aaaGCTTGGTAA,1.50\n2LCL.pdb_x,ATGGCT,\n2LCL.pdb_ins,ATGGCTTGGTGGTAA,2\nXXXX.pdb_A,{WT},3\n")
    got = rows(studies.tsuboyama(spark, str(tmp_path)), "assay_id", "nt_edit", "aa_change", "experimental_score")
    assert got == sorted([("ARGR_ECOLI_Tsuboyama_2023_1AOY", "c.[2T>A;3G>A]", "M1K", "1.50"), ("RFAH_ECOLI_Tsuboyama_2023_2LCL", "insertion", "insertion", "2")])
    (tmp_path / "Supplementary Data S8.csv").write_text("a,b,c,d,M,A\nx,,,,,\nr,ATG,Functional Score,Weighted Mean,,1\nr,GCT,Functional Score,Weighted Mean,1,\nr,GCC,Functional Score,Weighted Mean,1,2\nr,GCA,Other,Weighted Mean,1,\n")
    xlsx.write(tmp_path / "Supplementary Data S1.xlsx", {"Fitness (weighted mean)": [["t"], [None, None, 1, 2, None], ["K", "AAA", 0.1234567891234, "n/a"], ["A", "GCC", None, -2], ["Min", "Min", 9, 9]]})
    got = rows(studies.weeks(spark, str(tmp_path)), *MAIN)
    assert got == sorted([("AAAGCTTGA", "c.[2T>A;3G>A]", "M1K", str(round(0.1234567891234, 9))), ("ATGGCCTGA", "c.6T>C", "p.=", "-2.0")])


def test_ncrna(spark, tmp_path):
    tar(tmp_path / "a.tar.gz", {f"arvind_dms/processed_dms_nt_{s}.tsv": b"wt_seq_nt\tmt_seq_nt\tfitness\nACGT\tATGT\t0.5\n" for s in studies.NCRNA} | {"arvind_dms/processed_dms_nt_other_1999.tsv": b"wt_seq_nt\tmt_seq_nt\tfitness\nA\tC\t1\n"})
    df = studies.ncrna(spark, str(tmp_path / "a.tar.gz"))
    got = df.collect()
    assert df.columns == sinks.NCRNA_COLUMNS and len(got) == 7 and {(r.nt_edit, r.experimental_score) for r in got} == {("c.2C>T", "0.5")}
    counts = sinks.write_by_assay(df, str(tmp_path / "out"), sinks.NCRNA_COLUMNS)
    assert counts == dict.fromkeys(studies.NCRNA, 1)


def test_mavedb(spark, tmp_path):
    def gene(organism, seq="atggct"):
        return [{"name": "G", "targetSequence": seq and {"sequence": seq, "taxonomy": {"organismName": organism}}}]

    k12 = "Escherichia coli K-12"
    sets = [{"urn": "urn:b", "metaAnalyzesScoreSetUrns": ["x"], "targetGenes": gene(k12)}, {"urn": "urn:a", "metaAnalyzesScoreSetUrns": [], "targetGenes": gene(k12)}, {"urn": "urn:c", "metaAnalyzesScoreSetUrns": ["x"], "targetGenes": gene("Homo")}, {"urn": "urn:d", "metaAnalyzesScoreSetUrns": ["x"], "targetGenes": gene(k12, None)}]
    dump = {"asOf": "2026", "experimentSets": [{"experiments": [{"scoreSets": sets[:2]}, {"scoreSets": sets[2:]}]}]}
    tar(tmp_path / "d.tar.gz", {"d/csv/urn-b.scores.csv": b"accession,hgvs_nt,hgvs_pro,scores.score\nv1,c.4G>T,p.x,0.5\nv2,c.=,p.=,NA\n", "d/main.json": json.dumps(dump).encode()})
    df = studies.mavedb(spark, str(tmp_path / "d.tar.gz"))
    assert rows(df, "variant_id", "assay_id", "mutant_nt", "mutant_aa", "experimental_score") == [("v1", "urn:b", "ATGTCT", "MS", "0.5"), ("v2", "urn:b", "ATGGCT", "MA", "NA")]
    stats = studies.mavedb_stats(studies.score_sets(spark, str(tmp_path / "d.tar.gz")), sinks.write_by_assay(df, str(tmp_path / "o"), sinks.VARIANT_COLUMNS), "x/d.tar.gz")
    assert stats["num_variants"] == 2 and stats["source_release"] == "2026" and stats["assays"][0]["target"] == "G"


def test_csv_counts_rows(spark, tmp_path):
    df = spark.range(5).select(F.lit("p").alias("panel"), F.col("id").cast("string").alias("study_id"))
    assert sinks.write_csv(df, str(tmp_path / "o"), sinks.NCRNA_COLUMNS) == 5
    assert spark.read.option("header", True).csv(str(tmp_path / "o")).columns == sinks.NCRNA_COLUMNS


def test_shards_hold_exactly_so_many_rows(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(0, 1003, 1, 7).select((F.lit(5000) - F.col("id")).alias("k"), F.lit("x").alias("t"))
    assert sinks.write_shards(df, str(tmp_path / "s"), 100, ["k"]) == 11
    files = sorted(p for p in (tmp_path / "s").iterdir() if p.suffix == ".parquet")
    assert [p.name for p in files] == [f"chunks-{i:05d}.parquet" for i in range(11)]
    tables = [pq.read_table(p) for p in files]
    assert [t.num_rows for t in tables] == [100] * 10 + [3] and tables[0].column_names == ["k", "t"]
    assert [k for t in tables for k in t.column("k").to_pylist()] == sorted(5000 - i for i in range(1003))
    assert sinks.write_shards(df.limit(0), str(tmp_path / "e"), 100, ["k"]) == 0 and not list((tmp_path / "e").glob("*.parquet"))
    sinks.write_splits(df.withColumn("split", F.when(F.col("k") % 2 == 0, F.lit("train")).otherwise(F.lit("other"))), str(tmp_path / "p"), ("train", "validation"), 5)
    assert spark.read.parquet(str(tmp_path / "p" / "train")).count() == 502 and spark.read.parquet(str(tmp_path / "p" / "validation")).columns == ["k", "t"]
    assert max(pq.read_metadata(p).num_rows for p in (tmp_path / "p" / "train").glob("*.parquet")) <= 5 and sorted(p.name for p in (tmp_path / "p").iterdir() if p.is_dir()) == ["train", "validation"]


def test_a_corpus_feeds_a_subset(spark, tmp_path):
    """From archives to a subset, through the shards that the first build leaves."""
    import random

    r = random.Random(2)
    genomes = {f"GCA_70000{i}.1": "".join(r.choice("ACGT") for _ in range(32 * n + 5)) for i, n in enumerate((4, 5, 6, 3))}
    tar(tmp_path / "g.tar.gz", {f"d/{a}_genomic.fna.gz": gzip.compress(f">r1 x\n{s}\n".encode()) for a, s in genomes.items()})
    builds.build_corpus(spark, [str(tmp_path / "g.tar.gz")], str(tmp_path / "out"), length=32, rows_per_file=7)
    names = sorted(p.name for p in (tmp_path / "out").glob("chunks-*.parquet"))
    assert names == [f"chunks-{i:05d}.parquet" for i in range(4)]
    stored = archives.chunk_shards(spark, str(tmp_path / "out"))
    assert {x.n for x in stored.groupBy("file_name").agg(F.count("*").alias("n")).collect()} == {7, 1}
    (tmp_path / "t.tsv").write_text("".join(f"GB_{a}\td__B;p__P;c__C;o__O;f__F;g__{'Escherichia' if i == 0 else 'G'};s__S\n" for i, a in enumerate(genomes)))
    manifest = builds.build_subset(spark, stored, archives.taxonomy(spark, [str(tmp_path / "t.tsv")]), str(tmp_path / "sub"), 4 * 32, 0.34, length=32)
    assert manifest.count() == 4
    train = archives.training_sequences(spark, str(tmp_path / "sub"), "train").collect()
    assert len(train) == 4 and all(any(x.sequence in s for s in genomes.values()) for x in train)


def test_state_and_metrics(spark, tmp_path):
    for step in (5, 12):
        sinks.write_state(spark.createDataFrame([(0, 0, float(step))], "code int, dim int, ema_count double"), str(tmp_path / "s"), step)
    step, state = sinks.read_state(spark, str(tmp_path / "s"))
    assert step == 12 and state.first().ema_count == 12.0
    for step in (1, 2):
        sinks.append_metrics(spark, str(tmp_path / "m"), step, loss=1 / step)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "m")).collect())) == [(1, "loss", 1.0), (2, "loss", 0.5)]


def test_shards_of_a_failing_task(spark, tmp_path):
    """A task that fails leaves no file of its own; what others wrote is taken back, and a writer with gaps is refused."""
    from helixframe.sources import shards

    rows = spark.range(0, 100, 1, 4).select("id", F.when(F.col("id") == 57, F.raise_error(F.lit("no"))).otherwise(F.lit("x")).alias("t"))
    with pytest.raises(Exception, match="no"):
        shards.write_placed(rows, str(tmp_path / "a"), 10, F.col("id"), 100)
    with pytest.raises(Exception, match="dense"):
        shards.write_placed(spark.range(100).filter("id < 30 OR id >= 40"), str(tmp_path / "b"), 10, F.col("id"), 100)
    assert not [p for d in ("a", "b") for p in tmp_path.glob(f"{d}/**/*") if p.is_file()]
    shards.write_placed(spark.range(25), str(tmp_path / "c"), 10, F.col("id"), 25)
    assert sorted(p.name for p in (tmp_path / "c").iterdir()) == [f"chunks-0000{i}.parquet" for i in range(3)]


def test_a_writer_that_dies_within_a_file(tmp_path):
    import pyarrow as pa

    from helixframe.sources import shards

    w = shards.ShardWriter(pa.schema([("x", pa.int64())]), {"path": str(tmp_path), "rows": "2", "folders": "[]"})

    def batches():
        yield pa.RecordBatch.from_pydict({"f": ["", "", ""], "s": [0, 0, 1], "p": [0, 1, 2], "x": [1, 2, 3]})
        raise RuntimeError("gone")

    with pytest.raises(RuntimeError):
        w.write(batches())
    assert not list(tmp_path.iterdir())


def test_splits_hold_exactly_so_many_rows(spark, tmp_path):
    import pyarrow.parquet as pq

    df = spark.range(101).select("id", F.when(F.col("id") % 3 == 0, "train").otherwise("validation").alias("split"))
    sinks.write_splits(df, str(tmp_path / "s"), ("train", "validation", "escherichia_holdout"), 10)
    got = {s: [pq.read_metadata(p).num_rows for p in sorted((tmp_path / "s" / s).glob("chunks-*.parquet"))] for s in ("train", "validation", "escherichia_holdout")}
    assert got == {"train": [10, 10, 10, 4], "validation": [10] * 6 + [7], "escherichia_holdout": [0]}


@pytest.mark.parametrize("most", [1 << 14, 1])
def test_only_chosen_rows_move(spark, tmp_path, most):
    """Bitmaps pick rows where files are read, in one scan or in several: nothing stands between a scan and its filter but a broadcast."""
    from helixframe.operators import rowmaps

    sinks.write_shards(spark.range(70_001).select("id", F.concat(F.lit("seq"), "id").alias("sequence")), str(tmp_path / "s"), 40_000, ["id"])
    files = archives.chunk_shards(spark, str(tmp_path / "s"))
    chosen = files.filter("id % 9 = 4 OR id = 0 OR id = 70000").select("file_name", "row_index", F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("split"))
    out = rowmaps.chosen_rows(files, rowmaps.stored_maps(chosen, "split"), "split", most)
    got = out.collect()
    assert sorted(r.id for r in got) == sorted({i for i in range(70_001) if i % 9 == 4} | {0, 70_000}) and all(r.sequence == f"seq{r.id}" for r in got)
    for s in "ab":
        mine = sorted((r.place, r.id) for r in got if r.split == s)
        assert [p for p, _ in mine] == list(range(len(mine))) and [i for _, i in mine] == sorted(i for _, i in mine)
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "BroadcastExchange" in plan and "Exchange hashpartitioning" not in plan and "Exchange rangepartitioning" not in plan
    assert plan.count("FileScan parquet [id") == (1 if most > 1 else 2)


def test_members_of_one_archive_in_several_tasks(spark, tmp_path):
    import zipfile

    with zipfile.ZipFile(tmp_path / "m.zip", "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("folder/", "")
        for i in range(100):
            z.writestr(f"t{i:03d}.csv", f"a,b\n{i},x\n")
    tar(tmp_path / "m.tar", {f"t{i:03d}.csv": f"a,b\n{i},x\n".encode() for i in range(100)}, "w")
    tar(tmp_path / "m.tar.gz", {f"t{i:03d}.csv": f"a,b\n{i},x\n".encode() for i in range(100)})
    got = {}
    for name, parts in (("m.zip", 5), ("m.tar", 5), ("m.tar.gz", 1)):
        df = archives.load(spark, "member_rows", str(tmp_path / name), member="t*.csv", part_bytes=100)
        assert df.select(F.spark_partition_id()).distinct().count() >= parts
        got[name] = sorted((r.member, r.row_no, tuple(r.cells)) for r in df.collect())
        assert len(got[name]) == 200
    assert got["m.zip"] == got["m.tar"] == got["m.tar.gz"]
    assert archives.load(spark, "member_text", str(tmp_path / "m.tar"), member="none").count() == 0


def test_stats_of_a_build_equal_those_of_records(spark, tmp_path):
    from helixframe.operators import corpus

    g = {f"db/GCA_00000{i}.1_genomic.fna.gz": gzip.compress(f">r1 x\nacgtNN{'ACGT' * i}\n>r2\nnnn\n>r3\n\n>r4\nACG\n".encode()) for i in range(5)}
    tar(tmp_path / "g.tar", g, "w")
    stats = builds.build_corpus(spark, [str(tmp_path / "g.tar")], str(tmp_path / "out"), length=3, rows_per_file=4)
    plain = corpus.corpus_stats(archives.load(spark, "fasta_tar", str(tmp_path / "g.tar")), "archive_path", 3).first().asDict()
    assert {k: stats[k] for k in plain} == plain
    stored = archives.chunk_shards(spark, str(tmp_path / "out")).orderBy("file_name", "row_index").collect()
    assert [r.gtdb_accession for r in stored] == sorted(r.gtdb_accession for r in stored)
    chunks = corpus.genome_chunks(archives.load(spark, "fasta_tar", str(tmp_path / "g.tar")), 3).collect()
    assert sorted(r.chunk_id for r in stored) == sorted(r.chunk_id for r in chunks)


def test_digests_of_large_files(spark, tmp_path):
    """A sparse file of more than 2 GB is read piece by piece."""
    import hashlib

    (tmp_path / "a b%.txt").write_bytes(b"abc")
    with open(tmp_path / "large", "wb") as f:
        f.truncate((2 << 30) + 5)
    (tmp_path / "none").touch()
    got = {r.file.rpartition("/")[2]: (r.sha256, r.size) for r in archives.file_digests(spark, [str(tmp_path / "a b%.txt"), f"file:{tmp_path}/large", f"file://{tmp_path}/none"]).collect()}
    h, zero = hashlib.sha256(), bytes(1 << 20)
    for _ in range(2 << 10):
        h.update(zero)
    h.update(bytes(5))
    assert got == {"a b%.txt": (hashlib.sha256(b"abc").hexdigest(), 3), "large": (h.hexdigest(), (2 << 30) + 5), "none": (hashlib.sha256(b"").hexdigest(), 0)}


@pytest.mark.parametrize("piece", [1, 2, 7, 1 << 20])
def test_json_values_as_they_stream_by(piece):
    import io
    import random

    r = random.Random(piece)

    def thing(depth=0):
        if depth < 3 and r.random() < 0.5:
            return {r.choice("abc"): thing(depth + 1) for _ in range(3)} if r.random() < 0.5 else [thing(depth + 1) for _ in range(r.randint(0, 3))]
        return r.choice([r.random() * 100, "a", 'q"uo\\te', "é\u2028{[,:]}", "", "long " * 20, None, r.randint(-9, 9), True, {}, []])

    for case in range(60):
        dump = {"asOf": "2026", "a": [{"b": [{"c": [thing() for _ in range(r.randint(0, 3))]} for _ in range(r.randint(0, 2))], "z": thing()} for _ in range(r.randint(0, 3))], "last": thing()}
        text = json.dumps(dump, indent=r.choice([None, 2]), ensure_ascii=r.random() < 0.5)
        got = list(archives.json_values(io.StringIO(text).read, {"a[].b[].c[]", "asOf", "a[].z"}, piece))
        want = [("asOf", "2026")]
        for x in dump["a"]:
            want += [("a[].b[].c[]", v) for y in x["b"] for v in y["c"]] + [("a[].z", x["z"])]
        assert [(p, json.loads(v)) for p, v in got] == want
    for bad in ('{"a": [1, 2', '{"a": ]}', '"abc'):
        with pytest.raises(ValueError):
            list(archives.json_values(io.StringIO(bad).read, {"a"}, piece))


def test_memory_does_not_grow_with_the_dump():
    import tracemalloc

    def dump(n):
        yield '{"sets": ['
        for i in range(n):
            yield f'{"," if i else ""}{{"urn": "u{i}", "x": [{", ".join(["0.25"] * 50)}]}}'
        yield "]}"

    def peak(n):
        pieces = dump(n)
        tracemalloc.start()
        assert sum(1 for _ in archives.json_values(lambda size: next(pieces, ""), {"sets[]"}, 1 << 12)) == n
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most

    assert peak(4000) < 2 * peak(200)
