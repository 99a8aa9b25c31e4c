"""Mutational-scan studies as plans: each reads its source files and gives rows of one variant table.

Wild types, oligo tiles and score matrices of a study are small tables (hundreds of rows), joined by
Catalyst's choice. Every check that fails stops the job; nothing is written before a plan has run.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from helixframe.functions import dna, hgvs
from helixframe.functions.scores import python_round, python_text
from helixframe.sources.stored import stored
from helixframe.operators.corpus import keep_first
from helixframe.sources.archives import load, named, reference_fasta
from helixframe.sources.sinks import NCRNA_COLUMNS, VARIANT_COLUMNS, write_by_assay

ECOLI = "Escherichia coli"


def _fail(message: str, *parts: Column) -> Column:
    return F.raise_error(F.concat(F.lit(message), *[F.coalesce(p.cast("string"), F.lit("NULL")) for p in parts]))


def _checked(ok: Column, value: Column, message: str, *parts: Column) -> Column:
    """value, if ok; the check stands in a column that is used, so that it can't be pruned away."""
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(_fail(message, *parts))


def _variants(rows: DataFrame, study: str, assay: Column, organism: str, target: Column, aa_change: Column | None, score: Column, direction: int = 1) -> DataFrame:
    """The variant table of rows with wt_nt and mutant_nt; aa_change None: described from the residues."""
    rows = rows.withColumn("wt_aa", dna.translate_dna(F.col("wt_nt"))).withColumn("mutant_aa", dna.translate_dna(F.col("mutant_nt")))
    change = dna.describe_residue_changes(F.col("wt_aa"), F.col("mutant_aa")) if aa_change is None else aa_change
    return rows.select(
        F.lit("evo1").alias("panel"), F.lit(study).alias("study_id"), assay.alias("assay_id"), F.lit(None).cast("string").alias("variant_id"), F.lit(organism).alias("organism"), target.alias("target"),
        "wt_nt", "mutant_nt", dna.describe_coding_edit(F.col("wt_nt"), F.col("mutant_nt")).alias("nt_edit"), "wt_aa", "mutant_aa", change.alias("aa_change"), score.cast("string").alias("experimental_score"), F.lit(direction).alias("directionality"),
    )


def _residue(sequence: str, position: Column) -> Column:
    return F.substring(F.col(sequence), position.cast("int"), F.lit(1))


def _first_record(spark: SparkSession, path: str) -> DataFrame:
    return reference_fasta(spark, path).agg(F.min_by("sequence", "ordinal").alias("wt_nt"))


def _joined(first: DataFrame, order: str, value: str, tail: str = "") -> DataFrame:
    """One row, wt_nt: values in order put together."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    return first.agg(F.concat(F.array_join(parts, ""), F.lit(tail)).alias("wt_nt"))


def _with_one(rows: DataFrame, one: DataFrame) -> DataFrame:
    """rows beside the only row of one (an aggregate without keys)."""
    return rows.crossJoin(F.broadcast(one))


def adkar(spark: SparkSession, source: str) -> DataFrame:
    rows = named(load(spark, "worksheet", f"{source}/Adkar_2012_CcdB_original_results_mmc2.xlsx", sheet="bh01_with_RankScore", min_row=2), 0, ["Mutant", "RankScore"])
    rows = _with_one(rows, _first_record(spark, f"{source}/evo1_adkar_wt.fasta"))
    rx = r"\A([A-Z*])(\d{3})([A-Z*])=([ACGT]{3})\z"
    part = lambda g: F.regexp_extract("Mutant", rx, g)
    position = part(2).try_cast("int")
    position = _checked(F.rlike("Mutant", F.lit(rx)), position, "Unsupported mutation: ", F.col("Mutant"))
    rows = rows.withColumn("position", position).withColumn("wt", part(1)).withColumn("new", part(3)).withColumn("mutant_nt", dna.replace_codon(F.col("wt_nt"), F.col("position"), part(4)))
    out = F.concat("wt", F.col("position").cast("string"), "new")
    same = (_residue("wt_aa", F.col("position")) == F.col("wt")) & (_residue("mutant_aa", F.col("position")) == F.col("new"))
    return _variants(rows, "adkar_2012", F.lit("CCDB_ECOLI_Adkar_2012"), ECOLI, F.lit("CcdB toxin"), _checked(same, out, "Residue mismatch for ", F.col("Mutant")), F.col("RankScore"), -1)


def chen(spark: SparkSession, source: str) -> DataFrame:
    label = "codon position (G2 stands for Glycine 2 from the inhouse sequence)"
    rows = named(load(spark, "worksheet", f"{source}/elife-56707-supp2-v2.xlsx", sheet="SF2D Codon Fitness scores", min_row=2), 0, [label, "wt codon", "variant codon", "fitness score"])
    rows = rows.withColumnRenamed(label, "label").filter("label IS NOT NULL")
    first = rows.groupBy("label").agg(F.min("row_no").alias("seen"), dna.ascii_upper(F.min_by("wt codon", "row_no")).alias("codon"))
    first = first.withColumn("position", F.row_number().over(Window.orderBy("seen")))  # a row per codon of one gene
    rows = _with_one(rows.filter("`fitness score` IS NOT NULL").join(first.select("label", "position"), "label"), _joined(first, "position", "codon"))
    rows = rows.withColumn("mutant_nt", dna.replace_codon(F.col("wt_nt"), F.col("position"), F.col("variant codon")))
    change = F.concat(_residue("wt_aa", F.col("position")), F.col("position").cast("string"), _residue("mutant_aa", F.col("position")))
    return _variants(rows, "chen_2020", F.lit("A4GRB6_PSEAI_Chen_2020"), "Pseudomonas aeruginosa", F.lit("VIM-2 beta-lactamase"), change, F.col("fitness score"))


def firnberg(spark: SparkSession, source: str) -> DataFrame:
    rows = load(spark, "worksheet", f"{source}/supp_msu081_Data_S1-S4.xlsx", sheet="S1 Codon fitnesses", min_row=3)
    cell = lambda i: F.get("cells", F.lit(i))
    rows = rows.select("row_no", F.coalesce(cell(0), F.lit("None")).alias("label"), dna.ascii_upper(cell(1)).alias("wt_codon"), dna.ascii_upper(cell(2)).alias("codon"), cell(20).alias("score"))
    first = rows.groupBy("label").agg(F.min("row_no").alias("seen"), F.min_by("wt_codon", "row_no").alias("c"), F.count_distinct("wt_codon").alias("n"))
    first = first.select("label", "seen", _checked(F.col("n") == 1, F.col("c"), "Inconsistent wild-type codons under label ", F.col("label")).alias("wt_codon"))
    first = first.withColumn("position", F.row_number().over(Window.orderBy("seen")))
    rows = rows.filter("score IS NOT NULL AND codon <> wt_codon").drop("wt_codon")
    rows = _with_one(rows.join(first.select("label", "position"), "label"), _joined(first, "position", "wt_codon"))
    rows = rows.withColumn("mutant_nt", dna.replace_codon(F.col("wt_nt"), F.col("position"), F.col("codon")))
    change = F.concat(_residue("wt_aa", F.col("position")), F.col("position").cast("string"), _residue("mutant_aa", F.col("position")))
    return _variants(rows, "firnberg_2014", F.lit("BLAT_ECOLX_Firnberg_2014"), ECOLI, F.lit("TEM-1 beta-lactamase"), change, python_text(python_round(F.col("score").cast("double"), 4)))


def jacquier(spark: SparkSession, source: str) -> DataFrame:
    rows = named(load(spark, "worksheet", f"{source}/1215206110_sd01.xlsx", sheet="TEM-1 DB"), 0, ["Mutant_nt", "Residue", "Mutant_AA", "Mutation", "MIC_Score"])
    # Column names don't tell upper from lower case: the sheet's get names that the variant table doesn't use.
    rows = rows.select(F.col("Mutant_nt").alias("substitutions"), F.col("Residue").alias("place"), F.col("Mutant_AA").alias("expected"), "Mutation", "MIC_Score")
    rows = _with_one(rows, _first_record(spark, f"{source}/J01749.1_TEM-1_CDS.fasta"))
    rows = rows.withColumn("mutant_nt", dna.apply_substitutions(F.col("wt_nt"), F.col("substitutions")))
    same = _residue("mutant_aa", F.col("place").cast("double")) == F.col("expected")
    return _variants(rows, "jacquier_2013", F.lit("BLAT_ECOLX_Jacquier_2013"), ECOLI, F.lit("TEM-1 beta-lactamase"), _checked(same, F.col("Mutation"), "The mutant sequence lacks the residue named by ", F.col("Mutation")), F.col("MIC_Score"))


def kelsic(spark: SparkSession, source: str) -> DataFrame:
    def read(name: str) -> DataFrame:
        """Rows of one table with their places: a file of a few thousand rows, numbered in file order."""
        df = spark.read.csv(f"{source}/{name}", header=True, inferSchema=False, ignoreLeadingWhiteSpace=True, multiLine=True)
        return df.withColumn("row_no", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1)

    one, two = read("NIHMS836960-supplement-1.csv"), read("NIHMS836960-supplement-2.csv")
    codons = one.filter("is_wt = '1'").select(F.col("pos").cast("int").alias("position"), dna.ascii_upper(F.col("codon")).alias("codon"), "row_no").groupBy("position").agg(F.max_by("codon", "row_no").alias("codon"))
    edits = lambda *pairs: F.array(*[F.struct(F.col(p).cast("int").alias("p"), dna.ascii_upper(F.col(c)).alias("c")) for p, c in pairs])
    a = one.select(F.lit(0).alias("source_no"), "row_no", edits(("pos", "codon")).alias("edits"), "fitness_rich")
    b = two.select(F.lit(1).alias("source_no"), "row_no", edits(("pos1", "codon1"), ("pos2", "codon2")).alias("edits"), "fitness_rich")
    rows = _with_one(a.unionByName(b).filter("row_no > 0"), _joined(codons, "position", "codon"))
    wt = F.col("wt_nt")
    step = lambda s, e: F.when(F.substring(wt, (e["p"] - 1) * 3 + 1, F.lit(3)) == e["c"], s).otherwise(dna.replace_codon(s, e["p"], e["c"]))
    rows = rows.withColumn("mutant_nt", F.aggregate("edits", wt, step)).filter("mutant_nt <> wt_nt")
    rows = keep_first(rows, ["mutant_nt"], [F.col("source_no"), F.col("row_no")])
    return _variants(rows, "kelsic_2016", F.lit("IF1_ECOLI_Kelsic_2016"), ECOLI, F.lit("translation initiation factor IF-1"), None, python_text(F.col("fitness_rich").cast("double")))


def melnikov(spark: SparkSession, source: str) -> DataFrame:
    book, archive = f"{source}/supp_gku511_nar-01049-met-h-2014-File006.xlsx", f"{source}/supp_gku511_nar-01049-met-h-2014-File007.zip"
    cell = lambda i: F.get("cells", F.lit(i))
    wt = load(spark, "worksheet", book, sheet="Primers_etc").filter(cell(0) == "KKA2_KLEPN_opt").agg(F.min_by(cell(2), "row_no").alias("s")).select(_checked(F.col("s").isNotNull(), dna.ascii_upper(F.col("s")), "no row of the worksheet holds the wild type KKA2_KLEPN_opt").alias("wt_nt"))
    sheets = [load(spark, "worksheet", book, sheet=s, min_row=6, max_col=2).withColumn("sheet_no", F.lit(i)) for i, s in enumerate(("OLS_A", "OLS_B"))]
    rx = r"\A(KKA2_KLEPN_[AB]\d+)_(\d+)_(wt|[ACDEFGHIKLMNPQRSTVWY])\z"
    oligos = sheets[0].unionByName(sheets[1]).select("sheet_no", "row_no", cell(0).alias("id"), dna.ascii_upper(cell(1)).alias("tile")).filter(F.rlike("id", F.lit(rx)))
    oligos = oligos.groupBy("id").agg(F.max_by("tile", F.struct("sheet_no", "row_no")).alias("tile"))
    oligos = oligos.select(F.regexp_extract("id", rx, 1).alias("tile_id"), F.regexp_extract("id", rx, 2).cast("int").alias("position"), F.regexp_extract("id", rx, 3).alias("residue"), "tile", "id")
    tiles = oligos.filter("residue = 'wt'").groupBy("tile_id").agg(F.max_by("tile", "id").alias("wt_tile"))
    names = [f"Supplementary Data 2 - Unpacked/KKA2_{s}_Kan18_L1.aadiff.txt" for s in ("S1", "S3")]
    lines = load(spark, "member_rows", archive, member="Supplementary Data 2 - Unpacked/KKA2_S*_Kan18_L1.aadiff.txt", sep="\t").filter(F.col("member").isin(names))
    places = lines.filter("row_no = 1").select("member", F.slice("cells", 2, F.size("cells") - 1).alias("places"))
    cells = lines.filter("row_no > 2").filter(F.startswith(F.trim(cell(0)), F.lit("Delta-"))).join(places, "member")
    cells = cells.select("member", F.substring(F.trim(cell(0)), 7, 100).alias("residue"), F.explode(F.arrays_zip(F.col("places").alias("p"), F.slice("cells", 2, F.size("cells") - 1).alias("v"))).alias("x"))
    scores = cells.select("member", "residue", F.trim("x.p").try_cast("int").alias("position"), F.trim("x.v").try_cast("double").alias("score")).filter("position IS NOT NULL AND score IS NOT NULL")
    side = lambda i, n: scores.filter(F.col("member") == names[i]).select("position", "residue", F.col("score").alias(n))
    both = side(0, "s1").join(side(1, "s3"), ["position", "residue"], "left").select("position", "residue", _checked(F.col("s3").isNotNull(), (F.col("s1") + F.col("s3")) / 2, "No second replicate at ", F.col("position")).alias("score"))
    rows = oligos.filter("residue <> 'wt'").join(tiles, "tile_id", "left").join(both, ["position", "residue"], "left")
    rows = _with_one(rows, wt)
    tile = _checked(F.col("wt_tile").isNotNull() & F.col("score").isNotNull(), F.col("wt_tile"), "No wild-type tile or score for ", F.col("id"))
    codon = hgvs.mutant_codon(tile, F.col("tile"), F.substring(F.col("wt_nt"), (F.col("position") - 1) * 3 + 1, F.lit(3)), F.col("residue"))
    rows = rows.withColumn("mutant_nt", dna.replace_codon(F.col("wt_nt"), F.col("position"), codon))
    change = F.concat(_residue("wt_aa", F.col("position")), F.col("position").cast("string"), "residue")
    return _variants(rows, "melnikov_2014", F.lit("KKA2_KLEPN_Melnikov_2014"), "Klebsiella pneumoniae", F.lit("APH(3')II aminoglycoside phosphotransferase"), change, python_text(F.col("score")))


def rockah_shmuel(spark: SparkSession, source: str) -> DataFrame:
    cell = lambda i: F.get("cells", F.lit(i))
    last = 331
    raw = load(spark, "worksheet", f"{source}/pcbi.1004421.s002.xlsx", sheet="raw G0", min_row=3).filter(F.get("is_number", F.lit(0)) & F.rlike(cell(0), F.lit(r"\A-?\d+\z")))
    codons = raw.select(cell(0).cast("int").alias("position"), dna.ascii_upper(cell(2)).alias("codon"), "row_no").filter(F.col("position").between(0, last)).groupBy("position").agg(F.max_by("codon", "row_no").alias("codon"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("position", "codon"))), lambda x: x["codon"])
    wt = codons.agg(_checked(F.count("*") == last + 1, F.array_join(parts, ""), "The wild type lacks codons").alias("wt_nt"))
    book = f"{source}/pcbi.1004421.s003.xlsx"
    table = load(spark, "worksheet", book, sheet="# of nt exchanges")
    head = table.filter("row_no = 0").select(F.col("cells").alias("heads"))
    grid = _with_one(table.filter((F.col("row_no") >= 2) & cell(0).isNotNull()), head)
    grid = grid.select(cell(0).cast("double").cast("int").alias("position"), F.posexplode("heads").alias("i", "codon"), "cells").filter((F.col("i") >= 3) & (F.get("cells", F.col("i")).try_cast("double") == 1)).select("position", "codon")
    sheets = [named(load(spark, "worksheet", book, sheet=s), 0, ["Mutation", "Wrel G17"]) for s in ("Single nt nonSyn", "Syn", "nonSense")]
    scores = reduce(DataFrame.unionByName, sheets).filter("Mutation IS NOT NULL AND `Wrel G17` IS NOT NULL")
    rx = r"\A([A-Z])(\d+)([A-Z*])?\z"
    place = _checked(F.rlike("Mutation", F.lit(rx)), F.regexp_extract("Mutation", rx, 2).try_cast("int"), "Unsupported mutation: ", F.col("Mutation"))
    new = F.regexp_extract("Mutation", rx, 3)
    scores = scores.select("Mutation", F.col("Wrel G17").alias("score"), F.regexp_extract("Mutation", rx, 1).alias("wt"), place.alias("position")).withColumn("new", F.when(new == "", F.col("wt")).otherwise(new))
    known = scores.join(grid.select("position").distinct().withColumn("known", F.lit(True)), "position", "left")
    known = known.withColumn("position", _checked(F.col("known"), F.col("position"), "No codons listed at ", F.col("position")))
    rows = _with_one(known.join(grid, "position").filter(dna.translate_dna(F.col("codon")) == F.col("new")), wt)
    at = F.col("position") + 1  # the source counts from 0
    rows = rows.withColumn("mutant_nt", dna.replace_codon(F.col("wt_nt"), at, F.col("codon")))
    change = _checked(_residue("wt_aa", at) == F.col("wt"), F.concat("wt", at.cast("string"), "new"), "The wild type lacks the residue named by ", F.col("Mutation"))
    return _variants(rows, "rockah_shmuel_2015", F.lit("MTH3_HAEAE_RockahShmuel_2015"), "Haemophilus aegyptius", F.lit("HaeIII DNA methyltransferase"), change, F.col("score"))


# The five targets, their assays and names.
TSUBOYAMA = {
    "1AOY.pdb": ("ARGR_ECOLI_Tsuboyama_2023_1AOY", "Arginine repressor"),
    "2D1U.pdb": ("FECA_ECOLI_Tsuboyama_2023_2D1U", "Fe(3+) dicitrate transport protein FecA"),
    "1WCL.pdb": ("NUSA_ECOLI_Tsuboyama_2023_1WCL", "Transcription termination/antitermination protein NusA"),
    "2LCL.pdb": ("RFAH_ECOLI_Tsuboyama_2023_2LCL", "Transcription antitermination protein RfaH"),
    "2KVT.pdb": ("YAIA_ECOLI_Tsuboyama_2023_2KVT", "Uncharacterized protein YaiA"),
}


def tsuboyama(spark: SparkSession, source: str) -> DataFrame:
    rows = named(load(spark, "member_rows", f"{source}/Processed_K50_dG_datasets.zip", member="Processed_K50_dG_datasets/Tsuboyama2023_Dataset1_20230416.csv"), 0, ["name", "dna_seq", "deltaG"])
    wt_name = F.substring_index("name", "_", 1)
    rows = rows.withColumn("wt_name", wt_name).filter(F.col("wt_name").isin(*TSUBOYAMA) & (F.col("deltaG") != ""))
    wild = reference_fasta(spark, f"{source}/evo1_tsuboyama_wt.fasta").select(F.col("record_id").alias("wt_name"), F.col("sequence").alias("wt_nt"))
    rows = rows.join(wild, "wt_name", "left").withColumn("mutant_nt", dna.ascii_upper(F.col("dna_seq")))
    rows = rows.withColumn("wt_nt", _checked(F.col("wt_nt").isNotNull(), F.col("wt_nt"), "No wild type of ", F.col("wt_name"))).filter("mutant_nt <> wt_nt")
    names = F.create_map(*[x for k, v in TSUBOYAMA.items() for x in (F.lit(k), F.struct(F.lit(v[0]).alias("assay"), F.lit(v[1]).alias("target")))])
    meta = F.element_at(names, F.col("wt_name"))
    return _variants(rows, "tsuboyama_2023", meta["assay"], ECOLI, meta["target"], None, F.col("deltaG"))


def weeks(spark: SparkSession, source: str) -> DataFrame:
    cell = lambda i: F.get("cells", F.lit(i))
    lines = spark.read.csv(f"{source}/Supplementary Data S8.csv", header=False, inferSchema=False)
    lines = lines.select(F.array(*lines.columns).alias("cells"), (F.row_number().over(Window.orderBy(F.monotonically_increasing_id())) - 1).alias("row_no"))  # a matrix of 64 codons
    head = lines.filter("row_no = 0").select(F.col("cells").alias("heads"))
    found = _with_one(lines.filter(F.col("row_no") >= 2).filter((cell(2) == "Functional Score") & (cell(3) == "Weighted Mean")), head)
    found = found.select("row_no", cell(1).alias("codon"), "cells", F.posexplode("heads").alias("i", "residue")).filter("i >= 4 AND residue IS NOT NULL")
    blank = F.coalesce(F.get("cells", F.col("i")), F.lit("")) == ""
    table = dna.codon_map()
    fits = found.withColumn("fits", blank & (F.try_element_at(table, F.col("codon")) == F.col("residue")))
    codons = fits.groupBy("i").agg(F.min_by(F.when(F.col("fits"), F.col("codon")), F.when(F.col("fits"), F.col("row_no"))).alias("c"))
    codons = codons.select("i", _checked(F.col("c").isNotNull(), F.col("c"), "No wild-type codon in column ", F.col("i")).alias("codon"))
    wt = _joined(codons, "i", "codon", "TGA")
    grid = load(spark, "worksheet", f"{source}/Supplementary Data S1.xlsx", sheet="Fitness (weighted mean)")
    places = grid.filter("row_no = 1").select(F.filter(F.slice("cells", 3, 1 << 20), lambda x: x.isNotNull()).alias("places"))
    rows = _with_one(grid.filter(F.col("row_no") >= 2).filter(cell(1).isin(*dna.CODONS)), places)
    cells = F.arrays_zip(F.col("places").alias("p"), F.slice("cells", 3, 1 << 20).alias("v"), F.slice("is_number", 3, 1 << 20).alias("n"))
    rows = rows.select(cell(1).alias("codon"), F.explode(cells).alias("x")).filter("x.n AND x.p IS NOT NULL").select("codon", F.col("x.p").cast("double").cast("int").alias("position"), F.col("x.v").cast("double").alias("score"))
    rows = _with_one(rows, wt).withColumn("mutant_nt", dna.replace_codon(F.col("wt_nt"), F.col("position"), F.col("codon")))
    return _variants(rows, "weeks_2023", F.lit("RNC_ECOLI_Weeks_2023"), ECOLI, F.lit("RNase III"), None, python_text(python_round(F.col("score"), 9)))


#: The order in which studies are written.
STUDIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"adkar_2012": adkar, "chen_2020": chen, "firnberg_2014": firnberg, "jacquier_2013": jacquier, "kelsic_2016": kelsic, "melnikov_2014": melnikov, "rockah_shmuel_2015": rockah_shmuel, "tsuboyama_2023": tsuboyama, "weeks_2023": weeks}


def standardize(spark: SparkSession, source: str, output: str, studies: list[str] | None = None) -> dict[str, int]:
    """Writes each study's assays as CSV tables; source holds a folder per study. Returns rows by assay."""
    out: dict[str, int] = {}
    for s in studies or STUDIES:
        out |= write_by_assay(STUDIES[s](spark, f"{source}/{s}"), f"{output}/{s}", VARIANT_COLUMNS)
    return out


# The seven non-coding RNA studies.
NCRNA = ("andreasson_2020", "domingo_2018", "guy_2014", "hayden_2011", "kobori_2016", "pitt_2010", "zhang_2009")


def ncrna(spark: SparkSession, archive: str) -> DataFrame:
    """The seven studies of a tar.gz of tab-separated tables, in one table of eight columns."""
    rows = load(spark, "member_rows", archive, member="arvind_dms/processed_dms_nt_*.tsv", sep="\t")
    heads = rows.filter("row_no = 0").select("member", F.col("cells").alias("heads"))
    rows = rows.filter("row_no > 0").join(heads, "member")
    study = F.regexp_extract("member", r"processed_dms_nt_(.*)\.tsv$", 1)
    cell = lambda n: F.get("cells", (F.array_position("heads", n) - 1).cast("int"))
    rows = rows.select(study.alias("study_id"), cell("wt_seq_nt").alias("wt_nt"), cell("mt_seq_nt").alias("mutant_nt"), cell("fitness").alias("experimental_score")).filter(F.col("study_id").isin(*NCRNA))
    rows = rows.withColumn("panel", F.lit("evo1_ncrna")).withColumn("assay_id", F.col("study_id")).withColumn("nt_edit", dna.describe_coding_edit(F.col("wt_nt"), F.col("mutant_nt"))).withColumn("directionality", F.lit(1))
    return rows.select(*NCRNA_COLUMNS)


TARGET_ORGANISM = "Escherichia coli K-12"
#: Where a dump's score sets and date stand, and what is read of a score set.
SETS, DATE = "experimentSets[].experiments[].scoreSets[]", "asOf"
_SET = """struct<urn:string,metaAnalyzesScoreSetUrns:array<string>,
targetGenes:array<struct<name:string,targetSequence:struct<sequence:string,taxonomy:struct<organismName:string>>>>>"""


def score_sets(spark: SparkSession, archive: str, organism: str = TARGET_ORGANISM) -> DataFrame:
    """urn, target, organism, wt_nt, released of the combined score sets of one organism, in order of urn.

    The dump streams by once; each of its score sets is a row.
    """
    found = stored(load(spark, "json_values", archive, member="*/main.json", values=f"{SETS}\n{DATE}").select("path", "value"), "score-sets")
    date = found.agg(F.max(F.when(F.col("path") == DATE, F.from_json(F.concat(F.lit('{"v":'), "value", F.lit("}")), "v string")["v"])).alias("asOf"))  # one row
    # Parsed on its own: a filter pushed below would parse the other values too.
    e = stored(found.filter(F.col("path") == SETS).select(F.from_json("value", _SET, {"mode": "FAILFAST"}).alias("x")), "parsed-sets").crossJoin(F.broadcast(date))
    gene = F.get("x.targetGenes", F.lit(0))
    rows = e.select(F.col("x.urn").alias("urn"), F.col("x.metaAnalyzesScoreSetUrns").alias("parts"), gene["name"].alias("target"), gene["targetSequence"].alias("t"), F.col("asOf").alias("released"))
    rows = rows.filter("t IS NOT NULL AND size(parts) > 0").filter(F.col("t.taxonomy.organismName") == organism)
    return rows.select("urn", "target", F.col("t.taxonomy.organismName").alias("organism"), dna.ascii_upper(F.col("t.sequence")).alias("wt_nt"), "released").orderBy("urn")


def mavedb(spark: SparkSession, archive: str, organism: str = TARGET_ORGANISM) -> DataFrame:
    """Variants of the combined score sets of a dump: their tables are members csv/<urn with - for :>.scores.csv."""
    sets = score_sets(spark, archive, organism).withColumn("stem", F.translate("urn", ":", "-"))
    rows = load(spark, "member_rows", archive, member="*/csv/*.scores.csv").withColumn("stem", F.regexp_extract("member", r"csv/(.*)\.scores\.csv$", 1))
    heads = rows.filter("row_no = 0").select("member", F.col("cells").alias("heads"))
    rows = rows.filter("row_no > 0").join(sets, "stem").join(heads, "member")
    cell = lambda n: F.get("cells", (F.array_position("heads", n) - 1).cast("int"))
    rows = rows.withColumn("hgvs", cell("hgvs_nt")).withColumn("mutant_nt", hgvs.apply_edit(F.col("wt_nt"), F.col("hgvs")))
    return rows.select(
        F.lit("dnahnet").alias("panel"), F.lit("tsuboyama_2023").alias("study_id"), F.col("urn").alias("assay_id"), cell("accession").alias("variant_id"), "organism", "target", "wt_nt", "mutant_nt", F.col("hgvs").alias("nt_edit"),
        dna.translate_dna(F.col("wt_nt")).alias("wt_aa"), dna.translate_dna(F.col("mutant_nt")).alias("mutant_aa"), cell("hgvs_pro").alias("aa_change"), cell("scores.score").alias("experimental_score"), F.lit(1).alias("directionality"),
    )


def mavedb_stats(sets: DataFrame, counts: dict[str, int], archive: str) -> dict:
    """The summary that goes beside the tables."""
    rows = sets.collect()  # a row per selected score set
    assays = [{"assay_id": r["urn"], "target": r["target"], "num_variants": counts.get(r["urn"], 0)} for r in rows]
    return {"source": "MaveDB", "source_release": rows[0]["released"] if rows else None, "source_archive": archive.rsplit("/", 1)[-1], "selection": f"Combined score sets for {TARGET_ORGANISM}", "organism": TARGET_ORGANISM, "phenotype": "protein folding stability", "num_assays": len(assays), "num_variants": sum(a["num_variants"] for a in assays), "assays": assays}
