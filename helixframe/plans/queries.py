"""Queries of the engine's own operators over the driver's tables, each with SQL for the same rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from helixframe.functions import dna, hgvs, scores
from helixframe.functions.batches import bounded, flat, texts, whole_codons
from helixframe.operators import corpus, evaluation, sampling, vq
from helixframe.sources.stored import stored

SEED = 17
L = 3
HEX, BASES = "0123456789abcdef", "ACGTACGTACGTACGT"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _records(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("sequence"))


def _dna(spark, sf_dir) -> DataFrame:
    """doc_id, wt, mutant: 30 bases made from a hash of the text."""
    seq = lambda salt: F.substring(F.translate(F.md5(F.concat(F.col("text"), F.lit(salt)).cast("binary")), HEX, BASES), 1, 30)
    return table(spark, sf_dir, "documents").select("doc_id", seq("").alias("wt"), seq("m").alias("mutant"))


DNA_SQL = "(SELECT doc_id, substring(translate(md5(text),'0123456789abcdef','ACGTACGTACGTACGT'),1,30) AS wt, substring(translate(md5(text||'m'),'0123456789abcdef','ACGTACGTACGTACGT'),1,30) AS mutant FROM documents)"
UPPER_SQL = "translate(text,'abcdefghijklmnopqrstuvwxyz','ABCDEFGHIJKLMNOPQRSTUVWXYZ')"
CODON_SQL = "CASE WHEN {c} IS NULL THEN NULL ELSE substring('" + dna.RESIDUES + "', 16*(instr('TCAG',substring({c},1,1))-1)+4*(instr('TCAG',substring({c},2,1))-1)+instr('TCAG',substring({c},3,1)),1) END"


def translated(s: str) -> str:
    """SQL that translates a 30-base column."""
    return "(" + " || ".join(CODON_SQL.format(c=f"substring({s},{3 * i + 1},3)") for i in range(10)) + ")"


SEGMENTS_SQL = f"""runs AS (SELECT doc_id, length(text) AS n, regexp_extract_all({UPPER_SQL},'[ACGT]+|[^ACGT]+') AS r FROM documents),
lens AS (SELECT doc_id, n, r, list_transform(r, lambda x: length(x)) AS l FROM runs),
pieces AS (SELECT doc_id, n, unnest(r) AS seg, unnest(l) AS len, unnest(range(1,len(r)+1)) AS k, l FROM lens),
segs AS (SELECT doc_id, n, seg, len, coalesce(list_sum(l[1:k-1]),0)::BIGINT AS start FROM pieces WHERE regexp_matches(seg,'^[ACGT]'))"""

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


@query(f"""WITH {SEGMENTS_SQL}, c AS (SELECT doc_id, n, seg, len, start, unnest(range(0, len, {L})) AS o FROM segs)
SELECT doc_id, n::BIGINT AS record_length, (start+o)::BIGINT AS chunk_start, (start+least(o+{L},len))::BIGINT AS chunk_end, (least(o+{L},len)-o)::BIGINT AS chunk_length, substring(seg,o+1,{L}) AS sequence FROM c""")
def chunk_documents(spark, sf_dir):
    return corpus.chunks(_records(spark, sf_dir), L)


@query(f"""WITH {SEGMENTS_SQL}, per AS (SELECT d.doc_id, length(text) AS n, coalesce(kept,0) AS kept, coalesce(f,0) AS f, coalesce(s,0) AS s, coalesce(b,0) AS b FROM documents d LEFT JOIN
(SELECT doc_id, sum(len) AS kept, sum(len//{L}) AS f, sum(CASE WHEN len%{L}>0 THEN 1 ELSE 0 END) AS s, sum(len%{L}) AS b FROM segs GROUP BY 1) USING (doc_id))
SELECT count(DISTINCT doc_id)::BIGINT AS genomes_processed, count(*)::BIGINT AS fasta_records_processed, sum(n)::BIGINT AS input_bases, sum(n-kept)::BIGINT AS ambiguous_bases, sum(kept)::BIGINT AS retained_bases,
sum(f+s)::BIGINT AS chunks, sum(f)::BIGINT AS full_length_chunks, sum(s)::BIGINT AS short_chunks, sum(b)::BIGINT AS short_chunk_bases FROM per""")
def corpus_stats(spark, sf_dir):
    return corpus.corpus_stats(_records(spark, sf_dir), "doc_id", L)


@query(f"SELECT doc_id, {translated('wt')} AS wt_aa, {translated('mutant')} AS mutant_aa FROM {DNA_SQL}")
def dna_translate(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", dna.translate_dna(F.col("wt")).alias("wt_aa"), dna.translate_dna(F.col("mutant")).alias("mutant_aa"))


_DIFF = "list_filter(list_transform(range(1,{n}+1), lambda i: CASE WHEN substring({a},i,1) <> substring({b},i,1) THEN {e} END), lambda x: x IS NOT NULL)"


@query(f"""WITH d AS (SELECT doc_id, wt, mutant, {_DIFF.format(n=30, a='wt', b='mutant', e="i::VARCHAR||substring(wt,i,1)||'>'||substring(mutant,i,1)")} AS x FROM {DNA_SQL})
SELECT doc_id, CASE WHEN len(x)=0 THEN 'c.=' WHEN len(x)=1 THEN 'c.'||x[1] ELSE 'c.['||array_to_string(x,';')||']' END AS nt_edit FROM d""")
def coding_edit(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", dna.describe_coding_edit(F.col("wt"), F.col("mutant")).alias("nt_edit"))


@query(f"""WITH p AS (SELECT doc_id, {translated('wt')} AS a, {translated('mutant')} AS b FROM {DNA_SQL}),
d AS (SELECT doc_id, {_DIFF.format(n=10, a='a', b='b', e="substring(a,i,1)||i::VARCHAR||substring(b,i,1)")} AS x FROM p)
SELECT doc_id, CASE WHEN len(x)=0 THEN 'p.=' ELSE array_to_string(x,':') END AS aa_change FROM d""")
def aa_changes(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", dna.describe_residue_changes(dna.translate_dna(F.col("wt")), dna.translate_dna(F.col("mutant"))).alias("aa_change"))


@query(f"SELECT doc_id, reverse(translate(wt,'ACGT','TGCA')) AS rc FROM {DNA_SQL}")
def revcomp(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", dna.reverse_complement(F.col("wt")).alias("rc"))


@query(f"SELECT doc_id, substring(wt,1,3*(doc_id%10)::INT) || substring(mutant,1,3) || substring(wt,3*(doc_id%10)::INT+4) AS edited FROM {DNA_SQL}")
def replace_codon(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", dna.replace_codon(F.col("wt"), F.col("doc_id") % 10 + 1, F.lower(F.substring("mutant", 1, 3))).alias("edited"))


@query(f"""SELECT doc_id, wt AS original, left(wt,4)||'A'||substring(wt,6,5)||'T'||substring(wt,12) AS edited FROM {DNA_SQL}""")
def apply_substitutions(spark, sf_dir):
    m = F.concat(F.substring("wt", 5, 1), F.lit("5A_"), F.substring("wt", 11, 1), F.lit("11T"))
    return _dna(spark, sf_dir).select("doc_id", F.col("wt").alias("original"), dna.apply_substitutions(F.col("wt"), m).alias("edited"))


@query(f"""SELECT doc_id, CASE doc_id%5 WHEN 0 THEN wt WHEN 1 THEN left(wt,3)||'T'||substring(wt,5) WHEN 2 THEN left(wt,3)||substring(wt,7) WHEN 3 THEN left(wt,3)||'AAA'||substring(wt,4) ELSE left(wt,3)||'G'||substring(wt,5,1)||'TAA'||substring(wt,9) END AS mutant_nt FROM {DNA_SQL}""")
def hgvs_apply(spark, sf_dir):
    k = F.col("doc_id") % 5
    edit = F.when(k == 0, F.lit("c.=")).when(k == 1, F.lit("c.4G>T")).when(k == 2, F.lit("c.4_6del")).when(k == 3, F.lit("c.3_4insAAA")).otherwise(F.lit("c.[4A>G;6_8delinsTAA]"))
    return _dna(spark, sf_dir).select("doc_id", hgvs.apply_edit(F.col("wt"), edit).alias("mutant_nt"))


@query(f"""SELECT doc_id, substring(wt,13,3) AS wt_codon, CASE WHEN substring(wt,13,3)='TTC' THEN 'TTT' ELSE 'TTC' END AS codon FROM {DNA_SQL}""")
def designed_codon(spark, sf_dir):
    """The codon at place 13 is designed to code for F; reversed tiles on odd ids. TTC is F whatever it replaces."""
    new = F.when(F.substring("wt", 13, 3) == "TTC", F.lit("TTT")).otherwise(F.lit("TTC"))
    rows = _dna(spark, sf_dir).select("doc_id", "wt", F.concat(F.substring("wt", 1, 12), new, F.substring("wt", 16, 15)).alias("tile"))
    flip = lambda c: F.when(F.col("doc_id") % 2 == 1, dna.reverse_complement(F.col(c))).otherwise(F.col(c))
    found = hgvs.mutant_codon(flip("wt"), flip("tile"), F.substring("wt", 13, 3), F.lit("F"))
    return rows.select("doc_id", F.substring("wt", 13, 3).alias("wt_codon"), found.alias("codon"))


def _genomes(spark, sf_dir) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    n = corpus.full_chunk_counts(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F").withColumnRenamed("o_custkey", "c_custkey")
    tax = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("genus"))
    rows = n.join(c.select("c_custkey", "c_nationkey"), "c_custkey")
    return sampling.with_taxonomy(rows, tax, "c_nationkey").select("c_custkey", "genus", "full_chunks")


GENOMES_SQL = "g AS (SELECT c_custkey, n_name AS genus, full_chunks FROM (SELECT o_custkey AS c_custkey, (count(*) FILTER (o_orderstatus='F'))::BIGINT AS full_chunks FROM orders GROUP BY 1) JOIN customer USING (c_custkey) JOIN nation ON n_nationkey = c_nationkey)"


def _score_sql(purpose: str, value: str) -> str:
    return f"sha256('{SEED}:{purpose}:'||{value})"


SPLITS_SQL = GENOMES_SQL + f""", k AS (SELECT *, CASE WHEN full_chunks<=0 THEN NULL WHEN genus=(SELECT min(n_name) FROM nation) THEN 'escherichia_holdout' ELSE 'other' END AS kind FROM g),
r AS (SELECT *, row_number() OVER (PARTITION BY kind ORDER BY {_score_sql('validation_split', 'c_custkey::VARCHAR')}) AS rk, count(*) OVER (PARTITION BY kind) AS n FROM k),
s AS (SELECT c_custkey, genus, full_chunks, CASE WHEN kind='other' THEN CASE WHEN rk <= floor(n*0.1+0.5) THEN 'validation' ELSE 'train' END ELSE kind END AS split FROM r)"""


@query("SELECT o_custkey, (count(*) FILTER (o_orderstatus='F'))::BIGINT AS full_chunks FROM orders GROUP BY 1")
def genome_counts(spark, sf_dir):
    return corpus.full_chunk_counts(table(spark, sf_dir, "orders"), "o_custkey", F.col("o_orderstatus") == "F")


def _splits(spark, sf_dir) -> DataFrame:
    held = table(spark, sf_dir, "nation").agg(F.min("n_name")).first()[0]
    return sampling.assign_splits(stored(_genomes(spark, sf_dir), "genomes"), "c_custkey", "full_chunks", F.col("genus") == held, 0.1, SEED)


@query(f"WITH {SPLITS_SQL} SELECT * FROM s")
def split_assignment(spark, sf_dir):
    return _splits(spark, sf_dir)


def _target(spark, sf_dir) -> int:
    return table(spark, sf_dir, "orders").count() // 20


QUOTA_SQL = SPLITS_SQL + f""", goal AS (SELECT split, count(*) AS n, CASE WHEN split='train' THEN (SELECT count(*)//20 FROM orders) ELSE floor((SELECT count(*)//20 FROM orders)::DOUBLE/(SELECT count(*) FROM s WHERE split='train')*count(*)+0.5)::BIGINT END AS t FROM s WHERE split IS NOT NULL GROUP BY split),
u AS (SELECT c_custkey, split, unnest(range(0,full_chunks)) AS round, {_score_sql('quota', "split||'_'||c_custkey::VARCHAR")} AS h FROM s WHERE split IS NOT NULL),
o AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY round, h) AS p FROM u),
q AS (SELECT c_custkey, count(*) AS quota FROM o JOIN goal USING (split) WHERE p <= t GROUP BY 1),
w AS (SELECT s.c_custkey, genus, full_chunks, split, coalesce(quota,0)::BIGINT AS selected_chunks FROM s LEFT JOIN q USING (c_custkey))"""


def _quotas(spark, sf_dir) -> DataFrame:
    return sampling.split_quotas(stored(_splits(spark, sf_dir), "splits"), "c_custkey", "full_chunks", _target(spark, sf_dir), SEED)


@query(f"WITH {QUOTA_SQL} SELECT * FROM w")
def waterfill_quota(spark, sf_dir):
    return _quotas(spark, sf_dir)


@query(f"WITH {QUOTA_SQL}, three AS (SELECT unnest(['train','validation','escherichia_holdout']) AS split) SELECT split, count(c_custkey)::BIGINT AS genomes, coalesce(sum(selected_chunks),0)::BIGINT AS chunks, (coalesce(sum(selected_chunks),0)*8192)::BIGINT AS bases FROM three LEFT JOIN w USING (split) GROUP BY split")
def split_stats(spark, sf_dir):
    return sampling.split_statistics(_quotas(spark, sf_dir), corpus.CHUNK)


@query(f"WITH {QUOTA_SQL} SELECT lpad(c_custkey::VARCHAR,12,'0') AS accession, genus, split, full_chunks AS available_full_chunks, selected_chunks FROM w ORDER BY 1")
def manifest(spark, sf_dir):
    q = _quotas(spark, sf_dir)
    return q.select(F.lpad(F.col("c_custkey").cast("string"), 12, "0").alias("accession"), "genus", "split", F.col("full_chunks").alias("available_full_chunks"), "selected_chunks").orderBy("accession")


@query(f"""WITH {QUOTA_SQL}, c AS (SELECT o_orderkey, o_custkey AS c_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey)-1 AS ordinal FROM orders WHERE o_orderstatus='F'),
h AS (SELECT c.*, row_number() OVER (PARTITION BY c_custkey ORDER BY {_score_sql('chunk_selection', "c_custkey::VARCHAR||':'||ordinal::VARCHAR")}) AS r FROM c)
SELECT o_orderkey, c_custkey, ordinal::INT AS ordinal, split FROM h JOIN w USING (c_custkey) WHERE r <= selected_chunks""")
def chunk_selection(spark, sf_dir):
    full = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = sampling.with_ordinals(full, "c_custkey", ["o_orderkey"]).join(_quotas(spark, sf_dir).select("c_custkey", "split", "selected_chunks"), "c_custkey")
    return sampling.hash_selected(rows, "c_custkey", "selected_chunks", SEED).select("o_orderkey", "c_custkey", "ordinal", "split")


@query()
def chunk_selection_numpy(spark, sf_dir):
    """As chunk_selection, by NumPy's permutation: which rows it takes isn't for SQL to say; tests hold it against NumPy."""
    full = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    rows = sampling.with_ordinals(full, "c_custkey", ["o_orderkey"])
    return sampling.selected_rows(rows.withColumn("ordinal", F.col("ordinal").cast("long")), sampling.permuted_ordinals(_quotas(spark, sf_dir), "c_custkey", "full_chunks", "selected_chunks", SEED), "c_custkey")


@query("SELECT c_custkey, n_name AS genus, r_name AS domain FROM customer JOIN nation ON n_nationkey=c_nationkey JOIN region ON r_regionkey=n_regionkey")
def taxonomy_join(spark, sf_dir):
    tax = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.expr("n_regionkey = r_regionkey")).select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("genus"), F.col("r_name").alias("domain"))
    return sampling.with_taxonomy(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), tax, "c_nationkey").select("c_custkey", "genus", "domain")


@query(f"SELECT c_custkey, {_score_sql('split', 'c_custkey::VARCHAR')} AS score, ('0x'||substring({_score_sql('split', 'c_custkey::VARCHAR')},1,15))::BIGINT AS head FROM customer")
def hash_scores(spark, sf_dir):
    s = scores.stable_score(SEED, "split", F.col("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", s.alias("score"), F.floor(scores.seed_from_hash(s) / 16).cast("long").alias("head"))


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS n FROM events) WHERE n=1")
def dedup_keep_first(spark, sf_dir):
    return corpus.keep_first(table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], [F.col("event_id")])


@query("""WITH m AS (SELECT user_id, event_type, avg(value) AS v FROM events GROUP BY 1,2), t AS (SELECT min(event_type) AS a, max(event_type) AS b FROM events), k AS (SELECT m.user_id, max(CASE WHEN event_type=a THEN v END) AS x, max(CASE WHEN event_type=b THEN v END) AS y FROM m, t GROUP BY 1)
SELECT user_id, round((x+y)/2,6) AS score FROM k WHERE x IS NOT NULL AND y IS NOT NULL""")
def replicate_mean(spark, sf_dir):
    """Of the users that have both kinds of events; without that choice a missing replicate would fail the query."""
    e = table(spark, sf_dir, "events")
    kinds = e.agg(F.min("event_type"), F.max("event_type")).first()
    both = e.filter(F.col("event_type").isin(*kinds)).groupBy("user_id").agg(F.count_distinct("event_type").alias("n")).filter("n = 2")
    one = lambda t: e.join(both, "user_id", "left_semi").filter(F.col("event_type") == t).groupBy("user_id").agg(F.avg("value").alias("v"))
    return corpus.replicate_mean(one(kinds[0]), one(kinds[1]), "user_id", "v").withColumn("score", scores.sql_round("score", 6))


@query("SELECT * FROM (UNPIVOT (SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem) ON l_quantity, l_extendedprice, l_discount, l_tax INTO NAME position VALUE score)")
def matrix_unpivot(spark, sf_dir):
    return corpus.unpivoted(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], ["l_quantity", "l_extendedprice", "l_discount", "l_tax"])


def _spearman_sql(t: str, g: str, x: str, y: str) -> str:
    rank = lambda v: f"rank() OVER (PARTITION BY {g} ORDER BY {v}) + (count(*) OVER (PARTITION BY {g},{v})-1)/2.0"
    return f"SELECT {g}, count(*)::BIGINT AS num_variants, covar_pop(a,b)/nullif(stddev_pop(a)*stddev_pop(b),0) AS rho FROM (SELECT {g}, ({rank(x)})::DOUBLE AS a, ({rank(y)})::DOUBLE AS b FROM {t}) GROUP BY 1"


@query(f"SELECT l_returnflag, num_variants, round(rho,9) AS spearman FROM ({_spearman_sql('lineitem', 'l_returnflag', 'l_quantity', 'l_extendedprice')})")
def spearman_by_group(spark, sf_dir):
    r = evaluation.spearman(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_extendedprice")
    return r.withColumn("spearman", scores.sql_round("spearman", 9))


@query(f"SELECT count(*)::BIGINT AS num_studies, sum(num_variants)::BIGINT AS num_variants, round(avg(rho),9) AS spearman FROM ({_spearman_sql('orders', 'o_orderpriority', 'o_totalprice', 'o_custkey')})")
def macro_average(spark, sf_dir):
    r = evaluation.spearman(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_custkey")
    return evaluation.macro_average(r).withColumn("spearman", scores.sql_round("spearman", 9))


@query()
def reported_comparison(spark, sf_dir):
    r = evaluation.spearman(table(spark, sf_dir, "orders"), "o_orderpriority", "o_totalprice", "o_custkey")
    names = sorted(x[0] for x in table(spark, sf_dir, "orders").select("o_orderpriority").distinct().collect())
    out = evaluation.compared(r, {n: round(0.1 * (i + 1), 1) for i, n in enumerate(names)}, 0.3, "o_orderpriority")
    return out.select("o_orderpriority", "num_variants", scores.sql_round("spearman", 9).alias("spearman"), "reported_spearman", scores.sql_round("difference", 9).alias("difference"))


ORACLE["reported_comparison"] = f"""WITH r AS ({_spearman_sql('orders', 'o_orderpriority', 'o_totalprice', 'o_custkey')}), p AS (SELECT o_orderpriority, round(0.1*row_number() OVER (ORDER BY o_orderpriority),1)::DOUBLE AS rep FROM r)
SELECT o_orderpriority, num_variants, round(rho,9) AS spearman, rep AS reported_spearman, round(rho-rep,9) AS difference FROM r JOIN p USING (o_orderpriority)
UNION ALL SELECT 'macro_average', sum(num_variants)::BIGINT, round(avg(rho),9), 0.3::DOUBLE, round(avg(rho)-0.3,9) FROM r"""


@query("SELECT n_name, first_ordinal, row_number() OVER (ORDER BY first_ordinal, n_name)::INT AS position FROM (SELECT n_name, min(c_custkey) AS first_ordinal FROM customer JOIN nation ON n_nationkey=c_nationkey GROUP BY 1)")
def first_seen_index(spark, sf_dir):
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.expr("c_nationkey = n_nationkey"))
    return corpus.first_seen_index(rows, "n_name", "c_custkey")


@query("WITH f AS (SELECT p_brand, p_size, arg_min(p_type, p_partkey) AS v, count(DISTINCT p_type) AS n FROM part GROUP BY 1,2) SELECT p_brand, string_agg(v,'' ORDER BY p_size) AS joined, count(*) FILTER (n>1)::BIGINT AS n_variants FROM f GROUP BY 1")
def wt_concat(spark, sf_dir):
    return corpus.concatenated(table(spark, sf_dir, "part"), ["p_brand"], "p_size", "p_partkey", "p_type")


@query(f"SELECT doc_id, unnest(range(0,8))::INT AS window_no, substring(wt, 4*unnest(range(0,8))+1, 4) AS \"window\" FROM {DNA_SQL}")
def window_split(spark, sf_dir):
    return corpus.sequence_windows(_dna(spark, sf_dir).select("doc_id", F.col("wt").alias("sequence")), 4)


@query(f"SELECT doc_id, list_transform(range(1,31), lambda i: (instr('ACGT',substring(wt,i,1))-1)::BIGINT) AS input_ids FROM {DNA_SQL}")
def tokenize(spark, sf_dir):
    return _dna(spark, sf_dir).select("doc_id", dna.tokens(F.col("wt")).alias("input_ids"))


@query(f"WITH t AS (SELECT doc_id, doc_id//8 AS batch_no, list_transform(range(1,31), lambda i: (instr('ACGT',substring(wt,i,1))-1)::BIGINT) AS x FROM {DNA_SQL}) SELECT batch_no::BIGINT AS batch_no, list(x ORDER BY doc_id) AS input_ids FROM t GROUP BY 1")
def token_batches(spark, sf_dir):
    return corpus.token_batches(_dna(spark, sf_dir).select("doc_id", F.col("wt").alias("window")), 8, "doc_id")


def _codebook(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(16).select((F.row_number().over(Window.orderBy("vec_id")) - 1).alias("code"), F.col("embedding").alias("vector"))


CODES_SQL = """b AS (SELECT row_number() OVER (ORDER BY vec_id)-1 AS code, embedding::DOUBLE[] AS v FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT 16)),
d AS (SELECT vec_id, code, list_sum(list_transform(range(1,len(v)+1), lambda i: (e[i]-v[i])*(e[i]-v[i]))) AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), b),
a AS (SELECT vec_id, code FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, code) AS n FROM d) WHERE n=1),
h AS (SELECT c::INT AS code, count(vec_id)::BIGINT AS n FROM (SELECT unnest(range(0,16)) AS c) LEFT JOIN a ON a.code=c GROUP BY 1)"""


def _assigned(spark, sf_dir) -> DataFrame:
    return vq.nearest_code(table(spark, sf_dir, "embeddings"), _codebook(spark, sf_dir), "vec_id", "embedding")


@query(f"WITH {CODES_SQL} SELECT vec_id, code::INT AS code FROM a")
def nearest_code(spark, sf_dir):
    return _assigned(spark, sf_dir).select("vec_id", "code")


#: Bins of the scales that embeddings, as 8 positions of 8 numbers, are quantized at; each scale's 8 codes are other vectors' beginnings.
BINS = (1, 2, 8)


def _books(spark, sf_dir) -> list[tuple[int, list[list[float]]]]:
    rows = [r[0] for r in table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(8 * len(BINS)).select(F.transform(F.slice("embedding", 1, 8), lambda x: x.cast("double"))).collect()]
    return [(n, rows[8 * k : 8 * k + 8]) for k, n in enumerate(BINS)]


def _positions(spark, sf_dir) -> DataFrame:
    at = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda p: F.slice("embedding", p * 8 + 1, F.lit(8)))
    return table(spark, sf_dir, "embeddings").select("vec_id", at.alias("values"))


def _scale_sql(k: int, n: int) -> str:
    """One scale of residual quantization: codes, what their vectors give at 8 positions, and what is left."""
    pool = f"list_transform(range(0,{n}), lambda b: list_transform(range(1,9), lambda d: list_avg(list_transform(range((b*8)//{n}+1, -((-(b+1)*8)//{n})+1), lambda p: r[p][d]))))"
    code = f"list_transform({pool}, lambda v: list_transform(b{k}, lambda c: list_sum(list_transform(range(1,9), lambda j: (v[j]-c[j])*(v[j]-c[j])))))"
    at = f"greatest((p+0.5)*{n}/8-0.5, 0)"
    lo, hi = f"least(floor({at})::INT,{n - 1})", f"least(floor({at})::INT+1,{n - 1})"
    up = f"list_transform(range(0,8), lambda p: list_transform(range(1,9), lambda d: q[{lo}+1][d] + (q[{hi}+1][d]-q[{lo}+1][d])*({at}-{lo})))"
    left = "list_transform(range(1,9), lambda p: list_transform(range(1,9), lambda d: r[p][d]-u[p][d]))"
    return f"""c{k} AS (SELECT vec_id, r, list_transform({code}, lambda x: (list_position(x, list_min(x))-1)::INT) AS codes FROM r{k}, books), q{k} AS (SELECT vec_id, r, codes, list_transform(codes, lambda c: b{k}[c+1]) AS q FROM c{k}, books),
u{k} AS (SELECT vec_id, r, codes, {up} AS u FROM q{k}), r{k + 1} AS (SELECT vec_id, codes, u, {left} AS r FROM u{k})"""


RESIDUAL_SQL = f"""n AS (SELECT row_number() OVER (ORDER BY vec_id)-1 AS i, embedding[1:8]::DOUBLE[] AS v FROM (SELECT * FROM embeddings ORDER BY vec_id LIMIT {8 * len(BINS)})),
books AS (SELECT {", ".join(f"list(v ORDER BY i) FILTER (i//8={k}) AS b{k}" for k in range(len(BINS)))} FROM n),
r0 AS (SELECT vec_id, list_transform(range(0,8), lambda p: embedding[p*8+1:p*8+8]::DOUBLE[]) AS r FROM embeddings), {", ".join(_scale_sql(k, n) for k, n in enumerate(BINS))}"""


@query(f"WITH {RESIDUAL_SQL} " + " UNION ALL ".join(f"SELECT vec_id, {k} AS scale, codes, round(list_sum(list_transform(flatten(r), lambda x: x*x))/64, 9) AS mse FROM r{k + 1}" for k in range(len(BINS))))
def residual_codes(spark, sf_dir):
    out = vq.residual_codes(_positions(spark, sf_dir), "vec_id", "values", 8, _books(spark, sf_dir))
    return out.select("vec_id", "scale", "codes", scores.sql_round("mse", 9).alias("mse"))


@query(f"WITH {RESIDUAL_SQL}, s AS (" + " UNION ALL ".join(f"SELECT vec_id, {k} AS scale, flatten(u) AS u FROM r{k + 1}" for k in range(len(BINS))) + """), e AS (SELECT vec_id, scale, i, u[i] AS x FROM (SELECT *, unnest(range(1,65)) AS i FROM s)), t AS (SELECT vec_id, scale, i, sum(x) OVER (PARTITION BY vec_id, i ORDER BY scale) AS x FROM e)
SELECT vec_id, scale, round(sum(x*x),7) AS energy, round(sum(x*i),6) AS moment FROM t GROUP BY 1, 2""")
def cumulative_decode(spark, sf_dir):
    """What is decoded up to each scale, told by two sums over its numbers."""
    books = _books(spark, sf_dir)
    out = vq.decoded(vq.residual_codes(_positions(spark, sf_dir), "vec_id", "values", 8, books), "vec_id", 8, books)
    flat = F.flatten("values")
    energy = F.aggregate(flat, F.lit(0.0), lambda s, x: s + x * x)
    moment = F.aggregate(F.transform(flat, lambda x, i: x * (i + 1)), F.lit(0.0), lambda s, x: s + x)
    return out.select("vec_id", "scale", scores.sql_round(energy, 7).alias("energy"), scores.sql_round(moment, 6).alias("moment"))


@query(f"WITH {CODES_SQL} SELECT * FROM h")
def code_histogram(spark, sf_dir):
    return vq.code_histogram(_assigned(spark, sf_dir), 16)


@query(f"WITH {CODES_SQL} SELECT round(exp(-sum(p*ln(p))),6) AS perplexity FROM (SELECT n/(SELECT sum(n) FROM h) AS p FROM h WHERE n>0)")
def perplexity(spark, sf_dir):
    return vq.perplexity(vq.code_histogram(_assigned(spark, sf_dir), 16)).select(scores.sql_round("perplexity", 6).alias("perplexity"))


@query(f"WITH {CODES_SQL} SELECT (count(*) FILTER (n>0))::DOUBLE/count(*) AS utilization, (count(*) FILTER (n>0))::BIGINT AS codes_used FROM h")
def utilization(spark, sf_dir):
    return vq.utilization(vq.code_histogram(_assigned(spark, sf_dir), 16))


@query(f"""WITH {CODES_SQL}, x AS (SELECT vec_id, unnest(range(0,len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings),
s AS (SELECT code, dim, sum(x) AS total FROM x JOIN a USING (vec_id) GROUP BY 1,2),
st AS (SELECT code::INT AS code, unnest(range(0,len(v))) AS dim, unnest(v) AS v FROM b),
e AS (SELECT st.code, st.dim, 0.99+0.01*n AS c, 0.99*v+0.01*coalesce(total,0) AS m, n FROM st JOIN h ON h.code=st.code LEFT JOIN s ON s.code=st.code AND s.dim=st.dim),
t AS (SELECT sum(c) AS al FROM e WHERE dim=0)
SELECT code::INT AS code, dim::INT AS dim, round(c,6) AS ema_count, round(m/((c+1e-5)/(al+16e-5)*al),6) AS value, TRUE AS hit FROM e, t""")
def ema_update(spark, sf_dir):
    v, book = table(spark, sf_dir, "embeddings"), _codebook(spark, sf_dir)
    a = vq.nearest_code(v, book, "vec_id", "embedding")
    state = book.select("code", F.posexplode(F.col("vector").cast("array<double>")).alias("dim", "ema_sum")).select("code", "dim", F.lit(1.0).alias("ema_count"), "ema_sum", F.lit(True).alias("hit"))
    out = vq.ema_update(state, vq.code_histogram(a, 16), vq.vector_sums(v.join(a, "vec_id"), "embedding"), 0.99)
    return out.select("code", "dim", scores.sql_round("ema_count", 6).alias("ema_count"), scores.sql_round("value", 6).alias("value"), "hit")


@query("SELECT vec_id, list_transform(range(0,12), lambda i: round(list_avg(e[i*64//12+1:((i+1)*64+11)//12]),6)) AS pooled FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def area_pool(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(vq.area_pool(F.col("embedding"), 12), lambda x: scores.sql_round(x, 6)).alias("pooled"))


@query("""WITH p AS (SELECT i, greatest((i+0.5::DOUBLE)*64/100-0.5::DOUBLE,0::DOUBLE) AS t FROM range(0,100) r(i)), q AS (SELECT list(floor(t)::INT ORDER BY i) AS lo, list(least(floor(t)::INT+1,63) ORDER BY i) AS hi, list(t-floor(t) ORDER BY i) AS w FROM p)
SELECT vec_id, list_transform(range(1,101), lambda k: floor((e[lo[k]+1] + (e[hi[k]+1] - e[lo[k]+1]) * w[k])*100000+0.5::DOUBLE)/100000) AS up FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), q""")
def linear_upsample(spark, sf_dir):
    """Cut to five places by floor() on both sides: rounding halves differs between engines."""
    cut = lambda x: F.floor(x * 100000 + F.lit(0.5)).cast("double") / 100000
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(vq.linear_upsample(F.col("embedding"), 100), cut).alias("up"))


@query("SELECT vec_id, list_transform(e, lambda x: round((x-list_avg(e))/sqrt(list_var_pop(e)+1e-5),5)) AS norm FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def layer_norm(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.transform(vq.layer_norm(F.col("embedding")), lambda x: scores.sql_round(x, 5)).alias("norm"))


@query("""SELECT s::BIGINT AS step, round(3e-4*CASE WHEN s<10 THEN (s+1)/11.0 WHEN s>=100 THEN 0.1 ELSE 0.1+0.5*(1+cos(pi()*(s-10)/90.0))*0.9 END,12) AS lr FROM range(0,120) t(s)""")
def lr_schedule(spark, sf_dir):
    return spark.range(120).select(F.col("id").alias("step"), scores.sql_round(vq.learning_rate(F.col("id"), 10, 100, 3e-4, 3e-5), 12).alias("lr"))


@query(f"WITH {CODES_SQL} SELECT vec_id, a.code::INT AS code, v AS vector FROM a JOIN b ON a.code = b.code")
def code_lookup(spark, sf_dir):
    book = _codebook(spark, sf_dir).withColumn("vector", F.col("vector").cast("array<double>"))
    return vq.code_vectors(_assigned(spark, sf_dir).select("vec_id", "code"), book)


def _batch_sql(first: str) -> str:
    return f"SELECT l_returnflag, count(*)::BIGINT AS batches, round(avg(loss),9) AS loss FROM (SELECT l_returnflag, l_orderkey//64 AS k, avg(l_discount*l_discount) AS loss FROM lineitem {first} GROUP BY 1,2) GROUP BY 1"


@query(_batch_sql(""))
def batch_losses(spark, sf_dir):
    """The mean over batches of 64 orders, not over rows."""
    return vq.batch_means(table(spark, sf_dir, "lineitem"), "l_orderkey", 64, {"loss": F.col("l_discount") * F.col("l_discount")}, ["l_returnflag"]).withColumn("loss", scores.sql_round("loss", 9))


@query(_batch_sql("WHERE l_orderkey//64 < 5"))
def first_batch_losses(spark, sf_dir):
    return vq.batch_means(table(spark, sf_dir, "lineitem"), "l_orderkey", 64, {"loss": F.col("l_discount") * F.col("l_discount")}, ["l_returnflag"], 5).withColumn("loss", scores.sql_round("loss", 9))


@query("SELECT l_linestatus, count(*)::BIGINT AS n, avg(CASE WHEN (l_quantity >= 25) = (l_returnflag = 'N') THEN 1.0 ELSE 0.0 END)::DOUBLE AS accuracy FROM lineitem GROUP BY 1")
def accuracy_by_group(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select("l_linestatus", (F.col("l_returnflag") == "N").alias("truth"), (F.col("l_quantity") >= 25).alias("guess"))
    return evaluation.accuracy(rows, "truth", "guess", ["l_linestatus"])


@query("""WITH x AS (SELECT vec_id, unnest(range(0,len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings), s AS (SELECT unnest(range(0,4)) AS scale),
p AS (SELECT vec_id, dim, scale, x, x*(2*scale+1)/16 AS part FROM x, s), c AS (SELECT scale, x - sum(part) OVER (PARTITION BY vec_id, dim ORDER BY scale) AS gap FROM p)
SELECT scale::INT AS scale, round(avg(gap*gap),9) AS mse FROM c GROUP BY 1""")
def cumulative_errors(spark, sf_dir):
    """Parts of 1, 3, 5 and 7 sixteenths of each component: what is left shrinks to nothing at the last scale."""
    x = table(spark, sf_dir, "embeddings").select("vec_id", F.posexplode(F.col("embedding").cast("array<double>")).alias("dim", "x"))
    parts = x.withColumn("scale", F.explode(F.sequence(F.lit(0), F.lit(3)))).withColumn("part", F.col("x") * (2 * F.col("scale") + 1) / 16)
    return vq.cumulative_errors(parts, ["vec_id", "dim"], "scale", "x", "part").withColumn("mse", scores.sql_round("mse", 9))


@query("SELECT doc_id, (row_number() OVER (ORDER BY doc_id)-1)::BIGINT AS place, ((row_number() OVER (ORDER BY doc_id)-1)%4)::INT AS rank FROM documents")
def rank_split(spark, sf_dir):
    """Dealt by each row's place among all, whatever its id."""
    return corpus.dealt(corpus.with_place(table(spark, sf_dir, "documents").select("doc_id"), "doc_id"), 4, "place")


@query(f"""SELECT doc_id, round(list_sum(list_transform(['A','C','G','T'], lambda b: CASE WHEN wt LIKE '%'||b||'%' THEN (30-length(replace(wt,b,'')))*ln((30-length(replace(wt,b,'')))/30.0) ELSE 0 END))/30,9) AS evo_log_likelihood FROM {DNA_SQL}""")
def model_scores(spark, sf_dir):
    return evaluation.scored(_dna(spark, sf_dir).select("doc_id", "wt"), "wt", evaluation.base_frequency_scorer).select("doc_id", scores.sql_round("evo_log_likelihood", 9).alias("evo_log_likelihood"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id=d.doc_id)")
def pending_rows(spark, sf_dir):
    return evaluation.pending(table(spark, sf_dir, "documents").select("doc_id"), table(spark, sf_dir, "labels"), ["doc_id"])


@query("SELECT l_returnflag, sqrt(avg(l_discount*l_discount)) AS rms FROM lineitem GROUP BY 1".replace("sqrt(avg(l_discount*l_discount))", "round(sqrt(avg(l_discount*l_discount)),9)"))
def rms_by_group(spark, sf_dir):
    return vq.rms(table(spark, sf_dir, "lineitem"), F.array("l_discount"), ["l_returnflag"]).withColumn("rms", scores.sql_round("rms", 9))


# The operators on DNA text over whole texts: two bases a byte, trimmed to whole codons. The queries above keep the 30 bases
# that their SQL is about.
TEXT_MUTANT = BASES[:7] + "A" + BASES[8:]


def _text_dna(spark, sf_dir, *names: str) -> DataFrame:
    """doc_id and of wt and mutant those named (both, if none is) of the whole text; mutant has A where the text's hexadecimal digit is 7.

    A byte's two bases are looked up on Arrow batches: column functions look at each digit several times as long, and Spark
    would work them out again wherever a sequence is read.
    """
    bounded(spark)
    names = names or ("wt", "mutant")
    digits = [np.frombuffer({"wt": BASES, "mutant": TEXT_MUTANT}[n].encode(), np.uint8) for n in names]
    pairs = [np.stack([np.repeat(d, 16), np.tile(d, 16)], 1) for d in digits]

    def bases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, data = flat(b.column(1))
            n = 2 * np.diff(at)
            yield pa.RecordBatch.from_arrays([b.column(0), *(texts(whole_codons(p[data].ravel(), n), n - n % 3, b.column(1).is_valid()) for p in pairs)], names=["doc_id", *names])

    rows = table(spark, sf_dir, "documents").select("doc_id", "text")
    schema = StructType([rows.schema["doc_id"], *(StructField(n, StringType()) for n in names)])
    return rows.mapInArrow(bases, schema)


_TRIMMED_SQL = "left(hex(text),length(hex(text))-length(hex(text))%3)"
TEXT_DNA_SQL = f"(SELECT doc_id, translate({_TRIMMED_SQL},'{HEX.upper()}','{BASES}') AS wt, translate({_TRIMMED_SQL},'{HEX.upper()}','{TEXT_MUTANT}') AS mutant FROM documents)"
_TEXT_AA_SQL = "array_to_string(list_transform(regexp_extract_all({s},'...'), lambda c: " + CODON_SQL.format(c="c") + "),'')"


@query(f"SELECT doc_id, {_TEXT_AA_SQL.format(s='wt')} AS wt_aa, {_TEXT_AA_SQL.format(s='mutant')} AS mutant_aa FROM {TEXT_DNA_SQL}")
def dna_translate_text(spark, sf_dir):
    return _text_dna(spark, sf_dir).select("doc_id", dna.translate_dna(F.col("wt")).alias("wt_aa"), dna.translate_dna(F.col("mutant")).alias("mutant_aa"))


@query()
def coding_edit_text(spark, sf_dir):
    return _text_dna(spark, sf_dir).select("doc_id", dna.describe_coding_edit(F.col("wt"), F.col("mutant")).alias("nt_edit"))


@query()
def aa_changes_text(spark, sf_dir):
    return _text_dna(spark, sf_dir).select("doc_id", dna.describe_residue_changes(dna.translate_dna(F.col("wt")), dna.translate_dna(F.col("mutant"))).alias("aa_change"))


@query(f"SELECT doc_id, reverse(translate(wt,'ACGT','TGCA')) AS rc FROM {TEXT_DNA_SQL}")
def revcomp_text(spark, sf_dir):
    return _text_dna(spark, sf_dir, "wt").select("doc_id", dna.reverse_complement(F.col("wt")).alias("rc"))


def _coding(spark, sf_dir) -> DataFrame:
    """_text_dna's rows with a codon at least, and n, their length."""
    return _text_dna(spark, sf_dir, "wt").withColumn("n", F.length("wt")).filter("n > 0")


@query()
def replace_codon_text(spark, sf_dir):
    place = (F.pmod("doc_id", F.expr("cast(n / 3 as int)")) + 1).cast("int")
    return _coding(spark, sf_dir).select("doc_id", dna.replace_codon(F.col("wt"), place, F.lit("tag")).alias("edited"))


@query()
def apply_substitutions_text(spark, sf_dir):
    """The middle base becomes A, then the last one T."""
    base = lambda at: F.concat(F.substring(F.col("wt"), at, F.lit(1)), at.cast("string"))
    m = F.concat(base(F.expr("cast(n / 2 as int)")), F.lit("A_"), base(F.col("n")), F.lit("T"))
    return _coding(spark, sf_dir).select("doc_id", F.col("wt").alias("original"), dna.apply_substitutions(F.col("wt"), m).alias("edited"))


@query()
def hgvs_apply_text(spark, sf_dir):
    """Edits at the sequence's end, by doc_id: none, substitution, deletion, insertion, two edits."""
    k, s = F.pmod("doc_id", F.lit(5)), lambda back: (F.col("n") - back).cast("string")
    edit = F.when(k == 0, F.lit("c.=")).when(k == 1, F.concat(F.lit("c."), s(0), F.lit("G>T"))).when(k == 2, F.concat(F.lit("c."), s(2), F.lit("_"), s(0), F.lit("del")))
    edit = edit.when(k == 3, F.concat(F.lit("c."), s(0), F.lit("_"), s(-1), F.lit("insAAA"))).otherwise(F.concat(F.lit("c.[1A>G;"), s(1), F.lit("_"), s(0), F.lit("delinsTAA]")))
    return _coding(spark, sf_dir).select("doc_id", hgvs.apply_edit(F.col("wt"), edit).alias("mutant_nt"))


@query()
def designed_codon_text(spark, sf_dir):
    """The middle codon is designed to code for F, in tiles of the whole text; reversed tiles on odd ids."""
    at = F.expr("3 * cast(n / 6 as int) + 1")
    rows = _coding(spark, sf_dir).withColumn("wt_codon", F.substring(F.col("wt"), at, F.lit(3)))
    rows = rows.withColumn("tile", F.overlay("wt", F.when(F.col("wt_codon") == "TTC", F.lit("TTT")).otherwise(F.lit("TTC")), at, F.lit(3)))
    flip = lambda c: F.when(F.pmod("doc_id", F.lit(2)) == 1, dna.reverse_complement(F.col(c))).otherwise(F.col(c))
    return rows.select("doc_id", "wt_codon", hgvs.mutant_codon(flip("wt"), flip("tile"), F.col("wt_codon"), F.lit("F")).alias("codon"))


def _text_windows(spark, sf_dir) -> DataFrame:
    return corpus.sequence_windows(_text_dna(spark, sf_dir, "wt").select("doc_id", F.col("wt").alias("sequence")), corpus.CHUNK)


@query(f"SELECT doc_id, (o//{corpus.CHUNK})::INT AS window_no, substring(wt, o+1, {corpus.CHUNK}) AS \"window\" FROM (SELECT doc_id, wt, unnest(range(0,length(wt),{corpus.CHUNK})) AS o FROM {TEXT_DNA_SQL})")
def window_split_text(spark, sf_dir):
    return _text_windows(spark, sf_dir)


@query(f"SELECT doc_id, list_transform(regexp_extract_all(wt,'.'), lambda c: (instr('ACGT',c)-1)::BIGINT) AS input_ids FROM {TEXT_DNA_SQL}")
def tokenize_text(spark, sf_dir):
    return _text_dna(spark, sf_dir, "wt").select("doc_id", dna.tokens(F.col("wt")).alias("input_ids"))


@query()
def token_batches_text(spark, sf_dir):
    """Eight windows of a text a batch; a shorter last window is a batch of its own. A text has fewer than 2**18 windows."""
    place = F.col("doc_id") * (1 << 19) + F.when(F.length("window") < corpus.CHUNK, F.lit(1 << 18)).otherwise(F.col("window_no"))
    return corpus.token_batches(_text_windows(spark, sf_dir).select("window", place.alias("place")), 8, "place")


@query(f"""SELECT doc_id, CASE WHEN n=0 THEN 0.0 ELSE round(list_sum(list_transform(['A','C','G','T'], lambda b: CASE WHEN contains(wt,b) THEN (n-length(replace(wt,b,'')))*ln((n-length(replace(wt,b,'')))/n::DOUBLE) ELSE 0 END))/n,9) END AS evo_log_likelihood FROM (SELECT *, length(wt) AS n FROM {TEXT_DNA_SQL})""")
def model_scores_text(spark, sf_dir):
    return evaluation.scored(_text_dna(spark, sf_dir, "wt"), "wt", evaluation.base_frequency_scorer).select("doc_id", scores.sql_round("evo_log_likelihood", 9).alias("evo_log_likelihood"))
