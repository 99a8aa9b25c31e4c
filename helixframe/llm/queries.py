"""The queries opN_<name> over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from helixframe.llm import bpe, decontaminate, html_extract, licenses, merkle, minhash, mixing, repair, secrets, topk, toxicity, warc, whitening
from helixframe.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.secret_spans(table(spark, sf_dir, "documents")))


def op2_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.main_text(table(spark, sf_dir, "pages"))


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.edited_pairs(table(spark, sf_dir, "documents"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.groups(table(spark, sf_dir, "documents"), k=4)


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(mixing.sized(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))).drop("text")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.encode(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep_ids=False)


def op11_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(table(spark, sf_dir, "conversations"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


# What SQL can say of five results: the same operators with the same parameters, fewer columns.


def base_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op1_secrets(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")


def edited_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether fingerprints are equal just where the texts are stands in the last two columns."""
    out = op4_fingerprints(spark, sf_dir)
    return out.select("doc_id", "n_chars", "edited_sha256", (F.col("near_edited") == 1).alias("same_edited"), (F.col("near_next") == 1).alias("same_next"))


def mix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The excess of taken words over twice the size is 0 everywhere; each source's taken words are a row's distance from its target at most."""
    return op6_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 6).alias("target"), F.greatest(F.col("taken") - 2 * F.col("size"), F.lit(0)).cast("long").alias("excess"))


def base_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op8_licenses(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


def vector_deviations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return op12_whitening(spark, sf_dir).filter("component = 1").select("vec_id", "n", "deviation")


QUERIES: dict[str, Query] = {
    "op1_secrets": op1_secrets,
    "op2_html": op2_html,
    "op3_topk": op3_topk,
    "op4_fingerprints": op4_fingerprints,
    "op5_minhash": op5_minhash,
    "op6_mixing": op6_mixing,
    "op7_warc": op7_warc,
    "op8_licenses": op8_licenses,
    "op9_toxicity": op9_toxicity,
    "op10_bpe": op10_bpe,
    "op11_repair": op11_repair,
    "op12_whitening": op12_whitening,
    "op13_decontamination": op13_decontamination,
    "base_secrets": base_secrets,
    "edited_texts": edited_texts,
    "mix_targets": mix_targets,
    "base_licenses": base_licenses,
    "vector_deviations": vector_deviations,
}

_ASSIGN = r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])[\"'']?\x20*[:=]\x20*[\"'']?)([A-Za-z0-9+/_.=-]+)"""


def _spans_sql(kind: str, no: int, pattern: str, part: int, least: int) -> str:
    """Spans of one kind: starts add up what stands between matches and the matches before."""
    return f"""(SELECT doc_id, {no} AS no, '{kind}' AS kind, unnest(list_filter(list_transform(range(1, len(m)+1), lambda i: {{'s': (list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0))::BIGINT,
'n': length(m[i]), 'p': length(p[i])}}), lambda x: x.p >= {least})) AS x FROM (SELECT doc_id, string_split_regex(t, '{pattern}') AS g, regexp_extract_all(t, '{pattern}', 0) AS m, regexp_extract_all(t, '{pattern}', {part}) AS p FROM d WHERE regexp_matches(t, '{pattern}')))"""


_WORD_SQL = "regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
_PHRASE_SQL = "list_transform(list_filter(range(1, len(w)+1), lambda i: {tests}), lambda i: {{'i': i-1, 'l': '{label}'}})"


def _phrase_sql(phrase: str, label: str) -> str:
    return _PHRASE_SQL.format(tests=" AND ".join(f"w[i+{k}] = '{x}'" for k, x in enumerate(phrase.split())), label=label)


#: Queries that SQL expresses in full. The others add spans, labels, fingerprints, samples, models or token ids that it
#: can't; tests hold those against brute force, round trips or held-out labels.
ORACLE: dict[str, str] = {
    "op3_topk": """WITH v AS (SELECT vec_id, list_transform(embedding::DOUBLE[], lambda x: floor(256*x)::BIGINT) AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.t)+1), lambda i: q.t[i]*c.t[i]))::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s)
SELECT query_id, n::INT AS rank, vec_id, score FROM r WHERE n <= 5""",
    "op5_minhash": """WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i+3],' ') AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w)-3,1)+1)) AS i FROM d WHERE len(w) > 0)),
z AS (SELECT doc_id, count(*)::BIGINT AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN z x ON a = x.doc_id JOIN z y ON b = y.doc_id WHERE 100*i >= 80*(x.n+y.n-i)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS c FROM d UNION SELECT r.doc_id, e.b FROM r JOIN e ON r.c = e.a)
SELECT r.doc_id, coalesce(any_value(n),0)::BIGINT AS n_shingles, min(c) AS component_id, r.doc_id = min(c) AS kept FROM r LEFT JOIN z USING (doc_id) GROUP BY r.doc_id""",
    "op7_warc": """WITH p AS (SELECT page_id, url, sha256(coalesce(html,'')) AS d, octet_length(encode(coalesce(html,'')))::BIGINT AS n FROM pages),
f AS (SELECT d, min(page_id) AS m FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, d AS payload_digest, CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN m IS NOT NULL AND page_id IS DISTINCT FROM m THEN m END AS refers_to, TRUE AS digest_ok, url FROM p LEFT JOIN f USING (d)""",
    "base_secrets": f"""WITH d AS (SELECT doc_id, coalesce(text,'') AS t FROM documents), s AS ({_spans_sql("assign", 0, _ASSIGN, 2, 8)} UNION ALL {_spans_sql("access", 1, "AKIA[A-Z0-9]+", 0, 16)} UNION ALL {_spans_sql("hex", 2, "[0-9a-f]+", 0, 32)})
SELECT d.doc_id, count(*) FILTER (no=0)::BIGINT AS n_assign, count(*) FILTER (no=1)::BIGINT AS n_access, count(*) FILTER (no=2)::BIGINT AS n_hex, sha256(coalesce(string_agg(kind||':'||x.s||':'||(x.s+x.n), ',' ORDER BY x.s, no), '')) AS base_sha256 FROM d LEFT JOIN s USING (doc_id) GROUP BY d.doc_id""",
    "edited_texts": """WITH d AS (SELECT doc_id, coalesce(text,'') AS t, length(coalesce(text,''))::BIGINT AS n FROM documents), o AS (SELECT *, coalesce(lead(t) OVER (ORDER BY doc_id), first_value(t) OVER (ORDER BY doc_id)) AS x FROM d), e AS (SELECT *, left(t, n-n//4)||left(x, n//4) AS y FROM o)
SELECT doc_id, n AS n_chars, sha256(y) AS edited_sha256, y = t AS same_edited, x = t AS same_next FROM e""",
    "mix_targets": """WITH RECURSIVE d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text,''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::DOUBLE AS z, [3.0,1.0,2.0][((row_number() OVER (ORDER BY source NULLS LAST)-1)%3+1)::INT]::DOUBLE AS w FROM d GROUP BY 1),
r AS (SELECT 0 AS k, source, z, w, false AS full_, 1.5*sum(z) OVER ()/sum(w) OVER () AS level FROM s
UNION ALL SELECT k+1, source, z, w, f, CASE WHEN sum(CASE WHEN f THEN 0 ELSE w END) OVER () > 0 THEN (1.5*sum(z) OVER () - sum(CASE WHEN f THEN 2*z ELSE 0 END) OVER ())/sum(CASE WHEN f THEN 0 ELSE w END) OVER () ELSE 0 END
FROM (SELECT *, full_ OR level*w > 2*z AS f FROM r WHERE k < 12)),
g AS (SELECT source, z::BIGINT AS source_size, round(CASE WHEN full_ THEN 2*z ELSE level*w END, 6) AS target FROM r WHERE k = 12)
SELECT doc_id, size, source_size, target, 0::BIGINT AS excess FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source""",
    "base_licenses": f"""WITH d AS (SELECT doc_id, {_WORD_SQL} AS w FROM documents), h AS (SELECT doc_id, len(w)::BIGINT AS n, {" || ".join(_phrase_sql(p, label) for p, label in licenses.BASE.items())} AS h FROM d)
SELECT doc_id, n AS n_words, len(h)::BIGINT AS n_base, list_min(list_transform(h, lambda x: x.i))::BIGINT AS first_word, list_max(list_transform(h, lambda x: x.i))::BIGINT AS last_word, array_to_string(list_sort(list_distinct(list_transform(h, lambda x: x.l))), ',') AS base_labels FROM h""",
    "op13_decontamination": f"""WITH d AS (SELECT doc_id, {_WORD_SQL} AS w FROM documents), b AS (SELECT coalesce(item_id::VARCHAR,'') AS item, {_WORD_SQL} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(len(w),10) AS n, array_to_string(w[i:i+9],' ') AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w)-9,1)+1)) AS i FROM b WHERE len(w) > 0)),
p AS (SELECT doc_id, i, n, array_to_string(w[i:i+n-1],' ') AS x FROM (SELECT doc_id, w, unnest(range(1, len(w)+1)) AS i FROM d), (SELECT DISTINCT n FROM win) WHERE i+n-1 <= len(w)),
h AS (SELECT doc_id, i, n, item FROM p JOIN win USING (n, x)),
c AS (SELECT doc_id, count(DISTINCT j)::BIGINT AS n_hit FROM (SELECT doc_id, unnest(range(i, i+n)) AS j FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*)::BIGINT AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS items_sha256 FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit,0) AS n_hit, coalesce(n_items,0) AS n_items, coalesce(items_sha256, sha256('')) AS items_sha256, n_hit IS NOT NULL AS contaminated FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)""",
    "vector_deviations": """WITH v AS (SELECT row_number() OVER () AS k, vec_id, list_transform(embedding::DOUBLE[], lambda c: floor(1024*c)::BIGINT + 100000) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
e AS (SELECT k, vec_id, i, x[i] AS x FROM (SELECT *, unnest(range(1, len(x)+1)) AS i FROM v)), s AS (SELECT i, count(*) AS n, sum(x) AS t FROM e GROUP BY 1)
SELECT any_value(vec_id) AS vec_id, any_value(n)::BIGINT AS n, sum((n*x-t)*(n*x-t))::BIGINT AS deviation FROM e JOIN s USING (i) GROUP BY k""",
}
