"""The thin queries of the corpus operators, with SQL twins where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.llm import decontam, jaccard, linededup, lm, matroska, mixing, quality, tokenfile, urllist, warc
from fragmenta.llm._shared import table


def op1_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.store_texts(table(spark, sf_dir, "documents"))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_classes(table(spark, sf_dir, "documents"))


OP3_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) END) AS sh FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a AS u, b AS v FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS id, doc_id AS root FROM documents UNION SELECT e.u, r.root FROM r JOIN e ON e.v = r.id)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(root) FROM r WHERE r.id = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    """Where a public tokenizer's file is; it is the same on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_token_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.read_archives(tokenfile.write_archives(table(spark, sf_dir, "documents"), tokenizer_path()))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = linededup.drop_repeated_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP5_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
o AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
g AS (SELECT k.doc_id, k.pos, k.line, o.key IS NOT NULL AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
 sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256 FROM g GROUP BY doc_id
"""

def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP6_SQL = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes, p.payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
 CASE WHEN first <> page_id THEN first END AS refers_to FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

#: First day of the dated list, and the days that captures and entries are dealt over.
FIRST_DAY, DAYS = 18262, 1461


def op7_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page judged by lists made of all pages: each page dates one entry for its host, site or first segment."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host, segment = urllist.host_of(F.col("url")), urllist.segment_of(F.col("url"))
    pattern = F.expr("CASE page_id % 3 WHEN 0 THEN 'host' WHEN 1 THEN 'prefix' ELSE 'domain' END")
    site = F.array_join(F.slice(F.split("_host", r"\."), -3, 3), ".")
    entries = pages.withColumn("_host", host).withColumn("_seg", segment).where("_host <> ''").select(
        F.expr("CASE page_id % 4 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' WHEN 2 THEN 'spam' ELSE 'tracker' END").alias("list"),
        F.concat(pattern, F.lit(":"), F.when(F.expr("page_id % 3 = 0"), F.col("_host")).when(F.expr("page_id % 3 = 1"), F.concat("_host", F.lit("/"), "_seg")).otherwise(site)).alias("pattern"),
        F.expr(f"CAST({FIRST_DAY} + page_id * 53 % {DAYS} AS INT)").alias("day"),
        F.expr("CASE WHEN page_id % 5 < 3 THEN 'add' ELSE 'remove' END").alias("action"),
        F.col("page_id").alias("seq"),
    )
    captures = pages.withColumn("day", F.expr(f"CAST({FIRST_DAY} + page_id * 37 % {DAYS} AS INT)"))
    return urllist.judge(captures, entries)


OP7_SQL = rf"""
WITH h AS (SELECT page_id, url, CASE WHEN length(x) <= 253 THEN x ELSE '' END AS host, regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)', 1) AS seg
 FROM (SELECT *, regexp_extract(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)', 1) AS x FROM pages)),
e AS (SELECT CASE page_id % 4 WHEN 0 THEN 'adult' WHEN 1 THEN 'malware' WHEN 2 THEN 'spam' ELSE 'tracker' END AS list,
 CASE page_id % 3 WHEN 0 THEN 'host:' || host WHEN 1 THEN 'prefix:' || host || '/' || seg ELSE 'domain:' || array_to_string(list_slice(string_split(host, '.'), -3, -1), '.') END AS pattern,
 {FIRST_DAY} + page_id * 53 % {DAYS} AS day, CASE WHEN page_id % 5 < 3 THEN 'add' ELSE 'remove' END AS action, page_id FROM h WHERE host <> ''),
l AS (SELECT list, pattern, day, arg_max(action, page_id) AS action FROM e GROUP BY list, pattern, day),
i AS (SELECT *, lead(day) OVER (PARTITION BY list, pattern ORDER BY day) AS until FROM l),
k AS (SELECT page_id, host, {FIRST_DAY} + page_id * 37 % {DAYS} AS day, unnest(list_concat(['host:' || host, 'prefix:' || host || '/' || seg],
 list_transform(range(1, len(string_split(host, '.')) + 1), lambda j: 'domain:' || array_to_string(list_slice(string_split(host, '.'), j, -1), '.')))) AS pattern FROM h)
SELECT k.page_id, k.host, count(i.list) AS n_active, count(i.list) > 0 AS blocked, coalesce(string_agg(DISTINCT i.list, ',' ORDER BY i.list), '') AS lists
FROM k LEFT JOIN i ON i.pattern = k.pattern AND i.action = 'add' AND i.day <= k.day AND (i.until IS NULL OR k.day < i.until) GROUP BY k.page_id, k.host
"""

def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each document and benchmark passage that overlap."""
    return decontam.find_overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"), mixing.label_domains(table(spark, sf_dir, "labels")), mixing.SHARES)
    shares = [F.round(F.get("p", F.lit(i)), 6).alias(f"p_{d}") for i, d in enumerate(mixing.SHARES)]
    return mixed.select("doc_id", "tokens", *shares, F.round("rate", 6).alias("rate"), "copies")


def op10_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"), tokenizer_path())


QUERIES = {"op1_quality_crf": op1_quality_crf, "op2_matroska": op2_matroska, "op3_jaccard_join": op3_jaccard_join, "op4_token_archives": op4_token_archives, "op5_line_dedup": op5_line_dedup, "op6_warc": op6_warc, "op7_url_lists": op7_url_lists, "op8_decontaminate": op8_decontaminate, "op9_soft_mixing": op9_soft_mixing, "op10_lm_scores": op10_lm_scores}
ORACLE_SQL = {"op3_jaccard_join": OP3_SQL, "op5_line_dedup": OP5_SQL, "op6_warc": OP6_SQL, "op7_url_lists": OP7_SQL}
