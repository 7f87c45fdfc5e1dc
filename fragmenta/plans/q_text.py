"""Queries on motifs, CIGARs and sequence texts: J11, J12, A14, K1, A8, W5-W7, E28, E30, K9, SNK8, F12, streaming twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.functions import sequence as sq
from fragmenta.operators import support
from fragmenta.plans.core import query
from fragmenta.plans.fixtures import table, view
from fragmenta.streaming import sessions

c = F.col
PATTERNS = "SELECT item_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS p FROM benchmark WHERE length(text) >= 20"
BOTH = f"SELECT item_id, p FROM ({PATTERNS}) UNION SELECT item_id, reverse(p) FROM ({PATTERNS})"
DOCS = "SELECT doc_id, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq FROM documents"


def upper(x):
    return F.translate(x, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def docs(spark, d):
    return table(spark, d, "documents").select("doc_id", upper(c("text")).alias("seq"))


def patterns(spark, d):
    return table(spark, d, "benchmark").select("item_id", upper(c("text")).alias("pattern")).where("length(pattern) >= 20")


@query("j12_motif_semi_join", f"WITH p AS ({BOTH}), t AS ({DOCS}) SELECT DISTINCT doc_id, item_id FROM t JOIN p ON contains(t.seq, p.p)")
def j12(spark, d):
    both = support.with_reverse(patterns(spark, d), "pattern", F.reverse("pattern"))
    return support.kmer_hits(docs(spark, d), both, 20).select("doc_id", "item_id").distinct()


@query("k1_automaton", f"WITH p AS ({BOTH}), t AS ({DOCS}) SELECT DISTINCT doc_id, item_id FROM t JOIN p ON contains(t.seq, p.p)")
def k1(spark, d):
    both = support.with_reverse(patterns(spark, d), "pattern", F.reverse("pattern"))
    return support.automaton_hits(docs(spark, d), both, ["doc_id"], ident="item_id").distinct()


TURN = "SELECT conv_id AS qname, turn AS mate, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq FROM conversations"
WORDS = "SELECT DISTINCT item_id % 10 AS bp_id, translate(substr(text, 1, 7), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS p FROM benchmark"


def turns(spark, d):
    return table(spark, d, "conversations").select(c("conv_id").alias("qname"), c("turn").alias("mate"), upper(c("text")).alias("seq"))


def words(spark, d):
    return table(spark, d, "benchmark").select((c("item_id") % 10).alias("bp_id"), upper(F.substring("text", 1, 7)).alias("pattern")).distinct()


@query("j11_fragment_semi_join", f"WITH t AS ({TURN}), p AS ({WORDS}), h AS (SELECT DISTINCT qname FROM t JOIN p ON contains(t.seq, p.p)) SELECT t.qname, t.mate FROM t JOIN h ON t.qname = h.qname")
def j11(spark, d):
    reads = turns(spark, d)
    return support.fragments_of(reads, support.kmer_hits(reads, words(spark, d), 7)).select("qname", "mate")


@query("a14_kmer_support", f"WITH t AS ({TURN}), p AS ({WORDS}) SELECT bp_id, count(*) AS n FROM (SELECT DISTINCT bp_id, qname, mate FROM t JOIN p ON contains(t.seq, p.p)) GROUP BY bp_id")
def a14(spark, d):
    hits = support.kmer_hits(turns(spark, d), words(spark, d), 7)
    return hits.groupBy("bp_id").agg(F.count_distinct("qname", "mate").alias("n"))


@query("snk8_sorted_counts", f"WITH t AS ({TURN}), p AS ({WORDS}) SELECT bp_id, count(*) AS n FROM (SELECT DISTINCT bp_id, qname, mate FROM t JOIN p ON contains(t.seq, p.p)) GROUP BY bp_id")
def snk8(spark, d):
    return a14(spark, d).orderBy("bp_id")


CIGAR = "concat(l_linenumber % 4, 'S', 20 + l_partkey % 50, 'M', 1 + l_suppkey % 9, CASE WHEN l_orderkey % 2 = 0 THEN 'I' ELSE 'D' END, 30 + l_orderkey % 40, 'M')"


def cigars(spark, d):
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS id", "l_linenumber AS ln", "l_suppkey % 24 AS chr", "l_partkey * 37 AS pos", "CASE l_returnflag WHEN 'N' THEN 'n001' ELSE 't001' END AS sample", "CAST(floor(l_tax * 100 + 0.5) AS INT) + 3 AS nm", f"{CIGAR} AS cigar")


@query("a8_cigar_indels", "SELECT chr, pos + m AS at_pos, len, CASE WHEN ins THEN 'I' ELSE 'D' END AS kind, sample, count(*) AS n FROM (SELECT l_suppkey % 24 AS chr, l_partkey * 37 AS pos, 20 + l_partkey % 50 AS m, 1 + l_suppkey % 9 AS len, l_orderkey % 2 = 0 AS ins, CASE l_returnflag WHEN 'N' THEN 'n001' ELSE 't001' END AS sample FROM lineitem) GROUP BY ALL")
def a8(spark, d):
    """Indels of CIGARs with their places on the reference: every operation but I, S and H moves on."""
    parsed = cigars(spark, d).withColumn("ops", sq.cigar_ops(c("cigar"))).where(F.size("ops") > 1)
    each = parsed.select("chr", "pos", "sample", "ops", F.posexplode("ops").alias("k", "o")).where("o.op IN ('I', 'D')")
    before = sq.cigar_sum(F.slice(c("ops"), F.lit(1), c("k")), "MDN=XP")
    return each.groupBy("chr", (c("pos") + before).alias("at_pos"), c("o.len").cast("long").alias("len"), c("o.op").alias("kind"), "sample").agg(F.count("*").alias("n"))


@query("w5_flanked_indels", "SELECT l_orderkey AS id, l_linenumber AS ln, CAST(1 + l_suppkey % 9 AS INT) AS len, CAST(20 + l_partkey % 50 AS INT) AS left_m, CAST(30 + l_orderkey % 40 AS INT) AS right_m FROM lineitem")
def w5(spark, d):
    ops = cigars(spark, d).select("id", "ln", sq.cigar_ops(c("cigar")).alias("ops"))
    each = ops.select("id", "ln", "ops", F.posexplode("ops").alias("k", "o")).where("o.op IN ('I', 'D')")
    side = lambda k: F.get("ops", c("k") + k)
    flanked = each.where((side(-1)["op"] == "M") & (side(1)["op"] == "M"))
    return flanked.select("id", "ln", c("o.len").alias("len"), side(-1)["len"].alias("left_m"), side(1)["len"].alias("right_m"))


@query("e28_query_interval", "SELECT l_orderkey AS id, l_linenumber AS ln, CAST(l_linenumber % 4 AS INT) AS s, CAST(l_linenumber % 4 + 50 + l_partkey % 50 + l_orderkey % 40 + CASE WHEN l_orderkey % 2 = 0 THEN 1 + l_suppkey % 9 ELSE 0 END AS INT) AS e FROM lineitem")
def e28(spark, d):
    q = sq.query_interval(c("ops"))
    return cigars(spark, d).withColumn("ops", sq.cigar_ops(c("cigar"))).select("id", "ln", q["start"].alias("s"), q["end"].alias("e"))


@query("e30_adjusted_nm", "SELECT l_orderkey AS id, l_linenumber AS ln, CAST(greatest(0, CAST(floor(l_tax * 100 + 0.5) AS INT) + 3 - (1 + l_suppkey % 9)) AS INT) AS nm FROM lineitem")
def e30(spark, d):
    return cigars(spark, d).withColumn("ops", sq.cigar_ops(c("cigar"))).select("id", "ln", sq.adjusted_nm(c("nm"), c("ops")).cast("int").alias("nm"))


@query("w6_longest_repeat", "WITH s AS (SELECT o_orderkey AS id, translate(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 24), '0123456789abcdef', 'AAAAACCCCCGGGTTT') AS seq FROM orders) SELECT id, coalesce(list_max(list_transform(regexp_extract_all(seq, '(A{3,}|C{3,}|G{3,}|T{3,})'), lambda x: length(x))), 0) AS longest FROM s")
def w6(spark, d):
    s = table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.translate(F.substring(F.md5(c("o_orderkey").cast("string")), 1, 24), "0123456789abcdef", "AAAAACCCCCGGGTTT").alias("seq"))
    runs = F.regexp_extract_all("seq", F.lit("(A{3,}|C{3,}|G{3,}|T{3,})"), F.lit(1))
    return s.select("id", F.coalesce(F.array_max(F.transform(runs, lambda x: F.length(x))), F.lit(0)).cast("long").alias("longest"))


@query("w7_reference_repeats", "SELECT id FROM (SELECT o_orderkey AS id, repeat(substr('ACGT', 1 + CAST(o_custkey % 4 AS INT), 1), CAST(o_custkey % 30 AS INT)) || 'G' AS seq FROM orders) WHERE regexp_matches(seq, 'A{20,}|C{20,}|G{20,}|T{20,}')")
def w7(spark, d):
    o = table(spark, d, "orders").selectExpr("o_orderkey AS id", "concat(repeat(substr('ACGT', 1 + CAST(o_custkey % 4 AS INT), 1), CAST(o_custkey % 30 AS INT)), 'G') AS seq")
    return o.where(c("seq").rlike("A{20,}|C{20,}|G{20,}|T{20,}")).select("id")


@query("f12_fragment_sample", "SELECT qname, mate FROM v_reads WHERE substr(md5(CAST(qname AS VARCHAR)), 1, 6) < '800000'")
def f12(spark, d):
    """Half of the fragments by 24 bits of a hash of their name: both mates or none."""
    return view(spark, d, "v_reads").where(F.substring(F.md5(c("qname").cast("string")), 1, 6) < "800000").select("qname", "mate")


@query("k9_resample_fragments", "SELECT qname, mate, unnest(CASE WHEN substr(md5(CAST(qname AS VARCHAR) || ':9'), 1, 6) < '800000' THEN [1, 2] ELSE [1] END) AS copy FROM v_reads")
def k9(spark, d):
    """Fragments drawn at a rate of 1.5, with replacement: whole copies and a hashed rest."""
    copies = F.lit(1) + (F.substring(F.md5(F.concat(c("qname").cast("string"), F.lit(":9"))), 1, 6) < "800000").cast("int")
    return view(spark, d, "v_reads").withColumn("copy", F.explode(F.sequence(F.lit(1), copies))).select("qname", "mate", "copy")


SESSION = "SELECT user_id, floor(epoch(ts))::BIGINT AS t FROM events"


@query("ext_session_clusters", f"WITH e AS ({SESSION}), s AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t) < 3600 THEN 0 ELSE 1 END AS n FROM e), g AS (SELECT *, sum(n) OVER (PARTITION BY user_id ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM s) SELECT user_id, min(t) AS first, max(t) AS last, count(*) AS n FROM g GROUP BY user_id, i HAVING count(*) >= 2")
def ext_sessions(spark, d):
    return sessions.session_clusters(table(spark, d, "events"))
