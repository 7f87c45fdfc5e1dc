"""Queries on kernels: K2-K4, K6, K8, SRC10."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.operators import kernels
from fragmenta.plans.core import query
from fragmenta.plans.fixtures import table, view

c = F.col
GENOME = "translate(concat(md5(CAST(w AS {S})), md5(CAST(w + 1000 AS {S})), md5(CAST(w + 2000 AS {S})), md5(CAST(w + 3000 AS {S}))), '0123456789abcdef', 'ACGTACGTACGTACGT')"


def windows(spark, d):
    """Reads of 60 bases from invented windows of 128, one in ten with a changed base."""
    o = table(spark, d, "orders").selectExpr("o_orderkey AS read_id", "o_custkey % 40 AS win", "CAST(o_orderkey * 7 % 69 AS INT) AS at", "o_orderkey % 10 = 0 AS wrong")
    g = o.withColumn("genome", F.expr(GENOME.format(S="STRING").replace("CAST(w ", "CAST(win ").replace("CAST(w+", "CAST(win+")))
    seq = F.substring("genome", c("at") + 1, F.lit(60))
    changed = F.concat(F.substring(seq, 1, 29), F.translate(F.substring(seq, 30, 1), "ACGT", "CGTA"), F.substring(seq, 31, 30))
    return g.select("read_id", "win", "at", F.when(c("wrong"), changed).otherwise(seq).alias("seq"), seq.alias("truth"), "genome")


@query("k2_error_correction")
def k2(spark, d):
    """Reads that equal the truth before and after correction, for each window."""
    reads = windows(spark, d)
    fixed = kernels.correct_reads(reads)
    met = fixed.join(reads.select(c("read_id").alias("r"), "truth"), c("read_id") == c("r"))
    return met.groupBy("win").agg(F.count("*").alias("reads"), F.count_if(c("seq") == c("truth")).alias("right_before"), F.count_if(c("corrected") == c("truth")).alias("right_after"))


@query("k3_solid_kmers", f"WITH w AS (SELECT o_orderkey AS id, CAST(o_orderkey * 7 % 69 AS INT) AS a, {GENOME.format(S='VARCHAR')} AS g FROM (SELECT *, o_custkey % 40 AS w FROM orders)), s AS (SELECT substr(g, a + 1, 60) AS seq FROM w), k AS (SELECT substr(seq, i, 31) AS kmer FROM s, (SELECT unnest(range(1, 31)) AS i)) SELECT kmer, count(*) AS n FROM k GROUP BY kmer HAVING count(*) >= 3")
def k3(spark, d):
    return kernels.solid_kmers(windows(spark, d).select(c("truth").alias("seq")), 31, 3)


@query("k4_assembly")
def k4(spark, d):
    """Contigs of each window from its right reads, and whether one is the window's whole covered sequence."""
    reads = windows(spark, d)
    found = kernels.assemble(reads.select("win", c("truth").alias("seq")))
    truth = reads.groupBy(c("win").alias("w")).agg(F.first("genome").alias("genome"))
    return found.join(truth, c("win") == c("w")).select("win", "cname", F.length("contig").alias("length"), F.col("genome").contains(c("contig")).alias("in_genome"))


@query("k6_alignment")
def k6(spark, d):
    """The best contig of every read."""
    reads = windows(spark, d)
    contigs = kernels.assemble(reads.select("win", c("truth").alias("seq")))
    return kernels.align_reads(reads, contigs)


@query("k8_realignment_codes", "SELECT code, count(*) AS n FROM (SELECT CASE WHEN nm * 10 < mapq + 1 THEN 'KEPT' WHEN chr = mate_chr AND abs(pos - mate_pos) < 2000 THEN 'CONCORDANT' ELSE 'MOVED' END AS code FROM v_reads) GROUP BY code")
def k8(spark, d):
    r = view(spark, d, "v_reads").select((c("nm") * 10).alias("new_score"), c("mapq").alias("native_score"), c("chr").alias("new_chr"), c("pos").alias("new_pos"), "mate_chr", "mate_pos")
    return kernels.clipped_realignment(r).groupBy("code").agg(F.count("*").alias("n"))


@query("src10_reference_bases", f"SELECT bp_num, substr({GENOME.format(S='VARCHAR')}, CAST(pos1 % 100 + 1 AS INT), 3) AS bases FROM (SELECT *, chr1 AS w FROM v_bps)")
def src10(spark, d):
    from fragmenta.sources.tracks import fetch_bases

    text = F.expr(GENOME.format(S="STRING").replace("CAST(w ", "CAST(id "))
    whole = spark.range(30).select(c("id").alias("chrom"), text.alias("s"))
    fasta = whole.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.expr("(length(s) - 1) div 50")))).select("chrom", "chunk", F.expr("substring(s, chunk * 50 + 1, 50)").alias("seq"))
    sites = view(spark, d, "v_bps").select("bp_num", c("chr1").alias("chrom"), (c("pos1") % 100 + 1).alias("pos"))
    return fetch_bases(fasta, sites, 3, 50).select("bp_num", "bases")
