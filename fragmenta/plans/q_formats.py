"""Queries on formats: SRC1, F11, E21, E22, PRJ5, PRJ6, SNK3."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.plans.core import query
from fragmenta.plans.fixtures import view
from fragmenta.sources import sam

c = F.col


@query("src1_snk3_sam_round_trip", "SELECT 'f' || qname AS qname, mate * 64 AS flag, 'chr' || chr AS chr, CAST(pos AS INT) AS pos, mapq, 'chr' || mate_chr AS mate_chr, CASE WHEN nm = 10 THEN 'NA' ELSE 'rg' || rg END AS rg, nm FROM v_reads")
def src1(spark, d):
    """Reads written as SAM lines and parsed again; a mate on the same chromosome is written '='."""
    chrom = lambda x: F.concat(F.lit("chr"), c(x).cast("string"))
    reads = view(spark, d, "v_reads").select(
        F.concat(F.lit("f"), c("qname").cast("string")).alias("qname"), (c("mate") * 64).alias("flag"), chrom("chr").alias("chr"), "pos", "mapq", F.lit("151M").alias("cigar"),
        F.when(c("chr") == c("mate_chr"), "=").otherwise(chrom("mate_chr")).alias("mate_chr"), "mate_pos", "isize", F.lit("ACGT").alias("seq"), F.lit("IIII").alias("qual"),
        F.when(c("nm") != 10, F.concat(F.lit("rg"), c("rg").cast("string"))).otherwise("").alias("rg"), "nm",
    )
    return sam.parse(sam.lines(reads)).select("qname", "flag", "chr", "pos", "mapq", "mate_chr", "rg", "nm")


@query("f11_quality_trim", "SELECT qname, mate, CAST(greatest(0, 40 - nm - clip) AS BIGINT) AS n FROM v_reads")
def f11(spark, d):
    qual = F.concat(F.repeat(F.lit("!"), c("nm")), F.repeat(F.lit("I"), F.lit(40) - c("nm") - c("clip")), F.repeat(F.lit("#"), c("clip")))
    return view(spark, d, "v_reads").select("qname", "mate", F.length(sam.quality_trim(F.repeat(F.lit("A"), 40), qual)).cast("long").alias("n"))


@query("e22_breakpoint_ids", "SELECT bp_num, 'bp' || lpad(CAST(chr1 AS VARCHAR), 3, '0') || lpad(CAST(bp_num AS VARCHAR), 8, '0') AS bp_id FROM v_bps")
def e22(spark, d):
    return view(spark, d, "v_bps").select("bp_num", F.format_string("bp%03d%08d", c("chr1"), c("bp_num")).alias("bp_id"))


@query("e21_vcf_ids", "WITH h AS (SELECT bp_num, substr(md5(concat_ws(':', chr1, pos1, chr2, pos2, strand1, strand2)), 1, 8) AS h FROM v_bps) SELECT bp_num, concat(h, '_', row_number() OVER (PARTITION BY h ORDER BY bp_num)) AS id FROM h")
def e21(spark, d):
    """A call's VCF id: 32 bits of a hash of its places; equal ones are told apart by their number in order of calls."""
    h = F.substring(F.md5(F.concat_ws(":", *(c(x).cast("string") for x in ("chr1", "pos1", "chr2", "pos2", "strand1", "strand2")))), 1, 8)
    return view(spark, d, "v_bps").select("bp_num", h.alias("h")).selectExpr("bp_num", "concat(h, '_', row_number() OVER (PARTITION BY h ORDER BY bp_num)) AS id")


@query("prj5_side_swap", "SELECT bp_num, CASE WHEN maxlod % 2 = 0 THEN chr2 ELSE chr1 END AS chr1, CASE WHEN maxlod % 2 = 0 THEN pos2 ELSE pos1 END AS pos1, CASE WHEN maxlod % 2 = 0 THEN strand2 ELSE strand1 END AS strand1, CASE WHEN maxlod % 2 = 0 THEN chr1 ELSE chr2 END AS chr2 FROM v_bps")
def prj5(spark, d):
    """Sides of a call swapped where its coin (here the parity of maxlod) says so."""
    swap = c("maxlod") % 2 == 0
    return view(spark, d, "v_bps").select("bp_num", *(F.when(swap, c(b)).otherwise(c(a)).alias(a) for a, b in (("chr1", "chr2"), ("pos1", "pos2"), ("strand1", "strand2"), ("chr2", "chr1"))))


@query("prj6_maf_lite", "SELECT bp_num, CASE WHEN strand1 = '+' THEN '-' ELSE repeat('A', CAST(abs(somlod) % 5 + 1 AS INT)) END AS ref_allele, CASE WHEN strand1 = '+' THEN repeat('C', CAST(abs(somlod) % 5 + 1 AS INT)) ELSE '-' END AS tum_allele, CASE WHEN strand1 = '+' THEN pos1 ELSE pos1 + 1 END AS start FROM v_bps")
def prj6(spark, d):
    """Indels without the anchor base: '-' for the side that has nothing else."""
    n = F.abs("somlod") % 5 + 1
    ref = F.when(c("strand1") == "+", "G").otherwise(F.concat(F.lit("G"), F.repeat(F.lit("A"), n.cast("int"))))
    alt = F.when(c("strand1") == "+", F.concat(F.lit("G"), F.repeat(F.lit("C"), n.cast("int")))).otherwise("G")
    rest = lambda x: F.coalesce(F.nullif(F.substring(x, 2, 1000), F.lit("")), F.lit("-"))
    calls = view(spark, d, "v_bps").select("bp_num", "pos1", ref.alias("ref"), alt.alias("alt"))
    return calls.select("bp_num", rest("ref").alias("ref_allele"), rest("alt").alias("tum_allele"), F.when(F.length("ref") == 1, c("pos1")).otherwise(c("pos1") + 1).alias("start"))
