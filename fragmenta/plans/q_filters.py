"""Queries on reads and tables: F1-F27, PRJ1, PRJ7, O6 and viewer filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.functions import filters as fl
from fragmenta.operators import intervals as iv
from fragmenta.operators import stats
from fragmenta.plans.core import query
from fragmenta.plans.fixtures import table, view

c = F.col
#: Flags made from the fixture's columns.
FLAGS = "(CASE WHEN nm = 10 THEN 1024 ELSE 0 END) + (CASE WHEN nm = 9 THEN 512 ELSE 0 END) + (CASE WHEN clip = 8 THEN 256 ELSE 0 END)"
BLACK = "EXISTS (SELECT 1 FROM v_regions g WHERE g.chr = r.chr AND r.pos <= g.end_pos AND r.pos + 150 >= g.start_pos)"


def flagged(spark, d):
    return view(spark, d, "v_reads").withColumn("flag", F.expr(FLAGS))


@query("f1_hard_drop", f"SELECT sample, count(*) AS kept FROM v_reads r WHERE nm NOT IN (9, 10) AND clip <> 7 AND NOT {BLACK} GROUP BY sample")
def f1(spark, d):
    g = view(spark, d, "v_regions").select(*(c(x).alias(f"g_{x}") for x in ("chr", "start_pos", "end_pos")))
    kept = flagged(spark, d).where(~fl.bad_flags(c("flag")) & ~(c("clip") == 7))
    kept = iv.overlap_semi(kept, g, [("chr", "g_chr")], (c("pos"), c("pos") + 150), (c("g_start_pos"), c("g_end_pos")), anti=True)
    return kept.groupBy("sample").agg(F.count("*").alias("kept"))


@query("f2_read_rules", "SELECT qname, mate FROM v_reads WHERE (strand = mate_strand OR (strand = '-' AND mate_strand = '+' AND chr = mate_chr)) OR chr <> mate_chr OR (clip >= 5 AND readlen - clip >= 30) OR nm % 4 = 1 OR nm % 4 = 2 OR (mapq > 0 AND mate_pos % 50 = 0) OR (mapq = 0 AND mate_pos % 50 <> 0)")
def f2(spark, d):
    rules = '{"orientations": ["RR", "FF", "RF"], "interchromosomal": true, "clip": 5, "length": 30, "insertion": true, "deletion": true, "half_mapped": true}'
    r = view(spark, d, "v_reads").withColumns({"ins": c("nm") % 4 == 1, "del": c("nm") % 4 == 2, "mapped": c("mapq") > 0, "mate_mapped": c("mate_pos") % 50 != 0})
    return r.where(fl.read_rules(rules)).select("qname", "mate")


@query("f4_mismatch_salvage", "SELECT qname, mate FROM v_reads WHERE CAST(nm AS FLOAT) / CAST(readlen AS FLOAT) > CAST(0.02 AS FLOAT)")
def f4(spark, d):
    return view(spark, d, "v_reads").where(fl.many_mismatches(c("nm"), c("readlen"))).select("qname", "mate")


@query("f5_short_corrected", "SELECT sample, count(*) AS n FROM v_reads WHERE readlen - clip * 15 >= 40 GROUP BY sample")
def f5(spark, d):
    return view(spark, d, "v_reads").where(c("readlen") - c("clip") * 15 >= fl.LEAST_LENGTH).groupBy("sample").agg(F.count("*").alias("n"))


@query("f6_rf_overlap", "SELECT qname, mate FROM v_reads WHERE NOT (strand = '-' AND mate_strand = '+' AND chr = mate_chr AND abs(isize) < greatest(200, 2 * readlen))")
def f6(spark, d):
    rf = fl.orientation(c("chr"), c("mate_chr"), c("pos"), c("mate_pos"), c("strand"), c("mate_strand"), by_position=False) == "RF"
    return view(spark, d, "v_reads").where(~fl.rf_overlap(rf & (c("chr") == c("mate_chr")), c("isize"), c("readlen"))).select("qname", "mate")


@query("f7_zero_mapq", "SELECT sample, count(*) AS n FROM v_reads WHERE NOT (mapq <= 1) GROUP BY sample")
def f7(spark, d):
    return view(spark, d, "v_reads").where(fl.mate_pass_mapq(c("mapq") - 1, mate_pass=True)).groupBy("sample").agg(F.count("*").alias("n"))


@query("f8_adapter", "SELECT conv_id, turn FROM (SELECT conv_id, turn, length(text) AS n, turn % 7 AS clip, conv_id % 400 AS isize, translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') AS seq FROM conversations) WHERE isize <> 0 AND (abs(isize - n) < 5 OR (clip > 0 AND (abs(n - clip - abs(isize)) <= 6 OR contains(seq, 'CAAGCAGAAGACGGCAT'))))")
def f8(spark, d):
    r = view(spark, d, "v_pairs").select(c("qname").alias("conv_id"), c("mate").cast("long").alias("turn"), "seq", F.length("seq").alias("n"), (c("mate") % 7).alias("clip"), (c("qname") % 400).alias("isize"))
    return r.where(fl.has_adapter(F.lit(False), c("isize"), c("isize"), c("n"), c("clip"), c("seq"))).select("conv_id", "turn")


@query("f9_discordant_tag", f"SELECT dd, count(*) AS n FROM (SELECT CASE WHEN {BLACK} THEN 0 WHEN NOT (strand = '+' AND mate_strand = '-') OR abs(isize) >= 800 OR chr <> mate_chr THEN 1 ELSE 0 END AS dd FROM v_reads r) GROUP BY dd")
def f9(spark, d):
    g = view(spark, d, "v_regions").select(*(c(x).alias(f"g_{x}") for x in ("chr", "start_pos", "end_pos")))
    r = view(spark, d, "v_reads").withColumn("dd", fl.discordant(c("strand"), c("mate_strand"), c("chr"), c("mate_chr"), c("isize"), F.lit(800)).cast("int"))
    r = iv.with_overlap(r, g, [("chr", "g_chr")], (c("pos"), c("pos") + 150), (c("g_start_pos"), c("g_end_pos")), "black")
    return r.select(F.when(c("black"), 0).otherwise(c("dd")).alias("dd")).groupBy("dd").agg(F.count("*").alias("n"))


@query("f10_region_caps", "SELECT chr, pos // 25000 AS win, count(*) AS n FROM v_reads GROUP BY 1, 2 HAVING count(*) <= 70")
def f10(spark, d):
    return fl.drop_crowded(view(spark, d, "v_reads").withColumn("win", F.expr("pos div 25000")), ["chr", "win"], 70).groupBy("chr", "win").agg(F.count("*").alias("n"))


@query("f14_mate_candidates", f"SELECT qname, mate FROM v_reads r WHERE mapq >= 10 AND mate_chr <= 23 AND nm BETWEEN 0 AND 10 AND NOT (mate_chr = chr AND abs(mate_pos - pos) < 25000) AND NOT EXISTS (SELECT 1 FROM v_regions g WHERE g.chr = r.mate_chr AND r.mate_pos BETWEEN g.start_pos AND g.end_pos)")
def f14(spark, d):
    g = view(spark, d, "v_regions").select(*(c(x).alias(f"g_{x}") for x in ("chr", "start_pos", "end_pos")))
    r = view(spark, d, "v_reads").where("mapq >= 10 AND mate_chr <= 23 AND nm BETWEEN 0 AND 10").where(~((c("mate_chr") == c("chr")) & (F.abs(c("mate_pos") - c("pos")) < 25000)))
    return iv.overlap_semi(r, g, [("mate_chr", "g_chr")], (c("mate_pos"), c("mate_pos")), (c("g_start_pos"), c("g_end_pos")), anti=True).select("qname", "mate")


@query("f15_somatic_mate_regions", "WITH m AS (SELECT mate_chr, mate_pos // 2000 AS bin, substr(sample, 1, 1) AS k, count(*) AS n FROM v_reads GROUP BY 1, 2, 3), t AS (SELECT mate_chr, bin FROM m WHERE k = 't' AND n >= 3 AND NOT EXISTS (SELECT 1 FROM m o WHERE o.k = 'n' AND o.mate_chr = m.mate_chr AND o.bin = m.bin)) SELECT mate_chr, bin FROM (SELECT *, count(*) OVER (PARTITION BY mate_chr) AS k FROM t) WHERE k <= 6")
def f15(spark, d):
    m = view(spark, d, "v_reads").groupBy("mate_chr", F.expr("mate_pos div 2000").alias("bin")).agg(F.count_if(c("sample").startswith("t")).alias("t"), F.count_if(c("sample").startswith("n")).alias("n"))
    return fl.drop_crowded(m.where("t >= 3 AND n = 0"), ["mate_chr"], 6).select("mate_chr", "bin")


@query("f16_minimal_evidence", "SELECT bp_num FROM v_bp_counts WHERE alt_t + alt_n >= 2 AND repeat_len <> 12")
def f16(spark, d):
    return view(spark, d, "v_bp_counts").where(fl.has_minimal(c("alt_t"), c("alt_n"), F.lit(0), F.lit(0), c("repeat_len") == 12)).select("bp_num")


@query("f17_discordant_only", "SELECT bp_num FROM v_bp_counts b WHERE alt_t + alt_n >= 6 AND NOT EXISTS (SELECT 1 FROM v_bps a WHERE a.bp_num = b.bp_num AND a.conf = 'PASS')")
def f17(spark, d):
    assembled = view(spark, d, "v_bps").where("conf = 'PASS'").select(c("bp_num").alias("a"))
    return view(spark, d, "v_bp_counts").where("alt_t + alt_n >= 6").join(assembled, c("bp_num") == c("a"), "left_anti").select("bp_num")


@query("f18_cluster_validity", "SELECT bp_num FROM v_bps WHERE chr1 <> chr2 OR (strand1 = '-' AND strand2 = '+') OR NOT (pos1 + 150 > pos2)")
def f18(spark, d):
    from fragmenta.operators.cluster import is_valid

    return view(spark, d, "v_bps").where(is_valid(c("chr1"), c("chr2"), c("strand1"), c("strand2"), c("pos1") + 150, c("pos2"))).select("bp_num")


@query("f19_contig_length", "SELECT doc_id FROM documents WHERE length(text) >= 1.2::double * 151")
def f19(spark, d):
    return table(spark, d, "documents").where(F.char_length("text") >= 1.2 * 151).select("doc_id")


@query("f20_reference_contains", "SELECT item_id, count(*) AS n FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY item_id")
def f20(spark, d):
    from fragmenta.operators.support import kmer_hits

    b = table(spark, d, "benchmark").select("item_id", c("text").alias("pattern"))
    return kmer_hits(table(spark, d, "documents").select("doc_id", c("text").alias("seq")), b, 30).select("doc_id", "item_id").distinct().groupBy("item_id").agg(F.count("*").alias("n"))


@query("f21_first_contig_hit", "SELECT rg, chr, arg_min(qname, (pos, qname, mate)) AS qname FROM v_reads WHERE 0.5::double * (readlen - clip) <= mapq * 4 GROUP BY rg, chr")
def f21(spark, d):
    good = view(spark, d, "v_reads").where(0.5 * (c("readlen") - c("clip")) <= c("mapq") * 4)
    return good.groupBy("rg", "chr").agg(F.min_by("qname", F.struct("pos", "qname", "mate")).alias("qname"))


@query("f22_contig_cap", "SELECT bp_num FROM (SELECT bp_num, row_number() OVER (PARTITION BY chr1 ORDER BY bp_num) AS rn FROM v_bps) WHERE rn < 200")
def f22(spark, d):
    return stats.top_per_group(view(spark, d, "v_bps"), ["chr1"], [c("bp_num")], 199).select("bp_num")


@query("f23_repeat_filter", "WITH s AS (SELECT o_orderkey AS id, translate(substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 12), '0123456789abcdef', 'AAAACCCCGGGGTTTN') AS u FROM orders), r AS (SELECT id, CASE WHEN id % 3 = 0 THEN repeat(substr(u, 1, 1), 45) || u ELSE u || u || u END AS seq FROM s) SELECT id FROM r WHERE NOT (contains(seq, 'N') OR length(seq) < 35 OR regexp_matches(seq, 'A{40}|C{40}|G{40}|T{40}'))")
def f23(spark, d):
    u = table(spark, d, "orders").select(c("o_orderkey").alias("id"), F.translate(F.substring(F.md5(c("o_orderkey").cast("string")), 1, 12), "0123456789abcdef", "AAAACCCCGGGGTTTN").alias("u"))
    seq = F.when(c("id") % 3 == 0, F.concat(F.repeat(F.substring("u", 1, 1), 45), c("u"))).otherwise(F.concat("u", "u", "u"))
    return u.select("id", seq.alias("seq")).where(fl.assemblable(c("seq"), 35)).select("id")


@query("f24_viewer_filters", "SELECT bp_num FROM v_bps WHERE contains(chr1 || ' ' || pos1 || ' ' || conf, 'PASS') AND somlod BETWEEN 0 AND 30 AND maxlod >= 10 AND conf IN ('PASS', 'LOWLOD')")
def f24(spark, d):
    text = F.concat_ws(" ", c("chr1").cast("string"), c("pos1").cast("string"), c("conf"))
    return view(spark, d, "v_bps").where(fl.viewer(text, "PASS", {"somlod": (0, 30), "maxlod": (10, None)}, {"conf": ["PASS", "LOWLOD"]})).select("bp_num")


@query("f25_runtime_filters", "SELECT event_id FROM events WHERE user_id % 30 < 24 AND value BETWEEN 10 AND 60")
def f25(spark, d):
    return table(spark, d, "events").where((c("user_id") % 30 < 24) & c("value").between(10, 60)).select("event_id")


@query("f26_contig_lists", "SELECT DISTINCT pos1 AS cname FROM v_bps WHERE conf = 'PASS' AND somlod >= 1")
def f26(spark, d):
    return view(spark, d, "v_bps").where("conf = 'PASS' AND somlod >= 1").select(c("pos1").alias("cname")).distinct()


@query("f27_reads_with_tag", "SELECT l_orderkey AS id, l_linenumber AS ln FROM lineitem WHERE list_contains(string_split(concat(l_partkey % 9, ',', l_suppkey % 9), ','), '4')")
def f27(spark, d):
    from fragmenta.functions.sequence import has_token

    tags = F.concat_ws(",", (c("l_partkey") % 9).cast("string"), (c("l_suppkey") % 9).cast("string"))
    return table(spark, d, "lineitem").where(has_token(tags, F.lit("4"))).select(c("l_orderkey").alias("id"), c("l_linenumber").alias("ln"))


@query("e23_append_token", "SELECT l_orderkey AS id, l_linenumber AS ln, CASE WHEN l_partkey % 3 = l_suppkey % 3 THEN CAST(l_partkey % 3 AS VARCHAR) ELSE concat(l_partkey % 3, ',', l_suppkey % 3) END AS tags FROM lineitem")
def e23(spark, d):
    from fragmenta.functions.sequence import append_token

    return table(spark, d, "lineitem").select(c("l_orderkey").alias("id"), c("l_linenumber").alias("ln"), append_token((c("l_partkey") % 3).cast("string"), (c("l_suppkey") % 3).cast("string")).alias("tags"))


@query("prj1_duplicate_header", "SELECT 'alt_allele' AS a, 'alt_count' AS b")
def prj1(spark, d):
    from fragmenta.sources.bps import CORE

    names = [n for n in CORE if n.startswith("alt_")]
    return spark.createDataFrame([tuple(names)], "a string, b string")


@query("prj7_runtime_derived", "SELECT event_id, CAST(floor(value) AS BIGINT) + user_id % 10 AS weird_total, user_id % 10 + user_id % 7 AS mate_total FROM events")
def prj7(spark, d):
    return table(spark, d, "events").selectExpr("event_id", "CAST(floor(value) AS BIGINT) + user_id % 10 AS weird_total", "user_id % 10 + user_id % 7 AS mate_total")


@query("o6_viewer_page", "SELECT bp_num, somlod FROM v_bps ORDER BY somlod DESC, bp_num LIMIT 50 OFFSET 100")
def o6(spark, d):
    return view(spark, d, "v_bps").select("bp_num", "somlod").orderBy(c("somlod").desc_nulls_last(), "bp_num").offset(100).limit(50)
