"""Queries on duplicates, order and clusters: D1-D7, O1-O5, O7, O9, W1-W5, W8, J2-J9, J20, A11, A12, SRC7, SNK1, SNK2, SNK6."""

from __future__ import annotations

from pyspark.sql import functions as F

from fragmenta.functions import sequence as sq
from fragmenta.operators import cluster, dedup
from fragmenta.operators import intervals as iv
from fragmenta.plans import commands
from fragmenta.plans.core import query
from fragmenta.plans.fixtures import table, view
from fragmenta.sources import bps as bps_source

c = F.col

CANON = """
WITH k AS (SELECT *, (chr1 > chr2) OR (chr1 = chr2 AND (pos1 > pos2 OR (pos1 = pos2 AND strand1 > strand2))) AS sw FROM v_bps),
c AS (SELECT *, CASE WHEN sw THEN chr2 ELSE chr1 END AS ka, CASE WHEN sw THEN pos2 ELSE pos1 END AS kb, CASE WHEN sw THEN strand2 ELSE strand1 END AS kc,
 CASE WHEN sw THEN chr1 ELSE chr2 END AS kd, CASE WHEN sw THEN pos1 ELSE pos2 END AS ke, CASE WHEN sw THEN strand1 ELSE strand2 END AS kf FROM k),
r AS (SELECT *, row_number() OVER (PARTITION BY ka, kb, kc, kd, ke, kf ORDER BY somlod, maxlod DESC, bp_num) AS rn FROM c)
"""


@query("slice0_pass_somatic", CANON + "SELECT chr1, count(*) AS n_pass, CAST(sum(CASE WHEN somlod >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_somatic FROM r WHERE rn = 1 AND conf = 'PASS' GROUP BY chr1")
def pass_somatic(spark, d):
    """PASS and somatic calls of each chromosome after deduplication."""
    kept = dedup.canonical_pairs(view(spark, d, "v_bps"))
    return kept.where("conf = 'PASS'").groupBy("chr1").agg(F.count("*").alias("n_pass"), F.sum(F.when(c("somlod") >= 1, 1).otherwise(0)).alias("n_somatic"))


@query("d2_canonical_dedup", CANON + "SELECT bp_num, chr1, pos1, chr2, pos2, somlod, maxlod FROM r WHERE rn = 1")
def d2(spark, d):
    return dedup.canonical_pairs(view(spark, d, "v_bps")).select("bp_num", "chr1", "pos1", "chr2", "pos2", "somlod", "maxlod")


@query("d1_union_and_ignore", "SELECT cname, arg_min(label, src) AS label FROM (SELECT chr AS cname, 'r' || chr AS label, 0 AS src FROM v_regions UNION ALL SELECT chr1, 'b' || chr1, 1 FROM v_bps) GROUP BY cname")
def d1(spark, d):
    a = view(spark, d, "v_regions").select(c("chr").alias("cname"), F.concat(F.lit("r"), c("chr").cast("string")).alias("label"), F.lit(0).alias("src"))
    b = view(spark, d, "v_bps").select(c("chr1").alias("cname"), F.concat(F.lit("b"), c("chr1").cast("string")).alias("label"), F.lit(1).alias("src"))
    return dedup.first_per_key(a.unionByName(b), ["cname"], ["src"]).select("cname", "label")


@query("d3_token_union", "WITH t AS (SELECT l_suppkey % 20 AS chr, l_partkey % 300 AS pos, l_orderkey AS o, l_linenumber AS ln, unnest([l_orderkey % 5, l_suppkey % 5]) AS tok, unnest([0, 1]) AS i FROM lineitem), f AS (SELECT chr, pos, tok, min((o, ln, i)) AS at_ FROM t GROUP BY chr, pos, tok), n AS (SELECT l_suppkey % 20 AS chr, l_partkey % 300 AS pos, count(*) AS copies FROM lineitem GROUP BY 1, 2) SELECT f.chr, f.pos, copies, string_agg(CAST(tok AS VARCHAR), ',' ORDER BY at_) AS tags FROM f JOIN n ON f.chr = n.chr AND f.pos = n.pos GROUP BY f.chr, f.pos, copies")
def d3(spark, d):
    rows = table(spark, d, "lineitem").select((c("l_suppkey") % 20).alias("chr"), (c("l_partkey") % 300).alias("pos"), F.struct("l_orderkey", "l_linenumber").alias("ord"), F.concat_ws(",", (c("l_orderkey") % 5).cast("string"), (c("l_suppkey") % 5).cast("string")).alias("tags"))
    return dedup.union_tokens(rows, ["chr", "pos"], "ord", ["tags"])


@query("d4_fuzzy_pairs", "WITH a AS (SELECT *, CASE WHEN chr1 <> chr2 OR abs(pos2 - pos1) > 400 THEN 200 ELSE 10 END AS pad FROM v_bps), m AS (SELECT a.bp_num, count(*) AS n, max(CASE WHEN (o.conf = 'PASS') = (a.conf = 'PASS') AND (o.maxlod > a.maxlod OR (o.maxlod = a.maxlod AND o.bp_num < a.bp_num)) THEN 1 ELSE 0 END) AS beaten FROM a JOIN v_bps o ON a.chr1 = o.chr1 AND a.chr2 = o.chr2 AND a.strand1 = o.strand1 AND a.strand2 = o.strand2 AND abs(a.pos1 - o.pos1) <= pad AND abs(a.pos2 - o.pos2) <= pad AND a.bp_num <> o.bp_num GROUP BY a.bp_num) SELECT bp_num FROM v_bps WHERE bp_num NOT IN (SELECT bp_num FROM m WHERE n > 500 OR beaten = 1)")
def d4(spark, d):
    return dedup.fuzzy_pairs(view(spark, d, "v_bps")).select("bp_num")


@query("d5_unique_per_window", "SELECT chr1, pos1, strand1, chr2, pos2, strand2, min(bp_num) AS bp_num FROM v_bps GROUP BY ALL")
def d5(spark, d):
    keys = ["chr1", "pos1", "strand1", "chr2", "pos2", "strand2"]
    return dedup.first_per_key(view(spark, d, "v_bps"), keys, ["bp_num"]).select(*keys, "bp_num")


@query("d6_exact_sequences", "SELECT text AS seq, min(doc_id) AS first FROM documents GROUP BY text")
def d6(spark, d):
    return dedup.first_per_key(table(spark, d, "documents").select("doc_id", "text"), ["text"], ["doc_id"]).select(c("text").alias("seq"), c("doc_id").alias("first"))


@query("d7_pattern_dedup", "SELECT p, string_agg(DISTINCT CAST(item_id % 7 AS VARCHAR), ',' ORDER BY CAST(item_id % 7 AS VARCHAR)) AS ids FROM (SELECT substr(text, 1, 3) AS p, item_id FROM benchmark) GROUP BY p")
def d7(spark, d):
    b = table(spark, d, "benchmark").select(F.substring("text", 1, 3).alias("p"), (c("item_id") % 7).cast("string").alias("k"))
    return b.groupBy("p").agg(F.array_join(F.array_sort(F.collect_set("k")), ",").alias("ids"))


@query("w8_first_per_key", "SELECT chr1, pos1, arg_min(conf, bp_num) AS conf, min(bp_num) AS bp_num FROM v_bps GROUP BY chr1, pos1")
def w8(spark, d):
    return dedup.first_per_key(view(spark, d, "v_bps"), ["chr1", "pos1"], ["bp_num"]).select("chr1", "pos1", "conf", "bp_num")


ORDER = "CASE WHEN chr1 BETWEEN 1 AND 25 THEN chr1 ELSE 1000 END"


@query("o1_total_order", f"SELECT bp_num, row_number() OVER (ORDER BY {ORDER}, CASE WHEN {ORDER} >= 1000 THEN chr1 END NULLS FIRST, pos1, strand1, {ORDER.replace('chr1', 'chr2')}, CASE WHEN {ORDER.replace('chr1', 'chr2')} >= 1000 THEN chr2 END NULLS FIRST, pos2, strand2, CAST(maxlod AS FLOAT) DESC, bp_num) AS rn FROM v_bps")
def o1(spark, d):
    key = lambda x: F.when(c(x).between(1, 25), c(x)).otherwise(1000)
    name = lambda x: F.when(key(x) >= 1000, c(x))
    order = [key("chr1"), name("chr1").asc_nulls_first(), c("pos1"), c("strand1"), key("chr2"), name("chr2").asc_nulls_first(), c("pos2"), c("strand2"), c("maxlod").cast("float").desc(), c("bp_num")]
    lead = commands.place(key("chr1"), F.when(key("chr1") < 1000, c("pos1")).otherwise(c("chr1")))
    return commands.numbered(view(spark, d, "v_bps"), order, "rn", lead).select("bp_num", "rn")


@query("o2_somatic_order", "SELECT bp_num, row_number() OVER (ORDER BY chr1, pos1, chr2, pos2, somlod DESC, bp_num) AS rn FROM v_bps")
def o2(spark, d):
    order = [c("chr1"), c("pos1"), c("chr2"), c("pos2"), c("somlod").desc(), c("bp_num")]
    return commands.numbered(view(spark, d, "v_bps"), order, "rn", commands.place(c("chr1"), c("pos1"))).select("bp_num", "rn")


@query("o3_symbolic_order", "WITH k AS (SELECT bp_num, least((chr1, pos1), (chr2, pos2))[1] AS chr, least((chr1, pos1), (chr2, pos2))[2] AS pos FROM v_bps) SELECT *, row_number() OVER (ORDER BY chr, pos, bp_num) AS rn FROM k")
def o3(spark, d):
    low = F.least(F.struct(c("chr1").alias("chr"), c("pos1").alias("pos")), F.struct(c("chr2").alias("chr"), c("pos2").alias("pos")))
    rows = view(spark, d, "v_bps").select("bp_num", low.alias("k")).select("bp_num", "k.chr", "k.pos")
    return commands.numbered(rows, [c("chr"), c("pos"), c("bp_num")], "rn", commands.place(c("chr"), c("pos")))


@query("o4_coordinate_sort", "SELECT chr, pos, row_number() OVER (ORDER BY chr, pos) AS rn FROM v_reads")
def o4(spark, d):
    """Every read's place in coordinate order; reads at one position follow each other in any order, so only positions are given."""
    order = [c("chr"), c("pos"), c("qname"), c("mate")]
    return commands.numbered(view(spark, d, "v_reads").select("chr", "pos", "qname", "mate"), order, "rn", commands.place(c("chr"), c("pos"))).select("chr", "pos", "rn")


@query("o5_natural_order", "SELECT bp_num, row_number() OVER (ORDER BY chr1, pos1, chr2, pos2, maxlod, somlod, bp_num) AS rn FROM v_bps")
def o5(spark, d):
    order = [c(x) for x in ("chr1", "pos1", "chr2", "pos2", "maxlod", "somlod", "bp_num")]
    return commands.numbered(view(spark, d, "v_bps"), order, "rn", commands.place(c("chr1"), c("pos1"))).select("bp_num", "rn")


@query("o7_contigs_by_length", "WITH n AS (SELECT chr, max(pos) AS length FROM v_reads GROUP BY chr) SELECT *, row_number() OVER (ORDER BY length DESC, chr) AS rn FROM n")
def o7(spark, d):
    lengths = view(spark, d, "v_reads").groupBy("chr").agg(F.max("pos").alias("length"))
    return commands.numbered(lengths, [c("length").desc(), c("chr")], "rn", -c("length"))


@query("o9_widest_regions", "SELECT region_id, end_pos - start_pos AS width FROM v_regions ORDER BY width DESC, region_id LIMIT 20")
def o9(spark, d):
    return view(spark, d, "v_regions").select("region_id", (c("end_pos") - c("start_pos")).alias("width")).orderBy(c("width").desc(), "region_id").limit(20)


DISCORDANT = "SELECT *, pos % 60000 AS p FROM v_reads WHERE mapq >= 10"
ISLAND = f"i AS (SELECT *, CASE WHEN p - lag(p) OVER w <= 150 THEN 0 ELSE 1 END AS s FROM ({DISCORDANT}) WINDOW w AS (PARTITION BY chr, strand ORDER BY p, qname, mate, sample, rg, mate_pos, isize)), j AS (SELECT *, CAST(sum(s) OVER (PARTITION BY chr, strand ORDER BY p, qname, mate, sample, rg, mate_pos, isize ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS island FROM i)"
TIE = ["qname", "mate", "sample", "rg", "mate_pos", "isize"]


def discordant(spark, d):
    return view(spark, d, "v_reads").where("mapq >= 10").withColumn("p", c("pos") % 60000)


@query("w1_islands", f"WITH {ISLAND} SELECT chr, strand, island, count(*) AS n, min(p) AS low, max(p) AS high FROM j GROUP BY ALL HAVING count(*) >= 2")
def w1(spark, d):
    marked = cluster.islands(discordant(spark, d), ["chr", "strand"], "p", TIE)
    return marked.groupBy("chr", "strand", "island").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high")).where("n >= 2")


@query("w1_capped_islands", f"WITH RECURSIVE {ISLAND}, u AS (SELECT DISTINCT chr, strand, island, p FROM j), o AS (SELECT *, row_number() OVER (PARTITION BY chr, strand, island ORDER BY p) AS k FROM u), f AS (SELECT chr, strand, island, p, k, p AS s, 0::BIGINT AS part FROM o WHERE k = 1 UNION ALL SELECT o.chr, o.strand, o.island, o.p, o.k, CASE WHEN f.p - f.s > 3000 THEN o.p ELSE f.s END, f.part + CASE WHEN f.p - f.s > 3000 THEN 1 ELSE 0 END FROM f JOIN o ON o.chr = f.chr AND o.strand = f.strand AND o.island = f.island AND o.k = f.k + 1) SELECT j.chr, j.strand, j.island, f.part, count(*) AS n, min(j.p) AS low, max(j.p) AS high FROM j JOIN f ON f.chr = j.chr AND f.strand = j.strand AND f.island = j.island AND f.p = j.p GROUP BY ALL HAVING count(*) >= 2")
def w1_capped(spark, d):
    marked = cluster.capped_islands(discordant(spark, d), ["chr", "strand"], "p", TIE)
    return marked.groupBy("chr", "strand", "island", "part").agg(F.count("*").alias("n"), F.min("p").alias("low"), F.max("p").alias("high")).where("n >= 2")


@query("w2_mate_islands", f"WITH {ISLAND}, m AS (SELECT *, CASE WHEN mate_pos - lag(mate_pos) OVER x <= 150000 THEN 0 ELSE 1 END AS t FROM j WINDOW x AS (PARTITION BY chr, strand, island, mate_strand ORDER BY mate_pos, qname, mate)), q AS (SELECT *, sum(t) OVER (PARTITION BY chr, strand, island, mate_strand ORDER BY mate_pos, qname, mate ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS mi FROM m) SELECT chr, strand, island, mate_strand, CAST(mi AS BIGINT) AS mate_island, count(*) AS n FROM q GROUP BY ALL HAVING count(*) >= 2")
def w2(spark, d):
    marked = cluster.islands(discordant(spark, d), ["chr", "strand"], "p", TIE)
    split = cluster.second_level(marked, ["chr", "strand"], 150000)
    return split.groupBy("chr", "strand", "island", "mate_strand", "mate_island").agg(F.count("*").alias("n")).where("n >= 2")


@query("a11_cluster_summary", f"WITH {ISLAND} SELECT chr, strand, island, count(*) AS n, CAST(sum(CASE WHEN sample LIKE 't%' THEN 1 ELSE 0 END) AS BIGINT) AS tcount, CAST(sum(CASE WHEN sample LIKE 'n%' THEN 1 ELSE 0 END) AS BIGINT) AS ncount, min(pos) AS start1, max(pos) + 151 AS end1, min(mate_pos) AS start2, max(mate_pos) + 151 AS end2, CAST(floor(avg(mapq)) AS INT) AS mapq, round(avg(nm), 6) AS nm FROM j GROUP BY chr, strand, island HAVING count(*) >= 2")
def a11(spark, d):
    return cluster.summarize(cluster.islands(discordant(spark, d), ["chr", "strand"], "p", TIE), ["chr", "strand", "island"])


CLUSTERS = "SELECT bp_num AS c_id, chr1 AS c_chr1, pos1 AS c_start1, pos1 + bp_num % 60 AS c_end1, strand1 AS c_strand1, chr2 AS c_chr2, pos2 AS c_start2, pos2 + bp_num % 40 AS c_end2, strand2 AS c_strand2, maxlod AS c_tcount, somlod AS c_ncount FROM v_bps WHERE conf = 'LOWLOD'"


def clusters(spark, d):
    return view(spark, d, "v_bps").where("conf = 'LOWLOD'").selectExpr("bp_num AS c_id", "chr1 AS c_chr1", "pos1 AS c_start1", "pos1 + bp_num % 60 AS c_end1", "strand1 AS c_strand1", "chr2 AS c_chr2", "pos2 AS c_start2", "pos2 + bp_num % 40 AS c_end2", "strand2 AS c_strand2", "maxlod AS c_tcount", "somlod AS c_ncount")


@query("j4_best_cluster", f"WITH k AS ({CLUSTERS}) SELECT bp_num, arg_min(c_id, (-c_ncount, -c_tcount, c_id)) AS cluster FROM v_bps b JOIN k ON b.chr1 = c_chr1 AND b.chr2 = c_chr2 AND b.strand1 = c_strand1 AND b.strand2 = c_strand2 AND pos1 - 100 <= c_end1 AND c_start1 <= pos1 + 100 AND pos2 - 100 <= c_end2 AND c_start2 <= pos2 + 100 GROUP BY bp_num")
def j4(spark, d):
    return cluster.best_cluster(view(spark, d, "v_bps"), clusters(spark, d))


@query("j7_competing_clusters", f"WITH k AS ({CLUSTERS}) SELECT DISTINCT a.c_id FROM k a JOIN k b ON a.c_chr1 = b.c_chr1 AND a.c_chr2 = b.c_chr2 AND a.c_start1 - 100 <= b.c_end1 AND b.c_start1 <= a.c_end1 + 100 AND a.c_start2 - 100 <= b.c_end2 AND b.c_start2 <= a.c_end2 + 100 AND (a.c_strand1 <> b.c_strand1 OR a.c_strand2 <> b.c_strand2) WHERE a.c_chr1 <> a.c_chr2")
def j7(spark, d):
    return cluster.competing(clusters(spark, d))


@query("j6_mate_pickup", "SELECT DISTINCT a.qname, a.mate, b.mate AS other FROM v_reads a JOIN v_reads b ON a.qname = b.qname AND a.mate <> b.mate AND a.mate_chr = b.chr AND abs(b.pos - a.mate_pos) <= 1150")
def j6(spark, d):
    return cluster.pick_up_mates(view(spark, d, "v_reads"))


@query("j8_indel_cigar_counts", "SELECT bp_num, CAST(sum(CASE WHEN r.pos = b.pos1 * 2000 AND r.nm = b.bp_num % 8 THEN 1 ELSE 0 END) AS BIGINT) AS exact, CAST(sum(CASE WHEN r.pos = b.pos1 * 2000 AND r.nm = b.bp_num % 8 THEN 0 ELSE 1 END) AS BIGINT) AS near FROM v_bps b JOIN v_reads r ON r.chr = b.chr1 AND abs(r.pos - b.pos1 * 2000) <= 4 AND r.nm BETWEEN 1 AND b.bp_num % 8 + 4 GROUP BY bp_num")
def j8(spark, d):
    b = view(spark, d, "v_bps").select("bp_num", "chr1", (c("pos1") * 2000).alias("bp_pos"), (c("bp_num") % 8).alias("span"))
    met = iv.overlap_join(b, view(spark, d, "v_reads").select("chr", "pos", "nm"), [("chr1", "chr")], (c("bp_pos") - 4, c("bp_pos") + 4), (c("pos"), c("pos")), 2048).where("nm BETWEEN 1 AND span + 4")
    exact = (c("pos") == c("bp_pos")) & (c("nm") == c("span"))
    return met.groupBy("bp_num").agg(F.count_if(exact).alias("exact"), F.count_if(~exact).alias("near"))


@query("j9_indel_veto", "SELECT bp_num FROM v_bps a WHERE somlod >= 1 AND EXISTS (SELECT 1 FROM v_bps g WHERE g.conf = 'PASS' AND g.somlod < 1 AND g.chr1 = a.chr1 AND g.strand1 = a.strand1 AND abs(g.pos1 - a.pos1) <= 2)")
def j9(spark, d):
    around = F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1)))
    bps = view(spark, d, "v_bps")
    som = bps.where("somlod >= 1").select("bp_num", "chr1", "strand1", "pos1", around.alias("o"))
    germ = bps.where("conf = 'PASS' AND somlod < 1").select(c("chr1").alias("g1"), c("strand1").alias("g2"), c("pos1").alias("g3"), around.alias("o")).select("g1", "g2", (c("g3") + c("o")).alias("g3")).distinct()
    return som.join(germ, (c("chr1") == c("g1")) & (c("strand1") == c("g2")) & (c("pos1") + c("o") == c("g3")), "left_semi").select("bp_num").distinct()


@query("j13_dbsnp_overlap", "SELECT bp_num FROM v_bps b WHERE EXISTS (SELECT 1 FROM v_regions g WHERE g.chr = b.chr1 AND b.pos1 * 2000 - 2 <= g.start_pos + 1 AND g.start_pos <= b.pos1 * 2000 + 2)")
def j13(spark, d):
    b = view(spark, d, "v_bps").select("bp_num", "chr1", (c("pos1") * 2000).alias("p"))
    g = view(spark, d, "v_regions").select(c("chr").alias("g_chr"), c("start_pos").alias("s"))
    return iv.overlap_semi(b, g, [("chr1", "g_chr")], (c("p") - 2, c("p") + 2), (c("s"), c("s") + 1)).select("bp_num")


@query("j20_standard_alternative", "WITH a AS (SELECT l_orderkey AS cname, l_linenumber AS ln, l_suppkey % 30 AS chr, CAST(floor(l_quantity) AS INT) + 100 AS score, l_partkey % 20 AS s, l_partkey % 20 + 80 AS e FROM lineitem) SELECT p.cname, p.ln, arg_max(q.ln, (q.score, -q.ln)) AS alt FROM a p JOIN a q ON p.cname = q.cname AND p.ln <> q.ln AND p.chr > 23 AND q.chr <= 23 AND q.score >= CAST(trunc(p.score * 0.95::double) AS INT) AND (least(p.e, q.e) - greatest(p.s, q.s)) / greatest(p.e - p.s, q.e - q.s)::double >= 0.8 GROUP BY p.cname, p.ln")
def j20(spark, d):
    a = table(spark, d, "lineitem").selectExpr("l_orderkey AS cname", "l_linenumber AS ln", "l_suppkey % 30 AS chr", "CAST(floor(l_quantity) AS INT) + 100 AS score", "l_partkey % 20 AS s", "l_partkey % 20 + 80 AS e")
    q = a.where("chr <= 23").select(c("cname").alias("qc"), c("ln").alias("qln"), c("score").alias("qs"), c("s").alias("q1"), c("e").alias("q2"))
    met = a.where("chr > 23").join(q, (c("cname") == c("qc")) & (c("ln") != c("qln")) & (c("qs") >= (c("score") * 0.95).cast("int")))
    met = met.where(sq.reciprocal_overlap(c("s"), c("e"), c("q1"), c("q2")) >= 0.8)
    return met.groupBy("cname", "ln").agg(F.max_by("qln", F.struct(c("qs"), -c("qln"))).alias("alt"))


@query("a12_split_support", "WITH f AS (SELECT l_partkey AS bp, l_orderkey AS q, arg_min(l_returnflag, l_linenumber) AS s FROM (SELECT DISTINCT l_partkey, l_orderkey, l_linenumber, min(l_returnflag) OVER (PARTITION BY l_partkey, l_orderkey, l_linenumber) AS l_returnflag FROM lineitem) GROUP BY 1, 2) SELECT bp, s AS sample, count(*) AS split FROM f GROUP BY bp, s")
def a12(spark, d):
    from fragmenta.operators.support import split_support

    hits = table(spark, d, "lineitem").select(c("l_partkey").alias("bp"), c("l_orderkey").alias("qname"), c("l_linenumber").alias("mate"), c("l_returnflag").alias("sample"))
    return split_support(hits, order=["mate", "sample"])


@query("a13_alt_count", "SELECT l_partkey AS bp, CAST(greatest(count(DISTINCT l_orderkey), max(l_linenumber) * 4) AS BIGINT) AS alt FROM lineitem GROUP BY l_partkey")
def a13(spark, d):
    from fragmenta.operators.support import alt_count

    g = table(spark, d, "lineitem").groupBy(c("l_partkey").alias("bp")).agg(F.count_distinct("l_orderkey").alias("f"), (F.max("l_linenumber") * 4).cast("long").alias("g"))
    return g.select("bp", alt_count(c("f"), c("g")).alias("alt"))


@query("w3_cluster_ids", "SELECT (CASE WHEN strand1 = '+' THEN 'F' ELSE 'R' END) || (CASE WHEN strand2 = '+' THEN 'F' ELSE 'R' END) || '_' || chr1 || '_' || pos1 || '___' || chr2 || '_' || pos2 AS id, max(bp_num) AS last FROM v_bps GROUP BY 1")
def w3(spark, d):
    letter = lambda s: F.when(c(s) == "+", "F").otherwise("R")
    ident = cluster.cluster_id(F.concat(letter("strand1"), letter("strand2")), c("chr1"), c("pos1"), c("chr2"), c("pos2"))
    return view(spark, d, "v_bps").groupBy(ident.alias("id")).agg(F.max("bp_num").alias("last"))


@query("w4_adjacent_fragments", "WITH f AS (SELECT l_orderkey AS cname, l_linenumber AS ord, l_suppkey % 24 AS chr, CAST(floor(l_quantity) AS INT) + 15 AS mapq FROM lineitem), d AS (SELECT cname, ord, min(chr) AS chr, max(mapq) AS mapq FROM f GROUP BY cname, ord), l AS (SELECT cname, ord, lead(ord) OVER (PARTITION BY cname ORDER BY ord) AS nxt, 'local' AS kind FROM d), s AS (SELECT cname, count(*) AS n, coalesce(min(CASE WHEN mapq >= 50 THEN ord END), min(ord)) AS a, coalesce(max(CASE WHEN mapq >= 50 THEN ord END), max(ord)) AS b FROM d GROUP BY cname) SELECT cname, ord AS a, nxt AS b, kind FROM l WHERE nxt IS NOT NULL UNION ALL SELECT cname, a, b, 'global' FROM s WHERE n >= 3 AND b - a > 1")
def w4(spark, d):
    frags = table(spark, d, "lineitem").groupBy(c("l_orderkey").alias("cname"), c("l_linenumber").alias("ord")).agg(F.max(F.floor("l_quantity") + 15).alias("mapq"))
    local = frags.selectExpr("cname", "ord AS a", "lead(ord) OVER (PARTITION BY cname ORDER BY ord) AS b", "'local' AS kind").where("b IS NOT NULL")
    good = F.when(c("mapq") >= 50, c("ord"))
    ends = frags.groupBy("cname").agg(F.count("*").alias("n"), F.coalesce(F.min(good), F.min("ord")).alias("a"), F.coalesce(F.max(good), F.max("ord")).alias("b"))
    return local.unionByName(ends.where("n >= 3 AND b - a > 1").select("cname", "a", "b", F.lit("global").alias("kind")))


TEXT = "concat_ws(chr(9), 'chr' || chr1, pos1 + 1, strand1, 'chr' || chr2, pos2 + 1, strand2, 'N', 'N')"


@query("snk2_cluster_lines", "SELECT concat_ws(chr(9), chr1, pos1, strand1, chr2, pos2, strand2, maxlod, somlod, 60, 60, '0', '0', 'x', bp_num) AS value FROM v_bps WHERE maxlod > 0")
def snk2(spark, d):
    names = ["chr1", "pos1", "strand1", "chr2", "pos2", "strand2", "maxlod", "somlod"]
    cells = [*(c(x).cast("string") for x in names), F.lit("60"), F.lit("60"), F.lit("0"), F.lit("0"), F.lit("x"), c("bp_num").cast("string")]
    return view(spark, d, "v_bps").where("maxlod > 0").select(F.concat_ws("\t", *cells).alias("value"))


@query("src7_snk1_round_trip", "SELECT 'chr' || chr1 AS chr1, CAST(pos1 + 1 AS INT) AS pos1, conf, CASE WHEN chr1 = chr2 THEN CAST(abs(pos2 - pos1) AS INT) END AS span, CASE WHEN bp_num % 9 = 0 THEN NULL ELSE least(99, somlod * 4)::double END AS somlod, 'bp' || bp_num AS bp_id, 4 AS version FROM v_bps")
def src7(spark, d):
    """Calls written as text lines and parsed again."""
    made = view(spark, d, "v_bps").select(
        F.concat(F.lit("chr"), c("chr1").cast("string")).alias("chr1"), (c("pos1") + 1).cast("int").alias("pos1"), F.when(c("chr1") == c("chr2"), F.abs(c("pos2") - c("pos1")).cast("int")).alias("span"),
        F.when(c("bp_num") % 9 != 0, (c("somlod") * 4).cast("double")).alias("somlod"), "conf", F.concat(F.lit("bp"), c("bp_num").cast("string")).alias("bp_id"), F.lit("ACGT").alias("jxn_kmer"),
    )
    whole = made.select(*(c(n) if n in made.columns else F.lit(None).cast(bps_source.type_of(n)).alias(n) for n in bps_source.CORE))
    return bps_source.parse(bps_source.lines(whole)).select("chr1", "pos1", "conf", "span", "somlod", "bp_id", "version")


KIND = "CASE WHEN strand1 = strand2 THEN 'DEL' WHEN strand1 = '-' THEN 'DUP' ELSE 'INV' END"
SOMATIC = "CASE WHEN somlod >= 1 THEN ';SOMATIC' ELSE '' END"
QUAL = "CAST(CAST(least(99, round(10 * greatest(0, maxlod::double))) AS INT) AS VARCHAR)"
BND = """SELECT chr{0} AS chrom, pos{0} AS pos, bp_num || ':{0}' AS id, CASE WHEN strand{0} = '+' THEN 'N' || {2} ELSE {2} || 'N' END AS alt, {3} AS qual, 'EVENT=' || bp_num || ';MATEID=' || bp_num || ':{1};MAXLOD=' || printf('%.4g', maxlod::double) || {4} || ';SPAN=' || CASE WHEN chr1 = chr2 THEN abs(pos2 - pos1) ELSE -1 END || ';SVTYPE=BND' AS info FROM p"""
PLACE = "(CASE WHEN strand{0} = '+' THEN ']' ELSE '[' END || chr{0} || ':' || pos{0} || CASE WHEN strand{0} = '+' THEN ']' ELSE '[' END)"
RECORDS = CANON.rstrip() + f""", p AS (SELECT * FROM r WHERE rn = 1 AND conf = 'PASS'), s AS (SELECT *, {KIND} AS kind, least(pos1, pos2) AS low, greatest(pos1, pos2) AS high FROM p WHERE chr1 = chr2)
{BND.format(1, 2, PLACE.format(2), QUAL, SOMATIC)} UNION ALL {BND.format(2, 1, PLACE.format(1), QUAL, SOMATIC)}
UNION ALL SELECT chr1, low, CAST(bp_num AS VARCHAR), '<' || kind || '>', {QUAL}, 'END=' || high || {SOMATIC} || ';SVCLAIM=' || CASE WHEN kind = 'INV' THEN 'J' ELSE 'DJ' END || ';SVLEN=' || CASE WHEN kind = 'DEL' THEN low - high ELSE high - low END || ';SVTYPE=' || kind FROM s"""


@query("snk6_vcf_records", RECORDS)
def snk6(spark, d):
    """The text of all records of the deduplicated PASS calls: breakend pairs, and symbolic ones within a chromosome."""
    calls = dedup.canonical_pairs(view(spark, d, "v_bps")).where("conf = 'PASS'")
    ends, symbolic = commands.breakend_records(calls), commands.symbolic_records(calls.where("chr1 = chr2"))
    return ends.unionByName(symbolic).select("chrom", "pos", "id", "alt", "qual", "info")
