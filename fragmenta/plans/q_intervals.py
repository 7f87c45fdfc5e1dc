"""Queries on intervals: J1-J3, J5, J8-J10, J15-J19, F1, F13, A6, A7, A9, A10, A19, SRC2-SRC5, D8."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmenta.operators import intervals as iv
from fragmenta.plans.core import query
from fragmenta.plans.fixtures import view

c = F.col
SEMI = "EXISTS (SELECT 1 FROM v_regions g WHERE g.chr = r.chr AND r.pos <= g.end_pos AND r.pos + 150 >= g.start_pos)"


def reads(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "v_reads")


def regions(spark: SparkSession, d: str, prefix: str = "g_") -> DataFrame:
    df = view(spark, d, "v_regions")
    return df.select(*(c(x).alias(f"{prefix}{x}") for x in df.columns))


def near(prefix: str = "g_") -> tuple:
    return c(f"{prefix}start_pos"), c(f"{prefix}end_pos")


@query("j1_interval_semi", f"SELECT qname, mate FROM v_reads r WHERE {SEMI}")
def j1(spark, d):
    return iv.overlap_semi(reads(spark, d), regions(spark, d), [("chr", "g_chr")], (c("pos"), c("pos") + 150), near()).select("qname", "mate")


@query("j1_breakend_blacklist", "SELECT bp_num FROM v_bps b WHERE EXISTS (SELECT 1 FROM v_regions g WHERE (g.chr = b.chr1 AND b.pos1 * 2000 BETWEEN g.start_pos AND g.end_pos) OR (g.chr = b.chr2 AND b.pos2 * 2000 BETWEEN g.start_pos AND g.end_pos))")
def j1_either_end(spark, d):
    bps = view(spark, d, "v_bps").select("bp_num", "chr1", "chr2", (c("pos1") * 2000).alias("p1"), (c("pos2") * 2000).alias("p2"))
    for k in "12":
        bps = iv.with_overlap(bps, regions(spark, d), [(f"chr{k}", "g_chr")], (c(f"p{k}"), c(f"p{k}")), near(), f"in{k}")
    return bps.where("in1 OR in2").select("bp_num")


@query("j2_paired_range_semi", "SELECT bp_num FROM v_bps b WHERE EXISTS (SELECT 1 FROM v_bps k WHERE k.conf = 'LOWLOD' AND k.bp_num <> b.bp_num AND k.chr1 = b.chr1 AND k.chr2 = b.chr2 AND abs(k.pos1 - b.pos1) <= 10 AND abs(k.pos2 - b.pos2) <= 10)")
def j2(spark, d):
    bps = view(spark, d, "v_bps")
    known = bps.where("conf = 'LOWLOD'").select(*(c(x).alias(f"k_{x}") for x in ("bp_num", "chr1", "pos1", "chr2", "pos2")))
    met = iv.overlap_join(bps, known, [("chr1", "k_chr1"), ("chr2", "k_chr2")], (c("pos1") - 10, c("pos1") + 10), (c("k_pos1"), c("k_pos1")), 32)
    return met.where((F.abs(c("k_pos2") - c("pos2")) <= 10) & (c("k_bp_num") != c("bp_num"))).select("bp_num").distinct()


@query("j3_interval_anti", f"SELECT qname, mate FROM v_reads r WHERE substr(sample, 1, 1) = 't' AND NOT {SEMI}")
def j3(spark, d):
    return iv.overlap_semi(reads(spark, d).where("substr(sample, 1, 1) = 't'"), regions(spark, d), [("chr", "g_chr")], (c("pos"), c("pos") + 150), near(), anti=True).select("qname", "mate")


WINDOWS = "SELECT chr, w * 25000 AS win_start, w * 25000 + 24999 AS win_end FROM (SELECT unnest(range(0, 24)) AS chr), (SELECT unnest(range(0, 40)) AS w)"


def windows(spark: SparkSession) -> DataFrame:
    return spark.range(24).select(c("id").alias("chr"), F.explode(F.sequence(F.lit(0), F.lit(39))).alias("w")).select("chr", (c("w") * 25000).cast("long").alias("win_start"), (c("w") * 25000 + 24999).cast("long").alias("win_end"))


@query("j5_overlap_width", f"WITH w AS ({WINDOWS}) SELECT w.chr, win_start, CAST(sum(least(win_end, end_pos) - greatest(win_start, start_pos) + 1) AS BIGINT) AS covered FROM w JOIN v_regions g ON g.chr = w.chr AND win_start <= end_pos AND start_pos <= win_end GROUP BY w.chr, win_start")
def j5(spark, d):
    met = iv.overlap_join(windows(spark), regions(spark, d), [("chr", "g_chr")], (c("win_start"), c("win_end")), near(), 25000)
    return met.groupBy("chr", "win_start").agg(F.sum(F.least("win_end", "g_end_pos") - F.greatest("win_start", "g_start_pos") + 1).alias("covered"))


@query("f13_blacklisted_windows", "WITH w AS (SELECT chr, w * 500 AS s, w * 500 + 499 AS e FROM (SELECT unnest(range(0, 24)) AS chr), (SELECT unnest(range(0, 2000)) AS w)), m AS (SELECT chr, start_pos, end_pos, sum(n) OVER (PARTITION BY chr ORDER BY start_pos, end_pos, region_id) AS i FROM (SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY chr ORDER BY start_pos, end_pos, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS n FROM v_regions)), g AS (SELECT chr, min(start_pos) AS a, max(end_pos) AS b FROM m GROUP BY chr, i) SELECT w.chr, s AS win_start FROM w JOIN g ON g.chr = w.chr AND s <= b AND a <= e GROUP BY w.chr, s, e HAVING sum(least(e, b) - greatest(s, a) + 1) >= e - s + 1")
def f13(spark, d):
    w = spark.range(24).select(c("id").alias("chr"), F.explode(F.sequence(F.lit(0), F.lit(1999))).alias("w")).select("chr", (c("w") * 500).cast("long").alias("win_start"))
    merged = iv.merge_intervals(view(spark, d, "v_regions"), ["chr"], "start_pos", "end_pos").select(c("chr").alias("g_chr"), c("start_pos").alias("g_start_pos"), c("end_pos").alias("g_end_pos"))
    met = iv.overlap_join(w, merged, [("chr", "g_chr")], (c("win_start"), c("win_start") + 499), near(), 500)
    covered = F.sum(F.least(c("win_start") + 499, c("g_end_pos")) - F.greatest("win_start", "g_start_pos") + 1)
    return met.groupBy("chr", "win_start").agg(covered.alias("n")).where("n >= 500").select("chr", "win_start")


@query("a9_merge_intervals", "WITH x AS (SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY chr ORDER BY start_pos, end_pos, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 50 THEN 0 ELSE 1 END AS nw FROM v_regions), y AS (SELECT *, sum(nw) OVER (PARTITION BY chr ORDER BY start_pos, end_pos, region_id) AS i FROM x) SELECT chr, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM y GROUP BY chr, i")
def a9(spark, d):
    return iv.merge_intervals(view(spark, d, "v_regions"), ["chr"], "start_pos", "end_pos", 50, "label")


@query("src3_blacklist_union", "WITH u AS (SELECT chr, start_pos, end_pos FROM v_regions UNION ALL SELECT chr, start_pos + 100, end_pos + 300 FROM v_regions), x AS (SELECT *, CASE WHEN start_pos <= max(end_pos) OVER (PARTITION BY chr ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS nw FROM u), y AS (SELECT *, sum(nw) OVER (PARTITION BY chr ORDER BY start_pos, end_pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS i FROM x) SELECT chr, min(start_pos) AS start_pos, max(end_pos) AS end_pos, count(*) AS n FROM y GROUP BY chr, i")
def src3(spark, d):
    a = view(spark, d, "v_regions").select("chr", "start_pos", "end_pos")
    b = a.select("chr", (c("start_pos") + 100).alias("start_pos"), (c("end_pos") + 300).alias("end_pos"))
    return iv.merge_intervals(a.unionByName(b), ["chr"], "start_pos", "end_pos")


@query("src5_window_tiling", "SELECT region_id, s AS win_start, least(s + 200, end_pos) AS win_end FROM (SELECT region_id, end_pos, unnest(range(start_pos, greatest(start_pos, end_pos - 1) + 1, 150)) AS s FROM v_regions)")
def src5(spark, d):
    return iv.tile(view(spark, d, "v_regions"), "start_pos", "end_pos", 200, 50).select("region_id", "win_start", "win_end")


@query("a6_depth_runs", "WITH e AS (SELECT chr, pos + 5 AS p, 1 AS d FROM v_reads UNION ALL SELECT chr, pos + 146, -1 FROM v_reads), g AS (SELECT chr, p, sum(d) AS d FROM e GROUP BY chr, p), s AS (SELECT chr, p AS run_start, CAST(sum(d) OVER (PARTITION BY chr ORDER BY p) AS BIGINT) AS depth, lead(p) OVER (PARTITION BY chr ORDER BY p) - 1 AS run_end FROM g) SELECT * FROM s WHERE depth > 0")
def a6(spark, d):
    return iv.depth(reads(spark, d), ["chr"], c("pos") + 5, c("pos") + 145)


@query("a7_breakpoint_coverage", "WITH b AS (SELECT bp_num, chr1 AS chr, pos1 * 2000 AS p1, pos2 * 2000 AS p2 FROM v_bps WHERE chr1 = chr2), e AS (SELECT bp_num, chr, unnest([p1, p2]) AS p FROM b) SELECT bp_num, CAST(sum(least(p + 10, pos + 145) - greatest(p - 10, pos + 5) + 1) AS BIGINT) // 2 // 21 AS coverage FROM e JOIN v_reads r ON r.chr = e.chr AND pos + 5 <= p + 10 AND p - 10 <= pos + 145 GROUP BY bp_num")
def a7(spark, d):
    ends = view(spark, d, "v_bps").where("chr1 = chr2").select("bp_num", c("chr1").alias("b_chr"), F.explode(F.array(c("pos1") * 2000, c("pos2") * 2000)).alias("p"))
    met = iv.overlap_join(reads(spark, d).select("chr", "pos"), ends, [("chr", "b_chr")], (c("pos") + 5, c("pos") + 145), (c("p") - 10, c("p") + 10), 256)
    return met.groupBy("bp_num").agg(F.expr("sum(least(p + 10, pos + 145) - greatest(p - 10, pos + 5) + 1) div 2 div 21").alias("coverage"))


@query("a10_mate_region_support", "SELECT region_id, count(*) AS n FROM v_regions g JOIN v_reads r ON r.mate_chr = g.chr AND r.mate_pos BETWEEN start_pos AND end_pos WHERE mapq >= 10 GROUP BY region_id HAVING count(*) >= 2")
def a10(spark, d):
    mates = reads(spark, d).where("mapq >= 10").select("mate_chr", "mate_pos")
    met = iv.points_within(mates, regions(spark, d), [("mate_chr", "g_chr")], c("mate_pos"), near(), "g_region_id")
    return met.select(c("g_region_id").alias("region_id"), "n").where("n >= 2")


@query("j10_position_coverage", "SELECT region_id, count(*) AS reads, CAST(max(mapq) AS INT) AS top FROM v_regions g JOIN v_reads r ON r.chr = g.chr AND r.pos = g.start_pos GROUP BY region_id")
def j10(spark, d):
    g = regions(spark, d)
    met = g.join(reads(spark, d), (c("chr") == c("g_chr")) & (c("pos") == c("g_start_pos")))
    return met.groupBy(c("g_region_id").alias("region_id")).agg(F.count("*").alias("reads"), F.max("mapq").alias("top"))


BINNED = "SELECT chr, pos // 1000 AS bin, count(*) AS all_reads, CAST(sum(CASE WHEN mapq >= 20 THEN 1 ELSE 0 END) AS BIGINT) AS good FROM v_reads GROUP BY chr, pos // 1000"


@query("j15_paste_join", "WITH a AS (SELECT chr, pos // 1000 AS bin, count(*) AS n FROM v_reads GROUP BY 1, 2), b AS (SELECT chr, pos // 1000 AS bin, count(*) AS n FROM v_reads WHERE mapq >= 20 GROUP BY 1, 2) SELECT a.chr, a.bin, a.n AS depth, coalesce(b.n, 0) AS good_depth, round(coalesce(b.n, 0)::double / a.n, 6) AS ratio FROM a LEFT JOIN b ON a.chr = b.chr AND a.bin = b.bin")
def j15(spark, d):
    all_ = reads(spark, d).groupBy("chr", F.expr("pos div 1000").alias("bin")).agg(F.count("*").alias("depth"))
    good = reads(spark, d).where("mapq >= 20").groupBy("chr", F.expr("pos div 1000").alias("bin")).agg(F.count("*").alias("good_depth"))
    return iv.paste(all_, good, ["chr", "bin"]).select("chr", "bin", "depth", F.coalesce("good_depth", F.lit(0)).alias("good_depth")).withColumn("ratio", F.round(c("good_depth") / c("depth"), 6))


@query("a19_low_quality_blacklist", f"WITH b AS ({BINNED}), f AS (SELECT chr, bin * 1000 AS s, bin * 1000 + 1000 AS e FROM b WHERE good::double / all_reads <= 0.5), x AS (SELECT *, CASE WHEN s <= max(e) OVER (PARTITION BY chr ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1000 THEN 0 ELSE 1 END AS nw FROM f), y AS (SELECT *, sum(nw) OVER (PARTITION BY chr ORDER BY s) AS i FROM x), m AS (SELECT chr, min(s) AS s, max(e) AS e, count(*) AS n FROM y GROUP BY chr, i) SELECT chr, s, e, n, e - s AS width FROM m ORDER BY e - s DESC, chr, s LIMIT 20")
def a19(spark, d):
    binned = reads(spark, d).groupBy("chr", F.expr("pos div 1000").alias("bin")).agg(F.count("*").alias("a"), F.sum(F.when(c("mapq") >= 20, 1).otherwise(0)).alias("g"))
    flagged = binned.where(c("g") / c("a") <= 0.5).select("chr", (c("bin") * 1000).alias("s"), (c("bin") * 1000 + 1000).alias("e"))
    merged = iv.merge_intervals(flagged, ["chr"], "s", "e", 1000).withColumn("width", c("e") - c("s"))
    return merged.orderBy(c("width").desc(), "chr", "s").limit(20)


@query("j16_interval_intersect", "SELECT a.region_id AS id_a, b.region_id AS id_b, a.chr, greatest(a.start_pos, b.start_pos) AS s, least(a.end_pos, b.end_pos) AS e FROM v_regions a JOIN (SELECT region_id, chr, start_pos + 200 AS start_pos, end_pos + 900 AS end_pos FROM v_regions) b ON a.chr = b.chr AND a.start_pos <= b.end_pos AND b.start_pos <= a.end_pos")
def j16(spark, d):
    other = regions(spark, d, "b_").withColumn("b_start_pos", c("b_start_pos") + 200).withColumn("b_end_pos", c("b_end_pos") + 900)
    parts = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    met = iv.overlap_join(regions(spark, d, "a_"), other, [("a_chr", "b_chr")], near("a_"), near("b_"), 1024, parts)
    return met.select(c("a_region_id").alias("id_a"), c("b_region_id").alias("id_b"), c("a_chr").alias("chr"), F.greatest("a_start_pos", "b_start_pos").alias("s"), F.least("a_end_pos", "b_end_pos").alias("e"))


@query("j17_clip_to_length", "WITH l AS (SELECT unnest(range(0, 20)) AS k), n AS (SELECT k AS chrom, 500000 + k * 10000 AS length FROM l) SELECT region_id, chr, start_pos, CASE WHEN length IS NULL THEN end_pos ELSE least(end_pos, length) END AS end_pos FROM v_regions LEFT JOIN n ON chr = chrom WHERE length IS NULL OR start_pos < length")
def j17(spark, d):
    lengths = spark.range(20).select(c("id").alias("chrom"), (c("id") * 10000 + 500000).alias("length"))
    return iv.clip(view(spark, d, "v_regions"), lengths, "chr", "start_pos", "end_pos").select("region_id", "chr", "start_pos", "end_pos")


@query("j18_first_overlap_rate", "SELECT qname, mate, arg_min(region_id, (start_pos, region_id)) AS region_id FROM v_reads r JOIN v_regions g ON r.chr = g.chr AND r.pos BETWEEN start_pos AND end_pos GROUP BY qname, mate")
def j18(spark, d):
    met = iv.first_overlap(reads(spark, d).select("qname", "mate", "chr", "pos"), regions(spark, d), [("chr", "g_chr")], c("pos"), near(), "g_region_id")
    return met.groupBy("qname", "mate").agg(F.min_by("g_region_id", F.struct("g_start_pos", "g_region_id")).alias("region_id"))


@query("j19_annotate_labels", "SELECT bp_num, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM v_bps b JOIN v_regions g ON g.chr = b.chr1 AND b.pos1 * 2000 BETWEEN start_pos AND end_pos GROUP BY bp_num")
def j19(spark, d):
    bps = view(spark, d, "v_bps").select("bp_num", "chr1", (c("pos1") * 2000).alias("p"))
    met = iv.overlap_join(bps, regions(spark, d), [("chr1", "g_chr")], (c("p"), c("p")), near())
    return met.groupBy("bp_num").agg(F.array_join(F.array_sort(F.collect_set("g_label")), ",").alias("labels"))


@query("d8_labelled_union", "SELECT chr, source, count(*) AS n, CAST(sum(end_pos - start_pos) AS BIGINT) AS width FROM (SELECT chr, start_pos, end_pos, 'parts' AS source FROM v_regions UNION ALL SELECT chr, start_pos, end_pos + 10, 'slop' FROM v_regions) GROUP BY chr, source")
def d8(spark, d):
    a = view(spark, d, "v_regions").select("region_id", "chr", "start_pos", "end_pos")
    both = a.withColumn("source", F.lit("parts")).unionByName(a.withColumn("end_pos", c("end_pos") + 10).withColumn("source", F.lit("slop")))
    return both.groupBy("chr", "source").agg(F.count("*").alias("n"), F.sum(c("end_pos") - c("start_pos")).alias("width"))


@query("w9_interval_gaps", "SELECT region_id, start_pos - lag(end_pos) OVER (PARTITION BY chr ORDER BY start_pos, region_id) AS gap FROM v_regions")
def w9(spark, d):
    met = iv.previous(view(spark, d, "v_regions"), ["chr"], ["start_pos", "region_id"], "end_pos", "before")
    return met.select("region_id", (c("start_pos") - c("before")).alias("gap"))
